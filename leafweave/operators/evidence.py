"""Evidence: blocks aligned with layout in three steps, table bodies given to captions, candidates with all their channels, integrity of a graph."""

from __future__ import annotations

import itertools
import json
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafweave.functions import geometry as g
from leafweave.functions.groups import by_whole_groups
from leafweave.operators import layout, retrieval, spatial


def align_blocks(blocks: DataFrame, regions: DataFrame, width: float, height: float) -> DataFrame:
    """Every block (page, block_id, box) with its box: that of the best text region, else of the best visual container, else its own unverified, else none.

    regions: page, region_id, box, text_like, container. Returns page, block_id, bbox_source, granularity, region_id, score, box, and relation, set where a container shows the text.
    """
    usable = blocks.where(F.col("box").isNotNull() & g.valid_for_matching(F.col("box"), F.lit(width), F.lit(height)))
    text = spatial.match_regions(usable, regions.where("text_like")).select("page", "block_id", F.col("region_id").alias("tr"), F.col("score").alias("ts"))
    left = usable.join(text, ["page", "block_id"], "left_anti")
    held = layout.match_containers(left, regions.where("container"), width, height).select("page", "block_id", F.col("region_id").alias("cr"), F.col("score").alias("cs"))
    own = usable.select("page", "block_id", F.lit(True).alias("fine"))
    j = blocks.join(text, ["page", "block_id"], "left").join(held, ["page", "block_id"], "left").join(own, ["page", "block_id"], "left")
    j = j.withColumn("region_id", F.coalesce("tr", "cr")).join(regions.select("page", "region_id", F.col("box").alias("rb")), ["page", "region_id"], "left")
    pick = lambda a, b, c, d: F.when(F.col("tr").isNotNull(), a).when(F.col("cr").isNotNull(), b).when(F.col("fine"), c).otherwise(d)
    return j.select(
        "page", "block_id", pick("pp_doclayout", "pp_doclayout_container", "deepseekocr2_unverified", "missing").alias("bbox_source"), pick("layout_text_region", "visual_container", "deepseek_text_bbox", "none").alias("granularity"), "region_id",
        g.rounded(F.coalesce("ts", "cs"), 4).alias("score"), F.when(F.col("region_id").isNotNull(), F.col("rb")).when(F.col("fine"), F.col("box")).alias("box"), F.when(F.col("tr").isNull() & F.col("cr").isNotNull(), "contains_visible_text").alias("relation"),
    )


def claim_bodies(captions: list[tuple], bodies: list[tuple], reach: int = 2) -> list[tuple[int, int]]:
    """Table captions (order, scope) in order, each with the first body (order, scope) of its scope at most `reach` places after it that none has claimed yet."""
    free, out = sorted(bodies), []
    at = 0
    for order, scope in sorted(captions):
        while at < len(free) and free[at][0] <= order:  # behind every caption still to come
            at += 1
        k = at
        while k < len(free) and free[k][0] <= order + reach:
            if free[k][1] == scope:
                out.append((order, free.pop(k)[0]))
                break
            k += 1
    return out


def table_bodies(nodes: DataFrame, reach: int = 2) -> DataFrame:
    """doc_id, caption, body (both document orders). nodes: doc_id, document_order, scope (pages and section, as text), is_caption, is_body. A claim depends on those before it, hence Python, many documents a call; only captions and bodies travel."""
    n = nodes.where("is_caption or is_body").select("doc_id", F.col("document_order").cast("long").alias("o"), F.coalesce("scope", F.lit("")).alias("s"), "is_caption", "is_body")

    def claim(t: pa.Table) -> pa.Table:
        c = {k: t.column(k).to_pylist() for k in ("doc_id", "o", "s", "is_caption", "is_body")}
        out: tuple[list, list, list] = ([], [], [])
        for d, rows in itertools.groupby(zip(*c.values(), strict=True), key=lambda r: r[0]):
            rows = list(rows)
            for caption, body in claim_bodies([r[1:3] for r in rows if r[3]], [r[1:3] for r in rows if r[4]], reach):
                for x, v in zip(out, (d, caption, body), strict=True):
                    x.append(v)
        return pa.table({k: pa.array(v, pa.int64()) for k, v in zip(("doc_id", "caption", "body"), out, strict=True)})

    return by_whole_groups(n, "doc_id", claim, "doc_id long, caption long, body long")


def renumbered(nodes: DataFrame) -> DataFrame:
    """Canonical order of nodes (doc_id, node_id, document_order, part: 0 for a prefix or a plain node, 1 for a caption with a prefix): reading_order from 1, next_node_id."""
    w = Window.partitionBy("doc_id").orderBy("document_order", "part", "node_id")
    return nodes.withColumn("reading_order", F.row_number().over(w).cast("long")).withColumn("next_node_id", F.lead("node_id").over(w))


# The language of relations, and openings that point back.
MARKERS = {
    "QUALIFIES": r"(?i)\b(?:uncertain|uncertainty|limit(?:ation)?|assum(?:e|ing|ption)|only if|provided that|within|confidence interval|credible interval|upper limit|lower limit|systematic error)\b",
    "CONTRASTS_WITH": r"(?i)\b(?:however|whereas|in contrast|unlike|compared with|on the other hand|but instead|difference between)\b",
    "DEPENDS_ON": r"(?i)\b(?:requires?|depends? on|based on|relies? on|using|assumes?|calibrat(?:ed|ion)|prerequisite)\b",
    "RESULTS_IN": r"(?i)\b(?:results? in|leads? to|causes?|produces?|therefore|consequently|yields?)\b",
    "EXPLAINS": r"(?i)\b(?:because|mechanism|explains?|arises? from|due to|allows? us to|in order to|accounted for by)\b",
}
ANAPHORIC = r"(?i)^\s*(?:these|this|those|such|they|it|the former|the latter)\b"
EVIDENCE_ROLES, CLAIM_ROLES = ["observation", "result", "evidence"], ["motivation", "discussion", "conclusion", "other"]


# The relations and the signal of each rule, by the rule's bit.
RULES = [(["DEPENDS_ON", "ELABORATES"], "formula_context_signal"), (["ELABORATES", "EXPLAINS"], "anaphoric_reference_signal"), (["ELABORATES"], "mention_detail_signal"), (["PROVIDES_BACKGROUND_FOR"], "background_discourse_signal"), (["SUPPORTS"], "evidence_claim_signal")]
RULES += [([k], f"{k.lower()}_language_signal") for k in MARKERS]


def _bit(c: Column, k: int) -> Column:
    return F.when(c, F.lit(1 << k)).otherwise(0)


def _bits(each: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), each)


def seen(text: Column, order: Column, role: Column, kind: Column, terms: Column) -> Column:
    """All that the rules of pairs read of a node, found once a node and not once a pair: patterns are slow, and pairs many."""
    said = _bits([_bit(F.regexp_like(text, F.lit(p)), 5 + i) for i, p in enumerate(MARKERS.values())])
    is_ = lambda c: F.coalesce(c, F.lit(False))
    return F.struct(
        order.alias("order"), F.char_length(text).alias("chars"), terms.alias("terms"), said.alias("said"), is_(F.regexp_like(text, F.lit(ANAPHORIC))).alias("anaphoric"), is_(kind == "formula").alias("formula"),
        is_(role == "background").alias("background"), is_(role.isin(EVIDENCE_ROLES)).alias("evidence"), is_(role.isin(CLAIM_ROLES)).alias("claim"),
    )


def hypotheses(a: Column, b: Column) -> tuple[Column, Column]:
    """Relations a pair of nodes may have, and the signals for them, both sorted. Nodes are structs as seen() makes them."""
    shared = F.size(F.array_intersect(a["terms"], b["terms"])) > 0
    next_ = F.abs(a["order"] - b["order"]) == 1
    anaphoric = F.when(a["order"] > b["order"], a["anaphoric"]).otherwise(b["anaphoric"])
    la, lb = a["chars"], b["chars"]
    rules = [
        next_ & (a["formula"] | b["formula"]),
        next_ & anaphoric,
        shared & ((la >= 1.35 * F.greatest(F.lit(1), lb)) | (lb >= 1.35 * F.greatest(F.lit(1), la))),
        a["background"] | b["background"],
        (a["evidence"] & b["claim"]) | (b["evidence"] & a["claim"]),
    ]
    mask = _bits([_bit(c, k) for k, c in enumerate(rules)] + [a["said"], b["said"]])
    all_ = 1 << len(RULES)
    at = F.when((mask == 0) & shared, F.lit(all_)).otherwise(mask)
    held = [[r for k, r in enumerate(RULES) if m >> k & 1] for m in range(all_)]
    what = [sorted({x for v, _ in h for x in v}) for h in held] + [["ELABORATES"]]
    why = [sorted(s for _, s in h) for h in held] + [["shared_anchor_signal"]]
    pick = lambda rows: F.get(F.from_json(F.lit(json.dumps(rows)), "array<array<string>>"), at)  # noqa: E731  (a constant, read once)
    return pick(what), pick(why)


def shared_entities(nodes: DataFrame, k: int) -> DataFrame:
    """Each node's k partners of its document with the most common entities, the first in order of equals. nodes: doc_id, node_id (its place), entities (an array)."""
    e = nodes.select("doc_id", "node_id", F.explode(F.array_distinct(F.transform("entities", F.lower))).alias("entity")).where(F.trim("entity") != "")
    x, y = e.toDF("doc_id", "node", "entity"), e.toDF("doc_id", "other", "entity")
    n = x.join(y, ["doc_id", "entity"]).where("node <> other").groupBy("doc_id", "node", "other").agg(F.count("*").alias("n"))
    w = Window.partitionBy("doc_id", "node").orderBy(F.desc("n"), "other")
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("doc_id", F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"), F.lit("shared_entities").alias("reason")).distinct()


def keep_bridges(rows: list[tuple], per_node: int) -> list[int]:
    """Positions kept of rows (reasons, similarity, distance, a, b): most reasons first, then similarity, nearness and ids, while both ends have room."""
    used: dict = {}
    kept = []
    for i in sorted(range(len(rows)), key=lambda i: (-rows[i][0], -rows[i][1], *rows[i][2:])):
        a, b = rows[i][3:]
        if max(used.get(a, 0), used.get(b, 0)) < per_node:
            kept.append(i)
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
    return kept


def capped_candidates(nodes: DataFrame, pairs: DataFrame, per_node: int = 15) -> DataFrame:
    """Pairs (doc_id, a, b, reasons as an array, similarity) that one of their ends has among its best: by number of reasons, similarity and a common unit, then nearness, then ids. nodes: doc_id, node_id, unit. Adds distance and scope."""
    u = nodes.select("doc_id", "node_id", "unit")
    p = pairs.join(u.toDF("doc_id", "a", "ua"), ["doc_id", "a"]).join(u.toDF("doc_id", "b", "ub"), ["doc_id", "b"])
    scope = F.when(F.col("ua") == F.col("ub"), "WITHIN_CONTENT_UNIT").when(F.col("ua").isNotNull() & F.col("ub").isNotNull(), "CROSS_CONTENT_UNIT").otherwise("UNSCOPED")
    p = p.withColumn("scope", scope).withColumn("distance", F.abs(F.col("b") - F.col("a")))
    p = p.withColumn("score", F.round(F.size("reasons") + F.coalesce("similarity", F.lit(0.0)) + F.when(F.col("scope") == "WITHIN_CONTENT_UNIT", 2).otherwise(0), 6))
    each = p.withColumn("node", F.explode(F.array("a", "b")))
    w = Window.partitionBy("doc_id", "node").orderBy(F.desc("score"), "distance", "a", "b")
    kept = each.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_node)
    return kept.select("doc_id", "a", "b", "reasons", "similarity", "distance", "scope").dropDuplicates(["doc_id", "a", "b"])


def semantic_candidates(nodes: DataFrame, window: int = 3, k: int = 8, section_k: int = 5, entity_k: int = 5, per_node: int = 15, bridges: int = 2, strong: float = 0.45) -> DataFrame:
    """Candidate pairs of a document by all four channels, capped by node, with hypotheses and their signals; pairs across units only with a strong signal, and few for each node.

    nodes: doc_id, node_id (place in the document), text, section, role, kind, entities, terms, unit.
    """
    weights = retrieval.tfidf(nodes)
    c = retrieval.channels(nodes, weights, window, k, section_k).select("doc_id", "a", "b", F.explode(F.split("reasons", ",")).alias("reason"))
    c = c.unionByName(shared_entities(nodes, entity_k)).groupBy("doc_id", "a", "b").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    c = c.join(retrieval.similar_pairs(weights), ["doc_id", "a", "b"], "left").withColumn("similarity", F.when(F.array_contains("reasons", "embedding_top_k"), F.col("similarity")))
    c = capped_candidates(nodes, c, per_node)
    view = nodes.select("doc_id", "node_id", seen(*(F.col(k) for k in ("text", "node_id", "role", "kind", "terms"))).alias("v"))
    c = c.join(view.toDF("doc_id", "a", "va"), ["doc_id", "a"]).join(view.toDF("doc_id", "b", "vb"), ["doc_id", "b"])
    what, why = hypotheses(F.col("va"), F.col("vb"))
    c = c.withColumn("hypotheses", what).withColumn("signals", why).drop("va", "vb")
    has = lambda x: F.array_contains("reasons", x) | F.array_contains("signals", x)
    language = F.size(F.array_remove("signals", "shared_anchor_signal")) > 0
    fine = has("anaphoric_reference_signal") | has("formula_context_signal") | has("shared_entities") | ((F.col("distance") == 1) & has("structural_neighbor")) | ((F.coalesce("similarity", F.lit(0.0)) >= strong) & language)
    cross = F.col("scope") == "CROSS_CONTENT_UNIT"
    more = F.when(F.col("scope") == "WITHIN_CONTENT_UNIT", F.array(F.lit("same_content_unit"))).when(cross, F.array(F.lit("cross_content_unit_bridge"))).otherwise(F.array().cast("array<string>"))
    c = c.where(~cross | fine).withColumn("reasons", F.array_sort(F.array_distinct(F.concat("reasons", "signals", more)))).drop("signals")
    few = c.where(cross).select("doc_id", F.size("reasons").alias("n"), F.coalesce("similarity", F.lit(0.0)).alias("s"), F.col("distance").cast("long").alias("d"), "a", "b")

    def one(t: pa.Table) -> pa.Table:
        kept = keep_bridges(list(zip(*(t.column(x).to_pylist() for x in ("n", "s", "d", "a", "b")), strict=True)), bridges)
        return t.select(["doc_id", "a", "b"]).take(pa.array(kept, pa.int64()))

    kept = few.groupBy("doc_id").applyInArrow(one, "doc_id long, a long, b long")
    return c.where(~cross).unionByName(c.where(cross).join(kept, ["doc_id", "a", "b"], "left_semi"))


def graph_issues(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """issue, ref of everything wrong or odd about a graph: repeated ids, empty or incomplete evidence, ends that do not exist, edges of another layer, evidence that no sequence edge touches.

    nodes: node_id, kind, text, is_complete; edges: source, target, edge_type, layer.
    """
    issue = lambda df, name, ref: df.select(F.lit(name).alias("issue"), F.col(ref).cast("string").alias("ref"))
    ids = nodes.select("node_id").distinct()
    ev = nodes.where("kind = 'evidence'")
    ends = edges.select(F.concat_ws("->", "source", "target", "edge_type").alias("e"), "layer", F.explode(F.array("source", "target")).alias("node_id"))
    lost = ends.join(ids, "node_id", "left_anti").select("e").distinct()
    touched = edges.where(F.col("edge_type").isin("NEXT", "PREVIOUS", "CONTINUES_TO")).select(F.explode(F.array("source", "target")).alias("node_id")).distinct()
    return (
        issue(nodes.groupBy("node_id").agg(F.count("*").alias("n")).where("n > 1"), "duplicate_node_id", "node_id")
        .unionByName(issue(ev.where("coalesce(text, '') = ''"), "empty_evidence_text", "node_id"))
        .unionByName(issue(ev.where("not is_complete"), "incomplete_evidence_node", "node_id"))
        .unionByName(issue(lost, "edge_to_nonexistent_node", "e"))
        .unionByName(issue(edges.where("layer <> 'structural'").select(F.concat_ws("->", "source", "target", "edge_type").alias("e")), "mixed_edge_layer", "e"))
        .unionByName(issue(ev.join(touched, "node_id", "left_anti"), "isolated_evidence_nodes", "node_id"))
    )
