"""Registered queries over evidence, alignment, candidates and segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafweave.functions import geometry as g
from leafweave.functions import text as tx
from leafweave.operators import evidence, graph, segmentation
from leafweave.plans.layout import H, W
from leafweave.plans.registry import BOX, EDGES, INSIDE, INTER, _boxes, _evidence, _turns, lines_by_order, nodes, query, t


@query(
    f"""WITH {BOX}, u AS (SELECT page, n AS block_id, min(x1) AS x1, min(y1) AS y1, min(x2) AS x2, min(y2) AS y2 FROM raw WHERE n % 2 = 1 GROUP BY page, n), v AS (SELECT page, n AS region_id, min(x1) AS u1, min(y1) AS v1, min(x2) AS u2, min(y2) AS v2 FROM raw WHERE n % 2 = 0 GROUP BY page, n),
k AS (SELECT *, x1 < 500 AND y1 < 800 AND (x2 - x1) * (y2 - y1) <= 280000 AND block_id <> 7 AS fine FROM u),
j AS (SELECT *, {INTER} AS i, (x2 - x1) * (y2 - y1) AS ab, (u2 - u1) * (v2 - v1) AS ar, {INSIDE} AS inside FROM k JOIN v USING (page) WHERE fine),
t1 AS (SELECT page, block_id, region_id, round(0.60 * (i / ab) + 0.20 * inside::INT + 0.15 * (i / (ab + ar - i)) + 0.05, 8) AS score, i / ab AS contain, i / (ab + ar - i) AS iou FROM j WHERE region_id <> 4 AND (i / ab >= 0.20 OR inside)),
tm AS (SELECT page, block_id, region_id AS tr, score AS ts FROM t1 QUALIFY row_number() OVER (PARTITION BY page, block_id ORDER BY score DESC, round(contain, 8) DESC, round(iou, 8) DESC, region_id) = 1), tb AS (SELECT * FROM tm WHERE ts >= 0.25),
c1 AS (SELECT page, block_id, region_id, round(0.75 * (i / ab) + 0.20 * inside::INT + 0.05 * (i / (ab + ar - i)), 8) AS score, ar FROM j WHERE region_id >= 4 AND (i / ab >= 0.40 OR inside)),
cm AS (SELECT page, block_id, region_id AS cr, score AS cs FROM c1 QUALIFY row_number() OVER (PARTITION BY page, block_id ORDER BY score DESC, ar, region_id) = 1), cb AS (SELECT cm.* FROM cm ANTI JOIN tb USING (page, block_id) WHERE cs >= 0.40)
SELECT k.page, k.block_id, CASE WHEN tr IS NOT NULL THEN 'pp_doclayout' WHEN cr IS NOT NULL THEN 'pp_doclayout_container' WHEN fine THEN 'deepseekocr2_unverified' ELSE 'missing' END AS bbox_source, coalesce(tr, cr) AS region_id, floor(round(coalesce(ts, cs), 4) * 1000 + 1e-6)::BIGINT AS score_e3, CASE WHEN tr IS NULL AND cr IS NOT NULL THEN 'contains_visible_text' END AS relation,
  CASE WHEN coalesce(tr, cr) IS NOT NULL THEN v.u1 WHEN fine THEN k.x1 END AS x1 FROM k LEFT JOIN tb USING (page, block_id) LEFT JOIN cb USING (page, block_id) LEFT JOIN v ON v.page = k.page AND v.region_id = coalesce(tr, cr)"""
)
def aligned_blocks(spark, sf):
    b = _boxes(spark, sf).groupBy("page", "n").agg(*(F.min(f"box.{k}").alias(k) for k in ("x1", "y1", "x2", "y2"))).select("page", "n", g.box("x1", "y1", "x2", "y2").alias("box"))
    blocks = b.where("n % 2 = 1").select("page", F.col("n").alias("block_id"), F.when(F.col("n") != 7, F.col("box")).alias("box"))
    regions = b.where("n % 2 = 0").select("page", F.col("n").alias("region_id"), "box", (F.col("n") != 4).alias("text_like"), (F.col("n") >= 4).alias("container"))
    r = evidence.align_blocks(blocks, regions, W, H)
    return r.select("page", "block_id", "bbox_source", "region_id", F.floor(F.col("score") * 1000 + 1e-6).cast("long").alias("score_e3"), "relation", F.col("box.x1").alias("x1"))


@query()
def claimed_table_bodies(spark, sf):
    """Greedy, so without SQL: tested beside a plain loop."""
    n = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("document_order")).agg(F.min("l_partkey").alias("k"))
    k = F.col("k") % 4
    return evidence.table_bodies(n.select("doc_id", "document_order", (F.col("k") % 2).cast("string").alias("scope"), (k <= 1).alias("is_caption"), (k >= 2).alias("is_body")))


@query(
    """WITH n AS (SELECT l_orderkey AS doc_id, l_linenumber AS o, min(l_partkey) AS k FROM lineitem GROUP BY ALL), m AS (SELECT doc_id, o, k, 'E' || o AS node_id, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS part FROM n UNION ALL SELECT doc_id, o, k, 'E' || o || '_PREFIX_01', 0 FROM n WHERE k % 3 = 0),
x AS (SELECT doc_id, node_id, row_number() OVER w AS reading_order, lead(node_id) OVER w AS next_node_id FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY o, part, node_id)) SELECT * FROM x"""
)
def canonical_order(spark, sf):
    n = lines_by_order(spark, sf, "l_linenumber", "l_partkey").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("document_order")).agg(F.min("l_partkey").alias("k"))
    id_ = F.concat(F.lit("E"), "document_order")
    third = F.col("k") % 3 == 0
    node = lambda i, part: F.struct(i.alias("node_id"), part.alias("part"))
    own, prefix = node(id_, third.cast("int")), node(F.concat(id_, F.lit("_PREFIX_01")), F.lit(0))
    m = n.select("doc_id", "document_order", F.explode(F.when(third, F.array(own, prefix)).otherwise(F.array(own))).alias("v")).select("doc_id", "document_order", "v.*")
    return evidence.renumbered(m).select("doc_id", "node_id", "reading_order", "next_node_id")


SAYS = "CASE l_suppkey % 8 WHEN 0 THEN 'However, the limit holds within errors' WHEN 1 THEN 'These values arise from noise' WHEN 2 THEN 'It requires calibration and therefore yields more' WHEN 3 THEN 'Such a short one' ELSE 'Plain words of some length that say nothing of note at all' END"
ROLE = "CASE l_partkey % 6 WHEN 0 THEN 'background' WHEN 1 THEN 'result' WHEN 2 THEN 'discussion' WHEN 3 THEN 'evidence' WHEN 4 THEN 'other' END"
SIGNALS = {
    "formula_context_signal": ("d = 1 AND (ka OR kb)", "DEPENDS_ON,ELABORATES"),
    "anaphoric_reference_signal": ("d = 1 AND sb IN (1, 2, 3)", "ELABORATES,EXPLAINS"),
    "mention_detail_signal": ("sh AND (length(ta) >= 1.35 * length(tb) OR length(tb) >= 1.35 * length(ta))", "ELABORATES"),
    "background_discourse_signal": ("coalesce(ra = 'background', false) OR coalesce(rb = 'background', false)", "PROVIDES_BACKGROUND_FOR"),
    "evidence_claim_signal": ("coalesce((ra IN ('result', 'evidence') AND rb IN ('discussion', 'other')) OR (rb IN ('result', 'evidence') AND ra IN ('discussion', 'other')), false)", "SUPPORTS"),
    "qualifies_language_signal": ("sa = 0 OR sb = 0", "QUALIFIES"),
    "contrasts_with_language_signal": ("sa = 0 OR sb = 0", "CONTRASTS_WITH"),
    "depends_on_language_signal": ("sa = 2 OR sb = 2", "DEPENDS_ON"),
    "results_in_language_signal": ("sa = 2 OR sb = 2", "RESULTS_IN"),
    "explains_language_signal": ("sa = 1 OR sb = 1", "EXPLAINS"),
}


@query(
    f"""WITH n AS (SELECT l_orderkey AS d_, l_linenumber AS o, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL), v AS (SELECT d_, o, {SAYS} AS tx, {ROLE} AS r, l_suppkey % 8 AS s, l_partkey % 7 = 0 AS k, l_partkey % 5 AS e FROM n),
p AS (SELECT a.d_ AS doc_id, a.o AS a, b.o AS b, b.o - a.o AS d, a.tx AS ta, b.tx AS tb, a.r AS ra, b.r AS rb, a.s AS sa, b.s AS sb, a.k AS ka, b.k AS kb, a.e = b.e AS sh FROM v a JOIN v b ON a.d_ = b.d_ AND a.o < b.o),
q AS (SELECT doc_id, a, b, sh, list_sort(list_filter([{', '.join(f"CASE WHEN {c} THEN '{k}' END" for k, (c, _) in SIGNALS.items())}], lambda x: x IS NOT NULL)) AS w, list_sort(list_distinct(list_filter(string_split(concat_ws(',', {', '.join(f"CASE WHEN {c} THEN '{h}' END" for c, h in SIGNALS.values())}), ','), lambda x: x <> ''))) AS h FROM p)
SELECT doc_id, a, b, CASE WHEN len(h) = 0 AND sh THEN 'ELABORATES' ELSE array_to_string(h, ',') END AS hypotheses, CASE WHEN len(h) = 0 AND sh THEN 'shared_anchor_signal' ELSE array_to_string(w, ',') END AS signals FROM q"""
)
def relation_hypotheses(spark, sf):
    n = lines_by_order(spark, sf, "l_linenumber", "l_partkey", "l_suppkey").groupBy("l_orderkey", F.col("l_linenumber").alias("o")).agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    kind, terms = F.when(F.col("l_partkey") % 7 == 0, "formula").otherwise("text"), F.array((F.col("l_partkey") % 5).cast("string"))
    v = n.select(F.col("l_orderkey").alias("doc_id"), "o", evidence.seen(F.expr(SAYS), F.col("o"), F.expr(ROLE), kind, terms).alias("v"))
    p = v.toDF("doc_id", "a", "va").join(v.toDF("doc_id", "b", "vb"), "doc_id").where("a < b")
    what, why = evidence.hypotheses(F.col("va"), F.col("vb"))
    return p.select("doc_id", "a", "b", F.array_join(what, ",").alias("hypotheses"), F.array_join(why, ",").alias("signals"))


@query(
    """WITH e AS (SELECT DISTINCT l_orderkey AS d, l_linenumber AS n, 'e' || (l_partkey % 9) AS x FROM lineitem UNION SELECT l_orderkey, l_linenumber, 'f' || (l_suppkey % 5) FROM lineitem), p AS (SELECT a.d, a.n AS node, b.n AS other, count(*) AS c FROM e a JOIN e b ON a.d = b.d AND a.x = b.x AND a.n <> b.n GROUP BY ALL),
k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY d, node ORDER BY c DESC, other) <= 2) SELECT DISTINCT d AS doc_id, least(node, other) AS a, greatest(node, other) AS b FROM k"""
)
def shared_entity_pairs(spark, sf):
    n = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("node_id")).agg(F.flatten(F.collect_list(F.array(F.concat(F.lit("E"), F.col("l_partkey") % 9), F.concat(F.lit("f"), F.col("l_suppkey") % 5)))).alias("entities"))
    return evidence.shared_entities(n, 2).select("doc_id", "a", "b")


@query()
def semantic_candidates(spark, sf):
    """All channels, caps and the greedy quota of bridges: its parts have SQL of their own, the whole is tested beside a plain version."""
    n = _turns(spark, sf).withColumn("entities", F.slice(tx.terms(F.col("text")), 1, 6)).withColumn("terms", F.slice(tx.terms(F.col("text")), 1, 4))
    n = n.withColumn("role", F.when(F.col("node_id") % 3 == 0, "result").when(F.col("node_id") % 3 == 1, "discussion")).withColumn("kind", F.when(F.col("node_id") % 5 == 4, "formula").otherwise("text")).withColumn("unit", F.floor(F.col("node_id") / 3))
    c = evidence.semantic_candidates(n, 2, 2, 1, 2, 4, 2)
    return c.select("doc_id", "a", "b", F.array_join("reasons", ",").alias("reasons"), "scope", F.array_join("hypotheses", ",").alias("hypotheses"))


@query("WITH " + EDGES + """, x AS (SELECT 'incomplete_evidence_node' AS issue, node_id AS ref FROM evidence WHERE reason IS NOT NULL UNION ALL SELECT 'empty_evidence_text', node_id FROM evidence WHERE plain = ''
UNION ALL SELECT 'isolated_evidence_nodes', node_id FROM evidence WHERE node_id NOT IN (SELECT source FROM edges WHERE edge_type IN ('NEXT', 'PREVIOUS', 'CONTINUES_TO') UNION SELECT target FROM edges WHERE edge_type IN ('NEXT', 'PREVIOUS', 'CONTINUES_TO'))
UNION ALL SELECT DISTINCT 'edge_to_nonexistent_node', source || '->' || target || '->' || edge_type FROM edges WHERE edge_type IN ('IN_DOCUMENT', 'IN_SECTION')) SELECT issue, count(*) AS n, md5(min(ref) || max(ref)) AS ends FROM x GROUP BY issue""")
def graph_issues(spark, sf):
    e = graph.kept(_evidence(spark, sf).select("node_id", "doc_id", "document_order", "page", "section_no", "plain", "is_complete"))  # nodes and edges are read seven times
    n = e.select("node_id", F.lit("evidence").alias("kind"), F.col("plain").alias("text"), "is_complete")
    i = evidence.graph_issues(n, nodes.structural_edges(e).withColumn("layer", F.lit("structural")))
    return i.groupBy("issue").agg(F.count("*").alias("n"), F.md5(F.concat(F.min("ref"), F.max("ref"))).alias("ends"))


def _vectors(spark, sf):
    e = t(spark, sf, "embeddings").select(F.col("label").cast("long").alias("doc_id"), "vec_id", F.slice("embedding", 1, 8).cast("array<double>").alias("v"))
    e = e.withColumn("idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("vec_id")).cast("long"))
    return e.withColumn("doc_id", F.col("doc_id") * 1000 + F.floor(F.col("idx") / 60)).withColumn("reward", (F.col("vec_id") % 10 / 10.0).cast("double")).withColumn("p", (F.col("vec_id") % 7 / 10.0 + 0.1).cast("double"))


@query()
def optimal_segments(spark, sf):
    """Dynamic programming, so without SQL: tested beside all cuts of short documents."""
    return segmentation.optimal_segments(_vectors(spark, sf), 0.8)


@query()
def decoded_spans(spark, sf):
    return segmentation.decoded_spans(_vectors(spark, sf), 0.5)
