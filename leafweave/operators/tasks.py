"""Tasks for models, built from pairs and nodes without a look at any label, and what is kept of their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The versions that orders and orientations are salted with.
EXISTENCE, RETYPING, COMPARATIVE, LONG_RANGE = "freeform-edge-existence-v1", "current-accepted-pairs-split-retype-v1", "comparative-freeform-edge-selection-v1", "sequential-long-range-ranking-v1"


def oriented_pairs(rows: DataFrame, version: str) -> DataFrame:
    """The first row (seq) of every unordered pair (a, b), its ends in an order that a hash of version and pair decides: pair_id, first, second, seq."""
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    p = rows.groupBy(lo.alias("lo"), hi.alias("hi")).agg(F.min("seq").alias("seq")).withColumn("pair_id", F.concat_ws("||", "lo", "hi"))
    odd = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{version}|"), "pair_id"), 256), 2, 1), 16, 10).cast("int") % 2 == 1
    return p.select("pair_id", F.when(odd, F.col("hi")).otherwise(F.col("lo")).alias("first"), F.when(odd, F.col("lo")).otherwise(F.col("hi")).alias("second"), "seq")


def with_nodes(tasks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Tasks (first, second) with both nodes' views (node_id, and whatever else nodes have) as structs."""
    view = nodes.select("node_id", F.struct(*nodes.columns).alias("view"))
    return tasks.join(view.toDF("first", "evidence_a"), "first").join(view.toDF("second", "evidence_b"), "second")


def _blind(version: str, source: str, target: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{version}|"), F.col(source).cast("string"), F.lit("|"), F.col(target).cast("string")), 256)


def comparative_tasks(pairs: DataFrame) -> DataFrame:
    """Every node with all nodes it is paired with, in an order that hashes decide. pairs: a, b. A node has few partners: candidates are capped where they are made."""
    each = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("target")), F.struct(F.col("b").alias("source"), F.col("a").alias("target")))).alias("e")).select("e.*").distinct()
    c = each.groupBy("source").agg(F.array_sort(F.collect_list(F.struct(_blind(COMPARATIVE, "source", "target").alias("h"), "target"))).alias("c"))
    return c.select("source", F.transform("c", lambda x: x["target"]).alias("candidates"))


def long_range_tasks(pairs: DataFrame, least: int = 4) -> DataFrame:
    """Every later node with its earlier partners that stand `least` places before it or in another section, in an order that hashes decide. pairs: a, b, order_a, order_b, section_a, section_b."""
    forward = (F.col("order_a") < F.col("order_b")) | ((F.col("order_a") == F.col("order_b")) & (F.col("a") < F.col("b")))
    p = pairs.where((F.abs(F.col("order_a") - F.col("order_b")) >= least) | ~F.col("section_a").eqNullSafe(F.col("section_b")))
    p = p.select(F.when(forward, F.col("b")).otherwise(F.col("a")).alias("current"), F.when(forward, F.col("a")).otherwise(F.col("b")).alias("earlier")).distinct()
    c = p.groupBy("current").agg(F.array_sort(F.collect_list(F.struct(_blind(LONG_RANGE, "current", "earlier").alias("h"), "earlier"))).alias("c"))
    return c.select("current", F.transform("c", lambda x: x["earlier"]).alias("candidates"))


def section_groups(nodes: DataFrame, context: int = 2) -> DataFrame:
    """Members of every section's group, as rows group_no, doc_id, node_id, document_order, core: the section's nodes, anchors (nodes without a section path, abstracts), the last nodes of the section before and the first of the one after. nodes: doc_id, node_id, document_order, section_id, anchor."""
    d = Window.partitionBy("doc_id")
    first = nodes.groupBy("doc_id", "section_id").agg(F.min("document_order").alias("begins"))
    first = first.withColumn("group_no", F.row_number().over(d.orderBy("begins")).cast("long"))
    n = nodes.join(first, nodes["doc_id"].eqNullSafe(first["doc_id"]) & nodes["section_id"].eqNullSafe(first["section_id"])).select(nodes["*"], "group_no")
    s = Window.partitionBy("doc_id", "group_no")
    n = n.withColumn("head", F.row_number().over(s.orderBy("document_order"))).withColumn("tail", F.row_number().over(s.orderBy(F.desc("document_order"))))
    row = lambda no, core: F.struct(no.alias("group_no"), F.lit(core).alias("core"))
    own = n.select("doc_id", "node_id", "document_order", F.explode(F.array_compact(F.array(row(F.col("group_no"), True), F.when(F.col("tail") <= context, row(F.col("group_no") + 1, False)), F.when(F.col("head") <= context, row(F.col("group_no") - 1, False))))).alias("g")).select("doc_id", "node_id", "document_order", "g.*")
    groups = first.select("doc_id", "group_no")
    anchors = n.where("anchor").select("doc_id", "node_id", "document_order").join(groups, "doc_id").withColumn("core", F.lit(False))
    every = own.unionByName(anchors.select(*own.columns)).join(groups, ["doc_id", "group_no"], "left_semi")
    return every.groupBy("doc_id", "group_no", "node_id").agg(F.first("document_order").alias("document_order"), F.bool_or("core").alias("core"))


def kept_by_verdict(edges: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Edges (task_id, ...) with `kept`, whether a valid verdict keeps them, and why not: the verdict's directness, or INVALID without one. verdicts: task_id, valid, verdict, directness; one row a task."""
    j = edges.join(verdicts.select("task_id", "valid", "verdict", "directness"), "task_id", "left")
    keep = F.coalesce(F.col("valid") & (F.col("verdict") == "KEEP_EDGE"), F.lit(False))
    return j.select(*edges.columns, keep.alias("kept"), F.when(~keep, F.coalesce("directness", F.lit("INVALID"))).alias("reason"))


def profile_edges(typed: DataFrame, continues: DataFrame) -> DataFrame:
    """Edges from typed pairs (task_id, a, b, valid, relation, directed, source, target): pairs that continue each other (continues: source, target) are left to that edge, invalid ones stay as RELATED without direction."""
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    c = continues.select(F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi")).distinct().withColumn("continues", F.lit(True))
    j = typed.withColumn("lo", lo).withColumn("hi", hi).join(c, ["lo", "hi"], "left")
    ok = F.coalesce("valid", F.lit(False))
    aimed = ok & F.coalesce("directed", F.lit(False))
    state = F.when(F.col("continues"), "suppressed_continuation").when(ok, "typed").otherwise("typing_invalid_retained_as_related")
    return j.select("task_id", state.alias("state"), F.when(aimed, F.col("source")).otherwise(F.col("lo")).alias("source"), F.when(aimed, F.col("target")).otherwise(F.col("hi")).alias("target"), F.when(ok, F.col("relation")).otherwise("RELATED").alias("relation"), aimed.alias("directed"))


def trial_edges(pairs: DataFrame, references: DataFrame, least: float) -> DataFrame:
    """Why a judged pair becomes an edge or not: pairs (task_id, a, b, valid, status, confidence, span_a, span_b, text_a, text_b); references (source, target). Pairs that only share a third node they refer to are left out unless they refer to each other."""
    from leafweave.operators.replies import grounded

    r = references.select("source", "target").distinct()
    p = pairs.select("task_id", "a", "b")
    third = p.join(r.toDF("a", "t"), "a").join(r.toDF("b", "t"), ["b", "t"]).where("t <> a and t <> b").select("task_id").distinct().withColumn("third", F.lit(True))
    either = r.unionByName(r.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    direct = p.join(either.toDF("a", "b"), ["a", "b"]).select("task_id").distinct().withColumn("direct", F.lit(True))
    j = pairs.join(third, "task_id", "left").join(direct, "task_id", "left")
    strong = F.coalesce(F.col("valid") & (F.col("status") == "RELATED_STRONG"), F.lit(False))
    seen = grounded(F.col("span_a"), F.col("text_a")) & grounded(F.col("span_b"), F.col("text_b"))
    why = F.when(~strong, "not_strong").when(F.coalesce("confidence", F.lit(0.0)) < least, "confidence_below_threshold").when(~seen, "supporting_span_not_exactly_grounded")
    return j.select("task_id", why.when(F.col("third") & F.col("direct").isNull(), "shared_third_reference_only").otherwise("edge").alias("outcome"))


def whole_groups(groups: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every block in one group: of several claims the first (group_no, place) holds, unknown ids claim nothing, blocks that none claims stand alone. groups: page, group_no, kind, members (array, in order); blocks: page, block_id, order. Returns page, block_id, group (the least order of its members), kind (null alone)."""
    m = groups.select("page", "group_no", "kind", F.posexplode("members").alias("place", "block_id"))
    b = blocks.select("page", "block_id", "order")
    m = m.join(b, ["page", "block_id"])
    m = m.withColumn("turn", F.row_number().over(Window.partitionBy("page", "block_id").orderBy("group_no", "place"))).where("turn = 1")
    j = b.join(m.select("page", "block_id", "group_no", "kind"), ["page", "block_id"], "left")
    least = F.min("order").over(Window.partitionBy("page", "group_no"))
    return j.select("page", "block_id", F.when(F.col("group_no").isNull(), F.col("order")).otherwise(least).alias("group"), "kind")


def sampled_indices(pages: Column, wanted: int) -> Column:
    """Evenly spread distinct indices of pages, all of them if they are few; rounded half to even."""
    if wanted == 1:
        some = F.array(F.bround(0.5 * (pages - 1)).cast("int"))
    else:
        some = F.transform(F.sequence(F.lit(0), F.lit(wanted - 1)), lambda i: F.bround(i * (pages - 1) / (wanted - 1)).cast("int"))
    return F.when(pages <= wanted, F.sequence(F.lit(0), (pages - 1).cast("int"))).otherwise(F.array_sort(F.array_distinct(some)))


def mandatory(reasons: Column, distance: Column, role_a: Column, role_b: Column, similarity: Column) -> Column:
    """Why a candidate must be judged, sorted; empty if it need not be."""
    has = lambda x: F.array_contains(reasons, x)
    some = lambda values: F.coalesce(role_a.isin(values), F.lit(False)) | F.coalesce(role_b.isin(values), F.lit(False))
    claim = has("evidence_claim_signal") & some(["observation", "result", "evidence"]) & some(["result", "conclusion", "discussion", "motivation", "other"]) & ((F.coalesce(similarity, F.lit(0.0)) >= 0.85) | has("shared_entities"))
    own = F.array_intersect(reasons, F.array(*map(F.lit, MANDATORY)))
    more = F.array_compact(F.array(F.when((distance == 1) & has("contrasts_with_language_signal"), "grounded_explicit_contrast"), F.when((distance == 1) & has("qualifies_language_signal"), "grounded_explicit_qualification"), F.when(claim, "high_confidence_evidence_claim")))
    return F.concat(F.array_sort(own), more)


# A fixed value: reasons that are enough by themselves.
MANDATORY = ["anaphoric_reference_signal", "explicit_equation_reference", "explicit_figure_reference", "explicit_table_reference", "formula_context_signal"]


def important(kind: Column, role: Column, path: Column) -> Column:
    """Whether a node matters: a formula, a result, a method, a conclusion, or anything in a section that concludes."""
    p = F.lower(F.coalesce(F.array_join(path, " "), F.lit("")))
    return F.coalesce(kind == "formula", F.lit(False)) | F.coalesce(role.isin("evidence", "result", "method", "conclusion", "discussion"), F.lit(False)) | F.contains(p, F.lit("conclusion")) | F.contains(p, F.lit("outlook"))
