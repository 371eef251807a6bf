"""Registered queries that build tasks from pairs and keep their results, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafweave.operators import scoring, tasks
from leafweave.plans.registry import query, t

CAND = "c AS (SELECT o_orderkey AS seq, 'N' || (o_custkey % 500) AS a, 'N' || (o_orderkey % 700) AS b FROM orders)".replace("(o_custkey % 500)", "o_custkey").replace("(o_orderkey % 700)", "(o_orderkey // 3)")
ODD = "(instr('0123456789abcdef', substr(sha256('{0}|' || pair_id), 2, 1)) - 1) % 2 = 1"
ORIENTED = "p AS (SELECT least(a, b) AS lo, greatest(a, b) AS hi, min(seq) AS seq, least(a, b) || '||' || greatest(a, b) AS pair_id FROM c GROUP BY ALL)"


def _candidates(spark, sf):
    return t(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("N"), "o_custkey").alias("a"), F.concat(F.lit("N"), F.floor(F.col("o_orderkey") / 3).cast("long")).alias("b"))


def _oriented_sql(version):
    odd = ODD.format(version)
    return f"WITH {CAND}, {ORIENTED} SELECT pair_id, CASE WHEN {odd} THEN hi ELSE lo END AS first, CASE WHEN {odd} THEN lo ELSE hi END AS second, seq FROM p"


@query(_oriented_sql(tasks.EXISTENCE))
def existence_tasks(spark, sf):
    return tasks.oriented_pairs(_candidates(spark, sf), tasks.EXISTENCE)


@query(_oriented_sql(tasks.RETYPING))
def retyping_tasks(spark, sf):
    return tasks.oriented_pairs(_candidates(spark, sf), tasks.RETYPING)


@query(
    f"""WITH {CAND}, {ORIENTED}, n AS (SELECT 'N' || c_custkey AS node_id, c_mktsegment AS seg FROM customer), o AS (SELECT pair_id, CASE WHEN {ODD.format(tasks.EXISTENCE)} THEN hi ELSE lo END AS f, CASE WHEN {ODD.format(tasks.EXISTENCE)} THEN lo ELSE hi END AS s FROM p)
SELECT pair_id, x.seg AS segment_a, y.seg AS segment_b FROM o JOIN n x ON x.node_id = f JOIN n y ON y.node_id = s"""
)
def task_evidence(spark, sf):
    nodes = t(spark, sf, "customer").select(F.concat(F.lit("N"), "c_custkey").alias("node_id"), F.col("c_mktsegment").alias("seg"))
    return tasks.with_nodes(tasks.oriented_pairs(_candidates(spark, sf), tasks.EXISTENCE), nodes).select("pair_id", F.col("evidence_a.seg").alias("segment_a"), F.col("evidence_b.seg").alias("segment_b"))


@query(
    f"""WITH {CAND}, e AS (SELECT a AS source, b AS target FROM c UNION SELECT b, a FROM c) SELECT source, string_agg(target, ' ' ORDER BY sha256('{tasks.COMPARATIVE}|' || source || '|' || target), target) AS candidates FROM e GROUP BY source"""
)
def comparative_tasks(spark, sf):
    return tasks.comparative_tasks(_candidates(spark, sf)).select("source", F.array_join("candidates", " ").alias("candidates"))


LINES = "l AS (SELECT l_orderkey AS d, l_orderkey * 10 + l_linenumber AS id, l_linenumber AS o, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE 's' || (l_linenumber % 2) END AS s FROM lineitem)"


@query(
    f"""WITH {LINES}, p AS (SELECT DISTINCT x.id AS earlier, y.id AS current FROM l x JOIN l y ON x.d = y.d AND x.o < y.o WHERE y.o - x.o >= 4 OR x.s IS DISTINCT FROM y.s)
SELECT current, string_agg(earlier::VARCHAR, ' ' ORDER BY sha256('{tasks.LONG_RANGE}|' || current || '|' || earlier), earlier) AS candidates FROM p GROUP BY current"""
)
def long_range_tasks(spark, sf):
    n = F.col("l_linenumber")
    l = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("d"), (F.col("l_orderkey") * 10 + n).alias("id"), n.alias("o"), F.when(n % 4 != 0, F.concat(F.lit("s"), n % 2)).alias("s"))
    p = l.toDF("d", "a", "order_a", "section_a").join(l.toDF("d", "b", "order_b", "section_b"), "d").where("a < b")
    return tasks.long_range_tasks(p).select("current", F.array_join(F.transform("candidates", lambda x: x.cast("string")), " ").alias("candidates"))


@query(
    """WITH n AS (SELECT l_orderkey AS doc_id, l_orderkey * 10 + l_linenumber AS node_id, l_linenumber AS o, CASE WHEN l_linenumber = 5 THEN NULL ELSE (l_linenumber + l_orderkey % 3) // 3 END AS s, l_partkey % 6 = 0 AS anchor FROM lineitem),
f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY min(o)) AS g FROM n GROUP BY doc_id, s), m AS (SELECT n.*, g, row_number() OVER (PARTITION BY n.doc_id, g ORDER BY o) AS head, row_number() OVER (PARTITION BY n.doc_id, g ORDER BY o DESC) AS tail FROM n JOIN f ON n.doc_id = f.doc_id AND n.s IS NOT DISTINCT FROM f.s),
a AS (SELECT doc_id, g, node_id, o, true AS core FROM m UNION ALL SELECT doc_id, g + 1, node_id, o, false FROM m WHERE tail <= 2 UNION ALL SELECT doc_id, g - 1, node_id, o, false FROM m WHERE head <= 2 UNION ALL SELECT m.doc_id, f.g, node_id, o, false FROM m JOIN f ON m.doc_id = f.doc_id WHERE anchor)
SELECT a.doc_id, a.g AS group_no, node_id, any_value(o) AS document_order, bool_or(core) AS core FROM a JOIN f ON a.doc_id = f.doc_id AND a.g = f.g GROUP BY a.doc_id, a.g, node_id"""
)
def section_groups(spark, sf):
    n = F.col("l_linenumber")
    nodes = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_orderkey") * 10 + n).alias("node_id"), n.alias("document_order"), F.when(n != 5, F.floor((n + F.col("l_orderkey") % 3) / 3)).alias("section_id"), (F.col("l_partkey") % 6 == 0).alias("anchor"))
    return tasks.section_groups(nodes)


EDGES = """e AS (SELECT o_orderkey AS task_id, 'N' || o_custkey AS a, 'N' || (o_orderkey // 3) AS b FROM orders),
v AS (SELECT o_orderkey AS task_id, o_custkey % 4 <> 0 AS valid, CASE WHEN o_custkey % 3 = 0 THEN 'REJECT_EDGE' ELSE 'KEEP_EDGE' END AS verdict, CASE o_custkey % 6 WHEN 0 THEN 'MEDIATED' WHEN 1 THEN NULL ELSE 'DIRECT' END AS directness FROM orders WHERE o_orderkey % 5 <> 0)"""


@query(f"WITH {EDGES}, j AS (SELECT e.task_id, coalesce(valid AND verdict = 'KEEP_EDGE', false) AS kept, directness FROM e LEFT JOIN v USING (task_id)) SELECT task_id, kept, CASE WHEN NOT kept THEN coalesce(directness, 'INVALID') END AS reason FROM j")
def edges_kept_by_verdict(spark, sf):
    o = t(spark, sf, "orders")
    c = F.col("o_custkey")
    v = o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("task_id"), (c % 4 != 0).alias("valid"), F.when(c % 3 == 0, "REJECT_EDGE").otherwise("KEEP_EDGE").alias("verdict"), F.when(c % 6 == 0, "MEDIATED").when(c % 6 != 1, "DIRECT").alias("directness"))
    return tasks.kept_by_verdict(o.select(F.col("o_orderkey").alias("task_id")), v)


@query(
    f"""WITH {EDGES}, x AS (SELECT task_id, least(a, b) AS lo, greatest(a, b) AS hi, a, b, task_id % 4 <> 1 AS valid, task_id % 3 = 0 AS directed FROM e), k AS (SELECT DISTINCT lo, hi FROM x WHERE task_id % 10 = 0)
SELECT task_id, CASE WHEN k.lo IS NOT NULL THEN 'suppressed_continuation' WHEN valid THEN 'typed' ELSE 'typing_invalid_retained_as_related' END AS state, CASE WHEN valid AND directed THEN b ELSE x.lo END AS source, CASE WHEN valid AND directed THEN a ELSE x.hi END AS target, CASE WHEN valid THEN 'MODIFIES' ELSE 'RELATED' END AS relation, valid AND directed AS directed FROM x LEFT JOIN k USING (lo, hi)"""
)
def profile_edges(spark, sf):
    c = _candidates(spark, sf).withColumnRenamed("seq", "task_id")
    typed = c.select("task_id", "a", "b", (F.col("task_id") % 4 != 1).alias("valid"), F.lit("MODIFIES").alias("relation"), (F.col("task_id") % 3 == 0).alias("directed"), F.col("b").alias("source"), F.col("a").alias("target"))
    return tasks.profile_edges(typed, c.where("task_id % 10 = 0").select(F.col("a").alias("source"), F.col("b").alias("target")))


@query(
    """WITH p AS (SELECT o_orderkey AS task_id, o_custkey AS a, (SELECT max(c_custkey) FROM customer) - o_custkey AS b, o_orderkey % 5 <> 0 AS strong, (o_custkey % 10) / 10.0 AS conf, o_orderkey % 7 <> 0 AS seen FROM orders), r AS (SELECT DISTINCT c_custkey AS s, c_custkey % 40 AS t FROM customer),
j AS (SELECT *, EXISTS (SELECT 1 FROM r x JOIN r y ON x.t = y.t WHERE x.s = p.a AND y.s = p.b AND x.t <> p.a AND x.t <> p.b) AS third, EXISTS (SELECT 1 FROM r x WHERE (x.s = p.a AND x.t = p.b) OR (x.s = p.b AND x.t = p.a)) AS direct FROM p)
SELECT task_id, CASE WHEN NOT strong THEN 'not_strong' WHEN conf < 0.5 THEN 'confidence_below_threshold' WHEN NOT seen THEN 'supporting_span_not_exactly_grounded' WHEN third AND NOT direct THEN 'shared_third_reference_only' ELSE 'edge' END AS outcome FROM j"""
)
def trial_edges(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    customers = t(spark, sf, "customer")
    o = t(spark, sf, "orders").crossJoin(F.broadcast(customers.agg(F.max("c_custkey").alias("m"))))
    span = F.when(k % 7 != 0, "VALUE  is").otherwise("elsewhere")
    p = o.select(k.alias("task_id"), c.alias("a"), (F.col("m") - c).alias("b"), F.lit(True).alias("valid"), F.when(k % 5 != 0, "RELATED_STRONG").otherwise("AMBIGUOUS").alias("status"), (c % 10 / 10.0).cast("double").alias("confidence"), span.alias("span_a"), F.lit("given").alias("span_b"), F.lit("the value is here").alias("text_a"), F.lit("as given").alias("text_b"))
    return tasks.trial_edges(p, customers.select(F.col("c_custkey").alias("source"), (F.col("c_custkey") % 40).alias("target")), 0.5)


@query(
    """WITH l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL), b AS (SELECT l_orderkey AS page, l_linenumber AS block_id, l_linenumber AS o FROM l), g AS (SELECT l_orderkey AS page, l_linenumber AS group_no, CASE WHEN l_partkey % 2 = 0 THEN 'text' ELSE 'figure' END AS kind, [l_suppkey % 8, l_linenumber + 1, l_partkey % 8] AS members FROM l WHERE l_partkey % 3 <> 0),
m AS (SELECT g.page, group_no, kind, i AS place, members[i] AS block_id FROM g, generate_series(1, 3) s(i)), c AS (SELECT m.* FROM m JOIN b ON m.page = b.page AND m.block_id = b.block_id QUALIFY row_number() OVER (PARTITION BY m.page, m.block_id ORDER BY group_no, place) = 1),
j AS (SELECT b.page, b.block_id, b.o, group_no, kind FROM b LEFT JOIN c ON b.page = c.page AND b.block_id = c.block_id)
SELECT page, block_id, CASE WHEN group_no IS NULL THEN o ELSE min(o) OVER (PARTITION BY page, group_no) END AS "group", kind FROM j"""
)
def whole_groups(spark, sf):
    l = t(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    blocks = l.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("long").alias("block_id"), F.col("l_linenumber").alias("order"))
    members = F.array(F.col("l_suppkey") % 8, (F.col("l_linenumber") + 1).cast("long"), F.col("l_partkey") % 8)
    groups = l.where("l_partkey % 3 <> 0").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("group_no"), F.when(F.col("l_partkey") % 2 == 0, "text").otherwise("figure").alias("kind"), members.alias("members"))
    return tasks.whole_groups(groups, blocks)


@query("SELECT p_partkey AS id, CASE WHEN p_size <= 5 THEN generate_series(0, p_size - 1) ELSE list_sort(list_distinct([round_even(i * (p_size - 1) / 4, 0)::INT FOR i IN generate_series(0, 4)])) END::VARCHAR AS indices FROM part WHERE p_size > 0")
def sampled_page_indices(spark, sf):
    p = t(spark, sf, "part").where("p_size > 0").select(F.col("p_partkey").alias("id"), tasks.sampled_indices(F.col("p_size"), 5).alias("i"))
    return p.select("id", F.concat(F.lit("["), F.array_join(F.transform("i", lambda x: x.cast("string")), ", "), F.lit("]")).alias("indices"))


REASONS = ["formula_context_signal", "contrasts_with_language_signal", "qualifies_language_signal", "evidence_claim_signal", "shared_entities", "anaphoric_reference_signal"]
ROLE = "CASE {0} % 7 WHEN 0 THEN 'observation' WHEN 1 THEN 'result' WHEN 2 THEN 'conclusion' WHEN 3 THEN 'motivation' WHEN 4 THEN 'method' WHEN 5 THEN 'evidence' END"


@query(
    f"""WITH x AS (SELECT o_orderkey AS id, {', '.join(f'(o_orderkey >> {i}) % 2 = 1 AS r{i}' for i in range(6))}, 1 + o_custkey % 3 AS distance, {ROLE.format('o_custkey')} AS ra, {ROLE.format('o_orderkey')} AS rb, (o_custkey % 10) / 10.0 AS sim FROM orders),
y AS (SELECT *, r3 AND (coalesce(ra IN ('observation', 'result', 'evidence'), false) OR coalesce(rb IN ('observation', 'result', 'evidence'), false)) AND (coalesce(ra IN ('result', 'conclusion', 'motivation'), false) OR coalesce(rb IN ('result', 'conclusion', 'motivation'), false)) AND (sim >= 0.85 OR r4) AS claim FROM x)
SELECT id, concat_ws(',', CASE WHEN r5 THEN 'anaphoric_reference_signal' END, CASE WHEN r0 THEN 'formula_context_signal' END, CASE WHEN distance = 1 AND r1 THEN 'grounded_explicit_contrast' END, CASE WHEN distance = 1 AND r2 THEN 'grounded_explicit_qualification' END, CASE WHEN claim THEN 'high_confidence_evidence_claim' END) AS matched FROM y"""
)
def mandatory_pairs(spark, sf):
    k = F.col("o_orderkey")
    reasons = F.array_compact(F.array(*(F.when(F.shiftright(k, i) % 2 == 1, r) for i, r in enumerate(REASONS))))
    o = t(spark, sf, "orders").select(k.alias("id"), reasons.alias("r"), (1 + F.col("o_custkey") % 3).alias("d"), F.expr(ROLE.format("o_custkey")).alias("ra"), F.expr(ROLE.format("o_orderkey")).alias("rb"), (F.col("o_custkey") % 10 / 10.0).cast("double").alias("s"))
    return o.select("id", F.array_join(tasks.mandatory(F.col("r"), F.col("d"), F.col("ra"), F.col("rb"), F.col("s")), ",").alias("matched"))


@query(f"SELECT o_orderkey AS id, coalesce(o_custkey % 9 = 0, false) OR coalesce({ROLE.format('o_orderkey')} IN ('result', 'conclusion', 'method', 'evidence'), false) OR o_custkey % 5 = 0 AS important FROM orders")
def important_nodes(spark, sf):
    c = F.col("o_custkey")
    path = F.array(F.lit("Body"), F.when(c % 5 == 0, "Summary and Outlook").otherwise("Methods"))
    return t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), tasks.important(F.when(c % 9 == 0, "formula").otherwise("text"), F.expr(ROLE.format("o_orderkey")), path).alias("important"))


@query("WITH s AS (SELECT user_id AS task_id, event_id AS seq, CASE WHEN event_type IN ('click', 'purchase') THEN 'RELATED_STRONG' ELSE 'UNRELATED' END AS status, event_id % 3 = 0 AS valid FROM events), f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY NOT valid, seq) = 1) SELECT task_id, task_id % 4 = 0 AS overlaps FROM f WHERE valid AND status = 'RELATED_STRONG'")
def accepted_for_typing(spark, sf):
    e = t(spark, sf, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type").isin("click", "purchase"), "RELATED_STRONG").otherwise("UNRELATED").alias("status"), (F.col("event_id") % 3 == 0).alias("valid"))
    f = scoring.first_valid(e, "task_id").where("valid and status = 'RELATED_STRONG'")
    overlap = e.select("task_id").distinct().where("task_id % 4 = 0").withColumn("o", F.lit(True))
    return f.join(overlap, "task_id", "left").select("task_id", F.coalesce("o", F.lit(False)).alias("overlaps"))
