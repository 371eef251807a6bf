"""Registered queries over model replies, made from orders and their lines; each beside SQL that never sees the reply's text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafweave.operators import replies
from leafweave.plans.registry import query, t

#: Columns of a task and its reply, in SQL that both engines read.
FIELDS = {
    "task_id": "o_orderkey",
    "a": "'N' || (o_custkey % 97)",
    "b": "'M' || (o_orderkey % 89)",
    "source_node_id": "CASE o_custkey % 5 WHEN 0 THEN 'N' || (o_custkey % 97) WHEN 1 THEN 'M' || (o_orderkey % 89) WHEN 2 THEN NULL WHEN 3 THEN 'X' ELSE 'N' || (o_custkey % 97) END",
    "target_node_id": "CASE o_custkey % 5 WHEN 0 THEN 'M' || (o_orderkey % 89) WHEN 1 THEN 'N' || (o_custkey % 97) WHEN 2 THEN NULL WHEN 3 THEN 'M' || (o_orderkey % 89) ELSE 'N' || (o_custkey % 97) END",
    "confidence": "CASE o_custkey % 7 WHEN 0 THEN 'high' WHEN 1 THEN NULL WHEN 2 THEN '1.7' WHEN 3 THEN '-2' ELSE '0.25' END",
    "relation": "CASE o_orderkey % 13 WHEN 0 THEN 'supports' WHEN 1 THEN 'EXPANDS' WHEN 2 THEN 'Conditions' WHEN 3 THEN 'CONTRASTS_WITH' WHEN 4 THEN 'MODIFIES' WHEN 5 THEN 'CONTRIBUTES_TO' WHEN 6 THEN 'REFERENCES' WHEN 7 THEN 'REJECT_UNCERTAIN' WHEN 8 THEN 'EXPLAINS_OR_ELABORATES' WHEN 9 THEN 'QUALIFIES' WHEN 10 THEN 'RELATED' WHEN 11 THEN 'ELABORATES' ELSE NULL END",
    "second": "CASE o_orderkey % 4 WHEN 0 THEN 'supports' WHEN 1 THEN 'EXPLAINS_OR_ELABORATES' ELSE NULL END",
    "way": "CASE o_orderkey % 3 WHEN 0 THEN 'directed' WHEN 1 THEN 'SYMMETRIC' ELSE 'UNRESOLVED' END",
    "description": "CASE o_orderkey % 9 WHEN 0 THEN '  ' WHEN 1 THEN NULL ELSE 'one gives the other' END",
    "status": "CASE o_orderkey % 5 WHEN 0 THEN 'RELATED_STRONG' WHEN 1 THEN 'unrelated' WHEN 2 THEN 'RELATED' WHEN 3 THEN 'POSSIBLE_RELATION' ELSE 'AMBIGUOUS' END",
    "text_a": "'The  mass of ' || (o_custkey % 11) || ' units is given'",
    "text_b": "'A spin of ' || (o_orderkey % 7) || ' follows'",
    "anchor_a": "CASE o_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'no such words' ELSE 'the MASS of ' || (o_custkey % 11) END",
    "anchor_b": "CASE o_custkey % 4 WHEN 0 THEN NULL ELSE ' spin of ' END",
    "exists_": "CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END",
    "cue": "CASE o_orderkey % 6 WHEN 0 THEN 'Fig. 1' WHEN 3 THEN ' ' ELSE NULL END",
    "directness": "CASE o_orderkey % 4 WHEN 0 THEN 'direct' WHEN 1 THEN 'MEDIATED' WHEN 2 THEN 'TOPIC_ONLY' ELSE 'OTHER' END",
    "third": "CASE o_custkey % 3 WHEN 0 THEN true ELSE false END",
    "verdict": "CASE o_orderkey % 2 WHEN 0 THEN 'keep_edge' ELSE 'REJECT_EDGE' END",
    "reason": "CASE o_orderkey % 5 WHEN 0 THEN 'too far' ELSE NULL END",
}
TASKS = "x AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in FIELDS.items()) + ", o_orderkey % 53 <> 0 AS is_reply FROM orders), r AS (SELECT *, CASE WHEN TRY_CAST(confidence AS DOUBLE) IS NOT NULL THEN least(1.0, greatest(0.0, TRY_CAST(confidence AS DOUBLE))) END::DOUBLE AS conf, upper(coalesce(relation, '')) AS label, upper(way) AS dir, upper(status) AS st,\n  coalesce(source_node_id <> target_node_id AND ((source_node_id = a AND target_node_id = b) OR (source_node_id = b AND target_node_id = a)), false) AS ends, source_node_id IS NULL AND target_node_id IS NULL AS free, coalesce(trim(description) <> '', false) AS said FROM x)"


def _tasks(spark, sf, **fields: str) -> DataFrame:
    """Tasks with a reply of the given fields, each an SQL expression over FIELDS; every 53rd reply is no object."""
    x = t(spark, sf, "orders").selectExpr(*(f"{e} as {n}" for n, e in FIELDS.items()))
    body = F.to_json(F.struct(*(F.expr(e).alias(n) for n, e in fields.items())))
    return x.withColumn("reply", F.when(F.col("task_id") % 53 != 0, body).otherwise("[1]"))


def _typed(relations: str, abstain: bool = False) -> str:
    out = "label = 'REJECT_UNCERTAIN' AND conf IS NOT NULL" if abstain else "false"
    return f"""WITH {TASKS}, v AS (SELECT *, coalesce({out}, false) AS abstains FROM r)
SELECT task_id, CASE WHEN is_reply THEN label END AS relation, CASE WHEN is_reply AND NOT abstains THEN source_node_id END AS source, CASE WHEN is_reply AND NOT abstains THEN target_node_id END AS target, CASE WHEN is_reply THEN conf END AS confidence,
  is_reply AND (abstains OR (label IN ({relations}) AND ends AND conf IS NOT NULL)) AS valid FROM v"""


PAIR = {"relation_type": "relation", "source_node_id": "source_node_id", "target_node_id": "target_node_id", "confidence": "confidence"}


@query(_typed("'EXPANDS', 'SUPPORTS', 'CONDITIONS', 'CONTRASTS_WITH'"))
def coarse_replies(spark, sf):
    return replies.coarse_typed(_tasks(spark, sf, **PAIR))


@query(_typed("'CONTRIBUTES_TO', 'MODIFIES', 'CONTRASTS_WITH', 'REFERENCES'", True))
def four_class_replies(spark, sf):
    return replies.four_class_typed(_tasks(spark, sf, **PAIR))


@query(_typed("'ELABORATES', 'SUPPORTS', 'EXPLAINS', 'QUALIFIES', 'DEPENDS_ON', 'CONTRASTS_WITH'"))
def strict_replies(spark, sf):
    return replies.strictly_typed(_tasks(spark, sf, **PAIR))


@query(
    f"""WITH {TASKS}, v AS (SELECT *, CASE WHEN label = 'REJECT_UNCERTAIN' THEN free ELSE label IN ('SUPPORTS', 'EXPLAINS_OR_ELABORATES', 'MODIFIES', 'CONTRASTS_WITH') AND ends END AS sem,
  CASE WHEN exists_ THEN ends AND coalesce(trim(cue) <> '', false) WHEN NOT exists_ THEN free AND cue IS NULL ELSE false END AS ref FROM r)
SELECT task_id, CASE WHEN is_reply THEN label END AS relation, CASE WHEN is_reply THEN conf END AS semantic_confidence, CASE WHEN is_reply THEN exists_ END AS reference, CASE WHEN is_reply THEN conf END AS reference_confidence, is_reply AND conf IS NOT NULL AND sem AND ref AS valid FROM v"""
)
def split_replies(spark, sf):
    ends = "'source_node_id', source_node_id, 'target_node_id', target_node_id, 'confidence', confidence"
    return replies.split_typed(_tasks(spark, sf, semantic=f"named_struct('relation', relation, {ends})", references=f"named_struct('exists', exists_, 'cue', cue, {ends})"))


@query(
    f"""WITH {TASKS}, v AS (SELECT *, coalesce(trim(anchor_a) <> '', false) AND coalesce(trim(anchor_b) <> '', false) AND said AS every, anchor_a IS NULL AND anchor_b IS NULL AND description IS NULL AS none_ FROM r)
SELECT task_id, CASE WHEN is_reply THEN st END AS status, CASE WHEN is_reply THEN conf END AS confidence, is_reply AND conf IS NOT NULL AND CASE WHEN st IN ('RELATED_STRONG', 'AMBIGUOUS') THEN every WHEN st = 'UNRELATED' THEN none_ ELSE false END AS valid FROM v"""
)
def freeform_replies(spark, sf):
    return replies.freely_judged(_tasks(spark, sf, status="status", relation_description="description", supporting_span_a="anchor_a", supporting_span_b="anchor_b", confidence="confidence"))


GROUNDED = "coalesce(contains(lower(regexp_replace(text_a, '\\s+', ' ', 'g')), lower(trim(anchor_a))), false) AND coalesce(contains(lower(regexp_replace(text_b, '\\s+', ' ', 'g')), lower(trim(anchor_b))), false) AS anchored"


@query(
    f"""WITH {TASKS}, v AS (SELECT *, {GROUNDED}, task_id % 6 AS sig FROM r)
SELECT task_id, CASE WHEN is_reply THEN st END AS status, CASE WHEN is_reply THEN conf END AS probability, is_reply AND conf IS NOT NULL AND
  CASE WHEN st IN ('RELATED', 'POSSIBLE_RELATION') THEN sig IN (0, 1, 5) AND said AND anchored AND reason IS NULL WHEN st = 'UNRELATED' THEN sig = 4 AND description IS NULL AND anchor_a IS NULL AND anchor_b IS NULL AND reason IS NOT NULL ELSE false END AS valid FROM v"""
)
def existence_replies(spark, sf):
    signals = "case task_id % 6 when 0 then array('EXPLICIT_CONTRAST') when 1 then array('CONDITION_OR_SCOPE', 'SAME_CLAIM_OR_RESULT') when 2 then array('EXPLICIT_CONTRAST', 'EXPLICIT_CONTRAST') when 3 then array('OTHER') when 4 then cast(array() as array<string>) else array('EVIDENCE_OR_QUANTIFICATION') end"
    return replies.existence_judged(_tasks(spark, sf, status="status", signals=signals, best_relation_hypothesis="description", anchor_a="anchor_a", anchor_b="anchor_b", unrelated_reason="reason", relationship_probability="confidence"))


@query(
    f"""WITH {TASKS}, v AS (SELECT *, {GROUNDED}, upper(directness) AS d, upper(verdict) AS ve FROM r)
SELECT task_id, CASE WHEN is_reply THEN ve END AS verdict, CASE WHEN is_reply THEN d END AS directness, CASE WHEN is_reply THEN conf END AS confidence, is_reply AND conf IS NOT NULL AND
  CASE ve WHEN 'KEEP_EDGE' THEN d = 'DIRECT' AND NOT third AND anchored AND said AND (cue IS NOT NULL AND trim(cue) <> '' OR said) AND reason IS NULL ELSE d IN ('MEDIATED', 'TOPIC_ONLY') AND reason IS NOT NULL AND third = (d = 'MEDIATED') END AS valid FROM v"""
)
def validation_replies(spark, sf):
    return replies.strictly_validated(_tasks(spark, sf, verdict="verdict", directness="directness", anchor_a="anchor_a", anchor_b="anchor_b", shared_atomic_subject="description", contribution_a_to_b="cue", contribution_b_to_a="description", third_node_required="third", rejection_reason="reason", confidence="confidence"))


@query(
    f"""WITH {TASKS}, v AS (SELECT *, upper(second) AS s2 FROM r)
SELECT task_id, CASE WHEN is_reply THEN label END AS relation, CASE WHEN is_reply THEN s2 END AS secondary, CASE WHEN is_reply THEN dir END AS direction, CASE WHEN is_reply THEN conf END AS confidence, is_reply AND conf IS NOT NULL AND said
  AND (s2 IS NULL OR (label IN ('SUPPORTS', 'EXPLAINS_OR_ELABORATES') AND s2 IN ('SUPPORTS', 'EXPLAINS_OR_ELABORATES') AND s2 <> label))
  AND CASE WHEN label IN ('SUPPORTS', 'EXPLAINS_OR_ELABORATES', 'MODIFIES') THEN dir = 'DIRECTED' AND ends WHEN label = 'CONTRASTS_WITH' THEN dir = 'SYMMETRIC' AND free WHEN label = 'REJECT_UNCERTAIN' THEN dir = 'UNRESOLVED' AND free AND s2 IS NULL ELSE false END AS valid FROM v"""
)
def fixed_replies(spark, sf):
    return replies.fixed_typed(_tasks(spark, sf, relation="relation", secondary_relation="second", direction_status="way", source_node_id="source_node_id", target_node_id="target_node_id", relation_description="description", confidence="confidence"))


@query(
    f"""WITH {TASKS}, v AS (SELECT *, CASE task_id % 5 WHEN 0 THEN 'EVIDENTIAL' WHEN 1 THEN 'EXPLANATORY,EVIDENTIAL' WHEN 2 THEN 'EVIDENTIAL,EVIDENTIAL' WHEN 3 THEN '' ELSE NULL END AS modes FROM r)
SELECT task_id, CASE WHEN is_reply THEN label END AS relation, CASE WHEN is_reply THEN coalesce(modes, '') END AS modes, CASE WHEN is_reply THEN dir END AS direction, CASE WHEN is_reply THEN conf END AS confidence, is_reply AND conf IS NOT NULL AND said AND modes IS NOT NULL AND modes <> 'EVIDENTIAL,EVIDENTIAL'
  AND CASE label WHEN 'CONTRIBUTES_TO' THEN modes <> '' AND ((dir = 'DIRECTED' AND ends) OR (dir = 'UNRESOLVED' AND free)) WHEN 'MODIFIES' THEN modes = '' AND dir = 'DIRECTED' AND ends WHEN 'CONTRASTS_WITH' THEN modes = '' AND dir = 'SYMMETRIC' AND free WHEN 'RELATED' THEN modes = '' AND dir = 'UNRESOLVED' AND free ELSE false END AS valid FROM v"""
)
def profile_replies(spark, sf):
    modes = "case task_id % 5 when 0 then array('EVIDENTIAL') when 1 then array('EXPLANATORY', 'EVIDENTIAL') when 2 then array('EVIDENTIAL', 'EVIDENTIAL') when 3 then cast(array() as array<string>) end"
    r = _tasks(spark, sf, primary_relation="relation", contribution_modes=modes, direction_status="way", source_node_id="source_node_id", target_node_id="target_node_id", relation_description="description", confidence="confidence")
    r = replies.profile_typed(r)
    return r.withColumn("modes", F.array_join("modes", ","))


# --- rankings -----------------------------------------------------------------------------------

LISTS = """e AS (SELECT l_orderkey AS task_id, list_sort(list(DISTINCT format('D_EV_{:06d}', l_partkey))) AS expected FROM lineitem GROUP BY l_orderkey),
s AS (SELECT *, CASE task_id % 5 WHEN 0 THEN list_reverse(expected) WHEN 1 THEN expected[2:] WHEN 2 THEN list_concat(expected, expected[1:1]) WHEN 3 THEN list_transform(expected, lambda x: regexp_replace(x, '_EV_0+([0-9])', '_EV_\\1')) ELSE list_concat(['Z'], expected[2:]) END AS given, task_id % 53 <> 0 AS is_reply FROM e)"""


def _lists(spark, sf):
    e = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("task_id")).agg(F.array_sort(F.collect_set(F.format_string("D_EV_%06d", "l_partkey"))).alias("expected"))
    k = F.col("task_id") % 5
    x = F.col("expected")
    given = F.when(k == 0, F.reverse(x)).when(k == 1, F.slice(x, 2, 99)).when(k == 2, F.concat(x, F.slice(x, 1, 1)))
    given = given.when(k == 3, F.transform(x, lambda v: F.regexp_replace(v, "_EV_0+([0-9])", r"_EV_$1"))).otherwise(F.concat(F.array(F.lit("Z")), F.slice(x, 2, 99)))
    return e.withColumn("given", given)


def _reply(**fields):
    return F.when(F.col("task_id") % 53 != 0, F.to_json(F.struct(*(c.alias(n) for n, c in fields.items()))))


@query(
    f"""WITH {LISTS}, n AS (SELECT *, CASE WHEN is_reply THEN list_filter(given, lambda x: list_contains(expected, x)) ELSE [] END AS named FROM s),
u AS (SELECT task_id, pos, x FROM (SELECT task_id, list_concat(named, expected) AS l FROM n), unnest(l) WITH ORDINALITY AS q(x, pos)), f AS (SELECT task_id, x, min(pos) AS pos FROM u GROUP BY ALL)
SELECT n.task_id, string_agg(f.x, ' ' ORDER BY f.pos) AS ranked, any_value(is_reply AND len(named) = len(expected) AND len(list_distinct(named)) = len(expected)) AS complete FROM n JOIN f ON n.task_id = f.task_id GROUP BY n.task_id"""
)
def ranking_replies(spark, sf):
    r = replies.ranked_targets(_lists(spark, sf).withColumn("reply", _reply(ranked_target_ids=F.col("given"))))
    return r.select("task_id", F.array_join("ranked", " ").alias("ranked"), "complete")


@query(
    f"""WITH {LISTS}, v AS (SELECT *, is_reply AND task_id % 5 IN (0, 3) AS ordered, is_reply AND (task_id % 7) - 1 BETWEEN 0 AND len(expected) AS whole FROM s)
SELECT task_id, array_to_string(CASE WHEN ordered AND task_id % 5 = 0 THEN list_reverse(expected) ELSE expected END, ' ') AS ranked, CASE WHEN whole THEN (task_id % 7) - 1 ELSE 0 END::BIGINT AS cutoff, ordered AND whole AS valid FROM v"""
)
def sequence_replies(spark, sf):
    r = _lists(spark, sf).withColumn("reply", _reply(ranked_candidate_ids=F.col("given"), edge_cutoff=F.col("task_id") % 7 - 1))
    r = replies.ranked_in_sequence(r)
    return r.select("task_id", F.array_join("ranked", " ").alias("ranked"), "cutoff", "valid")


@query(
    f"""WITH {LISTS}, p AS (SELECT *, given[:2 + task_id % 3] AS picked FROM s), v AS (SELECT *, is_reply AND (task_id % 11 <> 0 OR len(picked) = 0) AND len(list_filter(picked, lambda x: NOT list_contains(expected, x))) = 0 AND len(list_distinct(picked)) = len(picked) AS fine FROM p)
SELECT task_id, CASE WHEN is_reply THEN CASE WHEN fine THEN array_to_string(picked, ' ') ELSE '' END END AS targets, fine AND len(picked) <= 3 AS valid FROM v"""
)
def selection_replies(spark, sf):
    row = lambda x: F.struct(x.alias("target_id"), F.lit("relates").alias("relation_description"), F.when(F.col("task_id") % 11 != 0, "span").otherwise(" ").alias("source_span"), F.lit("span").alias("target_span"))
    r = _lists(spark, sf).withColumn("selected", F.transform(F.slice("given", F.lit(1), (2 + F.col("task_id") % 3).cast("int")), row))
    r = replies.selected_targets(r.withColumnRenamed("expected", "candidates").withColumn("reply", _reply(selected=F.col("selected"))))
    return r.select("task_id", F.array_join("targets", " ").alias("targets"), "valid")


@query(
    """WITH c AS (SELECT 'N' || o_custkey || '||' || o_orderkey AS pair_id, o_orderkey AS k FROM orders),
d AS (SELECT pair_id, k, k AS seq, CASE k % 4 WHEN 0 THEN 'related' WHEN 1 THEN 'NONE' WHEN 2 THEN 'maybe' END AS cl, CASE k % 5 WHEN 0 THEN '85%' WHEN 1 THEN 'High' WHEN 2 THEN '0.4' WHEN 3 THEN 'odd' END AS co FROM c WHERE k % 3 <> 0
  UNION ALL SELECT pair_id, k, -1, 'POSSIBLE', '0.9' FROM c WHERE k % 2 = 0),
l AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY seq DESC) = 1),
j AS (SELECT c.pair_id, l.pair_id IS NULL AS missing, upper(coalesce(cl, 'POSSIBLE')) AS label, co FROM c LEFT JOIN l ON c.pair_id = l.pair_id), f AS (SELECT *, missing OR label NOT IN ('RELATED', 'POSSIBLE', 'NONE') AS fallback FROM j)
SELECT pair_id, CASE WHEN fallback THEN 'POSSIBLE' ELSE label END AS classification, CASE WHEN co IS NULL THEN CASE WHEN fallback THEN 0.5 ELSE 0.0 END WHEN co = '85%' THEN 0.85 WHEN co = 'High' THEN 0.85 WHEN co = 'odd' THEN 0.0 ELSE co::DOUBLE END::DOUBLE AS confidence, fallback FROM f"""
)
def screening_decisions(spark, sf):
    k = F.col("o_orderkey")
    c = t(spark, sf, "orders").select(F.concat(F.lit("N"), "o_custkey", F.lit("||"), "o_orderkey").alias("pair_id"), k.alias("k"))
    k = F.col("k")
    cl = F.when(k % 4 == 0, "related").when(k % 4 == 1, "NONE").when(k % 4 == 2, "maybe")
    co = F.when(k % 5 == 0, "85%").when(k % 5 == 1, "High").when(k % 5 == 2, "0.4").when(k % 5 == 3, "odd")
    d = c.where("k % 3 <> 0").select(k.alias("seq"), "pair_id", cl.alias("classification"), co.alias("confidence"))
    d = d.unionByName(c.where("k % 2 = 0").select(F.lit(-1).cast("long").alias("seq"), "pair_id", F.lit("POSSIBLE").alias("classification"), F.lit("0.9").alias("confidence")))
    return replies.screened(c.select("pair_id"), d)
