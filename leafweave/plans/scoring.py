"""Registered scores, over orders as pairs and their labels, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafweave.operators import scoring
from leafweave.operators.replies import ABSTAIN, FOUR, SPLIT, STRICT
from leafweave.plans.registry import query, t

#: Columns of a pair and what was said of it, in SQL that both engines read.
FIELDS = {
    "id": "o_orderkey",
    "gold": "o_orderkey % 3 = 0",
    "positive": "o_orderkey % 3 = 0",
    "negative": "o_orderkey % 3 = 1",
    "candidate": "o_custkey % 5 <> 0",
    "selected": "o_custkey % 4 = 0 OR o_orderkey % 6 = 0",
    "found": "o_custkey % 4 = 0 OR o_orderkey % 6 = 0",
    "keep": "o_custkey % 7 < 5",
    "distance": "o_custkey % 12",
    "crossing": "o_orderkey % 2 = 0",
    "shared": "o_custkey % 3 = 0",
    "v1": "o_custkey % 2 = 0",
    "v2": "o_custkey % 3 <> 1",
    "baseline": "o_custkey % 5 < 2",
    "expanded": "o_custkey % 5 < 4",
    "mandatory": "o_custkey % 29 = 0",
    "score": "(o_custkey % 100) / 100.0",
    "verdict": "CASE o_custkey % 6 WHEN 0 THEN 'RELATED' WHEN 1 THEN 'POSSIBLE' WHEN 2 THEN 'NONE' WHEN 3 THEN 'NONE' WHEN 4 THEN 'RELATED' END",
    "klass": "CASE o_custkey % 4 WHEN 0 THEN 'RELATION' WHEN 1 THEN 'POSSIBLE_RELATION' ELSE 'CLEARLY_NONE' END",
    "status": "CASE o_custkey % 5 WHEN 0 THEN 'RELATED_STRONG' WHEN 1 THEN 'AMBIGUOUS' WHEN 2 THEN 'UNRELATED' WHEN 3 THEN 'RELATED_STRONG' END",
    "fine": "CASE o_orderkey % 7 WHEN 0 THEN 'ELABORATES' WHEN 1 THEN 'SUPPORTS' WHEN 2 THEN 'EXPLAINS' WHEN 3 THEN 'QUALIFIES' WHEN 4 THEN 'DEPENDS_ON' WHEN 5 THEN 'CONTRASTS_WITH' ELSE 'PROVIDES_CONTEXT_FOR' END",
    "referenced": "o_orderkey % 11 = 0",
    "gold_source": "o_custkey",
    "gold_target": "o_orderkey",
    "resolved": "o_orderkey % 7 <> 4",
    "directed": "o_orderkey % 7 <> 5",
    "input_a": "CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE o_orderkey END",
    "source": "CASE o_custkey % 8 WHEN 0 THEN o_orderkey WHEN 1 THEN NULL ELSE o_custkey END",
    "target": "CASE o_custkey % 8 WHEN 0 THEN o_custkey WHEN 1 THEN NULL ELSE o_orderkey END",
    "gold_exists": "o_orderkey % 5 = 0",
    "said_exists": "CASE o_custkey % 4 WHEN 0 THEN true WHEN 1 THEN NULL ELSE o_orderkey % 10 = 0 END",
}
PAIRS = "x AS (SELECT " + ", ".join(f"{e} AS {k}" for k, e in FIELDS.items()) + " FROM orders)"
N = "count(*) FILTER (WHERE {})"


def _pairs(spark, sf):
    return t(spark, sf, "orders").selectExpr(*(f"{e} as {k}" for k, e in FIELDS.items()))


def _share(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) > 0 THEN round(({a}) / ({b}), 8) ELSE 0.0 END"


PRF = f"{_share('tp', 'tp + fp')} AS precision, {_share('tp', 'tp + fn')} AS recall, {_share('2 * tp', '2 * tp + fp + fn')} AS f1"


@query(
    f"""WITH {PAIRS}, a AS (SELECT {N.format('selected')} AS candidates, count(*) AS pairs, {', '.join(f"{N.format(f'gold AND {v}')} AS {k}_gold, {N.format(f'selected AND gold AND {v}')} AS {k}_found" for k, v in (('overall', 'true'), ('long_distance', 'distance >= 6'), ('cross_section', 'crossing'), ('weak_entity', 'NOT shared')))} FROM x)
SELECT candidates, {', '.join(f'{k}_gold, {k}_found, round({k}_found / nullif({k}_gold, 0), 8) AS {k}_recall' for k in ('overall', 'long_distance', 'cross_section', 'weak_entity'))}, round(1 - candidates / greatest(1, pairs), 8) AS compression FROM a"""
)
def candidate_recall(spark, sf):
    return scoring.candidate_recall(_pairs(spark, sf).withColumnRenamed("crossing", "cross"), 6)


@query(
    f"""WITH {PAIRS}, a AS (SELECT {N.format('selected AND candidate AND gold')} AS tp, {N.format('selected AND NOT (candidate AND gold)')} AS fp, {N.format('NOT selected AND candidate AND gold')} AS fn, {N.format('NOT selected AND candidate AND NOT gold')} AS tn, {N.format('gold')} AS g FROM x)
SELECT tp, fp, fn, tn, {PRF}, {_share('tn', 'tn + fp')} AS specificity, {_share('tp', 'g')} AS end_to_end_recall FROM a"""
)
def selection_scores(spark, sf):
    return scoring.selection_scores(_pairs(spark, sf))


@query(
    f"""WITH {PAIRS}, a AS (SELECT {N.format('keep AND gold')} AS tp, {N.format('keep AND NOT gold')} AS fp, {N.format('NOT keep AND gold')} AS true_rejected, {N.format('NOT keep AND NOT gold')} AS false_rejected FROM x WHERE selected)
SELECT *, {_share('tp', 'tp + fp')} AS precision, {_share('tp', 'tp + true_rejected')} AS recall_within, round(tp / 5000, 8) AS end_to_end_recall, {_share('2 * tp', 'tp + fp + 5000')} AS end_to_end_f1 FROM a"""
)
def validation_scores(spark, sf):
    return scoring.validation_scores(_pairs(spark, sf).where("selected"), 5000)


@query(f"WITH {PAIRS}, a AS (SELECT {N.format('found')} AS found, {N.format('found AND positive')} AS tp, {N.format('found AND negative')} AS fp, {N.format('NOT found AND positive')} AS fn, {N.format('NOT found AND negative')} AS tn FROM x) SELECT *, {PRF} FROM a")
def open_world_scores(spark, sf):
    return scoring.open_scores(_pairs(spark, sf))


@query(
    f"""WITH {PAIRS}, v AS (SELECT gold, 'v1' AS version, v1 AS f FROM x UNION ALL SELECT gold, 'v2', v2 FROM x), a AS (SELECT version, {N.format('gold AND f')} AS tp, {N.format('NOT gold AND f')} AS fp, {N.format('gold AND NOT f')} AS fn, {N.format('NOT gold AND NOT f')} AS tn FROM v GROUP BY version)
SELECT version, tp, fp, fn, tn, {PRF} FROM a"""
)
def prompt_version_scores(spark, sf):
    return scoring.version_scores(_pairs(spark, sf), ["v1", "v2"])


@query(
    f"""WITH {PAIRS}, y AS (SELECT *, coalesce(verdict IN ('RELATED', 'POSSIBLE'), false) AS sent FROM x), a AS (SELECT {N.format('candidate')} AS candidates, count(verdict) AS decisions, {N.format('candidate AND positive')} AS cg, {N.format('sent')} AS forwarded, {N.format('sent AND positive')} AS tp, {N.format('sent AND negative')} AS fp, {N.format('NOT sent AND positive')} AS fn FROM y)
SELECT decisions = candidates AS complete, candidates, {_share('cg', 'tp + fn')} AS candidate_recall, forwarded, round(1 - forwarded / greatest(1, candidates), 8) AS reduction, tp, fp, fn, {_share('tp', 'tp + fn')} AS recall, {_share('tp', 'tp + fp')} AS precision, decisions = candidates AND tp / (tp + fn) >= 0.9 AND forwarded <= 180 AS passed FROM a"""
)
def screening_gate(spark, sf):
    return scoring.screening_gate(_pairs(spark, sf).withColumnRenamed("verdict", "classification"), 0.9, 180)


@query(
    f"""WITH {PAIRS}, y AS (SELECT *, klass IN ('RELATION', 'POSSIBLE_RELATION') AS sent FROM x), a AS (SELECT count(*) AS evaluated, {N.format('positive')} AS gold, {N.format('sent')} AS forwarded, {N.format('sent AND positive')} AS tp, {N.format('sent AND negative')} AS fp, {N.format("klass = 'RELATION'")} AS relation, {N.format("klass = 'POSSIBLE_RELATION'")} AS possible_relation, {N.format("klass = 'CLEARLY_NONE'")} AS clearly_none FROM y)
SELECT *, {_share('tp', 'gold')} AS recall, {_share('tp', 'tp + fp')} AS precision FROM a"""
)
def proposal_forwarding(spark, sf):
    return scoring.forwarding(_pairs(spark, sf).withColumnRenamed("klass", "classification"))


@query(f"WITH {PAIRS}, a AS (SELECT {N.format('baseline')} AS baseline, {N.format('expanded')} AS expanded, {N.format('gold')} AS gold, {N.format('baseline AND gold')} AS baseline_found, {N.format('expanded AND gold')} AS expanded_found FROM x) SELECT *, {_share('baseline_found', 'gold')} AS baseline_recall, {_share('expanded_found', 'gold')} AS expanded_recall FROM a")
def expansion_recall(spark, sf):
    return scoring.expansion_recall(_pairs(spark, sf))


@query(
    f"""WITH {PAIRS}, h AS (SELECT unnest([0.5, 0.6, 0.7, 0.8])::DOUBLE AS threshold), y AS (SELECT threshold, gold, candidate, (coalesce(verdict <> 'NONE', false) AND score >= threshold) OR mandatory AS sent FROM x, h),
a AS (SELECT threshold, {N.format('sent')} AS forwarded, {N.format('sent AND gold')} AS found, {N.format('gold')} AS gold, {N.format('gold AND candidate')} AS retrieved FROM y GROUP BY threshold)
SELECT threshold, forwarded, found, gold, {_share('found', 'gold')} AS recall_all, {_share('found', 'retrieved')} AS recall_retrieved FROM a"""
)
def forwarding_thresholds(spark, sf):
    x = _pairs(spark, sf).withColumn("typed", F.col("verdict") != "NONE").withColumn("confidence", F.col("score").cast("double"))
    return scoring.forwarding_by_threshold(x, [0.5, 0.6, 0.7, 0.8])


@query(
    f"""WITH {PAIRS}, h AS (SELECT unnest([0.1, 0.25, 0.5])::DOUBLE AS threshold), a AS (SELECT threshold, {N.format('gold AND score >= threshold')} AS tp, {N.format('NOT gold AND score >= threshold')} AS fp, {N.format('gold AND score < threshold')} AS fn FROM x, h GROUP BY threshold)
SELECT threshold, tp, fp, fn, {PRF} FROM a"""
)
def detection_thresholds(spark, sf):
    return scoring.detection_scores(_pairs(spark, sf).select(F.col("gold").alias("label"), F.col("score").cast("double").alias("score")), [0.10, 0.25, 0.50])


SEVERAL = "s AS (SELECT user_id AS task_id, event_id AS seq, event_type AS status, event_id % 3 = 0 AS valid FROM events)"


@query(f"WITH {SEVERAL} SELECT task_id, seq, status, valid FROM s QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY NOT valid, seq) = 1")
def first_valid_predictions(spark, sf):
    e = t(spark, sf, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), (F.col("event_id") % 3 == 0).alias("valid"))
    return scoring.first_valid(e, "task_id")


@query(
    f"""WITH {PAIRS}, y AS (SELECT gold, coalesce(status, 'INVALID') AS s FROM x), a AS (SELECT {N.format("gold AND s = 'RELATED_STRONG'")} AS tp, {N.format("NOT gold AND s = 'RELATED_STRONG'")} AS fp, {N.format("NOT gold AND s <> 'RELATED_STRONG'")} AS tn, {N.format("gold AND s <> 'RELATED_STRONG'")} AS fn, {N.format("s = 'AMBIGUOUS'")} AS ambiguous, {N.format("s = 'AMBIGUOUS' AND gold")} AS ambiguous_gold, {N.format("s = 'INVALID'")} AS invalid FROM y)
SELECT *, {PRF}, {_share('tn', 'tn + fp')} AS specificity, {_share('tp + tn', 'tp + fp + tn + fn')} AS accuracy, round(tp / 36, 8) AS end_to_end_recall FROM a"""
)
def existence_scores(spark, sf):
    return scoring.existence_scores(_pairs(spark, sf), 36)


# --- typed relations ----------------------------------------------------------------------------

TYPES = {
    "split": (SPLIT, "CASE o_orderkey % 5 WHEN 0 THEN 'SUPPORTS' WHEN 1 THEN 'EXPLAINS_OR_ELABORATES' WHEN 2 THEN 'MODIFIES' ELSE 'CONTRASTS_WITH' END", "CASE o_custkey % 7 WHEN 0 THEN 'SUPPORTS' WHEN 1 THEN 'EXPLAINS_OR_ELABORATES' WHEN 2 THEN 'MODIFIES' WHEN 3 THEN 'CONTRASTS_WITH' WHEN 4 THEN 'REJECT_UNCERTAIN' WHEN 5 THEN 'SUPPORTS' END"),
    "coarse": (["EXPANDS", "SUPPORTS", "CONDITIONS", "CONTRASTS_WITH"], "CASE o_orderkey % 6 WHEN 0 THEN 'EXPANDS' WHEN 1 THEN 'SUPPORTS' WHEN 2 THEN 'CONDITIONS' WHEN 3 THEN 'CONTRASTS_WITH' ELSE 'EXPANDS' END", "CASE o_custkey % 5 WHEN 0 THEN 'EXPANDS' WHEN 1 THEN 'SUPPORTS' WHEN 2 THEN 'CONDITIONS' WHEN 3 THEN 'CONTRASTS_WITH' END"),
    "four_class": (FOUR, "CASE o_orderkey % 6 WHEN 0 THEN 'CONTRIBUTES_TO' WHEN 1 THEN 'MODIFIES' WHEN 2 THEN 'REFERENCES' WHEN 3 THEN 'CONTRASTS_WITH' ELSE 'CONTRIBUTES_TO' END", "CASE o_custkey % 6 WHEN 0 THEN 'CONTRIBUTES_TO' WHEN 1 THEN 'MODIFIES' WHEN 2 THEN 'CONTRASTS_WITH' WHEN 3 THEN 'REFERENCES' WHEN 4 THEN 'REJECT_UNCERTAIN' END"),
    "strict": (STRICT, "CASE o_orderkey % 6 WHEN 0 THEN 'ELABORATES' WHEN 1 THEN 'SUPPORTS' WHEN 2 THEN 'EXPLAINS' WHEN 3 THEN 'QUALIFIES' WHEN 4 THEN 'DEPENDS_ON' ELSE 'CONTRASTS_WITH' END", "CASE o_custkey % 9 WHEN 0 THEN 'SUPPORTS' WHEN 1 THEN 'EXPLAINS' WHEN 2 THEN 'QUALIFIES' WHEN 3 THEN 'CONTRASTS_WITH' WHEN 4 THEN NULL ELSE 'ELABORATES' END"),
}


def _typed_sql(kind: str) -> str:
    _, gold, said = TYPES[kind]
    return f"""{PAIRS}, o AS (SELECT o_orderkey AS id, {gold} AS gold_type, {said} AS type FROM orders),
y AS (SELECT x.*, gold_type, coalesce(type, 'INVALID') AS predicted, coalesce(type, 'INVALID') = gold_type AS tr, coalesce(source = gold_source AND target = gold_target, false) AS wr FROM x JOIN o USING (id)),
z AS (SELECT *, tr AND (NOT directed OR wr) AS ex FROM y)"""


def _report_sql(kind: str) -> str:
    return f"""WITH {_typed_sql(kind)}, a AS (SELECT count(*) AS pairs, {N.format('resolved')} AS evaluated, {N.format('resolved AND directed')} AS directed, {N.format('resolved AND tr')} AS k, {N.format('resolved AND directed AND wr')} AS w, {N.format('resolved AND ex')} AS e, {N.format("predicted = 'REJECT_UNCERTAIN'")} AS abstained, {N.format("predicted = 'INVALID'")} AS invalid FROM z)
SELECT pairs, evaluated, pairs - evaluated AS unresolved, directed, {_share('k', 'evaluated')} AS type_accuracy, {_share('w', 'directed')} AS direction_accuracy, {_share('e', 'evaluated')} AS exact_accuracy, abstained, invalid FROM a"""


def _classes_sql(kind: str) -> str:
    labels = ", ".join(f"('{x}')" for x in TYPES[kind][0])
    return f"""WITH {_typed_sql(kind)}, l(label) AS (VALUES {labels}), a AS (SELECT label, {N.format('gold_type = label')} AS support, {N.format('predicted = label')} AS said, {N.format('gold_type = label AND predicted = label')} AS tp FROM l, z WHERE resolved GROUP BY label),
m AS (SELECT label, support, said, {_share('tp', 'said')} AS precision, {_share('tp', 'support')} AS recall, {_share('2 * tp', 'said + support')} AS f1 FROM a)
SELECT * FROM m UNION ALL SELECT 'macro', sum(support)::BIGINT, sum(said)::BIGINT, round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6) FROM m"""


def _typed(spark, sf, kind):
    _, gold, said = TYPES[kind]
    o = t(spark, sf, "orders").selectExpr(*(f"{e} as {k}" for k, e in FIELDS.items()), f"{gold} as gold_type", f"{said} as type")
    return scoring.typed(o)


@query(_report_sql("split"))
def split_report(spark, sf):
    return scoring.typed_report(_typed(spark, sf, "split"))


@query(_classes_sql("split"))
def split_classes(spark, sf):
    return scoring.typed_classes(_typed(spark, sf, "split"), SPLIT)


@query(f"WITH {_typed_sql('split')} SELECT gold_type AS gold, predicted, count(*) AS pairs FROM z WHERE resolved GROUP BY ALL")
def split_confusion(spark, sf):
    return scoring.typed_confusion(_typed(spark, sf, "split"))


@query(
    f"""WITH {PAIRS}, y AS (SELECT *, coalesce(said_exists, false) AS p, coalesce(source = gold_source AND target = gold_target, false) AS wr, coalesce(said_exists = gold_exists, false) AS xr FROM x),
a AS (SELECT count(*) AS pairs, {N.format('gold_exists')} AS gold, {N.format('p')} AS said, {N.format('p AND gold_exists')} AS tp, {N.format('xr')} AS xx, {N.format('gold_exists AND p AND wr')} AS w, {N.format('CASE WHEN gold_exists THEN p AND wr ELSE xr END')} AS e FROM y)
SELECT pairs, gold, said, tp, {_share('tp', 'said')} AS precision, {_share('tp', 'gold')} AS recall, {_share('2 * tp', 'said + gold')} AS f1, {_share('xx', 'pairs')} AS existence_accuracy, {_share('w', 'gold')} AS direction_accuracy, {_share('e', 'pairs')} AS exact_accuracy FROM a"""
)
def reference_report(spark, sf):
    return scoring.reference_report(_pairs(spark, sf).withColumnRenamed("said_exists", "exists"))


@query(
    f"""WITH {_typed_sql('split')}, y2 AS (SELECT ex, CASE WHEN gold_exists THEN coalesce(said_exists, false) AND wr ELSE coalesce(said_exists = gold_exists, false) END AS rx FROM z WHERE resolved)
SELECT count(*) AS pairs, {N.format('ex AND rx')} AS "both", {N.format('ex AND NOT rx')} AS only_one, {N.format('NOT ex AND rx')} AS only_other, {N.format('NOT ex AND NOT rx')} AS neither FROM y2"""
)
def split_joint(spark, sf):
    x = _typed(spark, sf, "split").where("resolved")
    way = F.coalesce((F.col("source") == F.col("gold_source")) & (F.col("target") == F.col("gold_target")), F.lit(False))
    x = x.withColumn("reference_exact", F.when(F.col("gold_exists"), F.coalesce("said_exists", F.lit(False)) & way).otherwise(F.col("said_exists") == F.col("gold_exists")))
    return scoring.two_by_two(x, "exact", "reference_exact")


@query(_report_sql("four_class"))
def four_class_report(spark, sf):
    return scoring.typed_report(_typed(spark, sf, "four_class"))


@query(_classes_sql("four_class"))
def four_class_classes(spark, sf):
    return scoring.typed_classes(_typed(spark, sf, "four_class"), FOUR)


@query(
    f"""WITH {_typed_sql('four_class')}, l(label) AS (VALUES {', '.join(f"('{x}')" for x in [*FOUR, ABSTAIN, 'INVALID'])}), a AS (SELECT label, {N.format('predicted = label')} AS k, {N.format('predicted = label AND resolved')} AS r FROM l, z GROUP BY label)
SELECT label AS predicted, {_share('k', '(SELECT count(*) FROM z)')} AS of_all, {_share('r', '(SELECT count(*) FROM z WHERE resolved)')} AS of_evaluated FROM a"""
)
def four_class_shares(spark, sf):
    return scoring.label_shares(_typed(spark, sf, "four_class"), [*FOUR, ABSTAIN, scoring.INVALID])


@query(f"WITH {PAIRS}, a AS (SELECT {N.format('source = input_a')} AS first, count(source) AS aimed FROM x) SELECT *, {_share('first', 'aimed')} AS rate FROM a")
def order_bias(spark, sf):
    return scoring.order_bias(_pairs(spark, sf))


@query(_report_sql("coarse"))
def coarse_report(spark, sf):
    return scoring.typed_report(_typed(spark, sf, "coarse"))


@query(_classes_sql("coarse"))
def coarse_classes(spark, sf):
    return scoring.typed_classes(_typed(spark, sf, "coarse"), TYPES["coarse"][0])


IS_C, SAID_C = "gold_type = 'CONTRASTS_WITH'", "predicted = 'CONTRASTS_WITH'"


@query(f"WITH {_typed_sql('coarse')}, a AS (SELECT {N.format(f'{IS_C} AND {SAID_C}')} AS tp, {N.format(f'NOT {IS_C} AND {SAID_C}')} AS fp, {N.format(f'{IS_C} AND NOT {SAID_C}')} AS fn FROM z WHERE resolved) SELECT tp, fp, fn, {_share('tp', 'tp + fp')} AS precision, {_share('tp', 'tp + fn')} AS recall FROM a")
def contrast_detection(spark, sf):
    return scoring.class_detection(_typed(spark, sf, "coarse"), "CONTRASTS_WITH")


@query(_report_sql("strict"))
def strict_report(spark, sf):
    return scoring.typed_report(_typed(spark, sf, "strict"))


@query(_classes_sql("strict"))
def strict_classes(spark, sf):
    return scoring.typed_classes(_typed(spark, sf, "strict"), STRICT)


@query(
    f"""WITH {PAIRS} SELECT fine, referenced, CASE fine WHEN 'ELABORATES' THEN 'EXPANDS' WHEN 'EXPLAINS' THEN 'EXPANDS' WHEN 'SUPPORTS' THEN 'SUPPORTS' WHEN 'QUALIFIES' THEN 'CONDITIONS' WHEN 'DEPENDS_ON' THEN 'CONDITIONS' WHEN 'CONTRASTS_WITH' THEN 'CONTRASTS_WITH' END AS coarse,
  CASE WHEN fine = 'DEPENDS_ON' THEN NULL WHEN fine = 'CONTRASTS_WITH' THEN fine WHEN referenced THEN 'REFERENCES' WHEN fine = 'QUALIFIES' THEN 'MODIFIES' ELSE 'CONTRIBUTES_TO' END AS four, count(*) AS pairs FROM x GROUP BY ALL"""
)
def gold_label_maps(spark, sf):
    f = F.col("fine")
    x = _pairs(spark, sf).select("fine", "referenced", scoring.coarse_relation(f).alias("coarse"), scoring.four_class_truth(f, F.col("referenced")).alias("four"))
    return x.groupBy("fine", "referenced", "coarse", "four").agg(F.count("*").alias("pairs"))


MODELS = "m AS (SELECT l_orderkey AS task_id, 'm' || l_linenumber AS model, (l_partkey + l_linenumber) % 3 = 0 AS exact FROM lineitem WHERE l_linenumber <= 4)"


@query(f"WITH {MODELS}, j AS (SELECT a.model AS model_a, b.model AS model_b, a.exact AS p, b.exact AS q FROM m a JOIN m b USING (task_id) WHERE a.model < b.model) SELECT model_a, model_b, count(*) AS pairs, {N.format('p AND q')} AS \"both\", {N.format('p AND NOT q')} AS only_one, {N.format('NOT p AND q')} AS only_other, {N.format('NOT p AND NOT q')} AS neither FROM j GROUP BY ALL")
def model_pair_comparisons(spark, sf):
    m = t(spark, sf, "lineitem").where("l_linenumber <= 4").select(F.col("l_orderkey").alias("task_id"), F.concat(F.lit("m"), "l_linenumber").alias("model"), ((F.col("l_partkey") + F.col("l_linenumber")) % 3 == 0).alias("exact"))
    return scoring.model_pairs(m)


@query(
    f"""WITH {PAIRS}, a AS (SELECT o.gold, {N.format('v1 AND v2')} AS "both", {N.format('v1 AND NOT v2')} AS only_one, {N.format('NOT v1 AND v2')} AS only_other, {N.format('NOT v1 AND NOT v2')} AS neither, count(*) AS pairs FROM (SELECT *, id % 500 AS block FROM x) o GROUP BY o.gold, block, id % 7)
SELECT count(*) AS groups, sum(pairs)::BIGINT AS pairs, round(sum(CASE WHEN only_one + only_other = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(only_one + only_other + 1) - lgamma(i + 1) - lgamma(only_one + only_other - i + 1) - (only_one + only_other) * ln(2))) FROM generate_series(0, least(only_one, only_other)) u(i))) END), 3) AS p_total FROM a"""
)
def paired_p_values(spark, sf):
    x = _pairs(spark, sf).withColumn("block", F.col("id") % 500).withColumn("seventh", F.col("id") % 7)
    r = scoring.two_by_two(x, "v1", "v2", "gold", "block", "seventh")
    return r.agg(F.count("*").alias("groups"), F.sum("pairs").alias("pairs"), F.round(F.sum(scoring.two_sided(F.col("only_one"), F.col("only_other"))), 3).alias("p_total"))


ITEMS = """a AS (SELECT o_custkey AS doc_id, row_number() OVER w AS document_order, o_orderkey AS k FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
n AS (SELECT doc_id, document_order, sum(CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY document_order) AS item, k FROM a),
r AS (SELECT doc_id, document_order AS start, CASE WHEN k % 2 = 0 THEN 'article' ELSE 'advert' END AS kind FROM a WHERE document_order = 1 OR k % 6 = 0 OR k % 15 = 1),
e AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start) - 1, (SELECT max(document_order) FROM a WHERE a.doc_id = r.doc_id)) AS stop FROM r),
j AS (SELECT e.doc_id, e.start, e.stop, e.kind, (SELECT count(DISTINCT item) FROM n WHERE n.doc_id = e.doc_id AND n.document_order BETWEEN e.start AND e.stop) AS segments,
  (SELECT p.item FROM n p WHERE p.doc_id = e.doc_id AND p.document_order = e.start - 1) IS DISTINCT FROM (SELECT p.item FROM n p WHERE p.doc_id = e.doc_id AND p.document_order = e.start) AS before_,
  (SELECT p.item FROM n p WHERE p.doc_id = e.doc_id AND p.document_order = e.stop + 1) IS DISTINCT FROM (SELECT p.item FROM n p WHERE p.doc_id = e.doc_id AND p.document_order = e.stop) AS after_ FROM e)"""


def _items(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    a = t(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.row_number().over(w).cast("long").alias("document_order"), F.col("o_orderkey").alias("k"))
    n = a.withColumn("item", F.sum((F.col("k") % 3 == 0).cast("long")).over(Window.partitionBy("doc_id").orderBy("document_order")))
    r = a.where("document_order = 1 or k % 6 = 0 or k % 15 = 1").select("doc_id", F.col("document_order").alias("start"), F.when(F.col("k") % 2 == 0, "article").otherwise("advert").alias("kind"))
    return scoring.separated_items(r, n)


@query(f"WITH {ITEMS} SELECT doc_id, start, stop AS \"end\", kind, before_ AS before, after_ AS after, segments, before_ AND after_ AND segments = 1 AS clean FROM j")
def separated_items(spark, sf):
    return _items(spark, sf)


@query(f"WITH {ITEMS}, s AS (SELECT kind, before_ AND after_ AND segments = 1 AS clean FROM j) SELECT coalesce(kind, 'all') AS kind, count(*) AS reference, {N.format('clean')} AS clean FROM s GROUP BY ROLLUP (kind)")
def separation_summary(spark, sf):
    return scoring.separation_summary(_items(spark, sf))
