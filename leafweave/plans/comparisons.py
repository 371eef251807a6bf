"""Registered queries that compare edges, selections and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafweave.operators import evaluation, graph, selection
from leafweave.plans.decisions import QUOTA, _pairs
from leafweave.plans.registry import query, t, tasks_for


@query(
    """WITH e AS (SELECT l_orderkey * 100 + l_linenumber AS seq, l_partkey AS source, l_suppkey AS target, l_returnflag AS cue, (l_quantity::INT % 20) / 20.0 AS confidence FROM lineitem)
SELECT source, target, count(*) AS n, max(confidence)::DOUBLE AS confidence, min(seq) FILTER (WHERE confidence = top) AS seq FROM (SELECT *, max(confidence) OVER (PARTITION BY source, target) AS top FROM e WHERE source <> target) GROUP BY source, target"""
)
def strongest_edges(spark, sf):
    e = t(spark, sf, "lineitem").select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"), F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), F.col("l_returnflag").alias("cue"), (F.col("l_quantity").cast("int") % 20 / 20.0).cast("double").alias("confidence"))
    n = e.where("source <> target").groupBy("source", "target").agg(F.count("*").alias("n"))
    return graph.strongest_edges(e).join(n, ["source", "target"]).select("source", "target", "n", "confidence", "seq")


@query(
    """WITH p AS (SELECT o_orderkey % 3 = 0 AS gold, o_custkey % 4 = 0 AS found FROM orders), c AS (SELECT count(*) FILTER (WHERE gold AND found) AS tp, count(*) FILTER (WHERE found AND NOT gold) AS fp, count(*) FILTER (WHERE gold AND NOT found) AS fn, count(*) FILTER (WHERE NOT gold AND NOT found) AS tn FROM p)
SELECT *, round(tp / (tp + fp), 8) AS precision, round(tp / (tp + fn), 8) AS recall, round(2 * tp / (2 * tp + fp + fn), 8) AS f1, round((tp + tn) / (tp + fp + fn + tn), 8) AS accuracy FROM c"""
)
def closed_universe_scores(spark, sf):
    return evaluation.closed_scores(t(spark, sf, "orders").select((F.col("o_orderkey") % 3 == 0).alias("gold"), (F.col("o_custkey") % 4 == 0).alias("found")))


@query(
    """WITH p AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b, l_linenumber AS n FROM lineitem), m AS (SELECT a, b, bool_or(n <= 3) AS old, bool_or(n BETWEEN 2 AND 5) AS new, bool_or(n >= 5) AS gold FROM p GROUP BY a, b)
SELECT CASE WHEN old AND new THEN 'kept' WHEN new THEN 'added' WHEN old THEN 'removed' ELSE 'missed' END AS change, count(*) AS pairs, count(*) FILTER (WHERE gold) AS gold FROM m GROUP BY 1"""
)
def candidate_set_changes(spark, sf):
    p = t(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_linenumber").alias("n"))
    return evaluation.set_changes(p.where("n <= 3"), p.where("n between 2 and 5"), p.where("n >= 5"), tasks_for(p, 2))


@query(f"WITH {QUOTA} SELECT doc_id, node, count(DISTINCT other) AS n, array_to_string(list_sort(list(DISTINCT other)), ',') AS candidates FROM i GROUP BY doc_id, node")
def ranking_tasks(spark, sf):
    r = selection.ranking_tasks(_pairs(spark, sf))
    return r.select("doc_id", "node", F.size("candidates").cast("long").alias("n"), F.array_join(F.col("candidates").cast("array<string>"), ",").alias("candidates"))


@query("SELECT l_orderkey AS page, bool_or(l_returnflag = 'R') AS any_commercial, bool_and(l_returnflag = 'R') AS all_commercial FROM lineitem GROUP BY l_orderkey")
def page_truth(spark, sf):
    c = F.col("l_returnflag") == "R"
    return t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.bool_or(c).alias("any_commercial"), F.bool_and(c).alias("all_commercial"))
