"""Which nodes and pairs go on to the costly steps: pilots of a document, nearby pairs, ranked pairs, accepted segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _doc():
    return Window.partitionBy("doc_id")


def _units(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("doc_id", "unit").agg(F.count("*").alias("n"), F.min("idx").alias("first"))


def article_pilot(nodes: DataFrame, floor: int = 20, most: int = 25) -> DataFrame:
    """The first nodes (doc_id, idx, unit) of each document's largest unit of at least floor nodes, the earliest of equals: doc_id, unit, idx."""
    best = _units(nodes).where(F.col("n") >= floor).groupBy("doc_id").agg(F.max(F.struct("n", (-F.col("first")).alias("early"), "unit")).alias("best")).select("doc_id", "best.unit")
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy("idx"))
    return nodes.join(best, ["doc_id", "unit"], "left_semi").withColumn("k", k).where(F.col("k") <= most).select("doc_id", "unit", "idx")


def bridge_pilot(nodes: DataFrame, floor: int = 20, most: int = 25) -> DataFrame:
    """Both sides of the boundary between the two neighbouring units whose smaller one is largest: doc_id, unit, idx. The last nodes of the left unit, the first of the right."""
    w = _doc().orderBy("first")
    p = _units(nodes).withColumn("right", F.lead("unit").over(w)).withColumn("nr", F.lead("n").over(w)).where(F.col("n") + F.col("nr") >= floor)
    p = p.groupBy("doc_id").agg(F.max(F.struct(F.least("n", "nr").alias("smaller"), F.col("unit").alias("left"), "right", "n", "nr")).alias("p")).select("doc_id", "p.*")
    p = p.withColumn("a", F.least("n", F.lit(most // 2))).withColumn("b", F.least("nr", F.lit(most) - F.col("a")))
    p = p.withColumn("a", F.when(F.col("a") + F.col("b") < floor, F.least("n", F.lit(most) - F.col("b"))).otherwise(F.col("a")))
    side = F.explode(F.array(F.struct(F.col("left").alias("unit"), F.lit(True).alias("tail"), F.col("a").alias("take")), F.struct(F.col("right").alias("unit"), F.lit(False).alias("tail"), F.col("b").alias("take"))))
    j = nodes.join(p.select("doc_id", side.alias("s")).select("doc_id", "s.*"), ["doc_id", "unit"])
    k = F.row_number().over(Window.partitionBy("doc_id", "unit").orderBy(F.when(F.col("tail"), -F.col("idx")).otherwise(F.col("idx"))))
    return j.withColumn("k", k).where("k <= take").select("doc_id", "unit", "idx")


def section_pilot(nodes: DataFrame, floor: int = 20, most: int = 25, sections: int = 2) -> DataFrame:
    """The first nodes (doc_id, idx, unit; null unit: outside all sections) of the earliest run of sections that reaches floor together with the nodes outside, else of the first ones."""
    outside = nodes.where("unit is null").groupBy("doc_id").agg(F.count("*").alias("outside"))
    w = _doc().orderBy("first")
    u = _units(nodes.where("unit is not null")).withColumn("at", F.row_number().over(w)).withColumn("run", F.sum("n").over(w.rowsBetween(0, sections - 1))).withColumn("in_run", F.count("*").over(w.rowsBetween(0, sections - 1)))
    u = u.join(outside, "doc_id", "left")
    enough = (F.col("in_run") == sections) & (F.col("run") + F.coalesce("outside", F.lit(0)) >= floor)
    u = u.withColumn("start", F.coalesce(F.min(F.when(enough, F.col("at"))).over(_doc()), F.lit(1))).where((F.col("at") >= F.col("start")) & (F.col("at") < F.col("start") + sections))
    j = nodes.join(u.select("doc_id", "unit", F.lit(True).alias("chosen")), ["doc_id", "unit"], "left").where("chosen or unit is null")
    return j.withColumn("k", F.row_number().over(_doc().orderBy("idx"))).where(F.col("k") <= most).select("doc_id", "unit", "idx")


def add_nearby(nodes: DataFrame, pairs: DataFrame, within: int) -> DataFrame:
    """Pairs (doc_id, a, b, reason) united with all pairs of nodes (doc_id, idx, unit) at most `within` places apart: doc_id, a, b, reasons, scope (null for pairs that are not near)."""
    n = nodes.withColumn("at", F.row_number().over(_doc().orderBy("idx")))
    x = n.select("doc_id", F.col("idx").alias("a"), F.col("unit").alias("ua"), F.explode(F.sequence(F.col("at") + 1, F.col("at") + within)).alias("at"))
    near = x.join(n.select("doc_id", "at", F.col("idx").alias("b"), F.col("unit").alias("ub")), ["doc_id", "at"])
    scope = F.when(F.col("ua") == F.col("ub"), "WITHIN_CONTENT_UNIT").when(F.col("ua").isNotNull() & F.col("ub").isNotNull(), "CROSS_CONTENT_UNIT").otherwise("UNSCOPED")
    why = F.array_compact(F.array(F.lit("high_recall_distance_window"), F.when(F.col("ua") == F.col("ub"), "same_content_unit")))
    near = near.select("doc_id", "a", "b", F.explode(why).alias("reason"), scope.alias("scope"))
    all_ = pairs.select("doc_id", "a", "b", "reason", F.lit(None).cast("string").alias("scope")).unionByName(near)
    return all_.groupBy("doc_id", "a", "b").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"), F.max("scope").alias("scope"))


def ranked_pairs(tasks: DataFrame) -> DataFrame:
    """The first `cutoff` of each task's ranking (task, current, ranked, cutoff), each unordered pair once, where it came first: a, b, task, rank."""
    r = tasks.select("task", "current", F.posexplode(F.slice("ranked", F.lit(1), F.greatest(F.lit(0), F.col("cutoff").cast("int")))).alias("rank", "other"))
    first = r.groupBy(F.least("current", "other").alias("a"), F.greatest("current", "other").alias("b")).agg(F.min(F.struct("task", (F.col("rank") + 1).cast("long").alias("rank"))).alias("f"))
    return first.select("a", "b", "f.task", "f.rank")


# Decisions that begin a new item.
STARTS = ["STARTS_NEW_ITEM", "INSERTED_STANDALONE_ITEM"]


def decided_segments(nodes: DataFrame, decisions: DataFrame, at_least: float = 0.8) -> DataFrame:
    """Segments of nodes (doc_id, idx) between accepted boundaries (doc_id, idx of the node after it, decision, confidence, kind): doc_id, segment, boundary, kind, nodes, first, last."""
    d = decisions.where(F.col("decision").isin(STARTS) & (F.coalesce("confidence", F.lit(0.0)) >= at_least)).select("doc_id", "idx", "decision", "kind")
    w = _doc().orderBy("idx")
    n = nodes.select("doc_id", "idx").join(d, ["doc_id", "idx"], "left").withColumn("head", F.lag("idx").over(w).isNull())
    n = n.withColumn("decision", F.when(~F.col("head"), F.col("decision"))).withColumn("segment", F.sum((F.col("head") | F.col("decision").isNotNull()).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = n.groupBy("doc_id", "segment").agg(F.max("decision").alias("decision"), F.max(F.when(F.col("decision").isNotNull(), F.col("kind"))).alias("kind"), F.count("*").alias("nodes"), F.min("idx").alias("first"), F.max("idx").alias("last"))
    first = F.col("segment") == 1
    return g.select("doc_id", "segment", F.coalesce("decision", F.lit("DOCUMENT_START")).alias("boundary"), F.coalesce("kind", F.when(first, "front_matter").otherwise("other")).alias("kind"), "nodes", "first", "last")


def adjacency(groups: DataFrame) -> DataFrame:
    """Groups (doc_id, idx, id) with their place and neighbours."""
    w = _doc().orderBy("idx", "id")
    return groups.select("doc_id", "id", F.row_number().over(w).cast("long").alias("place"), F.lag("id").over(w).alias("previous"), F.lead("id").over(w).alias("following"))


def outer_pages(pages: DataFrame, front: int, back: int) -> DataFrame:
    """The first and last distinct pages (doc_id, page) of each document."""
    p = pages.select("doc_id", "page").distinct()
    a, z = F.row_number().over(_doc().orderBy("page")), F.row_number().over(_doc().orderBy(F.desc("page")))
    return p.withColumn("a", a).withColumn("z", z).where((F.col("a") <= front) | (F.col("z") <= back)).select("doc_id", "page")


def ranking_tasks(pairs: DataFrame) -> DataFrame:
    """Pairs (doc_id, a, b) seen from both ends: each node with its distinct partners in order."""
    both = pairs.select("doc_id", F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e")).select("doc_id", "e.*")
    return both.groupBy("doc_id", "node").agg(F.array_sort(F.collect_set("other")).alias("candidates"))
