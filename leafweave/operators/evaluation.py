"""Scores of predictions against gold labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ratio(a: Column, b: Column) -> Column:
    """0 where the divisor is 0."""
    return F.when(b > 0, a / b).otherwise(0.0)


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def class_metrics(rows: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of every class in gold or pred, and their means in a row `macro`."""
    g = rows.groupBy(F.col("gold").alias("label")).agg(F.count("*").alias("support"), F.sum((F.col("gold") == F.col("pred")).cast("long")).alias("hit"))
    p = rows.groupBy(F.col("pred").alias("label")).agg(F.count("*").alias("said"))
    m = g.join(p, "label", "full").fillna(0)
    pr, re = ratio(F.col("hit"), F.col("said")), ratio(F.col("hit"), F.col("support"))
    m = m.select("label", F.round(pr, 8).alias("precision"), F.round(re, 8).alias("recall"), F.round(f1(pr, re), 8).alias("f1"), "support")
    macro = m.agg(*(F.round(F.avg(k), 6).alias(k) for k in ("precision", "recall", "f1")), F.sum("support").alias("support")).where("support is not null")
    return m.unionByName(macro.withColumn("label", F.lit("macro")))


def paired(rows: DataFrame) -> DataFrame:
    """Paired 2x2 of two models' correctness (old, new booleans) with the exact two-sided binomial p of the discordant pairs."""
    from leafweave.operators.scoring import two_sided

    c = rows.agg(*(F.sum((F.col("old") == a).cast("long") * (F.col("new") == b).cast("long")).alias(k) for k, a, b in (("both_right", True, True), ("only_old", True, False), ("only_new", False, True), ("neither", False, False))))
    return c.withColumn("p_value", F.round(two_sided(F.col("only_old"), F.col("only_new")), 6))


def precise_threshold(rows: DataFrame, least_precision: float = 0.9) -> DataFrame:
    """Of the thresholds .10, .11 ... .99 the one with the best recall among those precise enough (then precision, then threshold); without any, the most precise. rows: score, gold (0/1). One pass, 91 bins."""
    bins = rows.select(F.least(F.lit(89), F.floor((F.col("score") - 0.10) / 0.01 + 1e-9)).cast("int").alias("bin"), "gold").groupBy("bin").agg(F.sum("gold").alias("pos"), F.count("*").alias("n"))
    each = rows.sparkSession.range(90).select(F.col("id").cast("int").alias("i")).crossJoin(F.broadcast(bins))
    total = lambda c, ok: F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0))
    s = each.groupBy("i").agg(total("pos", F.col("bin") >= F.col("i")).alias("tp"), total("n", F.col("bin") >= F.col("i")).alias("said"), F.sum("pos").alias("all_pos"))
    p, r = F.round(F.col("tp") / F.greatest(F.lit(1), "said"), 8), F.round(F.col("tp") / F.greatest(F.lit(1), "all_pos"), 8)
    s = s.select(F.round(0.10 + F.col("i") * 0.01, 2).alias("threshold"), p.alias("precision"), r.alias("recall"))
    best = F.max_by(F.struct("threshold", "precision", "recall"), F.struct(F.when(F.col("precision") >= least_precision, F.col("recall")).otherwise(-1.0).alias("r"), F.col("precision").alias("p"), F.col("threshold").alias("t")))
    return s.agg(best.alias("b")).select("b.*")


def best_threshold(rows: DataFrame) -> DataFrame:
    """Of all scores, 0 and 1 the threshold with the best F1, then precision, recall (each to four places) and threshold. rows: score, gold (0/1).

    A threshold between two scores finds what the upper one finds and is lower, so scores suffice. Counts above a score are
    prefix sums in two levels, by thousandths and within them.
    """
    s = rows.select(F.col("score").cast("double").alias("score"), "gold").unionByName(rows.sparkSession.createDataFrame([(0.0, None), (1.0, None)], "score double, gold int").select("score", F.col("gold").cast(rows.schema["gold"].dataType).alias("gold")))
    c = s.groupBy("score").agg(F.coalesce(F.sum("gold"), F.lit(0)).alias("pos"), F.count("gold").alias("n")).withColumn("slice", F.floor(F.col("score") * 1000))
    above = c.groupBy("slice").agg(F.sum("pos").alias("sp"), F.sum("n").alias("sn"))
    over = Window.orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)  # at most a thousand rows for scores of 0 to 1
    above = above.select("slice", F.coalesce(F.sum("sp").over(over), F.lit(0)).alias("bp"), F.coalesce(F.sum("sn").over(over), F.lit(0)).alias("bn"))
    w = Window.partitionBy("slice").orderBy(F.desc("score"))
    m = c.join(F.broadcast(above), "slice").select("score", (F.col("bp") + F.sum("pos").over(w)).alias("tp"), (F.col("bn") + F.sum("n").over(w)).alias("said"))
    m = m.crossJoin(F.broadcast(c.agg(F.sum("pos").alias("all_pos"))))
    pr, re = ratio(F.col("tp"), F.col("said")), ratio(F.col("tp"), F.col("all_pos"))
    m = m.select(F.col("score").alias("threshold"), F.round(pr, 4).alias("precision"), F.round(re, 4).alias("recall"), F.round(f1(pr, re), 4).alias("f1"))
    return m.agg(F.max_by(F.struct("threshold", "precision", "recall", "f1"), F.struct("f1", "precision", "recall", "threshold")).alias("b")).select("b.*")


def stratified(rows: DataFrame, share: float, salt: str = "small-edge-v1") -> DataFrame:
    """Marks max(1, n * share), rounded half to even, rows of each class, those first by the SHA-256 of salt and id: adds `calibration`.

    A class may hold most rows, so ranks are not taken over a class at once: prefix counts by the digest's first two bytes give
    the slice of the last row that stays, and only within slices are rows ranked.
    """
    d = rows.withColumn("_h", F.sha2(F.concat(F.lit(f"{salt}|"), F.col("id").cast("string")), 256))
    d = d.withColumn("_s", F.substring("_h", 1, 4))
    c = d.groupBy("label", "_s").agg(F.count("*").alias("k"))
    w = Window.partitionBy("label").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)  # at most 65536 slices a label
    c = c.withColumn("before", F.coalesce(F.sum("k").over(w), F.lit(0))).withColumn("n", F.sum("k").over(Window.partitionBy("label")))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("label", "_s").orderBy("_h", "id"))
    return d.join(c.drop("k"), ["label", "_s"]).withColumn("calibration", rank <= F.greatest(F.lit(1), F.bround(F.col("n") * share))).select(*rows.columns, "calibration")


VOTES = ["unilateral_top1", "unilateral_top2", "unilateral_top3", "mutual_top2", "mutual_top3", "mutual_with_top1", "top1_or_mutual_top3", "top2_or_mutual_top3"]


def voting(votes: DataFrame) -> DataFrame:
    """Which strategies select each unordered pair. votes: source, target, rank (1 to 3), among candidates only; a pair has two votes at most."""
    pair = [F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")]
    g = votes.groupBy(*pair).agg(F.min("rank").alias("best"), F.countDistinct("source").alias("sides"), F.countDistinct(F.when(F.col("rank") <= 2, F.col("source"))).alias("sides2"))
    one, two, m2, m3 = F.col("best") == 1, F.col("best") <= 2, F.col("sides2") == 2, F.col("sides") == 2
    return g.select("a", "b", *(c.alias(k) for k, c in zip(VOTES, (one, two, F.lit(True), m2, m3, m3 & one, one | m3, two | m3), strict=True)))


def closed_scores(pairs: DataFrame) -> DataFrame:
    """One row over a closed universe of pairs (gold, found as booleans): tp, fp, fn, tn, precision, recall, f1, accuracy; a share of nothing is 0."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    g, f = F.col("gold"), F.col("found")
    c = pairs.agg(n(g & f).alias("tp"), n(~g & f).alias("fp"), n(g & ~f).alias("fn"), n(~g & ~f).alias("tn"))
    share = lambda a, b: F.when(b > 0, F.round(a / b, 8)).otherwise(0.0)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("*", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"), share(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def set_changes(old: DataFrame, new: DataFrame, gold: DataFrame, tasks: int | None = None) -> DataFrame:
    """Counts of pairs (a, b) added, removed and kept from old to new, and of those that are gold. Pairs may repeat and meet once, in `tasks` tasks where it is given."""
    mark = lambda d, x: d.select("a", "b", *(F.lit(x == y).alias(y) for y in ("old", "new", "gold")))
    p = mark(old, "old").unionByName(mark(new, "new")).unionByName(mark(gold, "gold"))
    p = p.repartition(tasks, "a", "b") if tasks else p
    p = p.groupBy("a", "b").agg(*(F.bool_or(x).alias(x) for x in ("old", "new", "gold")))
    change = F.when(F.col("old") & F.col("new"), "kept").when(F.col("new"), "added").when(F.col("old"), "removed").otherwise("missed")
    return p.groupBy(change.alias("change")).agg(F.count("*").alias("pairs"), F.count_if("gold").alias("gold"))
