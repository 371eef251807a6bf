"""Scores of selected pairs, of typed relations and of screening, as conditional counts in one pass over rows.

A share of nothing is 0 unless said otherwise. Shares are rounded to eight places, so that neither a sum's order nor an
engine's division shows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafweave.operators.replies import ABSTAIN, COARSE, FOUR, SPLIT, STRICT

INVALID = "INVALID"


def n(c: Column) -> Column:
    """How many rows hold."""
    return F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0))


def share(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.round(a / b, 8)).otherwise(0.0)


def share_or_null(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.round(a / b, 8))


def harmonic(tp: Column, said: Column, true: Column) -> Column:
    """F1 of counts."""
    return share(2 * tp, said + true)


def c(*names: str) -> list[Column]:
    return [F.col(x) for x in names]


def confusion_counts(rows: DataFrame, gold: Column, found: Column, *by: str) -> DataFrame:
    g = rows.groupBy(*by) if by else rows
    return g.agg(n(gold & found).alias("tp"), n(~gold & found).alias("fp"), n(gold & ~found).alias("fn"), n(~gold & ~found).alias("tn"))


def candidate_recall(pairs: DataFrame, far: int) -> DataFrame:
    """Of the gold pairs, and of those far apart, across sections, without a shared entity: how many are selected; null shares of none. pairs: selected, gold, distance, cross, shared."""
    s, g = c("selected", "gold")
    kinds = {"overall": F.lit(True), "long_distance": F.col("distance") >= far, "cross_section": F.col("cross"), "weak_entity": ~F.col("shared")}
    counts = [n(s).alias("candidates"), F.count("*").alias("pairs")] + [x for k, v in kinds.items() for x in (n(g & v).alias(f"{k}_gold"), n(s & g & v).alias(f"{k}_found"))]
    r = pairs.agg(*counts)
    return r.select("candidates", *(x for k in kinds for x in (f"{k}_gold", f"{k}_found", share_or_null(F.col(f"{k}_found"), F.col(f"{k}_gold")).alias(f"{k}_recall"))), F.round(1 - F.col("candidates") / F.greatest(F.lit(1), "pairs"), 8).alias("compression"))


def selection_scores(pairs: DataFrame) -> DataFrame:
    """Selected pairs in the closed world of candidates; the last share is of all gold. pairs: selected, candidate, gold."""
    s, k, g = c("selected", "candidate", "gold")
    r = pairs.agg(n(s & k & g).alias("tp"), n(s & ~(k & g)).alias("fp"), n(~s & k & g).alias("fn"), n(~s & k & ~g).alias("tn"), n(g).alias("all_gold"))
    tp, fp, fn, tn = c("tp", "fp", "fn", "tn")
    return r.select("tp", "fp", "fn", "tn", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), harmonic(tp, tp + fp, tp + fn).alias("f1"), share(tn, tn + fp).alias("specificity"), share(tp, F.col("all_gold")).alias("end_to_end_recall"))


def validation_scores(edges: DataFrame, all_gold: int) -> DataFrame:
    """What a stricter check left of edges, against all gold relations there are. edges: keep, gold."""
    k, g = c("keep", "gold")
    r = edges.agg(n(k & g).alias("tp"), n(k & ~g).alias("fp"), n(~k & g).alias("true_rejected"), n(~k & ~g).alias("false_rejected"))
    tp, fp = c("tp", "fp")
    return r.select("*", share(tp, tp + fp).alias("precision"), share(tp, tp + F.col("true_rejected")).alias("recall_within"), share(tp, F.lit(all_gold)).alias("end_to_end_recall"), harmonic(tp, tp + fp, F.lit(all_gold)).alias("end_to_end_f1"))


def open_scores(pairs: DataFrame) -> DataFrame:
    """Scores where only annotated negatives are wrong: found pairs of no label count for nothing. pairs: found, positive, negative."""
    f, p, m = c("found", "positive", "negative")
    r = pairs.agg(n(f).alias("found"), n(f & p).alias("tp"), n(f & m).alias("fp"), n(~f & p).alias("fn"), n(~f & m).alias("tn"))
    tp, fp, fn = c("tp", "fp", "fn")
    return r.select("*", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), harmonic(tp, tp + fp, tp + fn).alias("f1"))


def version_scores(rows: DataFrame, versions: list[str]) -> DataFrame:
    """One row for each version of a prediction (a boolean column) over the same gold."""
    each = rows.select("gold", F.explode(F.array(*(F.struct(F.lit(v).alias("version"), F.col(v).alias("found")) for v in versions))).alias("v")).select("gold", "v.*")
    r = confusion_counts(each, F.col("gold"), F.col("found"), "version")
    tp, fp, fn = c("tp", "fp", "fn")
    return r.select("version", "tp", "fp", "fn", "tn", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), harmonic(tp, tp + fp, tp + fn).alias("f1"))


def screening_gate(pairs: DataFrame, least_recall: float, most_forwarded: int) -> DataFrame:
    """Whether screening forwarded enough gold and few enough pairs, every candidate being decided. pairs: candidate, classification (null undecided), positive, negative."""
    sent = F.coalesce(F.col("classification").isin("RELATED", "POSSIBLE"), F.lit(False))
    k, p, m = c("candidate", "positive", "negative")
    r = pairs.agg(n(k).alias("candidates"), n(F.col("classification").isNotNull()).alias("decisions"), n(k & p).alias("candidate_gold"), n(sent).alias("forwarded"), n(sent & p).alias("tp"), n(sent & m).alias("fp"), n(~sent & p).alias("fn"))
    tp, fp, fn = c("tp", "fp", "fn")
    complete = F.col("decisions") == F.col("candidates")
    recall = share(tp, tp + fn)
    return r.select(complete.alias("complete"), "candidates", share(F.col("candidate_gold"), tp + fn).alias("candidate_recall"), "forwarded", F.round(1 - F.col("forwarded") / F.greatest(F.lit(1), "candidates"), 8).alias("reduction"), "tp", "fp", "fn", recall.alias("recall"), share(tp, tp + fp).alias("precision"), (complete & (recall >= least_recall) & (F.col("forwarded") <= most_forwarded)).alias("passed"))


def forwarding(pairs: DataFrame) -> DataFrame:
    """Recall and precision of forwarded pairs, with counts of classes. pairs: classification, positive, negative."""
    k, p, m = c("classification", "positive", "negative")
    sent = k.isin("RELATION", "POSSIBLE_RELATION")
    r = pairs.agg(F.count("*").alias("evaluated"), n(p).alias("gold"), n(sent).alias("forwarded"), n(sent & p).alias("tp"), n(sent & m).alias("fp"), *(n(k == x).alias(x.lower()) for x in ("RELATION", "POSSIBLE_RELATION", "CLEARLY_NONE")))
    return r.select("*", share(F.col("tp"), F.col("gold")).alias("recall"), share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))


def expansion_recall(pairs: DataFrame) -> DataFrame:
    """How much gold candidates hold before and after their expansion. pairs: baseline, expanded, gold."""
    b, e, g = c("baseline", "expanded", "gold")
    r = pairs.agg(n(b).alias("baseline"), n(e).alias("expanded"), n(g).alias("gold"), n(b & g).alias("baseline_found"), n(e & g).alias("expanded_found"))
    return r.select("*", share(F.col("baseline_found"), F.col("gold")).alias("baseline_recall"), share(F.col("expanded_found"), F.col("gold")).alias("expanded_recall"))


def forwarding_by_threshold(pairs: DataFrame, thresholds: list[float]) -> DataFrame:
    """Gold forwarded at each threshold: typed pairs of that confidence, and mandatory ones. pairs: typed, confidence, mandatory, candidate, gold."""
    r = pairs.select("*", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    sent = F.coalesce(F.col("typed") & (F.col("confidence") >= F.col("threshold")), F.lit(False)) | F.col("mandatory")
    r = r.groupBy("threshold").agg(n(sent).alias("forwarded"), n(sent & F.col("gold")).alias("found"), n(F.col("gold")).alias("gold"), n(F.col("gold") & F.col("candidate")).alias("retrieved"))
    return r.select("threshold", "forwarded", "found", "gold", share(F.col("found"), F.col("gold")).alias("recall_all"), share(F.col("found"), F.col("retrieved")).alias("recall_retrieved"))


def detection_scores(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """Scores of a detector at each threshold. rows: score, label (boolean)."""
    r = rows.select("label", "score", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    r = confusion_counts(r, F.col("label"), F.col("score") >= F.col("threshold"), "threshold")
    tp, fp, fn = c("tp", "fp", "fn")
    return r.select("threshold", "tp", "fp", "fn", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), harmonic(tp, tp + fp, tp + fn).alias("f1"))


def first_valid(rows: DataFrame, *key: str) -> DataFrame:
    """Of several rows of a key the first, unless it is invalid and a later one is not: then the first valid one. rows: seq, valid."""
    best = F.min_by(F.struct("*"), F.struct((~F.coalesce("valid", F.lit(False))).alias("v"), F.col("seq").alias("s")))
    return rows.groupBy(*key).agg(best.alias("_r")).select("_r.*")


def existence_scores(rows: DataFrame, all_gold: int) -> DataFrame:
    """Strong relations as positives; ambiguous and invalid replies are negatives, and counted. rows: status (null if invalid), gold."""
    status = F.coalesce("status", F.lit(INVALID))
    g, found = F.col("gold"), status == "RELATED_STRONG"
    r = rows.agg(n(g & found).alias("tp"), n(~g & found).alias("fp"), n(~g & ~found).alias("tn"), n(g & ~found).alias("fn"), n(status == "AMBIGUOUS").alias("ambiguous"), n((status == "AMBIGUOUS") & g).alias("ambiguous_gold"), n(status == INVALID).alias("invalid"))
    tp, fp, tn, fn = c("tp", "fp", "tn", "fn")
    return r.select("*", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), harmonic(tp, tp + fp, tp + fn).alias("f1"), share(tn, tn + fp).alias("specificity"), share(tp + tn, tp + fp + tn + fn).alias("accuracy"), share(tp, F.lit(all_gold)).alias("end_to_end_recall"))


# --- typed relations: gold_type, gold_source, gold_target, directed, resolved; type (null if invalid), source, target -----------


def typed(rows: DataFrame) -> DataFrame:
    """Adds predicted, type_right, way_right (null where undirected or unresolved) and exact (null where unresolved)."""
    said = F.coalesce("type", F.lit(INVALID))
    right = F.coalesce(said == F.col("gold_type"), F.lit(False))
    way = F.coalesce((F.col("source") == F.col("gold_source")) & (F.col("target") == F.col("gold_target")), F.lit(False))
    res, dir_ = F.col("resolved"), F.col("resolved") & F.col("directed")
    return rows.select("*", said.alias("predicted"), F.when(res, right).alias("type_right"), F.when(dir_, way).alias("way_right"), F.when(res, right & F.when(dir_, way).otherwise(True)).alias("exact"))


def typed_report(rows: DataFrame) -> DataFrame:
    """One row: accuracies of type, direction and both, abstentions and invalid replies. rows: of typed()."""
    r = rows.agg(F.count("*").alias("pairs"), n(F.col("resolved")).alias("evaluated"), n(F.col("way_right").isNotNull()).alias("directed"), n(F.col("type_right")).alias("t"), n(F.col("way_right")).alias("w"), n(F.col("exact")).alias("e"), n(F.col("predicted") == ABSTAIN).alias("abstained"), n(F.col("predicted") == INVALID).alias("invalid"))
    ev, di = F.col("evaluated"), F.col("directed")
    return r.select("pairs", "evaluated", (F.col("pairs") - ev).alias("unresolved"), "directed", share(F.col("t"), ev).alias("type_accuracy"), share(F.col("w"), di).alias("direction_accuracy"), share(F.col("e"), ev).alias("exact_accuracy"), "abstained", "invalid")


def typed_classes(rows: DataFrame, relations: list[str]) -> DataFrame:
    """Precision, recall and F1 of every relation, and a row `macro` of their means (classes of no support included). rows: of typed()."""
    e = rows.where("resolved").groupBy("gold_type", "predicted").agg(F.count("*").alias("k"))
    each = e.crossJoin(F.broadcast(rows.sparkSession.createDataFrame([(x,) for x in relations], "label string")))
    g, p = F.col("gold_type") == F.col("label"), F.col("predicted") == F.col("label")
    total = lambda x: F.coalesce(F.sum(F.when(x, F.col("k"))), F.lit(0))
    m = each.groupBy("label").agg(total(g).alias("support"), total(p).alias("said"), total(g & p).alias("tp"))
    m = m.select("label", "support", "said", share(F.col("tp"), F.col("said")).alias("precision"), share(F.col("tp"), F.col("support")).alias("recall"), harmonic(F.col("tp"), F.col("said"), F.col("support")).alias("f1"))
    macro = m.agg(F.sum("support").alias("support"), F.sum("said").alias("said"), *(F.round(F.avg(x), 6).alias(x) for x in ("precision", "recall", "f1")))
    return m.unionByName(macro.withColumn("label", F.lit("macro")))


def typed_confusion(rows: DataFrame) -> DataFrame:
    """gold, predicted, pairs over resolved rows of typed()."""
    return rows.where("resolved").groupBy(F.col("gold_type").alias("gold"), "predicted").agg(F.count("*").alias("pairs"))


def label_shares(rows: DataFrame, labels: list[str]) -> DataFrame:
    """The share of each predicted label among all pairs and among resolved ones. rows: of typed()."""
    k = rows.groupBy("predicted").agg(F.count("*").alias("k"), n(F.col("resolved")).alias("r"))
    all_ = rows.agg(F.count("*").alias("all_k"), n(F.col("resolved")).alias("all_r"))
    every = rows.sparkSession.createDataFrame([(x,) for x in labels], "predicted string")
    j = every.join(k, "predicted", "left").fillna(0).crossJoin(F.broadcast(all_))
    return j.select("predicted", share(F.col("k"), F.col("all_k")).alias("of_all"), share(F.col("r"), F.col("all_r")).alias("of_evaluated"))


def order_bias(rows: DataFrame) -> DataFrame:
    """How often the first input is said to be the source. rows: input_a, source."""
    r = rows.agg(n(F.col("source") == F.col("input_a")).alias("first"), n(F.col("source").isNotNull()).alias("aimed"))
    return r.select("*", share(F.col("first"), F.col("aimed")).alias("rate"))


def class_detection(rows: DataFrame, label: str) -> DataFrame:
    """One class against all others. rows: of typed()."""
    r = confusion_counts(rows.where("resolved"), F.col("gold_type") == label, F.col("predicted") == label)
    tp, fp, fn = c("tp", "fp", "fn")
    return r.select("tp", "fp", "fn", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"))


def reference_report(rows: DataFrame) -> DataFrame:
    """References that were said to exist, and their direction. rows: gold_exists, gold_source, gold_target; exists (null if invalid), source, target."""
    g = F.col("gold_exists")
    p = F.coalesce("exists", F.lit(False))
    way = F.coalesce((F.col("source") == F.col("gold_source")) & (F.col("target") == F.col("gold_target")), F.lit(False))
    r = rows.agg(F.count("*").alias("pairs"), n(g).alias("gold"), n(p).alias("said"), n(g & p).alias("tp"), n(F.col("exists") == g).alias("x"), n(g & p & way).alias("w"), n(F.when(g, p & way).otherwise(F.col("exists") == g)).alias("e"))
    tp, said, gold, k = c("tp", "said", "gold", "pairs")
    return r.select("pairs", "gold", "said", "tp", share(tp, said).alias("precision"), share(tp, gold).alias("recall"), harmonic(tp, said, gold).alias("f1"), share(F.col("x"), k).alias("existence_accuracy"), share(F.col("w"), gold).alias("direction_accuracy"), share(F.col("e"), k).alias("exact_accuracy"))


def two_by_two(rows: DataFrame, one: str, other: str, *by: str) -> DataFrame:
    """Pairs right in both, in one, in the other, in neither, of two boolean columns; null is wrong."""
    a, b = F.coalesce(one, F.lit(False)), F.coalesce(other, F.lit(False))
    g = rows.groupBy(*by) if by else rows
    return g.agg(F.count("*").alias("pairs"), n(a & b).alias("both"), n(a & ~b).alias("only_one"), n(~a & b).alias("only_other"), n(~a & ~b).alias("neither"))


def model_pairs(rows: DataFrame) -> DataFrame:
    """Every two models on their common tasks. rows: model, task_id, exact; few rows a task."""
    a = rows.select("task_id", F.col("model").alias("model_a"), F.col("exact").alias("x"))
    b = rows.select("task_id", F.col("model").alias("model_b"), F.col("exact").alias("y"))
    return two_by_two(a.join(b, "task_id").where("model_a < model_b"), "x", "y", "model_a", "model_b")


def two_sided(a: Column, b: Column) -> Column:
    """The exact two-sided binomial p of a against b discordant pairs: a sum of min(a, b) + 1 terms, each from the last by a ratio."""
    total, low = a + b, F.least(a, b)
    # Terms relative to the largest, from it downwards: t(k - 1) = t(k) * k / (total - k + 1).
    step = lambda s, k: F.struct((s["t"] * (low - k + 1) / (total - low + k)).alias("t"), (s["sum"] + s["t"] * (low - k + 1) / (total - low + k)).alias("sum"))
    tail = F.aggregate(F.when(low > 0, F.sequence(F.lit(1).cast("long"), low)).otherwise(F.array().cast("array<bigint>")), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("sum")), step)["sum"]
    # The largest term in logs: lgamma by Stirling's series, exact to a double from 10 on; below, factorials.
    x = lambda v: (v + 1).cast("double")
    stirling = lambda v: (x(v) - 0.5) * F.log(x(v)) - x(v) + 0.9189385332046727 + 1 / (12 * x(v)) - 1 / (360 * F.pow(x(v), 3)) + 1 / (1260 * F.pow(x(v), 5)) - 1 / (1680 * F.pow(x(v), 7))
    gamma = lambda v: F.when(v <= 20, F.log(F.factorial(F.least(v, F.lit(20)).cast("int")).cast("double"))).otherwise(stirling(v))
    top = gamma(total) - gamma(low) - gamma(total - low) - total * F.log(F.lit(2.0))
    return F.when(total == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.exp(top) * tail))


def separated_items(reference: DataFrame, assigned: DataFrame) -> DataFrame:
    """Reference items (doc_id, start, kind) with their end and whether assigned items (doc_id, document_order, item) cut exactly there and nowhere between."""
    w = Window.partitionBy("doc_id").orderBy("start")
    d = Window.partitionBy("doc_id").orderBy("document_order")
    cuts = assigned.select("doc_id", "document_order", (F.lag("item").over(d).isNull() | (F.lag("item").over(d) != F.col("item"))).alias("cut"), "item")
    most = assigned.groupBy("doc_id").agg(F.max("document_order").alias("most"))
    r = reference.withColumn("next", F.lead("start").over(w)).join(most, "doc_id").withColumn("end", F.coalesce(F.col("next") - 1, "most"))
    # A node lies in the item that starts last at or before it.
    m = cuts.join(reference.select("doc_id", F.col("start").alias("document_order"), F.lit(True).alias("begins")), ["doc_id", "document_order"], "left")
    m = m.withColumn("start", F.last(F.when(F.col("begins"), F.col("document_order")), True).over(d)).where("start is not null")
    inside = m.groupBy("doc_id", "start").agg(F.countDistinct("item").alias("segments"), F.max(F.when(F.col("document_order") == F.col("start"), F.col("cut"))).alias("before"))
    j = r.join(inside, ["doc_id", "start"])
    after = j.select("doc_id", F.col("next").alias("start"), F.col("start").alias("prior")).join(inside.select("doc_id", "start", F.col("before").alias("after")), ["doc_id", "start"]).select("doc_id", F.col("prior").alias("start"), "after")
    j = j.join(after, ["doc_id", "start"], "left").withColumn("after", F.coalesce("after", F.lit(True)))
    return j.select("doc_id", "start", "end", "kind", "before", "after", "segments", (F.col("before") & F.col("after") & (F.col("segments") == 1)).alias("clean"))


def separation_summary(items: DataFrame) -> DataFrame:
    """Reference and clean items of every kind, and of all."""
    return items.rollup("kind").agg(F.count("*").alias("reference"), n(F.col("clean")).alias("clean")).select(F.coalesce("kind", F.lit("all")).alias("kind"), "reference", "clean")


FINE_TO_COARSE = {"ELABORATES": "EXPANDS", "EXPLAINS": "EXPANDS", "SUPPORTS": "SUPPORTS", "QUALIFIES": "CONDITIONS", "DEPENDS_ON": "CONDITIONS", "CONTRASTS_WITH": "CONTRASTS_WITH"}


def coarse_relation(fine: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in FINE_TO_COARSE.items() for x in kv)), fine)


def four_class_truth(relation: Column, referenced: Column) -> Column:
    """The four-class label of a fine relation, null where it stays unresolved: contrasts come before references, dependencies are not mapped."""
    return F.when(relation == "DEPENDS_ON", None).when(relation == "CONTRASTS_WITH", "CONTRASTS_WITH").when(referenced, "REFERENCES").when(relation == "QUALIFIES", "MODIFIES").when(relation.isin("ELABORATES", "EXPLAINS", "SUPPORTS", "PROVIDES_CONTEXT_FOR"), "CONTRIBUTES_TO")


LABELS = {"split": SPLIT, "coarse": COARSE, "four": FOUR, "strict": STRICT}
