"""Advertisements in magazines: node scores to pages and spans, page labels and names, and audits of instances across pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _page():
    return Window.partitionBy("doc_id", "page")


def _order():
    return Window.partitionBy("doc_id").orderBy("idx")


def probability(features: Column, mean: list[float], scale: list[float], weights: list[float], intercept: float) -> Column:
    """A linear model's probability of a feature array, standardised; logits are cut at 30."""
    lit = lambda v: F.array(*(F.lit(float(x)) for x in v))
    z = F.zip_with(F.zip_with(features, lit(mean), lambda a, b: a - b), lit(scale), lambda a, b: a / b)
    logit = F.aggregate(F.zip_with(z, lit(weights), lambda a, b: a * b), F.lit(float(intercept)), lambda s, x: s + x)
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit))))


def page_number(page: Column) -> Column:
    """The digits that end a page's name, null without."""
    return F.regexp_extract(page, r"(\d+)$", 1).try_cast("int")


def promoted(nodes: DataFrame, least_share: float = 0.4, least_mean: float = 0.85) -> DataFrame:
    """Fills pages that are mostly advertisement (doc_id, idx, page, text, label, p): adds `promoted`. Never pages 1 and 2 nor a table of contents."""
    share, mean = F.avg(F.col("label").cast("double")).over(_page()), F.avg("p").over(_page())
    contents = F.max(F.contains(F.lower("text"), F.lit("in this issue"))).over(_page())
    fill = (F.coalesce(page_number(F.col("page")), F.lit(0)) > 2) & ~F.coalesce(contents, F.lit(False)) & (F.round(share, 9) >= least_share) & (F.round(mean, 9) >= least_mean)
    return nodes.withColumn("promoted", F.col("label") | fill)


def with_runs(nodes: DataFrame) -> DataFrame:
    """Adds run: counts changes of label in a document."""
    change = F.coalesce(F.lag("label").over(_order()) != F.col("label"), F.lit(True))
    return nodes.withColumn("_c", change.cast("int")).withColumn("run", F.sum("_c").over(_order())).drop("_c")


def kept_runs(nodes: DataFrame, least_nodes: int = 2, least_mean: float = 0.65) -> DataFrame:
    """Drops runs of advertisement that are short or unsure: adds `kept`."""
    w = Window.partitionBy("doc_id", "run")
    n = with_runs(nodes)
    fine = (F.count("*").over(w) >= least_nodes) & (F.round(F.avg("p").over(w), 9) >= least_mean)
    return n.withColumn("kept", F.col("label") & fine).drop("run")


def whole_pages(nodes: DataFrame, pages: DataFrame, most_prose: int = 2, long: int = 240) -> DataFrame:
    """Pages (doc_id, page, predicted) that may be rewritten as whole advertisements: not 1 or 2, of two nodes or more, with little long prose. Adds `whole`."""
    n = nodes.groupBy("doc_id", "page").agg(F.count("*").alias("nodes"), F.count_if(F.char_length("text") > long).alias("prose"))
    number = page_number(F.col("page"))
    ok = F.coalesce(number > 2, F.lit(True)) & (F.coalesce("nodes", F.lit(0)) >= 2) & (F.coalesce("prose", F.lit(0)) <= most_prose)
    return pages.join(n, ["doc_id", "page"], "left").select(*pages.columns, (F.col("predicted") & ok).alias("whole"))


def page_labels_to_nodes(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds the page's label (doc_id, page, predicted) to its nodes; pages without one are not advertisement."""
    return nodes.join(pages.select("doc_id", "page", "predicted"), ["doc_id", "page"], "left").withColumn("label", F.coalesce("predicted", F.lit(False))).drop("predicted")


def surface_features(nodes: DataFrame) -> DataFrame:
    """Per node: log length and words, short, very short, upper case, share of capitals; and of its page: log nodes, characters and mean characters, share of short nodes."""
    t = F.col("text")
    letters = F.char_length(F.regexp_replace(t, r"[^\p{L}]+", ""))
    capitals = F.char_length(F.regexp_replace(t, r"[^\p{Lu}]+", ""))
    words = F.size(F.filter(F.split(t, r"\s+"), lambda x: x != ""))
    size = F.char_length(t)
    upper = (letters > 0) & (F.upper(t) == t)
    page = [F.log1p(F.count("*").over(_page())), F.log1p(F.sum(size).over(_page()) + F.count("*").over(_page()) - 1), F.log1p(F.sum(size).over(_page()) / F.count("*").over(_page())), F.count_if(size <= 80).over(_page()) / F.count("*").over(_page())]
    own = [F.log1p(size), F.log1p(words), (words <= 12).cast("double"), (words <= 4).cast("double"), upper.cast("double"), capitals / F.greatest(F.lit(1), letters)]
    names = ["node_length", "node_words", "node_short", "node_very_short", "node_upper", "node_upper_ratio", "page_nodes", "page_chars", "page_mean_chars", "page_short_ratio"]
    return nodes.select("doc_id", "idx", *(F.round(c.cast("double"), 8).alias(k) for k, c in zip(names, own + page, strict=True)))


def page_names(records: DataFrame) -> DataFrame:
    """Labels and file names of pages (doc_id, idx, status, inferred, page_type): numbers where they are known, else a count by status; equal names get a suffix."""
    s = F.col("status")
    known = s.isin("visible_anchor", "inferred") & (F.col("inferred") > 0)
    group = F.when(known, "known").when(s.isin("front_matter", "conflict", "unknown"), s).otherwise("unnumbered")
    r = records.withColumn("_g", group)
    k = F.row_number().over(Window.partitionBy("doc_id", "_g").orderBy("idx"))
    prefix = F.when(F.col("_g") == "front_matter", "front").when(F.col("_g") == "unnumbered", "unnum").otherwise(F.col("_g"))
    name = F.when(F.col("_g") == "known", F.format_string("p%04d", F.col("inferred").cast("int"))).otherwise(F.format_string("%s_%03d", prefix, k))
    r = r.withColumn("page_label", name).withColumn("_base", F.concat_ws("__", "page_label", "page_type"))
    again = F.row_number().over(Window.partitionBy("doc_id", "_base").orderBy("idx"))
    file = F.when(again == 1, F.concat("_base", F.lit(".png"))).otherwise(F.format_string("%s__%02d.png", "_base", again))
    return r.select("doc_id", "idx", "page_label", file.alias("filename"), F.when(F.col("_g") == "unnumbered", "unnumbered").otherwise(s).alias("status"))


# A fixed value: what pages may be.
PAGE_TYPES = ["cover", "table_of_contents", "article_page", "advertisement", "editorial", "masthead", "index", "back_cover", "blank_or_separator", "mixed", "unknown"]


def page_type(value: Column) -> Column:
    """A known page type, or unknown."""
    v = F.lower(F.trim(value))
    return F.when(v.isin(PAGE_TYPES), v).otherwise("unknown")


def visible_number(value: Column, reliable: Column) -> Column:
    """One to five digits above zero, without leading zeros, of a reliable reading; null otherwise."""
    v = F.trim(value)
    return F.when(reliable & F.regexp_like(v, F.lit(r"^\d{1,5}$")) & (v.try_cast("int") > 0), v.try_cast("int").cast("string"))


def pointers(instances: DataFrame) -> DataFrame:
    """Instances (doc_id, page_no, content_id) with the previous page that holds the same content, else NEW."""
    p = instances.select("doc_id", "page_no", "content_id").distinct()
    before = p.select("doc_id", (F.col("page_no") + 1).alias("page_no"), "content_id", F.col("page_no").alias("previous"))
    j = p.join(before, ["doc_id", "page_no", "content_id"], "left")
    return j.select("doc_id", "page_no", "content_id", "previous", F.when(F.col("previous").isNull(), "NEW").otherwise("CONTINUE").alias("relation"))


def chain_audit(instances: DataFrame) -> DataFrame:
    """Chains of contents over pages (doc_id, page_no, content_id, relation): length, gaps between their pages, CONTINUE on the first page, NEW after it."""
    w = Window.partitionBy("doc_id", "content_id").orderBy("page_no")
    p = instances.groupBy("doc_id", "content_id", "page_no").agg(F.max("relation").alias("relation"))
    p = p.withColumn("gap", F.col("page_no") - F.lag("page_no").over(w) > 1).withColumn("first", F.row_number().over(w) == 1)
    c = p.groupBy("doc_id", "content_id").agg(F.count("*").alias("pages"), F.count_if("gap").alias("gaps"), F.count_if(F.col("first") & (F.col("relation") == "CONTINUE")).alias("begins_continued"), F.count_if(~F.col("first") & (F.col("relation") == "NEW")).alias("begins_again"))
    return c.withColumn("length", F.when(F.col("pages") >= 3, "3+").otherwise(F.col("pages").cast("string")))


def dataset_audit(instances: DataFrame) -> DataFrame:
    """One row over instances (doc_id, page_no, content_id, label, relation, boxes as structs in shares of the page): counts, boxes an instance, anomalies."""
    n = F.size("boxes")
    bad = lambda f: F.exists("boxes", f)
    out = lambda b: (b["x1"] < 0) | (b["y1"] < 0) | (b["x2"] > 1) | (b["y2"] > 1)
    pages = instances.groupBy("doc_id", "page_no").agg(F.countDistinct("content_id").alias("k"))
    several = pages.agg(F.count("*").alias("pages"), F.count_if(F.col("k") > 1).alias("multi_pages"))
    labels = instances.groupBy("doc_id", "content_id").agg(F.countDistinct("label").alias("k")).agg(F.count_if(F.col("k") > 1).alias("conflicting_labels"))
    a = instances.agg(
        F.countDistinct("doc_id").alias("documents"), F.count("*").alias("instances"), F.count_if(F.col("relation") == "NEW").alias("new"), F.count_if(F.col("relation") == "CONTINUE").alias("continued"),
        *(F.count_if(n == k).alias(f"boxes_{k}") for k in (1, 2, 3, 4)), F.count_if(n >= 5).alias("boxes_5"), F.max(n).cast("long").alias("most_boxes"), F.round(F.avg(n), 8).alias("mean_boxes"),
        F.count_if(bad(lambda b: (b["x1"] >= b["x2"]) | (b["y1"] >= b["y2"]))).alias("degenerate"), F.count_if(bad(out)).alias("off_page"), F.count_if(n > F.size(F.array_distinct("boxes"))).alias("repeated_boxes"), F.count_if(bad(lambda b: (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) < 0.0001)).alias("tiny"),
    )
    return a.crossJoin(several).crossJoin(labels)


def snapped_spans(nodes: DataFrame, boundaries: DataFrame, radius: int = 2, sure: float = 0.9) -> DataFrame:
    """Spans of advertisement (doc_id, idx from 1, page, label, p) with their edges: a page's edge stays, another goes to the nearest boundary (doc_id, idx) within radius, the lesser of equals, or stays where it is if the span is sure; null otherwise."""
    n = with_runs(nodes).withColumn("prev_page", F.lag("page").over(_order())).withColumn("next_page", F.lead("page").over(_order())).withColumn("last", F.max("idx").over(Window.partitionBy("doc_id")))
    s = n.where("label").groupBy("doc_id", "run").agg(F.min("idx").alias("begin"), F.max("idx").alias("end"), F.avg("p").alias("mean"), F.min_by(F.coalesce(F.col("prev_page") != F.col("page"), F.lit(True)), "idx").alias("at_start"), F.max_by(F.coalesce(F.col("next_page") != F.col("page"), F.lit(True)), "idx").alias("at_end"), F.first("last").alias("last"))
    around = F.sequence(F.lit(-radius), F.lit(radius))

    def near(df: DataFrame, at: Column, name: str) -> DataFrame:
        k = df.select("doc_id", "run", at.alias("o"), F.explode(around).alias("d")).select("doc_id", "run", "d", (F.col("o") + F.col("d")).alias("idx"))
        k = k.join(boundaries.select("doc_id", "idx").distinct(), ["doc_id", "idx"]).groupBy("doc_id", "run").agg(F.min_by("idx", F.struct(F.abs("d").alias("a"), "idx")).alias(name))
        return df.join(k, ["doc_id", "run"], "left")

    s = near(near(s, F.col("begin"), "nb"), F.col("end") + 1, "ne")
    sure_ = F.col("mean") >= sure
    begin = F.when(F.col("at_start"), F.col("begin")).otherwise(F.coalesce("nb", F.when(sure_, F.col("begin"))))
    end = F.when(F.col("end") < F.col("last"), F.when(F.col("at_end"), F.col("end") + 1).otherwise(F.coalesce("ne", F.when(sure_, F.col("end") + 1))))
    return s.select("doc_id", "begin", "end", F.round("mean", 6).alias("mean"), begin.alias("snapped_begin"), end.alias("snapped_end"))
