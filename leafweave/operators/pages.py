"""Decisions about pages: roles of magazine pages, advertisement labels, content segments, regions of a paper, and boundaries between items."""

from __future__ import annotations

import itertools
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafweave.functions import geometry as g
from leafweave.functions.groups import by_whole_groups
from leafweave.functions.text import once

# Terms of advertisements and of navigation pages.
AD_TERMS = ["advertisement", "advertising", "product", "products", "solution", "solutions", "powered crate", "powered crates", "power supply", "power supplies", "high voltage", "low voltage", "source measure unit", "digitizer", "fpga", "module", "modules", "order now", "contact", "sales", "brochure", "technology", "technologies"]
NAV_TERMS = ["contents", "in this issue", "table of contents", "news", "features", "opinion", "reviews", "careers", "people", "events", "bookshelf", "editorial"]
#: Roles whose pages are never part of an article.
NO_ARTICLE = ["front_matter", "cover_or_separator", "back_cover_or_separator", "table_of_contents", "advertisement"]
# Patterns of titles and placeholders.
NON_TITLE = r"(?i)^(?:fig(?:ure)?\.?\s*\d+|table\s*\d+|volume\s+\d+|cern courier|january|february|www\.|https?://)"
PLACEHOLDER = r"(?i)^\s*(?:image|figure|photo|page\s*\d+)\s*$"
URL = r"(?i)(?:https?://|www\.|\b[a-z0-9-]+\.(?:com|org|net|it|de|io)\b|@)"


def _like(c: Column, pattern: str) -> Column:
    return F.regexp_like(c, F.lit(pattern))


def _count(c: Column) -> Column:
    return F.coalesce(F.sum(c.cast("long")), F.lit(0))


def page_roles(blocks: DataFrame) -> DataFrame:
    """The role of each page of blocks (doc_id, page, text, unmatched, template), with its counts; the first rule that holds, else ARTICLE_OR_MIXED."""
    s = F.regexp_replace("text", r"^\s+|\s+$", "")
    low = F.col("low")
    b = blocks.withColumn("s", s).withColumn("low", once(F.lower("s"))).withColumn("c", ~F.col("template") & (F.col("s") != ""))
    hits = sum(F.contains(low, F.lit(x)).cast("long") for x in AD_TERMS)
    nav = F.lit(False)
    for x in NAV_TERMS:
        nav = nav | F.contains(low, F.lit(x))
    c = F.col("c")
    p = b.groupBy("doc_id", "page").agg(
        F.count("*").alias("blocks"),
        _count(F.col("template")).alias("templates"),
        _count(c & _like(F.col("s"), r"^\s*[•▪◦‣*-]\s*\S")).alias("bullets"),
        _count(c & _like(F.col("s"), r"(?:\.|\s)\d{1,3}\s*$") & (F.char_length("s") <= 180)).alias("page_refs"),
        _count(c & _like(F.col("s"), URL)).alias("urls"),
        F.coalesce(F.sum(F.when(c, hits)), F.lit(0)).alias("ad_hits"),
        _count(c & F.col("unmatched") & (F.char_length("s") <= 120)).alias("short_unmatched"),
        F.coalesce(F.bool_or(c & nav), F.lit(False)).alias("nav"),
    )
    listing = (F.col("nav") & ((F.col("bullets") >= 2) | (F.col("page_refs") >= 2))) | (F.col("bullets") >= 5) | (F.col("page_refs") >= 5)
    ad = (F.col("urls") >= 1) & (F.col("ad_hits") >= 2) & (F.col("short_unmatched") >= 4)
    role = F.when(F.col("templates") / F.col("blocks") >= 0.65, "TEMPLATE_HEAVY").when(listing, "NAVIGATION").when(ad, "FULL_AD").otherwise("ARTICLE_OR_MIXED")
    return p.withColumn("role", role)


def ad_labels(detections: DataFrame, classes: list[str], at_least: float = 0.5) -> DataFrame:
    """FULL_PAGE_AD, PARTIAL_AD, UNCERTAIN or NO_AD for each page of detections (page, class, confidence, box, width, height)."""
    ad = F.col("class").isin(classes) & (F.coalesce("confidence", F.lit(0.0)) >= at_least)
    share = F.coalesce(g.area(F.col("box")) / (F.col("width") * F.col("height")), F.lit(0.0))
    p = detections.groupBy("page").agg(F.max(F.when(ad, share)).alias("coverage"))
    return p.withColumn("label", F.when(F.col("coverage").isNull(), "NO_AD").when(F.col("coverage") >= 0.9, "FULL_PAGE_AD").when(F.col("coverage") >= 0.05, "PARTIAL_AD").otherwise("UNCERTAIN"))


def page_segments(pages: DataFrame) -> DataFrame:
    """Ranges of pages (doc_id, idx, role, start): neighbours of one non-article role, or an article up to its next start."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    out = F.col("role").isin(NO_ARTICLE)
    before = F.lag("role").over(w)
    new = F.when(out, ~before.eqNullSafe(F.col("role"))).otherwise(before.isNull() | before.isin(NO_ARTICLE) | F.col("start"))
    p = pages.withColumn("new", new.cast("long")).withColumn("segment", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kind = F.first(F.when(out, F.col("role")).otherwise("article_or_content_run"))
    return p.groupBy("doc_id", "segment").agg(kind.alias("type"), F.min("idx").alias("page_start"), F.max("idx").alias("page_end"))


def segment_gaps(segments: DataFrame, first: int = 0) -> DataFrame:
    """Segments that do not begin where the one before ended: doc_id, segment, page_start, expected."""
    e = F.coalesce(F.lag("page_end").over(Window.partitionBy("doc_id").orderBy("page_start", "page_end")) + 1, F.lit(first)).cast("long")
    return segments.withColumn("expected", e).where("page_start <> expected or page_end < page_start").select("doc_id", "segment", "page_start", "expected")


def paper_regions(nodes: DataFrame, references: int = 5) -> DataFrame:
    """Regions of a paper's nodes (doc_id, idx, reference, affiliation, acknowledgement as booleans).

    The bibliography is the first run of at least five reference nodes; the body ends there or at the first acknowledgement; a paper with neither is all body.
    """
    d = Window.partitionBy("doc_id")
    w = d.orderBy("idx")
    n = nodes.withColumn("b", (~F.lag("reference").over(w).eqNullSafe(F.col("reference"))).cast("long"))
    n = n.withColumn("run", F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = Window.partitionBy("doc_id", "run")
    n = n.withColumn("long", F.col("reference") & (F.count("*").over(r) >= references))
    n = n.withColumn("first_run", F.min(F.when(F.col("long"), F.col("run"))).over(d)).withColumn("in_refs", F.col("run").eqNullSafe(F.col("first_run")))
    n = n.withColumn("s", F.min(F.when(F.col("in_refs"), F.col("idx"))).over(d)).withColumn("e", F.max(F.when(F.col("in_refs"), F.col("idx"))).over(d))
    n = n.withColumn("aff", F.min(F.when(F.col("affiliation") & (F.col("idx") > F.col("e")), F.col("idx"))).over(d)).withColumn("ack", F.min(F.when(F.col("acknowledgement"), F.col("idx"))).over(d))
    end = F.least("ack", "s")
    region = F.when(end.isNull() | (F.col("idx") < end), "SCIENTIFIC_BODY").when(F.col("in_refs"), "BIBLIOGRAPHY").when(F.col("idx") >= F.col("aff"), "AFFILIATIONS").when(F.col("idx") > F.col("e"), "AUTHOR_LIST").otherwise("ACKNOWLEDGMENTS")
    return n.select("doc_id", "idx", region.alias("region"))


def title_anchors(nodes: DataFrame, prose: int = 180) -> DataFrame:
    """Nodes (doc_id, idx, text) that look like titles and stand before prose, at most one short byline between: doc_id, idx. A document's first node never does."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    n = nodes.withColumn("s", F.trim(F.regexp_replace("text", r"\s+", " ")))
    n = n.withColumn("n1", F.lead(F.char_length("s"), 1).over(w)).withColumn("n2", F.lead(F.char_length("s"), 2).over(w)).withColumn("at", F.row_number().over(w))
    words = F.regexp_extract_all("s", F.lit(r"[A-Za-z][A-Za-z0-9'-]*"), F.lit(0))
    letters = F.char_length(F.regexp_replace("s", r"[^\p{L}]+", ""))
    capital = F.char_length(F.regexp_replace("s", r"[^\p{Lu}]+", "")) / F.greatest(F.lit(1), letters)
    cased = F.size(F.filter("words", lambda x: _like(x, "^[A-Z]"))) / F.size("words")
    n = n.where(F.col("n1").isNotNull() & (F.col("at") > 1)).withColumn("words", words).where(F.size("words").between(1, 14) & (F.char_length("s") <= 120))
    n = n.where(~_like(F.col("s"), NON_TITLE) & ~_like(F.col("s"), r"[.:;?!]$") & ~_like(F.col("s"), PLACEHOLDER))
    after = (F.col("n1") >= prose) | ((F.col("n1") < 100) & F.coalesce(F.col("n2") >= prose, F.lit(False)))
    return n.where(((capital >= 0.72) | (cased >= 0.75)) & after).select("doc_id", "idx")


def valleys(similar: DataFrame) -> DataFrame:
    """Boundary signals over the similarity of neighbours (doc_id, idx, s): smoothed median of 7, prominence, low (lowest tenth of the document) and trend."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    d = Window.partitionBy("doc_id")
    left, right = F.coalesce(F.avg("s").over(w.rowsBetween(-3, -1)), F.lit(0.0)), F.coalesce(F.avg("s").over(w.rowsBetween(1, 3)), F.lit(0.0))
    v = similar.withColumn("smoothed", F.percentile("s", F.lit(0.5)).over(w.rowsBetween(-3, 3))).withColumn("l", left).withColumn("r", right)
    v = v.withColumn("prominence", F.round(F.when((F.col("l") != 0) & (F.col("r") != 0), (F.col("l") + F.col("r")) / 2 - F.col("s")).otherwise(0.0), 9))
    v = v.withColumn("q10", F.round(F.percentile("s", F.lit(0.1)).over(d), 9)).withColumn("q90", F.greatest(F.lit(0.08), F.round(F.percentile("prominence", F.lit(0.9)).over(d), 9)))
    return v.select("doc_id", "idx", "smoothed", "prominence", (F.col("s") <= F.col("q10")).alias("low"), ((F.col("prominence") >= F.col("q90")) & (F.round("r", 9) > F.col("s"))).alias("trend"))


def unit_sizes(cuts: DataFrame, sizes: DataFrame) -> DataFrame:
    """Sizes of the units that cuts (doc_id, idx of a unit's last node, from 0) make of documents (doc_id, nodes)."""
    c = cuts.select("doc_id", "idx").unionByName(sizes.select("doc_id", (F.col("nodes") - 1).alias("idx")))
    return c.withColumn("size", F.col("idx") - F.coalesce(F.lag("idx").over(Window.partitionBy("doc_id").orderBy("idx")), F.lit(-1))).select("doc_id", F.col("idx").alias("last"), "size")


def match_greedily(gold: Iterable[int], found: Iterable[int], tolerance: int) -> list[tuple[int, int]]:
    """Gold boundaries in order, each with the nearest (then smallest) boundary found that is still free."""
    free, out = set(found), []
    for v in sorted(set(gold)):
        near = min((c for c in range(v - tolerance, v + tolerance + 1) if c in free), key=lambda c: (abs(v - c), c), default=None)
        if near is not None:
            free.discard(near)
            out.append((v, near))
    return out


def boundary_scores(gold: DataFrame, found: DataFrame, tolerance: int = 0) -> DataFrame:
    """Per document: boundaries (doc_id, idx) of gold, its first left out, and found; matched, precision, recall, f1. Without tolerance a join; with it a match depends on those before it, hence Python, many documents a call."""
    first = Window.partitionBy("doc_id").orderBy("idx")
    gold = gold.select("doc_id", "idx").distinct().withColumn("k", F.row_number().over(first)).where("k > 1").select("doc_id", "idx")
    rows = gold.select("doc_id", "idx", F.lit(True).alias("gold")).unionByName(found.select("doc_id", "idx", F.lit(False).alias("gold")))
    if tolerance == 0:
        b = rows.groupBy("doc_id", "idx").agg(F.bool_or("gold").alias("g"), F.bool_or(~F.col("gold")).alias("f"))
        c = b.groupBy("doc_id").agg(F.count_if("g").alias("gold"), F.count_if("f").alias("found"), F.count_if(F.col("g") & F.col("f")).alias("matched"))
        share = lambda x, y: F.when(y > 0, F.round(x / y, 4)).otherwise(0.0)
        m, g, f = F.col("matched"), F.col("gold"), F.col("found")
        return c.select("*", share(m, f).alias("precision"), share(m, g).alias("recall"), share(2 * m, g + f).alias("f1"))

    def match(t: pa.Table) -> pa.Table:
        c = [t.column(k).to_pylist() for k in ("doc_id", "idx", "gold")]
        docs, counts = [], []
        for d, its in itertools.groupby(zip(*c, strict=True), key=lambda r: r[0]):
            its = list(its)
            a, b = {r[1] for r in its if r[2]}, {r[1] for r in its if not r[2]}
            docs.append(d)
            counts.append((len(a), len(b), len(match_greedily(a, b, tolerance))))
        a, b, m = np.array(counts, np.int64).reshape(-1, 3).T
        p, r = m / np.maximum(b, 1), m / np.maximum(a, 1)
        f = 2 * p * r / np.where(p + r > 0, p + r, 1)
        places = lambda v: pa.array([round(x, 4) for x in v.tolist()], pa.float64())
        return pa.table({"doc_id": pa.array(docs, pa.int64()), "gold": a, "found": b, "matched": m, "precision": places(p), "recall": places(r), "f1": places(f)})

    return by_whole_groups(rows, "doc_id", match, "doc_id long, gold long, found long, matched long, precision double, recall double, f1 double")
