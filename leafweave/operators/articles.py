"""Where articles begin: commercial and front pages, scores of titles, structural roles of nodes, and zones around titles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafweave.operators.pages import _like

# Titles that never begin an article, and departments that do.
NON_ARTICLE_TITLES = ["abstract", "advertisement", "analysis", "background", "careers", "contents", "departments", "discussion", "editorial", "energy frontiers", "features", "field notes", "from the editor", "further reading", "introduction", "news", "news analysis", "opinion", "opinion interview", "opinion viewpoint", "people", "references", "reporting on international high-energy physics", "results", "reviews", "table of contents"]
DEPARTMENT_TITLES = ["appointments and awards", "recruitment"]
# Markers of contents pages, and patterns of advertisements.
TOC_MARKERS = ["in this issue", "table of contents"]
AD_STRONG = [r"\bscan me\b", r"\border now\b", r"\bvisit us\b", r"\bbooth\s+\d+\b", r"\bregistration open\b", r"\bplatinum sponsor\b", r"\bpatent pending\b", r"\bcustomi[sz]ed solutions?\b", r"\bwhy choose\b", r"\bnew!\s+best model\b", r"\bcall for (?:a )?quote\b", r"\bjob listings?\b", r"\bpositions? available\b", r"\bsend your application\b", r"\bregistration deadline\b", r"\babstract submission deadline\b"]
AD_CONTACT = [r"https?://", r"\bwww\.", r"\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b", r"\+\d[\d ()-]{6,}", r"\b(?:tel|phone|fax)\s*[:.]", r"\b\.com\b", r"\b[a-z0-9-]+\.(?:com|org|net|it|eu|ch|se)\b", r"\(\d{3}\)\s*\d{3}[- ]\d{4}"]
AD_PRODUCT = [r"\bproduct(?:s)?\b", r"\bmodel\s+[a-z0-9-]+\b", r"\bpower suppl(?:y|ies)\b", r"\bdigitizer\b", r"\bhigh[- ]precision\b", r"\brequest a quote\b"]
# Patterns of structural roles.
RUNNING = r"(?i)^(?:cern\s*courier|volume\s+\d+|january/february|may/june|november/december|\d{1,2}\s+(?:cern\s+courier|may/june|november/december))\b"
FURTHER_READING = r"(?i)^(?:further reading|references?|doi\b|arxiv\b)"
BYLINE = r"(?i)^(?:by|written by|interview by|reviewed by)\s+[A-Z]"
CAPTION = r"(?i)^(?:fig(?:ure)?\.?\s*\d*|table\s*\d+|image\b|credit\b|pictured\b)"
DEPARTMENT = r"(?i)^(?:news analysis|news digest|energy frontiers|field notes|opinion|interview|reviews|appointments(?: and awards)?|people|careers|background|astrowatch|policy|education and outreach|future circular collider|reports from .+)$"
ADVERTISING = r"(?i)\b(?:advertisement|register now|registration open|contact us|visit us|apply now|www\.|sales@|vacuum solutions|power supply|signal generator)\b"


def normal(text: Column) -> Column:
    """Words of letters a-z and digits in lower case, one space between."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), " ")


# What a text must hold for a pattern to match; patterns that begin at any word are slow to refuse a whole page.
GUARDS = {AD_CONTACT[0]: ["://"], AD_CONTACT[1]: ["www."], AD_CONTACT[2]: ["@"], AD_CONTACT[3]: ["+"], AD_CONTACT[5]: [".com"], AD_CONTACT[6]: [f".{x}" for x in ("com", "org", "net", "it", "eu", "ch", "se")], AD_CONTACT[7]: ["("]}
GUARDS |= dict(zip(AD_STRONG, [["scan me"], ["order now"], ["visit us"], ["booth"], ["registration open"], ["platinum sponsor"], ["patent pending"], ["customi"], ["why choose"], ["best model"], ["call for"], ["job listing"], ["available"], ["send your application"], ["registration deadline"], ["abstract submission deadline"]], strict=False))
GUARDS |= dict(zip(AD_PRODUCT, [["product"], ["model"], ["power suppl"], ["digitizer"], ["precision"], ["request a quote"]], strict=True))


def _hits(text: Column, patterns: list[str]) -> Column:
    """How many of the patterns a lower-case text matches."""
    may = lambda x: reduce(lambda a, b: a | b, (F.contains(text, F.lit(g)) for g in GUARDS[x])) if x in GUARDS else F.lit(True)
    return sum((F.when(may(x), _like(text, x).cast("int")).otherwise(0) for x in patterns), F.lit(0))


def _upper(text: Column) -> Column:
    return _like(text, r"\p{Lu}") & ~_like(text, r"\p{Ll}")


def commercial_roles(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, idx from 0, text, body_chars, images) with page_role and role_score by the first rule that holds, else content and null."""
    p = pages.withColumn("low", F.lower(F.coalesce("text", F.lit("")))).withColumn("norm", normal(F.col("low"))).withColumn("last", F.max("idx").over(Window.partitionBy("doc_id")))
    p = p.withColumn("strong", _hits(F.col("low"), AD_STRONG)).withColumn("contacts", _hits(F.col("low"), AD_CONTACT)).withColumn("products", _hits(F.col("low"), AD_PRODUCT))
    low, body, n, k, m = (F.col(c) for c in ("low", "body_chars", "strong", "contacts", "products"))
    toc = reduce(lambda a, b: a | b, (F.contains(low, F.lit(x)) for x in TOC_MARKERS))
    welcome = F.contains(low, F.lit("welcome to the digital edition")) | F.contains("norm", F.lit("cern courier digital edition"))
    pictures = (F.col("images") >= 2) & (body < 1400)
    ad = (n >= 1) | ((k >= 2) & ((m >= 1) | pictures)) | ((k >= 1) & (m >= 2)) | ((k >= 1) & (m >= 1) & (body < 1200))
    rules = [
        (toc, "table_of_contents", F.lit(1.0)),
        ((F.col("idx") <= 1) & welcome, "front_matter", F.lit(0.98)),
        ((F.col("idx") <= 2) & (body < 350) & (F.col("images") <= 1), "cover_or_separator", F.lit(0.78)),
        ((F.col("idx") == F.col("last")) & (body < 350), "back_cover_or_separator", F.lit(0.76)),
        (F.contains(F.substring("norm", 1, 500), F.lit("from the editor")), "editorial", F.lit(0.92)),
        (ad, "advertisement", F.round(F.least(F.lit(1.0), 0.62 + 0.16 * n + 0.08 * k + 0.08 * m), 6)),
    ]
    role, score = F, F
    for when, name, value in rules:
        role, score = role.when(when, F.lit(name)), score.when(when, value)
    return p.withColumn("page_role", role.otherwise("content")).withColumn("role_score", score).drop("low", "norm", "last", "strong", "contacts", "products")


def title_scores(titles: DataFrame, contents: DataFrame) -> DataFrame:
    """Titles (doc_id, kind, text, y: the top's share of the page's height) with noise, toc_match, score and starts, against each document's contents (doc_id, toc: normal text)."""
    t = titles.join(contents.select("doc_id", "toc"), "doc_id", "left").withColumn("norm", normal(F.coalesce("text", F.lit("")))).withColumn("toc", F.coalesce("toc", F.lit("")))
    norm, n = F.col("norm"), F.char_length("norm")
    words = F.split("norm", " ")
    long = F.filter(words, lambda x: F.char_length(x) >= 5)
    most = F.size(F.filter(long, lambda x: F.contains(F.col("toc"), x))) / F.greatest(F.lit(1), F.size(long)) >= 0.8
    listed = (n >= 12) & (F.col("toc") != "") & (F.contains("toc", "norm") | ((F.size(words) >= 4) & (F.size(long) >= 3) & most))
    noise = norm.isin("", *NON_ARTICLE_TITLES) | _like(norm, r"^(?:cern ?courier|cernourier)(?: .*)?$") | _like(norm, r"^(?:volume|vol) \d+.*$") | (n <= 3) | _like(norm, r"^\d+$")
    t = t.withColumn("noise", noise).withColumn("toc_match", ~noise & listed)
    part = lambda when, value: F.when(when, value).otherwise(0.0)
    score = F.when(F.col("kind") == "title", 0.48).otherwise(0.22)
    score = score + F.when(F.col("y").isNull(), 0.0).when(F.col("y") <= 0.30, 0.26).when(F.col("y") <= 0.45, 0.08).otherwise(-0.20)
    score = score + F.when(n.between(12, 110), 0.08).when((n > 140) | (F.size(words) > 20), -0.30).otherwise(0.0)
    score = score + part(norm.isin(DEPARTMENT_TITLES), 0.28) + part(F.col("toc_match"), 0.30) - part(_upper(F.coalesce("text", F.lit(""))) & (F.size(words) <= 4) & ~F.col("toc_match"), 0.22)
    t = t.withColumn("score", F.when(noise, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6)))
    return t.withColumn("starts", F.col("score") >= F.when(F.col("kind") == "title", 0.64).otherwise(0.74)).drop("norm", "toc")


def structural_roles(nodes: DataFrame) -> DataFrame:
    """Nodes (doc_id, page, idx, text, visual, explicit: a heading of the source stands here) with role; the first rule that holds, else BODY."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    n = nodes.withColumn("s", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")))
    n = n.withColumn("after", F.when(F.lead("page").over(w) == F.col("page"), F.char_length(F.lead("s").over(w))).otherwise(0))
    s, size = F.col("s"), F.char_length("s")
    tokens = F.regexp_extract_all("s", F.lit("[A-Za-z][A-Za-z0-9'’-]*"), F.lit(0))
    letters = F.greatest(F.lit(1), F.char_length(F.regexp_replace("s", r"[^\p{L}]+", "")))
    capital = F.char_length(F.regexp_replace("s", r"[^\p{Lu}]+", "")) / letters
    cased = F.size(F.filter(tokens, lambda x: _like(x, "^[A-Z]"))) / F.greatest(F.lit(1), F.size(tokens))
    title = F.size(tokens).between(2, 14) & (size <= 130) & ~_like(s, "[.,;?!]$") & ((capital >= 0.72) | (cased >= 0.78))
    label = (size > 0) & (F.size(F.split("s", " ")) <= 6) & (size <= 75) & _upper(s)
    role = (
        F.when(_like(s, RUNNING), "RUNNING_HEADER")
        .when(_like(s, FURTHER_READING), "FURTHER_READING")
        .when(_like(s, BYLINE), "BYLINE")
        .when(F.col("visual") | _like(s, CAPTION), "CAPTION")
        .when(_like(s, DEPARTMENT) | label, "DEPARTMENT_LABEL")
        .when(F.col("explicit") | (title & (F.col("after") >= 180)), "TITLE")
        .when(_like(s, ADVERTISING) & (size <= 500), "ADVERTISEMENT")
        .otherwise("BODY")
    )
    return n.withColumn("role", role).drop("s", "after")


def boundary_zones(nodes: DataFrame, titles: DataFrame) -> DataFrame:
    """Around each node that titles (doc_id, idx, page, title, classification, margin) stand at: its neighbours on the page from 2 before to 3 after.

    Labels and titles of contents pages make no zone, nor does a page whose nodes (doc_id, page, idx, text) read "in this issue".
    """
    page = Window.partitionBy("doc_id", "page")
    near = page.orderBy("idx").rangeBetween(-2, 3)
    z = nodes.select("doc_id", "page", "idx", F.min("idx").over(near).alias("zone_start"), F.max("idx").over(near).alias("zone_end"), F.count("*").over(near).alias("members"))
    squeezed = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    text = nodes.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", squeezed.alias("s")))), lambda x: x["s"]), " ").alias("t"))
    listing = text.where(F.contains(F.lower("t"), F.lit("in this issue"))).select("doc_id", "page")
    contents = titles.where(F.lower(F.trim("title")) == "in this issue").select("doc_id", "page").distinct()
    t = titles.where(F.col("idx").isNotNull() & ~F.col("classification").eqNullSafe("SECTION_OR_RUNNING_LABEL"))
    t = t.join(contents, ["doc_id", "page"], "left_anti").join(listing, ["doc_id", "page"], "left_anti")
    g = t.groupBy("doc_id", "idx").agg(F.count("*").alias("titles"), F.coalesce(F.bool_or(F.col("classification") == "LIKELY_STARTS_NEW_ITEM"), F.lit(False)).alias("strong"), F.max(F.coalesce("margin", F.lit(0.0))).alias("margin"))
    return g.join(z.drop("page"), ["doc_id", "idx"], "left").select("doc_id", F.col("idx").alias("anchor"), F.coalesce("zone_start", "idx").alias("zone_start"), F.coalesce("zone_end", "idx").alias("zone_end"), F.coalesce("members", F.lit(0)).alias("members"), "titles", "strong", "margin")
