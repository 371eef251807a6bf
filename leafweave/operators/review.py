"""Reviews of OCR blocks: which fragments belong to a neighbour, which blocks are no evidence, and how far a block's text can be trusted."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from leafweave.functions import text as tx
from leafweave.operators.pages import URL, _like

# Types, labels and roles of blocks that are no running text, and those that are.
EXCLUDED_TYPES = ["caption", "formula", "reference", "table", "figure", "heading", "title"]
EXCLUDED_LABELS = ["header", "header_text", "footer", "footnote", "doc_title", "document_title", "paragraph_title", "section_heading", "title"]
EXCLUDED_ROLES = ["header", "footer", "footnote"]
TEXT_TYPES = ["text", "paragraph", "list"]
TEXT_LABELS = ["text", "list", "paragraph", "body", "body_text"]
# Symbols that are never content, and roles that a repeated template leaves alone.
SYMBOLS = ["→", "←", "↑", "↓", "i", "☐", "□", "■", "●", "•"]
KEPT_ROLES = ["document_title", "author_metadata", "publication_metadata", "identifier_metadata"]
CONTINUES = r"^(?:\p{Ll}|[,.;:)\]}–—-])"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _any(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(c, F.lit(False)) for c in conditions))


def unmatched(region: Column, flags: Column, box_source: Column) -> Column:
    """No layout region, and either flagged so or without a known source of its box."""
    source = F.lower(F.coalesce(box_source, F.lit("")))
    return region.isNull() & _any(F.array_contains(F.transform(flags, F.lower), "no_layout_match"), source.isin("", "missing", "none"))


# --- fragments ----------------------------------------------------------------------------------


def _block_state(blocks: DataFrame) -> DataFrame:
    s = F.col("s")
    words = F.size(F.regexp_extract_all("s", F.lit("[A-Za-zÀ-ÖØ-öø-ÿ0-9]+"), F.lit(0)))
    letters = F.char_length(F.regexp_replace("s", r"[^\p{L}]+", ""))
    title = words.between(1, 10) & (letters > 0) & (F.char_length(F.regexp_replace("s", r"[^\p{Lu}]+", "")) / letters >= 0.8)
    kind, label, role = (F.lower(F.coalesce(c, F.lit(""))) for c in ("block_type", "label", "region_role"))
    out = kind.isin(EXCLUDED_TYPES) | label.isin(EXCLUDED_LABELS) | role.isin(EXCLUDED_ROLES)
    b = blocks.withColumn("s", _strip(F.coalesce("text", F.lit("")))).withColumn("open", tx.incomplete_reason(s)).withColumn("continues", _like(s, CONTINUES))
    short = (F.char_length("s") <= 40) & (F.size(F.split("s", r"\s+")) <= 8) & ~_like(s, "[.!?]$")
    why = F.coalesce(F.col("open"), F.when(F.col("continues"), "lowercase_or_continuation_prefix"), F.when(short, "very_short_nonterminal_text"))
    b = b.withColumn("reason", F.when((s != "") & ~out & ~F.coalesce(title, F.lit(False)), why))
    return b.withColumn("prose", ~out & (kind.isin(TEXT_TYPES) | label.isin(TEXT_LABELS) | (role == "text")))


def fragment_proposals(blocks: DataFrame) -> DataFrame:
    """Fragments among blocks (doc_id, page, block_no, text, block_type, label, region_role, region, unmatched) with their bridges to both neighbours.

    A neighbour is the block just before or after if it is of the same page. confidence is HIGH for an unmatched fragment with a textual bridge between
    blocks of running text of one region, MEDIUM between blocks of running text, else null; target_no is null where the direction is open.
    """
    w = Window.partitionBy("doc_id").orderBy("block_no")
    at = F.struct("page", "block_no", "region", F.col("open").isNotNull().alias("open"), "continues", "prose")
    b = _block_state(blocks).withColumn("p", F.lag(at).over(w)).withColumn("n", F.lead(at).over(w)).where("reason is not null")
    for x in ("p", "n"):
        b = b.withColumn(x, F.when(F.col(f"{x}.page") == F.col("page"), F.col(x)))
    yes = lambda c: F.coalesce(c, F.lit(False))
    unfinished = F.col("open").isNotNull()
    after = yes(F.col("p.open") & F.col("continues"))
    before = yes(unfinished & F.col("n.continues"))
    both = yes(F.col("p.open") & unfinished & F.col("n").isNotNull())
    prose = yes(F.col("p.prose") & F.col("n.prose"))
    b = b.withColumn("same_region", prose & yes(F.col("p.region") == F.col("n.region"))).withColumn("bridge", after | before | both)
    hold = F.col("unmatched") & F.col("bridge")
    confidence = F.when(hold & F.col("same_region"), "HIGH").when(hold & prose, "MEDIUM")
    target = F.when(after, F.col("p.block_no")).when(before, F.col("n.block_no"))
    way = F.when(after, "attach_after_previous").when(before, "attach_before_next").otherwise("ambiguous_target")
    return b.select("doc_id", "page", "block_no", "reason", "unmatched", "same_region", "bridge", confidence.alias("confidence"), target.alias("target_no"), way.alias("direction"))


def attach_fragments(blocks: DataFrame, proposals: DataFrame, allowed: tuple[str, ...] = ("HIGH",)) -> DataFrame:
    """Blocks after their fragments joined them: doc_id, block_no, text, absorbed. A target that is itself absorbed takes nothing, so that its fragments stay as they are."""
    w = Window.partitionBy("doc_id", "block_no").orderBy("target_no")
    p = proposals.where(F.col("confidence").isin(*allowed) & F.col("target_no").isNotNull()).withColumn("k", F.row_number().over(w)).where("k = 1").select("doc_id", "block_no", "target_no")
    own = p.select("doc_id", F.col("block_no").alias("target_no"))
    p = p.join(own, ["doc_id", "target_no"], "left_anti")
    b = blocks.select("doc_id", "block_no", _strip(F.coalesce("text", F.lit(""))).alias("s")).join(p, ["doc_id", "block_no"], "left")
    g = b.groupBy("doc_id", F.coalesce("target_no", "block_no").alias("block_no")).agg(F.sort_array(F.collect_list(F.struct(F.col("block_no").alias("k"), "s"))).alias("parts"))
    joined = F.array_join(F.filter(F.transform("parts", lambda x: x["s"]), lambda s: s != ""), " ")
    return g.select("doc_id", "block_no", joined.alias("text"), (F.size("parts") - 1).cast("long").alias("absorbed"))


# --- roles --------------------------------------------------------------------------------------


def route_roles(blocks: DataFrame) -> DataFrame:
    """Blocks (role, text, page_role, template, unmatched) with routed: template, navigation or advertisement where they are surely no evidence, else their role."""
    s = _strip(F.coalesce("text", F.lit("")))
    seen = F.regexp_replace(s, r"\s+", "")
    tiny = s.isin(SYMBOLS) | ((F.char_length(seen) <= 2) & ~_like(seen, r"[\p{L}\p{N}]"))
    brief = _like(s, r"^\s*[•▪◦‣*-]\s*\S") | (F.char_length(s) <= 180) | F.col("unmatched")
    evidence = F.col("role") == "evidence_content"
    routed = (
        F.when(F.col("template") & ~F.col("role").isin(KEPT_ROLES), "template")
        .when(evidence & tiny, "template")
        .when(evidence & (F.col("page_role") == "NAVIGATION") & brief, "navigation")
        .when(evidence & (F.col("page_role") == "FULL_AD"), "advertisement")
        .when(evidence & _like(s, URL) & (F.char_length(s) <= 40) & F.col("unmatched"), "template")
        .otherwise(F.col("role"))
    )
    return blocks.withColumn("routed", routed)


# --- trust in a block's text --------------------------------------------------------------------

# What each flag adds to a block's risk.
WEIGHTS = {
    "inside_complex_layout_container": 0.02, "inside_table_like_region": 0.03, "metadata_or_advertisement_keyword": 0.28, "phone_number_detected": 0.25, "email_detected": 0.12,
    "url_detected": 0.10, "doi_detected": 0.10, "isbn_detected": 0.10, "low_unique_token_ratio": 0.22, "single_token_repeated_many_times": 0.35, "repeated_bigram_loop": 0.40,
    "repeated_2gram_loop": 0.45, "repeated_3gram_loop": 0.45, "abnormal_character_distribution": 0.18, "very_long_unspaced_token": 0.18, "text_density_outlier_for_bbox": 0.25,
    "text_density_extreme_outlier_for_bbox": 0.40, "secondary_ocr_partial_disagreement": 0.15, "secondary_ocr_strong_disagreement": 0.40, "phone_not_supported_by_secondary_ocr": 0.35,
    "phone_digit_sequence_disagreement": 0.55,
}
ENTITIES = ["phone_number_detected", "email_detected", "url_detected", "doi_detected", "isbn_detected"]
LOOPS = ["repeated_bigram_loop", "repeated_2gram_loop", "repeated_3gram_loop"]
KEYWORD, CONTAINER, VISUAL, DENSE = "metadata_or_advertisement_keyword", "inside_complex_layout_container", "text_inside_visual_region_possible_valid", "text_density_extreme_outlier_for_bbox"
DISPUTED = ["secondary_ocr_strong_disagreement", "phone_digit_sequence_disagreement"]


def _has(*names: str) -> Column:
    return F.arrays_overlap(F.col("flags"), F.array(*map(F.lit, names)))


def verify(blocks: DataFrame, allow_medium: bool = False) -> DataFrame:
    """Blocks (text, title, flags) with risk_score (to 6 places), risk_level, status, index_text, use_for_embedding, use_for_nodes and needs_second_reading. Null flags are none."""
    b = blocks.withColumn("flags", F.array_distinct(F.coalesce("flags", F.array().cast("array<string>"))))
    weight = F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv))
    score = F.aggregate("flags", F.lit(0.0), lambda a, x: a + F.coalesce(F.try_element_at(weight, x), F.lit(0.0)))
    phone = _has("phone_number_detected")
    score = score + F.when(_has(CONTAINER) & phone, 0.08).otherwise(0.0) + F.when(_has(CONTAINER) & _has(KEYWORD), 0.12).otherwise(0.0)
    score = score + F.when(phone & _has("repeated_bigram_loop", "repeated_2gram_loop", "low_unique_token_ratio"), 0.20).otherwise(0.0)
    telling = [*ENTITIES, KEYWORD, *LOOPS, *DISPUTED]
    score = F.when(_has(VISUAL), F.when(_has(*telling, DENSE), F.greatest(F.lit(0.0), score - 0.12)).otherwise(0.0)).otherwise(score)
    text, low = F.coalesce("text", F.lit("")), F.lower(F.coalesce("text", F.lit("")))
    caption = _any(F.contains(F.lower("title"), F.lit("caption")), F.startswith(low, F.lit("fig.")), F.startswith(low, F.lit("figure ")), F.contains(F.substring(low, 1, 80), F.lit("top notch")))
    score = F.when(caption & ~_has(*telling), F.least(score, F.lit(0.20))).otherwise(score)
    b = b.withColumn("risk_score", F.round(F.least(F.lit(1.0), score), 6))
    b = b.withColumn("risk_level", F.when(F.col("risk_score") >= 0.70, "high").when(F.col("risk_score") >= 0.35, "medium").otherwise("low"))
    level = F.col("risk_level")
    risky = level != "low"
    status = (
        F.when(text == "", "empty")
        .when(_has(KEYWORD) & _has(CONTAINER) & risky, "metadata_only")
        .when((level == "high") & _has(DENSE, *DISPUTED, "single_token_repeated_many_times", *LOOPS), "quarantined")
        .when(_has(*ENTITIES) & risky, "entity_masked")
        .when(level == "medium", "needs_review")
        .when(level == "high", "quarantined")
        .otherwise("accepted")
    )
    b = b.withColumn("status", status)
    s = F.col("status")
    medium = F.lit(allow_medium) & (level == "medium") & s.isin("entity_masked", "needs_review")
    second = _has(*ENTITIES, "text_density_outlier_for_bbox", DENSE, *LOOPS, KEYWORD) & (text != "")
    index = F.when(s == "entity_masked", tx.masked_fully(text)).when(s.isin("accepted", "needs_review"), text).otherwise("")
    return b.select("*", index.alias("index_text"), ((s == "accepted") | medium).alias("use_for_embedding"), (s == "accepted").alias("use_for_nodes"), second.alias("needs_second_reading"))


# Words of imprints and advertisements, and layout types of pictures.
IMPRINT = ["produced for", "published by", "printed by", "advertisement", "advertising", "marketing and circulation", "general distribution", "head of media", "head of development", "content and production", "technical illustrator", "advertising sales", "recruitment sales", "issn", "iop publishing", "tel:", "fax:", "email:", "e-mail"]
PICTURES = ["picture", "image", "figure"]


def region_containers(blocks: DataFrame) -> DataFrame:
    """Regions of blocks (page, block_id, regions: array, region_type) in order of block_id: page, region, type (the first that is known), blocks, container (two blocks or more)."""
    r = blocks.select("page", "block_id", "region_type", F.explode("regions").alias("region")).where("region is not null")
    g = r.groupBy("page", "region").agg(F.count("*").alias("blocks"), F.min(F.when(F.col("region_type") != "", F.struct("block_id", "region_type")))["region_type"].alias("type"))
    return g.select("page", "region", "type", "blocks", (F.col("blocks") >= 2).alias("container"))


def block_flags(blocks: DataFrame) -> DataFrame:
    """Blocks (page, block_id, text, regions, region_type) with flags, sorted: layout, imprint words and entities. Repetition, odd characters and density have operators of their own."""
    b = blocks.join(region_containers(blocks).withColumnRenamed("region", "r").select("page", "r", "type", "container").groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("r", F.struct("type", "container")))).alias("by")), "page", "left")
    of = F.filter(F.transform(F.coalesce("regions", F.array().cast("array<long>")), lambda x: F.try_element_at("by", x)), lambda x: x.isNotNull())
    layout = F.flatten(F.transform(of, lambda x: F.array(F.when(x["container"], CONTAINER), F.concat(F.lit("layout_type_"), x["type"]), F.when(x["type"].isin(PICTURES), VISUAL))))
    text = F.coalesce("text", F.lit(""))
    low = F.lower(text)
    words = reduce(lambda a, c: a | c, (F.contains(low, F.lit(x)) for x in IMPRINT))
    e = tx.entities(text)
    own = F.array(
        F.when(F.col("region_type") == "table", "inside_table_like_region"),
        F.when(F.col("region_type").isin(PICTURES), "inside_visual_region_possible_valid"),
        F.when(words, KEYWORD),
        F.when(F.size(tx.phones(text)) > 0, "phone_number_detected"),
        *(F.when(F.size(e[k]) > 0, f"{k}_detected") for k in ("email", "url", "doi")),
        F.when(F.size(tx.isbns(text)) > 0, "isbn_detected"),
        F.when(text == "", "empty_text"),
    )
    return b.withColumn("flags", F.array_sort(F.array_distinct(F.array_compact(F.concat(layout, own))))).drop("by")


@F.pandas_udf(DoubleType())
def _likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching characters; 0 where either is missing or empty."""
    squeeze = lambda x: " ".join((x or "").lower().split())
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(map(squeeze, a), map(squeeze, b), strict=True)], dtype="float64")


def second_reading(blocks: DataFrame) -> DataFrame:
    """Blocks (text, second: the text of another reading) with overlap (share of the text's words in it) and disagreement, the flags that follow.

    Characters are compared only where the words already disagree strongly: the comparison is the one step that needs Python.
    """
    text, other = F.coalesce("text", F.lit("")), F.coalesce("second", F.lit(""))
    a, b = F.array_distinct(tx.tokens(text)), F.array_distinct(tx.tokens(other))
    d = blocks.withColumn("overlap", F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0))
    long = (F.char_length(text) >= 40) & (other != "")
    far = long & (F.col("overlap") < 0.20)
    d = d.withColumn("_like", _likeness(F.when(far, text), F.when(far, other)))
    strong = far & (F.col("_like") < 0.30)
    mine, theirs = (F.filter(F.transform(tx.phones(x), tx.digits), lambda x: F.char_length(x) >= 7) for x in (text, other))
    agree = F.exists(mine, lambda x: F.exists(theirs, lambda y: F.contains(x, y) | F.contains(y, x)))
    flags = F.array(
        F.when(strong, "secondary_ocr_strong_disagreement").when(long & (F.col("overlap") < 0.35), "secondary_ocr_partial_disagreement"),
        F.when((other != "") & (F.size(mine) > 0) & (F.size(theirs) == 0), "phone_not_supported_by_secondary_ocr").when((F.size(mine) > 0) & (F.size(theirs) > 0) & ~agree, "phone_digit_sequence_disagreement"),
        F.when(other == "", "secondary_ocr_empty"),
    )
    return d.withColumn("disagreement", F.array_sort(F.array_compact(flags))).drop("_like")
