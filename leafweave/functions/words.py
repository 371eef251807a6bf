"""Short texts as Columns: labels, titles, names, lines of metadata, and replies that hold JSON somewhere."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from leafweave.functions import text as tx

# Patterns and words that decide names, titles and metadata.
ACRONYM = r"\b[A-Z][A-Z0-9-]{1,14}\b"
CAPITALISED = r"\b(?:[A-Z][a-z]+(?:[-'][A-Za-z]+)?)(?:\s+(?:of|the|and|for|in|on|with|[A-Z][a-z]+(?:[-'][A-Za-z]+)?)){1,5}\b"
STOP = "a an and are as at be by for from has have in is it of on or that the their this to was were which with we our can may using figure fig table section page".split()
ACRONYM_STOP = ["FIG", "FIGURE", "TABLE", "SECTION", "THE", "THIS", "AND", "FOR", "WITH"]
LONG_WORD = r"[A-Za-z][A-Za-z'’-]{3,}"
TITLE_WORD = r"[A-Za-z][A-Za-z0-9'’-]*"
METADATA_LINE = r"(?i)^\s*(?:[-*]\s*)?(?:block_id|matched_region|matched_region_id|matched_region_ids|bbox|deepseek_bbox|bbox_source|bbox_granularity|layout_type|region_type)\s*[:：].*$"
COMMENT_LINE = r"^\s*<!--.*?-->\s*$"
SERIAL = ["deepseek_bbox", "matched_region", "bbox_granularity", "bbox_source"]


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def cleaned(c: Column) -> Column:
    """Comments, tags and images gone, links as their text, white space squeezed; null is empty."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)<!--.*?-->", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"!\[[^\]]*\]\([^)]+\)", " ")
    c = F.regexp_replace(c, r"\[([^\]]+)\]\([^)]+\)", "$1")
    return squeezed(F.replace(c, F.lit(" "), F.lit(" ")))


def long_tokens(c: Column) -> Column:
    """The distinct tokens of three characters or more of a text as templates see it."""
    return F.array_distinct(F.filter(F.split(tx.normalised(c), " "), lambda x: F.char_length(x) >= 3))


def salient_overlap(a: Column, b: Column) -> Column:
    """Shared words of four letters or more over the smaller number of them."""
    words = lambda c: F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(LONG_WORD), F.lit(0)), F.lower))
    x, y = words(a), words(b)
    return F.size(F.array_intersect(x, y)) / F.greatest(F.lit(1), F.least(F.size(x), F.size(y)))


def compact_label(c: Column) -> Column:
    """A short line that ends no sentence."""
    s = squeezed(c)
    return F.char_length(s).between(1, 90) & (F.size(F.split(s, " ")) <= 12) & ~F.regexp_like(s, F.lit(r"[.?!;]$"))


def compact_title(c: Column) -> Column:
    """Two to fourteen words, mostly capitals or capitalised, that end no clause."""
    words = F.regexp_extract_all(c, F.lit(TITLE_WORD), F.lit(0))
    letters, capitals = F.char_length(F.regexp_replace(c, r"[^\p{L}]+", "")), F.char_length(F.regexp_replace(c, r"[^\p{Lu}]+", ""))
    cased = F.size(F.filter(words, lambda w: F.regexp_like(w, F.lit("^[A-Z]")))) / F.size(words)
    fine = F.size(words).between(2, 14) & (F.char_length(c) <= 130) & ~F.regexp_like(c, F.lit(r"[.,;?!]$"))
    return F.when(fine, (capitals / F.greatest(F.lit(1), letters) >= 0.72) | (cased >= 0.78)).otherwise(False)


def canonical(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def named_entities(c: Column) -> Column:
    """Acronyms and capitalised phrases as (key, name), distinct by key, the first name of each, by key."""
    acronyms = F.filter(F.transform(F.regexp_extract_all(c, F.lit(ACRONYM), F.lit(0)), lambda x: F.regexp_replace(x, "^-+|-+$", "")), lambda x: ~x.isin(ACRONYM_STOP) & ~F.regexp_like(x, F.lit(r"^\d*$")))
    phrases = F.filter(
        F.transform(F.regexp_extract_all(c, F.lit(CAPITALISED), F.lit(0)), F.trim),
        lambda x: (F.char_length(canonical(x)) >= 5) & F.exists(F.split(canonical(x), " "), lambda w: ~w.isin(STOP)) & ~F.regexp_like(canonical(x), F.lit("^(?:figure|table|section) ")),
    )
    all_ = F.transform(F.concat(acronyms, phrases), lambda x, i: F.struct(canonical(x).alias("key"), i.alias("i"), x.alias("name")))
    keys = F.array_sort(F.array_distinct(F.transform(all_, lambda x: x["key"])))
    return F.transform(keys, lambda k: F.struct(k.alias("key"), F.get(F.filter(all_, lambda x: x["key"] == k), F.lit(0))["name"].alias("name")))


def entity_id(key: Column) -> Column:
    """entity:, at most 60 characters of the key with underscores, and the beginning of its SHA-1."""
    slug = F.substring(F.regexp_replace(F.regexp_replace(key, "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, 60)
    return F.concat(F.lit("entity:"), F.when(slug == "", "entity").otherwise(slug), F.lit(":"), F.substring(F.sha1(key), 1, 8))


def recovered_span(span: Column, text: Column) -> Column:
    """What a text says where a span stands in it, whatever its case and white space; null if it does not. A whole formula has a name of its own."""
    words = F.filter(F.split(span, r"\s+"), lambda w: w != "")
    flexible = F.concat(F.lit("(?i)"), F.array_join(F.transform(words, lambda w: F.concat(F.lit("\\Q"), w, F.lit("\\E"))), r"\s+"))
    found = F.call_function("regexp_extract", text, flexible, F.lit(0))
    return F.when(span == "__FULL_FORMULA__", text).when(F.size(words) > 0, F.nullif(found, F.lit("")))


def embedding_text(original: Column, summary: Column, mode: str) -> Column:
    """What a node is embedded by: its text, its summary or both."""
    o, s = F.coalesce(original, F.lit("")), F.coalesce(summary, F.lit(""))
    return {"original_only": o, "base_summary_only": s, "original_plus_summary": F.trim(F.regexp_replace(F.concat(o, F.lit("\n"), s), r"^\s+|\s+$", ""))}[mode]


def without_metadata(c: Column, most: int) -> Column:
    """A page's text without comment and metadata lines, blank lines and spaces squeezed, cut to `most` characters with a mark."""
    lines = F.filter(F.split(c, "\n"), lambda x: ~F.regexp_like(x, F.lit(COMMENT_LINE)) & ~F.regexp_like(x, F.lit(METADATA_LINE)) & ~F.exists(F.array(*map(F.lit, SERIAL)), lambda k: F.contains(F.lower(x), k)))
    s = F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), r"[ \t]{2,}", " ")
    s = F.regexp_replace(s, r"^\s+|\s+$", "")
    return F.when(F.char_length(s) > most, F.concat(F.substring(s, 1, most), F.lit("\n...[TRUNCATED]"))).otherwise(s)


def kept_in_order(values: Column) -> Column:
    """Distinct texts in order, without nulls and empty ones."""
    return F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != "")))


# --- JSON in replies ------------------------------------------------------------------------------

_ESCAPE = re.compile(r'\\(?:["\\/]|[bfnrt](?![A-Za-z])|u[0-9a-fA-F]{4})')


def _mended(s: str) -> str:
    """Backslashes inside strings that escape nothing, such as those of formulas, doubled."""
    out, i, inside = [], 0, False
    while i < len(s):
        c = s[i]
        if inside and c == "\\":
            m = _ESCAPE.match(s, i)
            out.append(m[0] if m else "\\\\")
            i = m.end() if m else i + 1
            continue
        inside ^= c == '"'
        out.append(c)
        i += 1
    return "".join(out)


def _loaded(s: str):
    try:
        return json.loads(s)
    except ValueError:
        return json.loads(_mended(s))


def _balanced(s: str) -> str | None:
    """The first object or array of a text, up to where its brackets close."""
    starts = [i for i in (s.find("["), s.find("{")) if i >= 0]
    if not starts:
        return None
    begin = min(starts)
    opening, closing = s[begin], {"[": "]", "{": "}"}[s[begin]]
    depth, inside, i = 0, False, begin
    while i < len(s):
        c = s[i]
        if inside and c == "\\":
            i += 1
        elif c == '"':
            inside = not inside
        elif not inside:
            depth += (c == opening) - (c == closing)
            if depth == 0:
                return s[begin : i + 1]
        i += 1
    return None


def json_in(reply: str | None) -> str | None:
    """The JSON that a reply holds, with sorted keys: all of it without its fence, else the first object or array in it; null without any."""
    if reply is None:
        return None
    s = re.sub(r"```\s*$", "", re.sub(r"^\s*```(?:json)?", "", reply.strip(), flags=re.I)).strip()
    for part in (s, _balanced(s)):
        try:
            if part is not None:
                return json.dumps(_loaded(part), sort_keys=True, ensure_ascii=False)
        except ValueError:
            continue
    return None


def extracted_json(reply: Column) -> Column:
    """json_in over Arrow batches: a state machine over characters, which no built-in expresses."""

    def apply(s: pd.Series) -> pd.Series:
        return s.map(json_in, na_action="ignore")

    return F.pandas_udf(apply, "string")(reply)
