"""Text of blocks and nodes as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that decide roles, completeness and entities.
TERMINAL = r"[.!?][\]\)\}\"'’”]*$"
UNFINISHED = r"(?i)(?<![\p{L}\p{N}_])(?:a|an|the|and|or|but|of|to|in|on|at|for|from|with|by|as|that|which|is|are|was|were)$"
EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
URL = r"(?i)\b(?:https?://|www\.)[^\s<>()]+"
DOI = r"(?i)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+\b"
TOKEN = r"[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)?"
TERM = r"[A-Za-z][A-Za-z0-9_-]{1,}"
ODD = r"[^\p{L}\p{N}\s.,;:!?()\[\]{}+\-–—_/\\'\"%&@#€$£°=<>]"


def plain_text(markdown: Column) -> Column:
    """Heading marks, images, links and emphasis gone; underscores stay."""
    c = F.regexp_replace(markdown, r"(?m)^#{1,6}\s*", "")
    c = F.regexp_replace(c, r"!\[([^\]]*)\]\([^)]+\)", "$1")
    c = F.regexp_replace(c, r"\[([^\]]+)\]\([^)]+\)", "$1")
    return F.trim(F.regexp_replace(c, r"(?<!\\)[*~`]", ""))


def incomplete_reason(text: Column) -> Column:
    """Why a node's text seems unfinished; null where it is complete."""
    t = F.regexp_replace(text, r"\s+$", "")
    return (
        F.when(t == "", "empty_text")
        .when(F.regexp_like(t, F.lit(r"[\p{L}\p{N}_]-$")), "ends_with_hyphenated_word")
        .when(F.regexp_like(t, F.lit(UNFINISHED)), "ends_with_unfinished_phrase")
        .when(~F.regexp_like(t, F.lit(TERMINAL)), "does_not_end_with_terminal_punctuation")
    )


def normalised(text: Column, lowered: bool = False) -> Column:
    """For repeated templates: lower case (unless the text is lowered), no scheme, digits as #, other symbols as spaces."""
    c = F.regexp_replace(text if lowered else F.lower(text), "https?://", "")
    c = F.regexp_replace(c, r"\d+", "#")
    c = F.regexp_replace(c, r"[^a-zà-öø-ÿ0-9#@./:+_-]+", " ")
    return F.trim(c)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def once(c: Column) -> Column:
    """The value itself, in a select, behind a border that filters above do not cross: otherwise they would work it out a second time."""
    return F.explode(F.array(c))


def repeats(values: str, least: Column | str) -> Column:
    """Whether one of a sorted array's values is in it `least` times: then it equals the one `least` - 1 places on. False for shorter arrays."""
    k = F.col(least) if isinstance(least, str) else least
    n = F.greatest(F.lit(0), F.size(values) - k + 1)
    return F.array_contains(F.zip_with(F.slice(values, 1, n), F.slice(values, k, n), lambda x, y: x == y), True)


def terms(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower)


def entities(text: Column) -> Column:
    """email, url and doi of a text, in order."""
    return F.struct(*(F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(k) for k, p in (("email", EMAIL), ("url", URL), ("doi", DOI))))


def masked(text: Column) -> Column:
    for k, p in (("EMAIL", EMAIL), ("URL", URL), ("DOI", DOI)):
        text = F.regexp_replace(text, p, f"[UNVERIFIED_{k}]")
    return text


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def number_of(label: Column) -> Column:
    """The value of an Arabic or Roman numeral; null for anything else and for a Roman total of zero."""
    t = F.upper(F.trim(label))
    value = F.create_map(*(x for k, v in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items() for x in (F.lit(k), F.lit(v))))
    digits = F.transform(F.split(t, ""), lambda c: F.element_at(value, c))
    total = F.aggregate(
        F.reverse(F.filter(digits, lambda x: x.isNotNull())),
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")),
        lambda s, x: F.struct((s["sum"] + F.when(x < s["last"], -x).otherwise(x)).alias("sum"), F.greatest(s["last"], x).alias("last")),
        lambda s: s["sum"],
    )
    return F.when(F.regexp_like(t, F.lit(r"^\d+$")), t.cast("int")).when(F.regexp_like(t, F.lit("^[IVXLCDM]+$")), F.nullif(total, F.lit(0)))


# Patterns of telephone numbers, with a cue before them or in international form, and of ISBNs.
PHONE_CUE = r"(?i)\b(?:tel|telephone|phone|fax|mobile|mob)\.?\s*[:：]?\s*(\+?\d[\d\s().\-]{5,}\d)"
PHONE_PLUS = r"(?<![\p{L}\p{N}_])(\+\d[\d\s().\-]{6,}\d)(?![\p{L}\p{N}_])"
ISBN = r"(?i)\b(?:ISBN(?:-1[03])?:?\s*)?(?:97[89][-\s]?)?\d[-\s]?\d{2,5}[-\s]?\d{2,7}[-\s]?\d[-\s]?[0-9X]\b"


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{Nd}]+", "")


def phones(text: Column) -> Column:
    """Distinct telephone numbers of 7 to 16 digits and at most one point, those with a cue first, white space squeezed."""
    all_ = F.concat(F.regexp_extract_all(text, F.lit(PHONE_CUE), F.lit(1)), F.regexp_extract_all(text, F.lit(PHONE_PLUS), F.lit(1)))
    good = F.filter(all_, lambda x: F.char_length(digits(x)).between(7, 16) & (F.char_length(F.regexp_replace(x, "[^.]+", "")) <= 1))
    return F.array_distinct(F.transform(good, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))))


def isbns(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ISBN), F.lit(0))


def masked_fully(text: Column) -> Column:
    """masked, and telephone numbers before the others, ISBNs after them."""
    plain = F.aggregate(phones(text), text, lambda t, p: F.replace(t, p, F.lit("[UNVERIFIED_PHONE]")))
    return F.regexp_replace(masked(plain), ISBN, "[UNVERIFIED_ISBN]")
