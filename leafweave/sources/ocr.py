"""Readers of OCR output: Markdown with box comments, grounding tags, and the JSON files of pages and graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafweave.functions.text import once

NUMBER = r"(-?\d+(?:\.\d+)?)"
BOX = r"\[+\s*" + r"\s*,\s*".join([NUMBER] * 4) + r"\s*\]+"
# Tags of the grounding format, and the comment that carries a box.
REF_DET = r"(?s)<\|ref\|>(.*?)<\|/ref\|>\s*<\|det\|>(.*?)<\|/det\|>"
DET = r"(?s)<\|det\|>(.*?)<\|/det\|>"
COMMENT = r"<!--\s*bbox:\s*(\{.*?\})\s*-->"
META = "type string, pixel_bbox array<double>, bbox array<double>, raw_bbox array<double>, bbox_scale string"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def pixel_box(raw: Column, width: Column, height: Column, scale: str = "auto") -> Column:
    """A raw box (array of 4) in whole pixels, ordered and clipped to the page. auto: coordinates up to 1000 are shares of 999."""
    if scale not in ("auto", "norm999", "norm1000", "raw"):
        raise ValueError(f"unknown scale {scale}")
    big = F.array_max(F.transform(raw, F.abs)) > 1000
    whole = 1000.0 if scale == "norm1000" else 999.0

    def at(i, side):
        v, share = raw[i], raw[i] / whole * side
        return v if scale == "raw" else share if scale != "auto" else F.when(big, v).otherwise(share)

    x, y = (at(0, width), at(2, width)), (at(1, height), at(3, height))
    edges = F.greatest(F.lit(0.0), F.least(*x)), F.greatest(F.lit(0.0), F.least(*y)), F.least(width.cast("double"), F.greatest(*x)), F.least(height.cast("double"), F.greatest(*y))
    return F.array(*(F.bround(e).cast("long") for e in edges))


def grounding(pages: DataFrame, scale: str = "auto") -> DataFrame:
    """Boxes of a page's tagged text: keys of the page, id from 0, text, raw_bbox, pixel_bbox, source. pages: text, width, height and keys.

    Tags of a box alone count only where no tagged text has a box. A null text gives no rows.
    """
    keys = [c for c in pages.columns if c not in ("text", "width", "height")]

    def boxes(det):
        return F.transform(F.regexp_extract_all(det, F.lit(BOX), F.lit(0)), lambda b: F.regexp_extract_all(b, F.lit(NUMBER), F.lit(1)).cast("array<double>"))

    def items(pattern, text, det, source):
        pairs = F.arrays_zip(text.alias("text"), F.regexp_extract_all("text", F.lit(pattern), F.lit(det)).alias("det"))
        return F.flatten(F.transform(pairs, lambda p: F.transform(boxes(p["det"]), lambda b: F.struct(_trim(p["text"]).alias("text"), b.alias("raw_bbox"), F.lit(source).alias("source")))))

    both = items(REF_DET, F.regexp_extract_all("text", F.lit(REF_DET), F.lit(1)), 2, "text_ref_det")
    alone = items(DET, F.transform(F.regexp_extract_all("text", F.lit(DET), F.lit(1)), lambda _: F.lit("")), 1, "text_det_only")
    p = pages.withColumn("_b", both).withColumn("_b", F.when(F.size("_b") > 0, F.col("_b")).otherwise(alone))
    p = p.select(*keys, "width", "height", F.posexplode("_b").alias("id", "_i"))
    return p.select(*keys, F.col("id").cast("long").alias("id"), "_i.text", "_i.raw_bbox", pixel_box(F.col("_i.raw_bbox"), F.col("width"), F.col("height"), scale).alias("pixel_bbox"), "_i.source")


def block_type(text: Column, raw_type: Column) -> Column:
    """heading, table, caption or text; the type that the OCR gave counts before the look of the text."""
    r, s = F.coalesce(raw_type, F.lit("")), _trim(text)
    says = lambda x: F.regexp_like(r, F.lit(f"(?i){x}"))  # noqa: E731  (F.lower costs a microsecond and more)
    table = F.contains(text, F.lit("|")) & F.regexp_like(s, F.lit(r"\|[-:\s]+\|"))
    return F.when(says("title") | F.startswith(s, F.lit("#")), "heading").when(says("table"), "table").when(says("caption"), "caption").when(table, "table").when(F.regexp_like(s, F.lit(r"(?i)^(fig\.|figure|table)\s*\d*")), "caption").otherwise("text")


def markdown_blocks(pages: DataFrame, page: str = "page") -> DataFrame:
    """Blocks of a page's OCR Markdown (columns page, text): page, block_no from 1, block_type, markdown, bbox, raw_bbox.

    A block is a stretch of lines without blank ones. A box comment belongs to the next block only; one with broken JSON is text.
    A page is parsed within its row: pieces between blank lines, and lines only of pieces that hold a comment.
    """

    def let(value, then):
        """then(value), the value worked out once: a lambda's variable is, a Column used twice within one is not."""
        return F.get(F.transform(F.array(value), then), 0)

    def parts(piece):
        """(meta, text) of a piece: what precedes its first comment, and each comment with the text behind it."""
        meta = lambda x: let(F.regexp_extract(_trim(x), COMMENT, 1), lambda c: F.when(F.get_json_object(c, "$").isNotNull(), c))
        metas = lambda lines: F.transform(lines, lambda x: F.when(F.contains(x, F.lit("<!--")), meta(x)))
        stops = lambda m: F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: F.get(m, i).isNotNull())
        between = lambda lines, at, end: F.array_join(F.slice(lines, at + 2, end - at - 1), "\n")
        cut = lambda lines, m, ends: F.transform(F.sequence(F.lit(0), F.size(ends) - 2), lambda k: item(F.get(m, F.get(ends, k)), between(lines, F.get(ends, k), F.get(ends, k + 1))))
        return let(F.split(piece, "\n"), lambda lines: let(metas(lines), lambda m: let(F.concat(F.array(F.lit(-1)), stops(m), F.array(F.size(lines))), lambda ends: cut(lines, m, ends))))

    item = lambda meta, text: F.struct(meta.cast("string").alias("meta"), _trim(text).alias("text"))
    text = F.regexp_replace("text", r"\r\n|\r", "\n")
    p = pages.where("text is not null").select(page, once(F.split(text, r"\n(?=[ \t\x0B\f]*\n)")).alias("pieces"))
    each = F.transform("pieces", lambda x: F.when(F.contains(x, F.lit("<!--")), parts(x)).otherwise(F.array(item(F.lit(None), x))))
    p = p.select(page, once(F.filter(F.flatten(each), lambda x: (x["text"] != "") | x["meta"].isNotNull())).alias("items"))
    before = lambda i: F.get("items", i - 1)
    own = F.transform("items", lambda x, i: item(F.coalesce(x["meta"], F.when((i > 0) & (before(i)["text"] == ""), before(i)["meta"])), x["text"]))
    b = p.select(page, F.posexplode(F.filter(own, lambda x: x["text"] != "")).alias("n", "b")).select(page, (F.col("n") + 1).cast("long").alias("block_no"), F.col("b.text").alias("markdown"), once(F.from_json("b.meta", META)).alias("m"))
    return b.select(page, "block_no", block_type(F.col("markdown"), F.col("m.type")).alias("block_type"), "markdown", F.coalesce("m.pixel_bbox", "m.bbox").alias("bbox"), F.col("m.raw_bbox").alias("raw_bbox"))


def page_number(name: Column) -> Column:
    """The last digits in a name; 10^12 where there are none, so that such pages come last."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(name, r"(\d+)\D*$", 1), F.lit("")), F.lit("9" * 18)).cast("long"), F.lit(10**12))


def read_pages(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Page files <root>/<doc_id>/<page>.json, one object each, in the given schema; adds source_file and page_no. A file of another document fails the read."""
    p = spark.read.schema(schema).option("multiLine", True).json(f"{root}/*/*.json").withColumn("source_file", F.col("_metadata.file_path"))
    folder = F.element_at(F.split("source_file", "/"), -2)
    fits = F.when(F.col("doc_id").isNull() | (F.col("doc_id") == folder), F.col("doc_id")).otherwise(F.raise_error(F.concat(F.lit("other document in "), "source_file")))
    return p.withColumn("doc_id", F.coalesce(fits, folder)).withColumn("page_no", page_number(F.col("page")))


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines in the given schema, with the column of a folder per document where there is one; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def write_graph(tables: dict[str, DataFrame], root: str, by: str = "doc_id") -> None:
    """Each table as JSON lines below root, a folder per document; an empty table still gets its folder."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").partitionBy(by).json(f"{root}/{name}")
