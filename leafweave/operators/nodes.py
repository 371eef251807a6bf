"""From documents to blocks, roles, sections, evidence nodes and structural edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafweave.functions import text as tx

#: Lines of a document that make a page.
LINES_A_PAGE = 10


def blocks(documents: DataFrame, lines_a_page: int = LINES_A_PAGE) -> DataFrame:
    """One row per line: doc_id, block_no, page, text, and markdown with headings of five levels at fixed places."""
    b = documents.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_no", "text"))
    n = F.col("block_no")
    mark = F.when(n == 0, "# ").when(n % 7 == 0, "## ").when(n % 7 == 3, "### ").when(n % 7 == 5, "#### ").when(n % 14 == 8, "##### ").otherwise("")
    return b.select("doc_id", n.cast("long").alias("block_no"), (F.floor(n / lines_a_page)).cast("long").alias("page"), "text", F.concat(mark, "text").alias("markdown"))


def block_text(markdown: Column, text: Column) -> Column:
    """The markdown, even if empty, else the text, else nothing."""
    return F.coalesce(markdown, text, F.lit(""))


ORDER_ISSUES = ["duplicated_final_order", "missing_or_invalid_final_order", "deepseek_order_conflict", "geometry_order_conflict"]


def page_number(page: Column) -> Column:
    """The last number in a page's name; pages without one come last."""
    return F.coalesce(F.regexp_extract(page, r"(\d+)(?!.*\d)", 1).try_cast("long"), F.lit(10**12))


def reading_order(b: DataFrame) -> DataFrame:
    """Adds position: blocks of a document by page, by final_order else deepseek_order, by block_id as text and by place in the page (index)."""
    order = F.coalesce("final_order", "deepseek_order", F.lit(10**12)).cast("double")
    w = Window.partitionBy("doc_id").orderBy(page_number(F.col("page")), order, F.coalesce(F.col("block_id").cast("string"), F.lit("")), "index")
    return b.withColumn("position", F.row_number().over(w).cast("long"))


def order_issues(b: DataFrame, threshold: int = 3) -> DataFrame:
    """issue, doc_id, page, block_id (null for a duplicated order), final_order, other (the count, or the order in conflict)."""
    f, d, g_ = F.col("final_order"), F.col("deepseek_order"), F.col("geometry_order")
    row = lambda ok, k, other: F.when(ok, F.struct(F.lit(k).alias("issue"), other.cast("double").alias("other")))
    each = F.array(row(f.isNull(), ORDER_ISSUES[1], F.lit(None)), row(F.abs(f - d) > threshold, ORDER_ISSUES[2], d), row(f != g_, ORDER_ISSUES[3], g_))
    own = b.select("doc_id", "page", F.col("block_id").cast("string").alias("block_id"), f.cast("double").alias("final_order"), F.explode(F.array_compact(each)).alias("i")).select("i.issue", "doc_id", "page", "block_id", "final_order", "i.other")
    again = b.where(f.isNotNull()).groupBy("doc_id", "page", f.cast("double").alias("final_order")).agg(F.count("*").cast("double").alias("other")).where("other > 1")
    return own.unionByName(again.select(F.lit(ORDER_ISSUES[0]).alias("issue"), "doc_id", "page", F.lit(None).cast("string").alias("block_id"), "final_order", "other"))


#: A fixed value: how names of authors look.
AUTHORS = r"^[A-Z](?:\.\s*)?[A-Z]?\.?(?:\s+[A-Z][\p{L}\p{N}_'’-]+)+(?:\s+et al\.)?\s*(?:\\\(|\(|$)"


def role(markdown: Column, region_label: Column | None = None, region_role: Column | None = None, block_type: Column | None = None, flags: Column | None = None) -> Column:
    """The first rule that holds, over what layout says of a block and what its text looks like."""
    low = lambda c: F.lower(F.coalesce(c, F.lit(""))) if c is not None else F.lit("")
    label, region, kind, marks = (low(c) for c in (region_label, region_role, block_type, flags))
    t = F.regexp_replace(markdown, r"^\s+|\s+$", "")
    visible = F.regexp_replace(F.regexp_replace(t, r"\\[()\[\]]", ""), r"[^\p{L}\p{N}]+", "")
    like = lambda p: F.regexp_like(t, F.lit(p))
    return (
        F.when(label.isin("header", "header_text") | (region == "header"), "header")
        .when((label == "footer") | (region == "footer"), "footer")
        .when((label == "footnote") | (region == "footnote"), "footnote")
        .when(label.isin("doc_title", "document_title") | like(r"^#\s+"), "document_title")
        .when(label.isin("paragraph_title", "section_heading") | like(r"^#{2,6}\s+") | (F.contains(kind, F.lit("heading")) & (t != "")), "section_heading")
        .when(like(r"(?i)^(?:doi\s*:|https?://(?:dx\.)?doi\.org/)"), "identifier_metadata")
        .when(like(r"(?i)\b(?:received|accepted|published)\s+\d{1,2}\s+[A-Za-z]+\s+\d{4}\b"), "publication_metadata")
        .when((F.char_length(t) <= 250) & ~like(r"^\[\d+\]") & like(r"(?i)\b(?:collaboration|consortium)\b"), "author_metadata")
        .when(like(AUTHORS), "author_metadata")
        .when((F.char_length(visible) <= 1) | ((F.char_length(visible) <= 3) & ~F.regexp_like(visible, F.lit(r"\p{L}"))), "ocr_noise")
        .when(F.regexp_like(marks, F.lit("ocr_noise|garbage|meaningless")), "ocr_noise")
        .otherwise("evidence_content")
    )


LEVELS = 5


def with_sections(b: DataFrame) -> DataFrame:
    """Each block's section under a stack of headings: section_no (count of headings so far), head_level, parent_no, and the path, the numbers and titles of the headings that hold it.

    A heading of level k closes all of level k or more. So its parent is the last heading of a lower level, and a heading is
    open as long as none of its level or a lower one follows: windows over the document, one running value for each level.
    """
    w = Window.partitionBy("doc_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("doc_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    head = F.col("role") == "section_heading"
    level = F.when(head, F.greatest(F.lit(1), F.length(F.regexp_extract("markdown", r"^\s*(#{1,6})\s+", 1)) - 1))
    b = b.withColumn("head_level", level).withColumn("section_no", F.sum(head.cast("int")).over(w))
    title = F.trim(F.regexp_replace("markdown", r"^\s*#{1,6}\s*", ""))
    last = lambda k, over: F.max(F.when(F.col("head_level") == k, F.col("section_no"))).over(over)
    for k in range(1, LEVELS + 1):
        b = b.withColumn(f"_s{k}", last(k, w)).withColumn(f"_p{k}", last(k, before)).withColumn(f"_t{k}", F.last(F.when(F.col("head_level") == k, title), True).over(w))
    lower = lambda k: F.greatest(F.lit(0), *(F.coalesce(f"_s{j}", F.lit(0)) for j in range(1, k))) if k > 1 else F.lit(0)
    held = [F.when(F.col(f"_s{k}") > lower(k), F.struct(F.col(f"_s{k}").alias("no"), F.col(f"_t{k}").alias("title"))) for k in range(1, LEVELS + 1)]
    parent = F.when(F.col("head_level") > 1, F.nullif(F.greatest(F.lit(0), *(F.when(F.col("head_level") > k, F.col(f"_p{k}")) for k in range(1, LEVELS))), F.lit(0)))
    b = b.withColumn("parent_no", parent).withColumn("path", F.array_compact(F.array(*held)))
    return b.drop(*(f"_{x}{k}" for x in "spt" for k in range(1, LEVELS + 1)))


def evidence(b: DataFrame) -> DataFrame:
    """Evidence nodes in order: node_id, document_order, completeness."""
    e = b.where(F.col("role") == "evidence_content")
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("block_no"))
    e = e.withColumn("document_order", order.cast("long")).withColumn("plain", tx.plain_text(F.col("markdown")))
    reason = tx.incomplete_reason(F.col("plain"))
    return e.withColumn("reason", reason).select(
        F.format_string("%d_EV_%06d", "doc_id", "document_order").alias("node_id"),
        "doc_id", "document_order", "block_no", "page", "section_no", "plain", F.col("reason").isNull().alias("is_complete"), "reason",
    )


def structural_edges(e: DataFrame) -> DataFrame:
    """IN_DOCUMENT, IN_SECTION, NEXT, PREVIOUS and CONTINUES_TO edges of evidence nodes: source, target, edge_type, confidence."""
    w = Window.partitionBy("doc_id").orderBy("document_order")
    n = e.withColumn("next_id", F.lead("node_id").over(w)).withColumn("next_text", F.lead("plain").over(w)).withColumn("next_page", F.lead("page").over(w))
    first = F.substring(F.regexp_replace("next_text", r"^\s+", ""), 1, 1)
    lower = F.regexp_like(first, F.lit(r"^\p{Ll}$"))
    has = F.col("next_id").isNotNull()

    def edge(s, t, kind, c):
        return F.struct(s.alias("source"), t.alias("target"), F.lit(kind).alias("edge_type"), c.cast("double").alias("confidence"))

    node, one = F.col("node_id"), F.lit(1.0)
    section = F.format_string("%d_SEC_%04d", "doc_id", "section_no")
    each = F.array(
        edge(node, F.col("doc_id").cast("string"), "IN_DOCUMENT", one),
        F.when(F.col("section_no") > 0, edge(node, section, "IN_SECTION", one)),
        F.when(has, edge(node, F.col("next_id"), "NEXT", one)),
        F.when(has, edge(F.col("next_id"), node, "PREVIOUS", one)),
        F.when(has & ~F.col("is_complete") & lower, edge(node, F.col("next_id"), "CONTINUES_TO", F.when(F.col("page") != F.col("next_page"), 0.93).otherwise(0.90))),
    )
    return n.select(F.explode(F.array_compact(each)).alias("e")).select("e.*")
