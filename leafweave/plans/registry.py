"""The registered queries: operators over the driver's tables, each beside its SQL where SQL can express it.

Tables have no boxes, headings or mentions, so those are derived from keys, alike on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafweave.functions import geometry as g
from leafweave.functions import text as tx
from leafweave.operators import evaluation, graph, nodes, retrieval, sequence, spatial

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Rows of a table that meet in one task where a query deals them by a key.
ROWS_A_TASK = 250_000


def tasks_for(rows: DataFrame, times: int = 1) -> int:
    """A number of partitions that grows with a table (its count comes from the files' footers), so that what a task holds does not."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() * times // ROWS_A_TASK))


def lines_by_order(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Columns of lineitem, dealt by order at once: groups, windows and joins of an order's lines need no other exchange."""
    n = t(spark, sf, "lineitem").select("l_orderkey", *columns)
    return n.repartition(tasks_for(n), "l_orderkey")


# --- documents to graph -------------------------------------------------------------------------

LINES = """lines AS (
  SELECT doc_id, i - 1 AS block_no, (i - 1) // 10 AS page, a[i] AS text FROM (
    SELECT doc_id, a, unnest(generate_series(1, len(a))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL))
), blocks AS (
  SELECT *, CASE WHEN block_no = 0 THEN '# ' WHEN block_no % 7 = 0 THEN '## ' WHEN block_no % 7 = 3 THEN '### ' WHEN block_no % 7 = 5 THEN '#### ' WHEN block_no % 14 = 8 THEN '##### ' ELSE '' END || text AS markdown FROM lines
)"""
ROLES = (
    LINES
    + r""", trimmed AS (SELECT *, regexp_replace(regexp_replace(markdown, '^\s+', ''), '\s+$', '') AS s FROM blocks),
roles AS (SELECT *, CASE
  WHEN regexp_matches(s, '^#\s+') THEN 'document_title' WHEN regexp_matches(s, '^#{2,6}\s+') THEN 'section_heading'
  WHEN regexp_matches(s, '(?i)^(?:doi\s*:|https?://(?:dx\.)?doi\.org/)') THEN 'identifier_metadata'
  WHEN regexp_matches(s, '(?i)\b(?:received|accepted|published)\s+\d{1,2}\s+[A-Za-z]+\s+\d{4}\b') THEN 'publication_metadata'
  WHEN length(s) <= 250 AND NOT regexp_matches(s, '^\[\d+\]') AND regexp_matches(s, '(?i)\b(?:collaboration|consortium)\b') THEN 'author_metadata'
  WHEN regexp_matches(s, '^[A-Z](?:\.\s*)?[A-Z]?\.?(?:\s+[A-Z][\p{L}\p{N}_''’-]+)+(?:\s+et al\.)?\s*(?:\\\(|\(|$)') THEN 'author_metadata'
  WHEN length(v) <= 1 OR (length(v) <= 3 AND NOT regexp_matches(v, '\p{L}')) THEN 'ocr_noise' ELSE 'evidence_content' END AS role
  FROM (SELECT *, regexp_replace(regexp_replace(s, '\\[()\[\]]', '', 'g'), '[^\p{L}\p{N}]+', '', 'g') AS v FROM trimmed))"""
)
EVIDENCE = (
    ROLES
    + r""", secs AS (SELECT *, sum(CASE WHEN role = 'section_heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_no) AS section_no FROM roles),
plain AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_no) AS document_order,
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(markdown, '(?m)^#{1,6}\s*', '', 'g'), '!\[([^\]]*)\]\([^)]+\)', '\1', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '[*~`]', '', 'g'), ' ') AS plain
  FROM secs WHERE role = 'evidence_content'),
evidence AS (SELECT *, format('{:d}_EV_{:06d}', doc_id, document_order) AS node_id, CASE WHEN e = '' THEN 'empty_text'
  WHEN regexp_matches(e, '[\p{L}\p{N}_]-$') THEN 'ends_with_hyphenated_word'
  WHEN regexp_matches(e, '(?i)(?:^|[^\p{L}\p{N}_])(?:a|an|the|and|or|but|of|to|in|on|at|for|from|with|by|as|that|which|is|are|was|were)$') THEN 'ends_with_unfinished_phrase'
  WHEN NOT regexp_matches(e, '[.!?][\]\)\}"''’”]*$') THEN 'does_not_end_with_terminal_punctuation' END AS reason
  FROM (SELECT *, regexp_replace(plain, '\s+$', '') AS e FROM plain))"""
)
EDGES = (
    EVIDENCE
    + r""", n AS (SELECT *, lead(node_id) OVER w AS next_id, lead(plain) OVER w AS next_text, lead(page) OVER w AS next_page FROM evidence WINDOW w AS (PARTITION BY doc_id ORDER BY document_order)),
edges AS (
  SELECT node_id AS source, doc_id::VARCHAR AS target, 'IN_DOCUMENT' AS edge_type, 1.0::DOUBLE AS confidence FROM n
  UNION ALL SELECT node_id, format('{:d}_SEC_{:04d}', doc_id, section_no::BIGINT), 'IN_SECTION', 1.0 FROM n WHERE section_no > 0
  UNION ALL SELECT node_id, next_id, 'NEXT', 1.0 FROM n WHERE next_id IS NOT NULL
  UNION ALL SELECT next_id, node_id, 'PREVIOUS', 1.0 FROM n WHERE next_id IS NOT NULL
  UNION ALL SELECT node_id, next_id, 'CONTINUES_TO', CASE WHEN page <> next_page THEN 0.93 ELSE 0.90 END FROM n
    WHERE next_id IS NOT NULL AND reason IS NOT NULL AND regexp_matches(left(regexp_replace(next_text, '^\s+', ''), 1), '^\p{Ll}$'))"""
)


def _roles(spark, sf, by_document=False):
    """by_document: deal documents by id first, so that every window over a document that follows needs no exchange of its blocks."""
    d = t(spark, sf, "documents").select("doc_id", "text")
    return nodes.blocks(d.repartition("doc_id") if by_document else d).withColumn("role", nodes.role(F.col("markdown")))


def _evidence(spark, sf):
    return nodes.evidence(nodes.with_sections(_roles(spark, sf, True)))


def flagship(spark, sf):
    """Documents to blocks, roles, evidence nodes and structural edges, counted by type."""
    return structural_edge_counts(spark, sf)


@query("WITH " + LINES + " SELECT doc_id, block_no, page, length(text) AS chars FROM blocks")
def blocks_scan(spark, sf):
    return nodes.blocks(t(spark, sf, "documents")).select("doc_id", "block_no", "page", F.char_length("text").cast("long").alias("chars"))


@query("WITH " + ROLES + " SELECT doc_id, block_no, role FROM roles")
def block_roles(spark, sf):
    return _roles(spark, sf).select("doc_id", "block_no", "role")


@query("WITH " + ROLES + " SELECT role, count(*) AS blocks, count(DISTINCT doc_id) AS documents FROM roles GROUP BY role")
def role_statistics(spark, sf):
    return _roles(spark, sf).groupBy("role").agg(F.count("*").alias("blocks"), F.countDistinct("doc_id").alias("documents"))


@query(
    "WITH "
    + ROLES
    + r""", h AS (SELECT doc_id, block_no, CASE WHEN regexp_matches(markdown, '^#{1,6}\s') THEN greatest(1, length(regexp_extract(markdown, '^(#{1,6})\s+', 1)) - 1) ELSE 1 END AS lv, row_number() OVER (PARTITION BY doc_id ORDER BY block_no) AS no FROM roles WHERE role = 'section_heading'),
p AS (SELECT c.doc_id, c.no, c.lv, c.block_no, max(o.no) AS parent FROM h c LEFT JOIN h o ON o.doc_id = c.doc_id AND o.no < c.no AND o.lv < c.lv GROUP BY ALL),
g1 AS (SELECT x.*, y.parent AS g1 FROM p x LEFT JOIN p y ON y.doc_id = x.doc_id AND y.no = x.parent), g2 AS (SELECT x.*, y.parent AS g2 FROM g1 x LEFT JOIN p y ON y.doc_id = x.doc_id AND y.no = x.g1), g3 AS (SELECT x.*, y.parent AS g3 FROM g2 x LEFT JOIN p y ON y.doc_id = x.doc_id AND y.no = x.g2)
SELECT doc_id, no AS section_no, lv::BIGINT AS level, parent AS parent_no, block_no, concat_ws('/', g3, g2, g1, parent, no) AS path FROM g3"""
)
def sections(spark, sf):
    s = nodes.with_sections(_roles(spark, sf, True)).where("role = 'section_heading'")
    return s.select("doc_id", F.col("section_no").cast("long").alias("section_no"), F.col("head_level").cast("long").alias("level"), F.col("parent_no").cast("long").alias("parent_no"), "block_no", F.array_join(F.transform("path", lambda x: x["no"].cast("string")), "/").alias("path"))


LAID = {
    "label": "CASE block_no % 13 WHEN 1 THEN 'Header' WHEN 2 THEN 'footer' WHEN 3 THEN 'doc_title' WHEN 4 THEN 'paragraph_title' WHEN 6 THEN 'text' END",
    "region": "CASE block_no % 17 WHEN 2 THEN 'footnote' WHEN 3 THEN 'HEADER' WHEN 5 THEN 'footer' END",
    "kind": "CASE block_no % 19 WHEN 4 THEN 'sub_heading' WHEN 5 THEN 'text' END",
    "flags": "CASE block_no % 11 WHEN 3 THEN 'no_layout_match garbage' WHEN 4 THEN 'small' END",
}


@query(
    "WITH "
    + ROLES
    + f""", x AS (SELECT *, {', '.join(f'{e} AS {k}' for k, e in LAID.items())} FROM roles),
y AS (SELECT *, lower(coalesce(label, '')) AS l, lower(coalesce(region, '')) AS r FROM x)
SELECT doc_id, block_no, CASE WHEN l IN ('header', 'header_text') OR r = 'header' THEN 'header' WHEN l = 'footer' OR r = 'footer' THEN 'footer' WHEN l = 'footnote' OR r = 'footnote' THEN 'footnote' WHEN l = 'doc_title' OR role = 'document_title' THEN 'document_title'
  WHEN l = 'paragraph_title' OR role = 'section_heading' OR (kind = 'sub_heading' AND s <> '') THEN 'section_heading' WHEN role = 'evidence_content' AND coalesce(flags, '') LIKE '%garbage%' THEN 'ocr_noise' ELSE role END AS role FROM y"""
)
def laid_out_roles(spark, sf):
    b = nodes.blocks(t(spark, sf, "documents").select("doc_id", "text")).selectExpr("*", *(f"{e} as {k}" for k, e in LAID.items()))
    return b.select("doc_id", "block_no", nodes.role(nodes.block_text(F.col("markdown"), F.col("text")), *(F.col(k) for k in LAID)).alias("role"))


PAGED = {
    "doc_id": "l_orderkey % 2000",
    "page": "CASE WHEN l_orderkey % 5 = 0 THEN 'cover' ELSE 'p2_page_' || (l_orderkey % 31) END",
    "block_id": "l_partkey",
    "index": "(l_orderkey * 10 + l_linenumber) * 100000 + l_suppkey",
    "final_order": "CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE l_partkey % 9 END",
    "deepseek_order": "CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_linenumber END",
    "geometry_order": "CASE WHEN l_suppkey % 3 = 0 THEN l_partkey % 9 ELSE l_linenumber END",
}
PAGED_SQL = "pg AS (SELECT " + ", ".join(f'{e} AS "{k}"' for k, e in PAGED.items()) + ", l_orderkey AS tie FROM lineitem)"


def _paged(spark, sf):
    return t(spark, sf, "lineitem").selectExpr(*(f"{e} as `{k}`" for k, e in PAGED.items()), "l_orderkey as tie")


@query(
    f"""WITH {PAGED_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN page = 'cover' THEN 1000000000000 ELSE regexp_extract(page, '([0-9]+)$', 1)::BIGINT END, coalesce(final_order, deepseek_order, 1000000000000), block_id::VARCHAR, index) AS position FROM pg)
SELECT doc_id, position, page, final_order, deepseek_order, block_id, index FROM o"""
)
def reading_order(spark, sf):
    return nodes.reading_order(_paged(spark, sf)).select("doc_id", "position", "page", "final_order", "deepseek_order", "block_id", "index")


@query(
    f"""WITH {PAGED_SQL} SELECT 'missing_or_invalid_final_order' AS issue, doc_id, page, block_id::VARCHAR AS block_id, final_order::DOUBLE AS final_order, NULL::DOUBLE AS other FROM pg WHERE final_order IS NULL
UNION ALL SELECT 'deepseek_order_conflict', doc_id, page, block_id::VARCHAR, final_order, deepseek_order FROM pg WHERE abs(final_order - deepseek_order) > 3
UNION ALL SELECT 'geometry_order_conflict', doc_id, page, block_id::VARCHAR, final_order, geometry_order FROM pg WHERE final_order <> geometry_order
UNION ALL SELECT 'duplicated_final_order', doc_id, page, NULL, final_order, count(*) FROM pg WHERE final_order IS NOT NULL GROUP BY doc_id, page, final_order HAVING count(*) > 1"""
)
def order_issues(spark, sf):
    return nodes.order_issues(_paged(spark, sf))


@query("WITH " + EVIDENCE + " SELECT node_id, doc_id, document_order, page, reason IS NULL AS is_complete, reason FROM evidence")
def evidence_nodes(spark, sf):
    return _evidence(spark, sf).select("node_id", "doc_id", "document_order", "page", "is_complete", "reason")


@query("WITH " + EVIDENCE + " SELECT coalesce(reason, 'complete') AS state, count(*) AS nodes, count(DISTINCT doc_id) AS documents FROM evidence GROUP BY 1")
def completeness_flags(spark, sf):
    return _evidence(spark, sf).groupBy(F.coalesce("reason", F.lit("complete")).alias("state")).agg(F.count("*").alias("nodes"), F.countDistinct("doc_id").alias("documents"))


@query("WITH " + EDGES + " SELECT source, target, edge_type, confidence FROM edges")
def structural_edges(spark, sf):
    return nodes.structural_edges(_evidence(spark, sf))


@query("WITH " + EDGES + " SELECT edge_type, count(*) AS edges, count(*) FILTER (WHERE confidence > 0.91) AS confident FROM edges GROUP BY edge_type")
def structural_edge_counts(spark, sf):
    return nodes.structural_edges(_evidence(spark, sf)).groupBy("edge_type").agg(F.count("*").alias("edges"), F.sum((F.col("confidence") > 0.91).cast("long")).alias("confident"))


@query(
    "WITH "
    + LINES
    + r""", n AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), 'https?://', '', 'g'), '\d+', '#', 'g'), '[^a-zà-öø-ÿ0-9#@./:+_-]+', ' ', 'g'), ' ') AS form FROM blocks),
c AS (SELECT form, count(DISTINCT doc_id) AS documents, count(*) AS blocks FROM n WHERE length(form) >= 3 GROUP BY form HAVING count(DISTINCT doc_id) >= 3),
d AS (SELECT count(DISTINCT doc_id) AS total FROM n)
SELECT form, documents, blocks, CASE WHEN documents >= 0.8 * total THEN 'UNIVERSAL' WHEN documents >= 0.1 * total THEN 'SECTION_SPECIFIC' ELSE 'REPEATED' END AS pattern FROM c, d"""
)
def repeated_templates(spark, sf):
    d = t(spark, sf, "documents").where("text is not null").select("doc_id", "text").repartition("doc_id")
    total = d.agg(F.countDistinct("doc_id").alias("total"))
    form = lambda df: df.select("doc_id", F.explode(F.split(F.lower("text"), "\n")).alias("line")).select("doc_id", tx.once(tx.normalised(F.col("line"), lowered=True)).alias("form")).where(F.char_length("form") >= 3)
    # Forms are counted by 16-byte digests; only those of the few that repeat are read again.
    n = form(d).select("doc_id", F.unhex(F.md5("form")).alias("key"))
    c = n.groupBy("key", "doc_id").agg(F.count("*").alias("k")).groupBy("key").agg(F.count("*").alias("documents"), F.sum("k").alias("blocks")).where("documents >= 3")
    names = form(d).withColumn("key", F.unhex(F.md5("form"))).join(c, "key").groupBy("key").agg(F.first("form").alias("form"), F.first("documents").alias("documents"), F.first("blocks").alias("blocks"))
    p = F.when(F.col("documents") >= 0.8 * F.col("total"), "UNIVERSAL").when(F.col("documents") >= 0.1 * F.col("total"), "SECTION_SPECIFIC").otherwise("REPEATED")
    return names.join(F.broadcast(total)).select("form", "documents", "blocks", p.alias("pattern"))


# --- text checks --------------------------------------------------------------------------------

ENT = r"""e AS (SELECT doc_id, text,
  regexp_extract_all(text, '\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b') AS email,
  regexp_extract_all(text, '(?i)\b(?:https?://|www\.)[^\s<>()]+') AS url,
  regexp_extract_all(text, '(?i)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+\b') AS doi FROM documents WHERE text IS NOT NULL)"""


@query("WITH " + ENT + " SELECT doc_id, array_to_string(email, ' ') AS email, array_to_string(url, ' ') AS url, array_to_string(doi, ' ') AS doi FROM e WHERE len(email) + len(url) + len(doi) > 0")
def entity_extraction(spark, sf):
    e = t(spark, sf, "documents").where("text is not null").select("doc_id", tx.entities(F.col("text")).alias("e")).select("doc_id", "e.*")
    return e.where(F.size("email") + F.size("url") + F.size("doi") > 0).select("doc_id", *(F.array_join(k, " ").alias(k) for k in ("email", "url", "doi")))


@query(
    r"""SELECT doc_id, md5(m) AS masked_md5, (length(m) - length(replace(m, '[UNVERIFIED_', ''))) // 12 AS masks FROM (SELECT doc_id,
  regexp_replace(regexp_replace(regexp_replace(text, '\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b', '[UNVERIFIED_EMAIL]', 'g'), '(?i)\b(?:https?://|www\.)[^\s<>()]+', '[UNVERIFIED_URL]', 'g'), '(?i)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+\b', '[UNVERIFIED_DOI]', 'g') AS m FROM documents WHERE text IS NOT NULL)"""
)
def entity_masking(spark, sf):
    m = t(spark, sf, "documents").where("text is not null").select("doc_id", tx.masked(F.col("text")).alias("m"))
    n = F.char_length("m") - F.char_length(F.replace("m", F.lit("[UNVERIFIED_"), F.lit("")))
    return m.select("doc_id", F.md5("m").alias("masked_md5"), F.floor(n / 12).cast("long").alias("masks"))


@query(
    r"""WITH k AS (SELECT doc_id, regexp_extract_all(lower(text), '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)?') AS a FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, unnest(a) AS x FROM k WHERE len(a) >= 12), c AS (SELECT doc_id, x, count(*) AS n FROM w GROUP BY 1, 2),
o AS (SELECT doc_id, count(*) AS kinds, sum(n)::BIGINT AS total, max(n) AS most FROM c GROUP BY 1),
b AS (SELECT doc_id, unnest(list_transform(generate_series(1, len(a) - 1), lambda i: a[i] || ' ' || a[i + 1])) AS x FROM k WHERE len(a) >= 12),
m AS (SELECT doc_id, max(n) AS pairs FROM (SELECT doc_id, x, count(*) AS n FROM b GROUP BY 1, 2) GROUP BY 1)
SELECT doc_id, kinds / total < 0.35 AS low_unique, most >= 6 AND most / total >= 0.25 AS one_token, pairs >= 4 AS bigram_loop FROM o JOIN m USING (doc_id)
WHERE kinds / total < 0.35 OR (most >= 6 AND most / total >= 0.25) OR pairs >= 4"""
)
def repetition_flags(spark, sf):
    # A document's tokens are counted within its row, so memory goes with the longest document and not with the table. once() has them found once for all the rules.
    k = t(spark, sf, "documents").where("text is not null").select("doc_id", "text").repartition("doc_id").select("doc_id", tx.once(tx.tokens(F.col("text"))).alias("a")).where(F.size("a") >= 12)
    n = F.size("a")
    most = F.greatest(F.lit(6), F.ceil(n / 4).cast("int"))
    pairs = F.zip_with(F.slice("a", 1, n - 1), F.slice("a", 2, n - 1), lambda x, y: F.concat(x, F.lit(" "), y))
    k = k.select("doc_id", "a", (F.size(F.array_distinct("a")) / n < 0.35).alias("low_unique"), most.alias("most"), tx.once(F.sort_array("a")).alias("s"))
    k = k.select("doc_id", "low_unique", tx.repeats("s", "most").alias("one_token"), tx.once(F.sort_array(pairs)).alias("s"))
    r = k.select("doc_id", tx.once(F.struct("low_unique", "one_token", tx.repeats("s", F.lit(4)).alias("bigram_loop"))).alias("r")).select("doc_id", "r.*")
    return r.where("low_unique or one_token or bigram_loop")


@query(
    r"""SELECT doc_id, length(o) AS odd, length(text) >= 50 AND length(o) / length(text) > 0.10 AS abnormal, regexp_matches(text, '\S{45,}') AS very_long_token
FROM (SELECT doc_id, text, regexp_replace(text, '[\p{L}\p{N}\s.,;:!?()\[\]{}+\-–—_/\\''"%&@#€$£°=<>]+', '', 'g') AS o FROM documents WHERE text IS NOT NULL)"""
)
def abnormal_characters(spark, sf):
    d = t(spark, sf, "documents").where("text is not null")
    odd = F.char_length(F.regexp_replace("text", "[" + tx.ODD[2:] + "+", "")).cast("long")
    return d.select("doc_id", odd.alias("odd"), ((F.char_length("text") >= 50) & (odd / F.char_length("text") > 0.10)).alias("abnormal"), F.regexp_like("text", F.lit(r"\S{45,}")).alias("very_long_token"))


@query(
    """WITH b AS (SELECT doc_id, source, len(string_split(text, chr(10))) AS blocks, length(text) AS chars FROM documents WHERE text IS NOT NULL),
q AS (SELECT source, quantile_cont(chars, 0.5) AS median, quantile_cont(chars, 0.95) AS p95 FROM b GROUP BY source)
SELECT source, count(*) AS documents, round(any_value(median), 4) AS median, round(any_value(p95), 4) AS p95, count(*) FILTER (WHERE chars > p95) AS above, sum(blocks)::BIGINT AS blocks FROM b JOIN q USING (source) GROUP BY source"""
)
def density_outliers(spark, sf):
    b = t(spark, sf, "documents").where("text is not null").select("source", F.size(F.split("text", "\n")).cast("long").alias("blocks"), F.char_length("text").alias("chars"))
    q = b.groupBy("source").agg(F.percentile("chars", F.lit(0.5)).alias("median"), F.percentile("chars", F.lit(0.95)).alias("p95"))
    return b.join(q, "source").groupBy("source").agg(F.count("*").alias("documents"), F.round(F.first("median"), 4).alias("median"), F.round(F.first("p95"), 4).alias("p95"), F.sum((F.col("chars") > F.col("p95")).cast("long")).alias("above"), F.sum("blocks").alias("blocks"))


# --- boxes --------------------------------------------------------------------------------------

BOX = """raw AS (SELECT l_orderkey AS page, l_linenumber AS n, (l_linenumber * 40 + l_partkey % 50)::DOUBLE AS x1, (l_suppkey % 60 * 10)::DOUBLE AS y1, (l_linenumber * 40 + l_partkey % 50 + 40 + l_partkey % 120)::DOUBLE AS x2, (l_suppkey % 60 * 10 + 20 + l_partkey % 180)::DOUBLE AS y2 FROM lineitem),
b AS (SELECT page, n AS block_id, x1, y1, x2, y2 FROM raw WHERE n % 2 = 1), r AS (SELECT page, n AS region_id, x1 AS u1, y1 AS v1, x2 AS u2, y2 AS v2 FROM raw WHERE n % 2 = 0)"""


def _boxes(spark, sf):
    x, y = F.col("l_linenumber") * 40 + F.col("l_partkey") % 50, F.col("l_suppkey") % 60 * 10
    return t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("n"), g.box(x, y, x + 40 + F.col("l_partkey") % 120, y + 20 + F.col("l_partkey") % 180).alias("box"))


def _sides(spark, sf):
    b = _boxes(spark, sf)
    return b.where("n % 2 = 1").withColumnRenamed("n", "block_id"), b.where("n % 2 = 0").withColumnRenamed("n", "region_id")


INTER = "greatest(0.0, least(x2, u2) - greatest(x1, u1)) * greatest(0.0, least(y2, v2) - greatest(y1, v1))"
INSIDE = "((x1 + x2) / 2 BETWEEN u1 AND u2 AND (y1 + y2) / 2 BETWEEN v1 AND v2)"


@query(
    f"""WITH {BOX}, j AS (SELECT *, {INTER} AS i, (x2 - x1) * (y2 - y1) AS ab, (u2 - u1) * (v2 - v1) AS ar, {INSIDE} AS inside FROM b JOIN r USING (page)),
s AS (SELECT *, i / ab AS contain, i / (ab + ar - i) AS iou FROM j),
k AS (SELECT *, round(0.60 * contain + 0.20 * inside::INT + 0.15 * iou + 0.05, 8) AS score FROM s WHERE contain >= 0.20 OR inside),
m AS (SELECT *, row_number() OVER (PARTITION BY page, block_id ORDER BY score DESC, round(contain, 8) DESC, round(iou, 8) DESC, region_id) AS rank FROM k)
SELECT page, block_id, region_id, floor(score * 10000 + 1e-6)::BIGINT AS score_e4 FROM m WHERE rank = 1 AND score >= 0.25"""
)
def spatial_match_best_region(spark, sf):
    return spatial.match_regions(*_sides(spark, sf)).select("page", "block_id", "region_id", F.floor(F.col("score") * 10000 + 1e-6).cast("long").alias("score_e4"))


@query(
    f"""WITH {BOX}, c AS (SELECT page, n AS child, x1, y1, x2, y2 FROM raw), p AS (SELECT page, n AS parent, x1 AS u1, y1 AS v1, x2 AS u2, y2 AS v2 FROM raw),
j AS (SELECT *, (x2 - x1) * (y2 - y1) AS ca, (u2 - u1) * (v2 - v1) AS pa, {INTER} / ((x2 - x1) * (y2 - y1)) AS cover, {INSIDE} AS inside FROM c JOIN p USING (page) WHERE child <> parent),
m AS (SELECT *, row_number() OVER (PARTITION BY page, child ORDER BY pa, parent, round(cover, 6) DESC) AS rank FROM j WHERE (cover >= 0.82 OR (cover >= 0.68 AND inside)) AND pa >= 1.2 * ca AND pa <= 0.92 * 420000.0)
SELECT page, child, parent, round(cover, 6) AS coverage FROM m WHERE rank = 1"""
)
def visual_parent_child(spark, sf):
    return spatial.parents(_boxes(spark, sf).withColumnRenamed("n", "region_id"), 420000.0)


@query(
    f"""WITH {BOX}, j AS (SELECT page, region_id, block_id, y1 - v2 AS gap, greatest(0.0, least(x2, u2) - greatest(x1, u1)) / least(x2 - x1, u2 - u1) AS share FROM r JOIN b USING (page)),
s AS (SELECT *, round(0.60 * share + 0.30 * greatest(0.0, 1 - greatest(gap, 0.0) / 160.0), 6) AS score FROM j WHERE gap BETWEEN -25 AND 160 AND share >= 0.18),
m AS (SELECT *, row_number() OVER (PARTITION BY page, region_id ORDER BY score DESC, block_id) AS rank FROM s)
SELECT page, region_id, block_id, rank, floor(score * 10000 + 1e-3)::BIGINT AS score_e4 FROM m WHERE rank <= 3"""
)
def caption_range_topk(spark, sf):
    b, r = _sides(spark, sf)
    return spatial.captions(r, b).select("page", "region_id", "block_id", "rank", F.floor(F.col("score") * 10000 + 1e-3).cast("long").alias("score_e4"))


@query(f"WITH {BOX} SELECT page, count(*) AS boxes, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, sum((x2 - x1) * (y2 - y1)) AS area FROM raw GROUP BY page")
def page_union_boxes(spark, sf):
    return _boxes(spark, sf).groupBy("page").agg(F.count("*").alias("boxes"), g.union_all(F.col("box")).alias("u"), F.sum(g.area(F.col("box"))).alias("area")).select("page", "boxes", "u.*", "area")


# --- edges --------------------------------------------------------------------------------------

REMAP = """e AS (SELECT o_orderkey AS seq, o_custkey AS source, (SELECT max(c_custkey) FROM customer) - o_custkey AS target, CASE o_orderkey % 4 WHEN 0 THEN 'CAPTION_OF' WHEN 1 THEN 'IN_DOCUMENT' ELSE 'NEXT' END AS edge_type FROM orders),
a AS (SELECT c_custkey AS s, c_custkey // 2 AS c FROM customer WHERE c_custkey % 3 = 0), on_ AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 11 <> 0),
m AS (SELECT seq, edge_type, coalesce(x.c, e.source) AS source, coalesce(y.c, e.target) AS target FROM e LEFT JOIN a x ON e.source = x.s LEFT JOIN a y ON e.target = y.s),
o AS (SELECT *, CASE WHEN edge_type = 'CAPTION_OF' THEN 'dropped_by_type' WHEN source = target THEN 'dropped_self_loop_after_remap'
  WHEN source NOT IN (SELECT id FROM on_) OR target NOT IN (SELECT id FROM on_) THEN 'dropped_dangling_after_remap' ELSE 'output' END AS outcome FROM m),
d AS (SELECT seq, source, target, edge_type, CASE WHEN outcome = 'output' AND row_number() OVER (PARTITION BY source, target, edge_type, outcome ORDER BY seq) > 1 THEN 'dropped_duplicate_after_remap' ELSE outcome END AS outcome FROM o)"""


def _graph(spark, sf):
    """The edges of orders over all customers, the customers' aliases and the active ones."""
    c, k = t(spark, sf, "customer"), F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "CAPTION_OF").when(k % 4 == 1, "IN_DOCUMENT").otherwise("NEXT")
    e = t(spark, sf, "orders").crossJoin(F.broadcast(c.agg(F.max("c_custkey").alias("most"))))
    e = e.select(k.alias("seq"), F.col("o_custkey").alias("source"), (F.col("most") - F.col("o_custkey")).alias("target"), kind.alias("edge_type"))
    a = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("source_node_id"), F.floor(F.col("c_custkey") / 2).alias("canonical_node_id"))
    return e, a, c.where("c_custkey % 11 <> 0").select(F.col("c_custkey").alias("node_id"))


def _edges(spark, sf):
    return _graph(spark, sf)[0]


@query(f"WITH {REMAP} SELECT seq, source, target, edge_type FROM d WHERE outcome = 'output'")
def edge_remap(spark, sf):
    return graph.remap(*_graph(spark, sf), ["CAPTION_OF"]).where("outcome = 'output'").drop("outcome")


@query(f"WITH {REMAP} SELECT outcome, count(*) AS edges FROM d GROUP BY outcome")
def edge_remap_stats(spark, sf):
    return graph.remap(*_graph(spark, sf), ["CAPTION_OF"]).groupBy("outcome").agg(F.count("*").alias("edges"))


@query(f"WITH {REMAP} SELECT source, target, edge_type, count(*) AS copies FROM e GROUP BY ALL HAVING count(*) > 1")
def duplicate_edges(spark, sf):
    return _edges(spark, sf).groupBy("source", "target", "edge_type").agg(F.count("*").alias("copies")).where("copies > 1")


@query(f"WITH {REMAP} SELECT seq, source, target FROM e WHERE source NOT IN (SELECT id FROM on_) OR target NOT IN (SELECT id FROM on_)")
def dangling_edges(spark, sf):
    e, _, on = _graph(spark, sf)
    bad = e.join(on, e["source"] == on["node_id"], "left_anti").unionByName(e.join(on, e["target"] == on["node_id"], "left_anti"))
    return bad.select("seq", "source", "target").distinct()


@query(f"WITH {REMAP} SELECT node, count(*) AS degree, count(DISTINCT other) AS neighbours FROM (SELECT source AS node, target AS other FROM e WHERE source <> target UNION ALL SELECT target, source FROM e WHERE source <> target) GROUP BY node")
def node_degrees(spark, sf):
    e = _edges(spark, sf).where("source <> target")
    both = e.select(F.explode(F.array(F.struct(F.col("source").alias("node"), F.col("target").alias("other")), F.struct(F.col("target").alias("node"), F.col("source").alias("other")))).alias("e")).select("e.*")
    return both.groupBy("node").agg(F.count("*").alias("degree"), F.countDistinct("other").alias("neighbours"))


@query()
def connected_components(spark, sf):
    """Orders and parts (as -1 - l_partkey), linked by every row of lineitem. Recursive SQL is too slow on it; tested beside union-find."""
    return graph.components(t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("source"), (-1 - F.col("l_partkey")).alias("target")))


INVERSE = {"SUPPORTS": "IS_SUPPORTED_BY", "EXPLAINS": "IS_EXPLAINED_BY", "ELABORATES": "IS_ELABORATED_BY"}


@query(
    """WITH e AS (SELECT o_orderkey AS source, o_custkey AS target, CASE o_orderkey % 4 WHEN 0 THEN 'SUPPORTS' WHEN 1 THEN 'EXPLAINS' WHEN 2 THEN 'ELABORATES' ELSE 'QUALIFIES' END AS relation FROM orders)
SELECT source, target, relation AS label, 'forward' AS view FROM e UNION ALL
SELECT target, source, CASE relation WHEN 'SUPPORTS' THEN 'IS_SUPPORTED_BY' WHEN 'EXPLAINS' THEN 'IS_EXPLAINED_BY' WHEN 'ELABORATES' THEN 'IS_ELABORATED_BY' ELSE 'INVERSE_' || relation END, 'inverse' FROM e"""
)
def bidirectional_traversal(spark, sf):
    k = F.col("o_orderkey") % 4
    e = t(spark, sf, "orders").select(F.col("o_orderkey").alias("source"), F.col("o_custkey").alias("target"), F.when(k == 0, "SUPPORTS").when(k == 1, "EXPLAINS").when(k == 2, "ELABORATES").otherwise("QUALIFIES").alias("relation"))
    return graph.both_ways(e, INVERSE)


# --- order --------------------------------------------------------------------------------------

RUNS = "b AS (SELECT user_id, event_id, ts, event_type, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS boundary FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(boundary) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS segment FROM b)"


def _runs(spark, sf):
    return sequence.runs(t(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", "value"), "user_id", ["ts", "event_id"], "event_type")


@query(f"WITH {RUNS} SELECT user_id, segment::BIGINT AS segment, any_value(event_type) AS kind, count(*) AS nodes, min(event_id) AS first_id FROM s GROUP BY user_id, segment")
def gap_island_segments(spark, sf):
    return _runs(spark, sf).groupBy("user_id", F.col("segment").cast("long").alias("segment")).agg(F.first("event_type").alias("kind"), F.count("*").alias("nodes"), F.min("event_id").alias("first_id"))


@query(f"WITH {RUNS} SELECT event_id, user_id FROM s WHERE boundary = 1 AND segment > 1")
def adjacent_boundaries(spark, sf):
    return _runs(spark, sf).where("boundary = 1 and segment > 1").select("event_id", "user_id")


PAGES = "p AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS idx, o_orderkey AS k FROM orders), n AS (SELECT doc_id, idx, CASE WHEN k % 3 = 0 THEN idx + CASE WHEN k % 17 = 0 THEN 3 ELSE 0 END END AS number FROM p)"


@query(
    f"""WITH {PAGES}, w AS (SELECT *,
  last_value(CASE WHEN number IS NOT NULL THEN idx END IGNORE NULLS) OVER b AS li, last_value(number IGNORE NULLS) OVER b AS ln,
  first_value(CASE WHEN number IS NOT NULL THEN idx END IGNORE NULLS) OVER f AS ri, first_value(number IGNORE NULLS) OVER f AS rn,
  min(CASE WHEN number = 1 THEN idx END) OVER (PARTITION BY doc_id) AS one FROM n
  WINDOW b AS (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
x AS (SELECT *, coalesce(rn - ln = ri - li AND rn > ln, false) AS fits FROM w)
SELECT doc_id, idx, CASE WHEN number IS NOT NULL THEN number WHEN fits THEN ln + idx - li END AS inferred,
  CASE WHEN (number IS NOT NULL AND (coalesce(rn <= number, false) OR coalesce(number <= ln, false))) OR (number IS NULL AND coalesce(rn <= ln, false)) THEN 'conflict'
    WHEN number IS NOT NULL THEN 'visible_anchor' WHEN fits THEN 'interpolated' WHEN coalesce(idx < one, false) THEN 'front_matter' ELSE 'unknown' END AS status FROM x"""
)
def page_number_interpolation(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("idx"), F.col("o_orderkey").alias("k"))
    n = F.when(F.col("k") % 3 == 0, F.col("idx") + F.when(F.col("k") % 17 == 0, 3).otherwise(0))
    return sequence.interpolate_numbers(o.select("doc_id", "idx", n.alias("number")))


@query(
    """WITH v AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'click')
SELECT c.event_id, (SELECT v.event_id FROM v WHERE v.user_id = c.user_id AND v.ts > c.ts ORDER BY v.ts, v.event_id LIMIT 1) AS following FROM c"""
)
def asof_following_node(spark, sf):
    e = t(spark, sf, "events").select("user_id", "ts", "event_id", "event_type").where("event_type in ('purchase', 'click')")
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(1, Window.unboundedFollowing)
    nxt = F.min(F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id"))).over(w)
    return e.withColumn("n", nxt).where("event_type = 'click'").select("event_id", F.col("n.event_id").alias("following"))


@query()
def viterbi_smoothing(spark, sf):
    e = t(spark, sf, "events")
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    r = e.select(F.col("user_id").alias("doc_id"), i.alias("idx"), (F.abs(F.hash("event_type", "event_id")) % 1000 / 1000.0).alias("p"))
    return sequence.smooth(r.withColumn("page", F.floor(F.col("idx") / 5).cast("long"))).select("doc_id", "idx", "label")


# --- vectors and candidates ---------------------------------------------------------------------

TFIDF = r"""nod AS (SELECT conv_id AS doc_id, turn AS node_id, role AS section, text FROM conversations),
tk AS (SELECT doc_id, node_id, lower(unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_-]{1,}'))) AS term FROM nod), tf AS (SELECT doc_id, node_id, term, count(*) AS tf FROM tk GROUP BY ALL),
df AS (SELECT doc_id, term, count(*) AS df FROM tf GROUP BY ALL), tot AS (SELECT doc_id, count(*) AS total FROM nod GROUP BY ALL),
w0 AS (SELECT doc_id, node_id, term, (1 + ln(tf)) * (ln((1 + total) / (1 + df)) + 1) AS w FROM tf JOIN df USING (doc_id, term) JOIN tot USING (doc_id)),
wt AS (SELECT doc_id, node_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, node_id)), 8) AS weight FROM w0),
sim AS (SELECT x.doc_id, x.node_id AS a, y.node_id AS b, round(sum(x.weight * y.weight), 6) AS similarity FROM wt x JOIN wt y ON x.doc_id = y.doc_id AND x.term = y.term AND x.node_id < y.node_id GROUP BY ALL)"""
TOPK = "(SELECT *, row_number() OVER (PARTITION BY doc_id, node ORDER BY similarity DESC, abs(node - other), other) AS rank FROM (SELECT doc_id, a AS node, b AS other, similarity FROM {0} UNION ALL SELECT doc_id, b, a, similarity FROM {0}))"


def _turns(spark, sf):
    return t(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("node_id"), F.col("role").alias("section"), "text")


@query(f"WITH {TFIDF} SELECT doc_id, node_id, count(*) AS terms, round(max(weight), 6) AS top, round(sum(weight), 4) AS total FROM wt GROUP BY doc_id, node_id")
def tfidf_weights(spark, sf):
    return retrieval.tfidf(_turns(spark, sf)).groupBy("doc_id", "node_id").agg(F.count("*").alias("terms"), F.round(F.max("weight"), 6).alias("top"), F.round(F.sum("weight"), 4).alias("total"))


@query(f"WITH {TFIDF} SELECT doc_id, node, other, rank FROM {TOPK.format('sim')} WHERE rank <= 3")
def tfidf_topk(spark, sf):
    return retrieval.top_k(retrieval.similar_pairs(retrieval.tfidf(_turns(spark, sf))), 3).select("doc_id", "node", "other", "rank")


@query(
    f"""WITH {TFIDF}, same AS (SELECT sim.* FROM sim JOIN nod x ON sim.doc_id = x.doc_id AND a = x.node_id JOIN nod y ON sim.doc_id = y.doc_id AND b = y.node_id WHERE x.section = y.section),
al AS (SELECT x.doc_id, x.node_id AS a, y.node_id AS b, 'structural_neighbor' AS reason FROM nod x JOIN nod y ON x.doc_id = y.doc_id AND y.node_id BETWEEN x.node_id + 1 AND x.node_id + 2
  UNION ALL SELECT doc_id, least(node, other), greatest(node, other), 'embedding_top_k' FROM {TOPK.format('sim')} WHERE rank <= 2
  UNION ALL SELECT doc_id, least(node, other), greatest(node, other), 'same_section' FROM {TOPK.format('same')} WHERE rank <= 1)
SELECT doc_id, a, b, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM al GROUP BY doc_id, a, b"""
)
def candidate_channels(spark, sf):
    n = _turns(spark, sf)
    return retrieval.channels(n, retrieval.tfidf(n))


@query(
    """WITH x AS (SELECT vec_id, label, embedding FROM embeddings), p AS (SELECT a.vec_id AS node, b.vec_id AS other, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM x a JOIN x b ON a.label = b.label AND a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY similarity DESC, other) AS rank FROM p) SELECT node, other, rank FROM k WHERE rank <= 5"""
)
def embedding_topk(spark, sf):
    return retrieval.nearest_vectors(t(spark, sf, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v")), 5)


@query("""SELECT a.l_partkey AS x, b.l_partkey AS y, count(*) AS support FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2 HAVING count(*) >= 2""")
def entity_cooccurrence(spark, sf):
    m = lines_by_order(spark, sf, "l_partkey").distinct()
    a, b = m.toDF("o", "x"), m.toDF("o", "y")
    # Hardly a pair comes twice, so pairs travel as they are, into as many tasks as keep their counts small.
    pairs = a.join(b, "o").where("x < y").select("x", "y").repartition(tasks_for(t(spark, sf, "lineitem"), 2), "x", "y")
    return pairs.groupBy("x", "y").agg(F.count("*").alias("support")).where("support >= 2")


@query("SELECT l_partkey AS entity, o AS source, nxt AS target FROM (SELECT l_partkey, l_orderkey AS o, lead(l_orderkey) OVER (PARTITION BY l_partkey ORDER BY l_orderkey) AS nxt FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem)) WHERE nxt IS NOT NULL")
def consecutive_entity_links(spark, sf):
    m = t(spark, sf, "lineitem").select(F.col("l_partkey").alias("entity"), F.col("l_orderkey").alias("source")).distinct()
    return m.withColumn("target", F.lead("source").over(Window.partitionBy("entity").orderBy("source"))).where("target is not null")


# --- evaluation ---------------------------------------------------------------------------------

GOLD = "r AS (SELECT o_orderkey AS id, o_orderpriority AS gold, CASE WHEN o_orderkey % 5 = 0 THEN '5-LOW' ELSE o_orderpriority END AS pred, (o_custkey % 100) / 100.0 AS score, CASE WHEN o_custkey % 100 + o_orderkey % 37 > 80 THEN 1 ELSE 0 END AS truth, o_orderkey % 7 <> 0 AS old, o_orderkey % 9 <> 0 AS new FROM orders)"


def _gold(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return t(spark, sf, "orders").select(k.alias("id"), F.col("o_orderpriority").alias("gold"), F.when(k % 5 == 0, "5-LOW").otherwise(F.col("o_orderpriority")).alias("pred"), (c % 100 / 100.0).alias("score"), (c % 100 + k % 37 > 80).cast("int").alias("truth"), (k % 7 != 0).alias("old"), (k % 9 != 0).alias("new"))


@query(
    f"""WITH {GOLD}, g AS (SELECT gold AS label, count(*) AS support, count(*) FILTER (WHERE gold = pred) AS hit FROM r GROUP BY 1), p AS (SELECT pred AS label, count(*) AS said FROM r GROUP BY 1),
m AS (SELECT label, coalesce(support, 0) AS support, coalesce(hit, 0) AS hit, coalesce(said, 0) AS said FROM g FULL JOIN p USING (label)), x AS (SELECT *, CASE WHEN said > 0 THEN hit / said ELSE 0 END AS pr, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS re FROM m),
y AS (SELECT label, round(pr, 8) AS precision, round(re, 8) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 8) AS f1, support FROM x)
SELECT * FROM y UNION ALL SELECT 'macro', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM y"""
)
def class_metrics(spark, sf):
    return evaluation.class_metrics(_gold(spark, sf))


@query(f"WITH {GOLD} SELECT gold, pred, count(*) AS n FROM r GROUP BY gold, pred")
def confusion(spark, sf):
    return _gold(spark, sf).groupBy("gold", "pred").agg(F.count("*").alias("n"))


@query(
    f"""WITH {GOLD}, c AS (SELECT count(*) FILTER (WHERE old AND new) AS both_right, count(*) FILTER (WHERE old AND NOT new) AS only_old, count(*) FILTER (WHERE new AND NOT old) AS only_new, count(*) FILTER (WHERE NOT old AND NOT new) AS neither FROM r)
SELECT both_right, only_old, only_new, neither, round(CASE WHEN only_old + only_new = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(only_old + only_new + 1) - lgamma(i + 1) - lgamma(only_old + only_new - i + 1) - (only_old + only_new) * ln(2))) FROM generate_series(0, least(only_old, only_new)) u(i))) END, 6) AS p_value FROM c"""
)
def mcnemar(spark, sf):
    return evaluation.paired(_gold(spark, sf))


@query(
    f"""WITH {GOLD}, i AS (SELECT unnest(generate_series(0, 89)) AS i), s AS (SELECT i, count(*) FILTER (WHERE score >= 0.10 + i * 0.01 - 1e-9 AND truth = 1) AS tp, count(*) FILTER (WHERE score >= 0.10 + i * 0.01 - 1e-9) AS said, count(*) FILTER (WHERE truth = 1) AS pos FROM i, r GROUP BY i),
x AS (SELECT round(0.10 + i * 0.01, 2)::DOUBLE AS threshold, round(tp / greatest(1, said), 8) AS precision, round(tp / greatest(1, pos), 8) AS recall FROM s)
SELECT * FROM x ORDER BY CASE WHEN precision >= 0.9 THEN recall ELSE -1 END DESC, precision DESC, threshold DESC LIMIT 1"""
)
def precise_threshold(spark, sf):
    return evaluation.precise_threshold(_gold(spark, sf).select("score", F.col("truth").alias("gold")))


@query(
    f"""WITH {GOLD}, v AS (SELECT DISTINCT score::DOUBLE AS v FROM r UNION SELECT 0.0 UNION SELECT 1.0), h AS (SELECT v FROM v UNION SELECT (v + lead(v) OVER (ORDER BY v)) / 2 FROM v),
s AS (SELECT v AS threshold, count(*) FILTER (WHERE score >= v AND truth = 1) AS tp, count(*) FILTER (WHERE score >= v) AS said, count(*) FILTER (WHERE truth = 1) AS pos FROM h, r WHERE v IS NOT NULL GROUP BY v),
x AS (SELECT threshold, CASE WHEN said > 0 THEN tp / said ELSE 0 END AS p, CASE WHEN pos > 0 THEN tp / pos ELSE 0 END AS q FROM s), f AS (SELECT threshold, round(p, 4) AS precision, round(q, 4) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 4) AS f1 FROM x)
SELECT * FROM f ORDER BY f1 DESC, precision DESC, recall DESC, threshold DESC LIMIT 1"""
)
def threshold_sweep(spark, sf):
    return evaluation.best_threshold(_gold(spark, sf).select("score", F.col("truth").alias("gold")))


@query(
    f"""WITH {GOLD}, x AS (SELECT id, gold AS label, row_number() OVER (PARTITION BY gold ORDER BY sha256('small-edge-v1|' || id), id) AS k, count(*) OVER (PARTITION BY gold) AS n FROM r)
SELECT id, label, k <= greatest(1, round_even(n * 0.2, 0)) AS calibration FROM x"""
)
def calibration_split(spark, sf):
    return evaluation.stratified(_gold(spark, sf).select("id", F.col("gold").alias("label")), 0.2)


VOTED = """v AS (SELECT l_partkey AS source, l_suppkey AS target, l_linenumber AS n, l_orderkey AS o FROM lineitem), u AS (SELECT DISTINCT source, target FROM v WHERE source <> target),
k AS (SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY (source * 7 + target * 13) % 101, target) AS rank FROM u), s AS (SELECT least(source, target) AS a, greatest(source, target) AS b, source, rank FROM k WHERE rank <= 3),
g AS (SELECT a, b, min(rank) AS best, count(DISTINCT source) AS sides, count(DISTINCT CASE WHEN rank <= 2 THEN source END) AS sides2 FROM s GROUP BY a, b)"""


@query(f"WITH {VOTED} SELECT a, b, best = 1 AS unilateral_top1, best <= 2 AS unilateral_top2, true AS unilateral_top3, sides2 = 2 AS mutual_top2, sides = 2 AS mutual_top3, sides = 2 AND best = 1 AS mutual_with_top1, best = 1 OR sides = 2 AS top1_or_mutual_top3, best <= 2 OR sides = 2 AS top2_or_mutual_top3 FROM g")
def voting_strategies(spark, sf):
    u = t(spark, sf, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target")).where("source <> target").distinct()
    w = Window.partitionBy("source").orderBy((F.col("source") * 7 + F.col("target") * 13) % 101, "target")
    return evaluation.voting(u.withColumn("rank", F.row_number().over(w)).where("rank <= 3"))


@query("SELECT o_orderkey AS id, (row_number() OVER (ORDER BY o_orderkey) - 1) % 4 AS shard FROM orders WHERE o_orderstatus = 'F'")
def strided_shards(spark, sf):
    o = t(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    # Row numbers by prefix counts of key ranges: no single task sees all rows.
    o = o.withColumn("slice", F.floor(F.col("id") / 1_000_000))
    c = o.groupBy("slice").agg(F.count("*").alias("n"))
    c = c.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    k = F.row_number().over(Window.partitionBy("slice").orderBy("id"))
    return o.withColumn("k", k).join(c, "slice").select("id", ((F.col("before") + F.col("k") - 1) % 4).alias("shard"))


from leafweave.plans import adverts, beginnings, comparisons, decisions, evidence, graphs, layout, references, replies, reviews, scoring, tasks, words  # noqa: E402,F401  (they register their queries here)
