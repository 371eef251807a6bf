"""More registered queries: OCR input, page decisions, boundaries, quotas. Their inputs are derived from keys, alike on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafweave.functions import geometry as g
from leafweave.functions import text as tx
from leafweave.operators import nodes, pages, retrieval
from leafweave.plans.registry import LINES, ROLES, TFIDF, _roles, _turns, lines_by_order, query, t
from leafweave.sources import ocr


def _any(column: str, terms: list[str], join: str, each: str) -> str:
    return join.join(each.format(f"contains({column}, '{x}')") for x in terms)


# --- OCR input ----------------------------------------------------------------------------------


@query(
    """SELECT page, id, text, x1::DOUBLE AS raw_x1, greatest(0, round_even(least(x1, x2) / 999.0 * 1200, 0))::BIGINT AS left_px, least(900, round_even(greatest(y1, y2) / 999.0 * 900, 0))::BIGINT AS bottom_px FROM (
  SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) - 1 AS id, l_returnflag || l_linenumber AS text, l_partkey % 999 AS x1, l_suppkey % 999 AS y1, l_partkey % 777 AS x2, l_suppkey % 888 AS y2 FROM lineitem)"""
)
def grounding_boxes(spark, sf):
    """Tags written for each order's lines, parsed back."""
    n = [F.col("l_partkey") % 999, F.col("l_suppkey") % 999, F.col("l_partkey") % 777, F.col("l_suppkey") % 888]
    tag = F.concat(F.lit("<|ref|> "), "l_returnflag", "l_linenumber", F.lit("\n<|/ref|><|det|>[["), F.concat_ws(", ", *n), F.lit("]]<|/det|>"))
    p = lines_by_order(spark, sf, "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").groupBy(F.col("l_orderkey").alias("page")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", tag.alias("tag")))), lambda s: s["tag"]), "\n").alias("text"))
    b = ocr.grounding(p.withColumn("width", F.lit(1200)).withColumn("height", F.lit(900)), "norm999")
    return b.select("page", "id", "text", F.col("raw_bbox")[0].alias("raw_x1"), F.col("pixel_bbox")[0].alias("left_px"), F.col("pixel_bbox")[3].alias("bottom_px"))


@query(
    """WITH l AS (SELECT l_orderkey AS page, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_linestatus) * 2 AS k, l_partkey, l_linestatus FROM lineitem),
b AS (SELECT page, k, CASE WHEN n % 3 = 0 THEN 'heading' WHEN n % 3 = 1 THEN 'caption' ELSE 'text' END AS block_type, l_partkey::DOUBLE AS x1, 'Figure ' || l_partkey AS markdown FROM l WHERE n % 3 = 1
  UNION ALL SELECT page, k, CASE WHEN n % 3 = 0 THEN 'heading' ELSE 'text' END, l_partkey, 'part ' || l_partkey FROM l WHERE n % 3 <> 1
  UNION ALL SELECT page, k + 1, 'text', NULL, 'status ' || l_linestatus FROM l WHERE n % 2 = 0)
SELECT page, row_number() OVER (PARTITION BY page ORDER BY k) AS block_no, block_type, x1, markdown FROM b"""
)
def ocr_markdown_blocks(spark, sf):
    """Markdown with box comments written for each order's lines, parsed back; even lines have a second paragraph, which has no box."""
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    kind = F.when(n % 3 == 0, "sub_title").otherwise("text")
    md = F.concat(F.lit('<!-- bbox: {"type": "'), kind, F.lit('", "pixel_bbox": ['), p, F.lit(", 0, 9, 9]} -->\n\n"), F.when(n % 3 == 1, "Figure ").otherwise("part "), p, F.when(n % 2 == 0, F.concat(F.lit("\n\nstatus "), "l_linestatus")).otherwise(""), F.lit("\n"))
    md = lines_by_order(spark, sf, "l_linenumber", "l_partkey", "l_linestatus").groupBy(F.col("l_orderkey").alias("page")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_linestatus", md.alias("md")))), lambda s: s["md"]), "\n").alias("text"))
    return ocr.markdown_blocks(md).select("page", "block_no", "block_type", F.col("bbox")[0].alias("x1"), "markdown")


@query(
    "WITH "
    + ROLES
    + """, m AS (SELECT doc_id, arg_min(s, block_no) FILTER (WHERE role = 'document_title') AS title, arg_max(s, block_no) FILTER (WHERE role = 'identifier_metadata') AS doi,
  count(*) FILTER (WHERE role = 'publication_metadata') AS dates, count(*) FILTER (WHERE role = 'author_metadata') AS authors FROM roles GROUP BY doc_id)
SELECT doc_id, md5(ltrim(title, '# ')) AS title_md5, doi, dates, authors FROM m"""
)
def document_metadata(spark, sf):
    r = _roles(spark, sf).withColumn("s", F.regexp_replace("markdown", r"^\s+|\s+$", ""))
    is_ = {k: F.col("role") == k for k in ("document_title", "identifier_metadata", "publication_metadata", "author_metadata")}
    m = r.groupBy("doc_id").agg(
        F.min(F.when(is_["document_title"], F.struct("block_no", "s")))["s"].alias("title"),
        F.max(F.when(is_["identifier_metadata"], F.struct("block_no", "s")))["s"].alias("doi"),
        F.count_if(is_["publication_metadata"]).alias("dates"),
        F.count_if(is_["author_metadata"]).alias("authors"),
    )
    return m.select("doc_id", F.md5(F.regexp_replace("title", "^[# ]+", "")).alias("title_md5"), "doi", "dates", "authors")


# --- pages --------------------------------------------------------------------------------------


@query(
    "WITH "
    + LINES
    + r""", n AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), 'https?://', '', 'g'), '\d+', '#', 'g'), '[^a-zà-öø-ÿ0-9#@./:+_-]+', ' ', 'g'), ' ') AS form FROM blocks),
k AS (SELECT form FROM n WHERE length(form) >= 3 GROUP BY form HAVING count(DISTINCT doc_id) >= 3),
b AS (SELECT n.*, k.form IS NOT NULL AS template, k.form IS NULL AND s <> '' AS c, lower(s) AS low FROM (SELECT *, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS s FROM n) n LEFT JOIN k USING (form)),
p AS (SELECT doc_id, page, count(*) AS blocks, count(*) FILTER (WHERE template) AS templates, count(*) FILTER (WHERE c AND regexp_matches(s, '^\s*[•▪◦‣*-]\s*\S')) AS bullets,
  count(*) FILTER (WHERE c AND length(s) <= 180 AND regexp_matches(s, '(?:\.|\s)\d{1,3}\s*$')) AS page_refs,
  count(*) FILTER (WHERE c AND regexp_matches(s, '(?i)(?:https?://|www\.|\b[a-z0-9-]+\.(?:com|org|net|it|de|io)\b|@)')) AS urls,
  coalesce(sum(CASE WHEN c THEN """
    + _any("low", pages.AD_TERMS, " + ", "{}::INT")
    + """ END), 0)::BIGINT AS ad_hits, count(*) FILTER (WHERE c AND block_no % 2 = 0 AND length(s) <= 120) AS short_unmatched,
  coalesce(bool_or(c AND ("""
    + _any("low", pages.NAV_TERMS, " OR ", "{}")
    + """)), false) AS nav FROM b GROUP BY doc_id, page)
SELECT *, CASE WHEN templates / blocks >= 0.65 THEN 'TEMPLATE_HEAVY' WHEN (nav AND (bullets >= 2 OR page_refs >= 2)) OR bullets >= 5 OR page_refs >= 5 THEN 'NAVIGATION'
  WHEN urls >= 1 AND ad_hits >= 2 AND short_unmatched >= 4 THEN 'FULL_AD' ELSE 'ARTICLE_OR_MIXED' END AS role FROM p"""
)
def page_roles(spark, sf):
    # Forms are found once a block and compared by 16-byte digests.
    b = nodes.blocks(t(spark, sf, "documents").select("doc_id", "text").repartition("doc_id")).select("doc_id", "block_no", "page", "text", tx.once(tx.normalised(F.col("text"))).alias("form"))
    b = b.select("doc_id", "block_no", "page", "text", F.when(F.char_length("form") >= 3, F.unhex(F.md5("form"))).alias("key"))
    k = b.where("key is not null").groupBy("key", "doc_id").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("*").alias("d")).where("d >= 3").select("key", F.lit(True).alias("template"))
    b = b.join(k, "key", "left").withColumn("template", F.coalesce("template", F.lit(False)))
    return pages.page_roles(b.withColumn("unmatched", F.col("block_no") % 2 == 0))


@query(
    """WITH d AS (SELECT l_orderkey AS page, l_linenumber % 3 <> 0 AND l_discount * 10 >= 0.5 AS ad, (40 + l_partkey % 120) * (20 + l_partkey % 180) / 30000.0 AS share FROM lineitem),
p AS (SELECT page, max(share) FILTER (WHERE ad) AS m FROM d GROUP BY page)
SELECT page, CASE WHEN m IS NULL THEN 'NO_AD' WHEN m >= 0.9 THEN 'FULL_PAGE_AD' WHEN m >= 0.05 THEN 'PARTIAL_AD' ELSE 'UNCERTAIN' END AS label FROM p"""
)
def ad_page_labels(spark, sf):
    kind = F.element_at(F.array(F.lit("figure"), F.lit("advertisement"), F.lit("banner")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    box = g.box(F.lit(0), F.lit(0), 40 + F.col("l_partkey") % 120, 20 + F.col("l_partkey") % 180)
    d = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), kind.alias("class"), (F.col("l_discount") * 10).alias("confidence"), box.alias("box"), F.lit(150).alias("width"), F.lit(200).alias("height"))
    return pages.ad_labels(d, ["advertisement", "banner"]).select("page", "label")


SEQ = "o AS (SELECT o_custkey AS doc_id, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS idx FROM orders)"
SEGMENTS = f"""{SEQ}, r AS (SELECT doc_id, idx, k % 3 = 0 AS start, CASE k % 7 WHEN 0 THEN 'advertisement' WHEN 1 THEN 'table_of_contents' WHEN 2 THEN 'advertisement' ELSE 'article' END AS role FROM o),
l AS (SELECT *, lag(role) OVER (PARTITION BY doc_id ORDER BY idx) AS prev FROM r),
n AS (SELECT *, CASE WHEN role <> 'article' THEN prev IS DISTINCT FROM role ELSE prev IS NULL OR prev <> 'article' OR start END AS new FROM l),
s AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY idx) AS segment FROM n),
seg AS (SELECT doc_id, segment::BIGINT AS segment, CASE any_value(role) WHEN 'article' THEN 'article_or_content_run' ELSE any_value(role) END AS type, min(idx) AS page_start, max(idx) AS page_end FROM s GROUP BY doc_id, segment)"""


def _seq(spark, sf):
    i = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long") - 1
    return t(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("k"), i.alias("idx"))


def _segments(spark, sf):
    k = F.col("k")
    role = F.when(k % 7 == 1, "table_of_contents").when((k % 7).isin(0, 2), "advertisement").otherwise("article")
    return pages.page_segments(_seq(spark, sf).select("doc_id", "idx", (k % 3 == 0).alias("start"), role.alias("role")))


@query(f"WITH {SEGMENTS} SELECT * FROM seg")
def page_segments(spark, sf):
    return _segments(spark, sf)


@query(f"WITH {SEGMENTS} SELECT doc_id, segment, page_start, expected FROM (SELECT *, coalesce(lag(page_end) OVER (PARTITION BY doc_id ORDER BY page_start, page_end) + 1, 0) AS expected FROM seg WHERE segment % 4 <> 2) WHERE page_start <> expected OR page_end < page_start")
def segment_coverage_gaps(spark, sf):
    """Every fourth segment is taken out first, so that there are gaps to find."""
    return pages.segment_gaps(_segments(spark, sf).where("segment % 4 <> 2"))


@query(
    f"""WITH {SEQ}, f AS (SELECT doc_id, idx, k % 9 <> 0 AND idx > 3 AS ref, k % 5 = 0 AS aff, k % 11 = 0 AS ack FROM o),
b AS (SELECT *, CASE WHEN lag(ref) OVER (PARTITION BY doc_id ORDER BY idx) IS NOT DISTINCT FROM ref THEN 0 ELSE 1 END AS b FROM f), r AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY idx) AS run FROM b),
l AS (SELECT doc_id, run, min(idx) AS s, max(idx) AS e FROM r WHERE ref GROUP BY doc_id, run HAVING count(*) >= 5), x AS (SELECT doc_id, min(s) AS s, arg_min(e, s) AS e FROM l GROUP BY doc_id),
y AS (SELECT f.*, s, e, min(CASE WHEN ack THEN idx END) OVER (PARTITION BY doc_id) AS a, min(CASE WHEN aff AND idx > e THEN idx END) OVER (PARTITION BY doc_id) AS z FROM f LEFT JOIN x USING (doc_id))
SELECT doc_id, idx, CASE WHEN least(a, s) IS NULL OR idx < least(a, s) THEN 'SCIENTIFIC_BODY' WHEN idx BETWEEN s AND e THEN 'BIBLIOGRAPHY' WHEN idx >= z THEN 'AFFILIATIONS' WHEN idx > e THEN 'AUTHOR_LIST' ELSE 'ACKNOWLEDGMENTS' END AS region FROM y"""
)
def paper_regions(spark, sf):
    k = F.col("k")
    return pages.paper_regions(_seq(spark, sf).select("doc_id", "idx", ((k % 9 != 0) & (F.col("idx") > 3)).alias("reference"), (k % 5 == 0).alias("affiliation"), (k % 11 == 0).alias("acknowledgement")))


@query("SELECT l_orderkey AS page, count(*) AS nodes, round(avg(l_quantity), 6) AS mean_quantity, round(stddev_pop(l_quantity), 6) AS std_quantity, round(avg(l_discount), 6) AS mean_discount, round(stddev_pop(l_discount), 6) AS std_discount FROM lineitem GROUP BY l_orderkey")
def page_feature_statistics(spark, sf):
    f = [("quantity", "l_quantity"), ("discount", "l_discount")]
    return t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.count("*").alias("nodes"), *(F.round(a(c), 6).alias(f"{p}_{n}") for n, c in f for p, a in (("mean", F.avg), ("std", F.stddev_pop))))


# --- boundaries ---------------------------------------------------------------------------------


@query(
    "WITH "
    + LINES
    + r""", s AS (SELECT doc_id, block_no AS idx, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS s FROM blocks),
n AS (SELECT *, lead(length(s), 1) OVER w AS n1, lead(length(s), 2) OVER w AS n2, row_number() OVER w AS place, regexp_extract_all(s, '[A-Za-z][A-Za-z0-9''-]*') AS words FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY idx))
SELECT doc_id, idx FROM n WHERE n1 IS NOT NULL AND place > 1 AND len(words) BETWEEN 1 AND 14 AND length(s) <= 120
  AND NOT regexp_matches(s, '(?i)^(?:fig(?:ure)?\.?\s*\d+|table\s*\d+|volume\s+\d+|cern courier|january|february|www\.|https?://)') AND NOT regexp_matches(s, '[.:;?!]$') AND NOT regexp_matches(s, '(?i)^\s*(?:image|figure|photo|page\s*\d+)\s*$')
  AND (length(regexp_replace(s, '[^\p{Lu}]+', '', 'g')) / greatest(1, length(regexp_replace(s, '[^\p{L}]+', '', 'g'))) >= 0.72 OR len(list_filter(words, lambda x: regexp_matches(x, '^[A-Z]'))) / len(words) >= 0.75)
  AND (n1 >= 180 OR (n1 < 100 AND coalesce(n2 >= 180, false)))"""
)
def title_anchors(spark, sf):
    return pages.title_anchors(nodes.blocks(t(spark, sf, "documents")).select("doc_id", F.col("block_no").alias("idx"), "text"))


VALLEYS = """e AS (SELECT label AS doc_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx, embedding::DOUBLE[] AS v FROM embeddings),
sm AS (SELECT doc_id, idx, round(list_dot_product(v, nxt), 6) AS s FROM (SELECT *, lead(v) OVER (PARTITION BY doc_id ORDER BY idx) AS nxt FROM e) WHERE nxt IS NOT NULL),
m AS (SELECT *, quantile_cont(s, 0.5) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS smoothed,
  coalesce(avg(s) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS l, coalesce(avg(s) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 0) AS r FROM sm),
pr AS (SELECT *, round(CASE WHEN l <> 0 AND r <> 0 THEN (l + r) / 2 - s ELSE 0.0 END, 9) AS prominence FROM m),
q AS (SELECT doc_id, round(quantile_cont(s, 0.1), 9) AS q10, greatest(0.08, round(quantile_cont(prominence, 0.9), 9)) AS q90 FROM pr GROUP BY doc_id),
val AS (SELECT doc_id, idx, smoothed, prominence, s <= q10 AS low, prominence >= q90 AND round(r, 9) > s AS trend FROM pr JOIN q USING (doc_id))"""


def _valleys(spark, sf):
    e = t(spark, sf, "embeddings").select(F.col("label").cast("long").alias("doc_id"), (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long").alias("idx"), F.col("embedding").cast("array<double>").alias("v"))
    e = e.withColumn("nxt", F.lead("v").over(Window.partitionBy("doc_id").orderBy("idx")))
    dot = F.aggregate(F.zip_with("v", "nxt", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return pages.valleys(e.where("nxt is not null").select("doc_id", "idx", F.round(dot, 6).alias("s")))


@query(f"WITH {VALLEYS} SELECT doc_id::BIGINT AS doc_id, idx, round(smoothed * 1e8, 0)::BIGINT AS smoothed_e8, round(prominence * 1e8, 0)::BIGINT AS prominence_e8, low, trend FROM val")
def quantile_valleys(spark, sf):
    return _valleys(spark, sf).select("doc_id", "idx", *(F.round(F.col(c) * 1e8).cast("long").alias(f"{c}_e8") for c in ("smoothed", "prominence")), "low", "trend")


@query(
    f"WITH {VALLEYS}, n AS (SELECT doc_id, count(*) AS nodes FROM e GROUP BY doc_id), c AS (SELECT doc_id, idx FROM val WHERE trend UNION ALL SELECT doc_id, nodes - 1 FROM n) SELECT doc_id::BIGINT AS doc_id, idx AS last, idx - coalesce(lag(idx) OVER (PARTITION BY doc_id ORDER BY idx), -1) AS size FROM c"
)
def unit_sizes(spark, sf):
    n = t(spark, sf, "embeddings").groupBy(F.col("label").cast("long").alias("doc_id")).agg(F.count("*").alias("nodes"))
    return pages.unit_sizes(_valleys(spark, sf).where("trend"), n)


def _cuts(spark, sf):
    s = _seq(spark, sf)
    return s.where("k % 3 = 0").select("doc_id", "idx"), s.where("k % 4 = 0").select("doc_id", "idx")


@query(
    f"""WITH {SEQ}, x AS (SELECT *, k % 3 = 0 AND count(*) FILTER (WHERE k % 3 = 0) OVER (PARTITION BY doc_id ORDER BY idx) > 1 AS g, k % 4 = 0 AS f FROM o),
d AS (SELECT doc_id, count(*) FILTER (WHERE g) AS gold, count(*) FILTER (WHERE f) AS found, count(*) FILTER (WHERE g AND f) AS matched FROM x WHERE g OR f GROUP BY doc_id)
SELECT doc_id, gold, found, matched, CASE WHEN found > 0 THEN round(matched / found, 4) ELSE 0.0 END AS precision, CASE WHEN gold > 0 THEN round(matched / gold, 4) ELSE 0.0 END AS recall, round(2 * matched / (gold + found), 4) AS f1 FROM d"""
)
def boundary_f1_exact(spark, sf):
    return pages.boundary_scores(*_cuts(spark, sf))


@query()
def boundary_f1_tolerant(spark, sf):
    return pages.boundary_scores(*_cuts(spark, sf), tolerance=2)


# --- candidates ---------------------------------------------------------------------------------

QUOTA = f"""{TFIDF}, c AS (SELECT s.*, x.section <> y.section AS role_complement, a // 3 <> b // 3 AS cross_section, (a + b) % 11 = 0 AS anchor, b - a AS distance FROM sim s JOIN nod x ON s.doc_id = x.doc_id AND a = x.node_id JOIN nod y ON s.doc_id = y.doc_id AND b = y.node_id),
i AS (SELECT *, a AS node, b AS other FROM c UNION ALL SELECT *, b, a FROM c)"""


def _pairs(spark, sf):
    n = _turns(spark, sf)
    s = retrieval.similar_pairs(retrieval.tfidf(n))
    n = n.select("doc_id", F.col("node_id").alias("a"), F.col("section").alias("sa"))
    p = s.join(n, ["doc_id", "a"]).join(n.toDF("doc_id", "b", "sb"), ["doc_id", "b"])
    return p.select("doc_id", "a", "b", "similarity", (F.col("sa") != F.col("sb")).alias("role_complement"), (F.floor(F.col("a") / 3) != F.floor(F.col("b") / 3)).alias("cross_section"), ((F.col("a") + F.col("b")) % 11 == 0).alias("anchor"))


@query(
    f"""WITH {QUOTA}, k AS (
  SELECT doc_id, a, b, 'similarity_quota' AS reason FROM i QUALIFY row_number() OVER (PARTITION BY doc_id, node ORDER BY similarity DESC, distance, other) <= 2
  UNION ALL SELECT doc_id, a, b, 'role_complement_quota' FROM i WHERE role_complement QUALIFY row_number() OVER (PARTITION BY doc_id, node ORDER BY similarity DESC, distance DESC, other) <= 1
  UNION ALL SELECT doc_id, a, b, 'long_cross_section_quota' FROM i WHERE cross_section AND distance >= 3 QUALIFY row_number() OVER (PARTITION BY doc_id, node ORDER BY similarity DESC, distance DESC, other) <= 1
  UNION ALL SELECT doc_id, a, b, 'deterministic_anchor' FROM i WHERE anchor)
SELECT doc_id, a, b, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM k GROUP BY doc_id, a, b"""
)
def multichannel_quota(spark, sf):
    return retrieval.quotas(_pairs(spark, sf))


def _reasons(p):
    r = [(F.col("role_complement"), "evidence_claim_signal"), (~F.col("cross_section"), "same_section"), (F.col("anchor"), "explicit_figure_reference"), (F.col("a") % 3 == 0, "shared_entities"), (F.col("b") % 4 == 0, "shared_anchor_signal"), (F.col("b") % 5 == 0, "qualifies_language_signal")]
    return p.select("doc_id", "a", "b", "similarity", (F.col("b") - F.col("a")).alias("distance"), F.array_compact(F.array(*(F.when(c, v) for c, v in r))).alias("reasons"))


@query(
    f"""WITH {QUOTA}, r AS (SELECT *, role_complement::INT + (b % 5 = 0)::INT AS n FROM c)
SELECT doc_id, a, b, round(1e6 * (100.0 * anchor::INT + CASE distance WHEN 1 THEN 50 WHEN 2 THEN 1 ELSE 0 END + CASE WHEN similarity >= 0.2 THEN 4 + 10 * (similarity - 0.2) ELSE 0 END + 2 * (a % 3 = 0)::INT + 2 * (b % 4 = 0)::INT + least(3, 1.25 * n) + CASE WHEN cross_section THEN 0 ELSE 0.25 END), 0)::BIGINT AS score_e6,
  concat_ws(',', CASE WHEN anchor THEN 'mandatory_reference_or_continuity' END, CASE WHEN distance = 1 THEN 'immediate_neighbor' END, CASE WHEN similarity >= 0.2 THEN 'strong_embedding' END, CASE WHEN a % 3 = 0 THEN 'shared_entities' END, CASE WHEN b % 4 = 0 THEN 'shared_anchor' END, CASE WHEN n > 0 THEN 'relation_language_or_role' END) AS evidence FROM r"""
)
def candidate_scores(spark, sf):
    score, evidence = retrieval.candidate_score(0.2)
    return _reasons(_pairs(spark, sf)).select("doc_id", "a", "b", F.round(score * 1e6).cast("long").alias("score_e6"), F.array_join(evidence, ",").alias("evidence"))


@query()
def pruned_candidates(spark, sf):
    return retrieval.prune(_reasons(_pairs(spark, sf)), threshold=0.2)


# Fine relations and the classes that hold them; others stay unresolved.
RELATIONS = {"SUPPORTS": "SUPPORTS", "ELABORATES": "EXPLAINS_OR_ELABORATES", "EXPLAINS": "EXPLAINS_OR_ELABORATES", "PROVIDES_BACKGROUND_FOR": "EXPLAINS_OR_ELABORATES", "PROVIDES_CONTEXT_FOR": "EXPLAINS_OR_ELABORATES", "QUALIFIES": "MODIFIES", "MODIFIES": "MODIFIES", "CONTRASTS_WITH": "CONTRASTS_WITH"}
FINE = [*RELATIONS, "DEPENDS_ON", "OTHER"]


@query(
    "WITH r AS (SELECT o_orderkey AS id, ["
    + ", ".join(f"'{x}'" for x in FINE)
    + "][o_orderkey % 10 + 1] AS fine FROM orders), m AS (SELECT *, CASE fine "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RELATIONS.items())
    + " END AS relation FROM r) SELECT id, fine, relation, relation <> 'CONTRASTS_WITH' AS directed, CASE WHEN relation IS NULL THEN CASE fine WHEN 'DEPENDS_ON' THEN 'DEPENDS_ON_requires_manual_condition_or_prerequisite_review' ELSE 'relation_not_mapped_to_split_taxonomy' END END AS unresolved_reason FROM m"
)
def relation_taxonomy(spark, sf):
    fine = F.element_at(F.array(*map(F.lit, FINE)), (F.col("o_orderkey") % 10 + 1).cast("int"))
    r = t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), fine.alias("fine"))
    r = r.withColumn("relation", F.element_at(F.create_map(*(F.lit(x) for kv in RELATIONS.items() for x in kv)), F.col("fine")))
    why = F.when(F.col("fine") == "DEPENDS_ON", "DEPENDS_ON_requires_manual_condition_or_prerequisite_review").otherwise("relation_not_mapped_to_split_taxonomy")
    return r.select("id", "fine", "relation", (F.col("relation") != "CONTRASTS_WITH").alias("directed"), F.when(F.col("relation").isNull(), why).alias("unresolved_reason"))
