"""Registered queries about where articles begin. Pages are twelve pieces of ten words; markers, places and titles come from keys, alike on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafweave.operators import articles, nodes
from leafweave.plans.registry import LINES, query, t
from leafweave.plans.reviews import PIECE, _pieces

MARKS = ["TABLE of Contents", "Order now", "see www.example.com for our products", "From the editor", "tel: 12 model x1", "+41 22 767 61 11 or info@example.ch"]
TITLES = ["NEW RESULTS", "Appointments and awards", "Editorial", "Vol 12 no 3", "12"]
PAGED = (
    f"""pc AS (SELECT doc_id, unnest(a) AS piece, unnest(range(len(a))) AS n FROM (SELECT doc_id, regexp_extract_all(text, '{PIECE}') AS a FROM documents WHERE text IS NOT NULL)),
g AS (SELECT doc_id, n // 12 AS idx, string_agg(piece, ' ' ORDER BY n) AS body, min_by(piece, n) AS first FROM pc GROUP BY ALL),
pg AS (SELECT *, coalesce(CASE (doc_id + idx) % 11 """
    + " ".join(f"WHEN {i} THEN '{x} '" for i, x in enumerate(MARKS))
    + """ END, '') || body AS text, length(body) AS body_chars, (doc_id + 2 * idx) % 4 AS images FROM g)"""
)


def _key(k, values):
    c = F
    for i, x in enumerate(values):
        c = c.when(k == i, F.lit(x))
    return c


def _paged(spark, sf):
    g = _pieces(spark, sf).groupBy("doc_id", F.col("page").alias("idx")).agg(F.sort_array(F.collect_list(F.struct("block_no", F.col("text").alias("piece")))).alias("a"))
    body = F.array_join(F.transform("a", lambda x: x["piece"]), " ")
    mark = F.coalesce(F.concat(_key((F.col("doc_id") + F.col("idx")) % 11, MARKS), F.lit(" ")), F.lit(""))
    return g.select("doc_id", "idx", F.col("a")[0]["piece"].alias("first"), F.concat(mark, body).alias("text"), F.char_length(body).alias("body_chars"), ((F.col("doc_id") + 2 * F.col("idx")) % 4).alias("images"))


def _sum(patterns):
    return " + ".join(f"regexp_matches(low, '{x}')::INT" for x in patterns)


@query(
    f"""WITH {PAGED}, x AS (SELECT *, lower(text) AS low, max(idx) OVER (PARTITION BY doc_id) AS last FROM pg), h AS (SELECT *, array_to_string(regexp_extract_all(low, '[a-z0-9]+'), ' ') AS norm, {_sum(articles.AD_STRONG)} AS s, {_sum(articles.AD_CONTACT)} AS c, {_sum(articles.AD_PRODUCT)} AS p FROM x),
r AS (SELECT *, CASE WHEN contains(low, 'in this issue') OR contains(low, 'table of contents') THEN 'table_of_contents' WHEN idx <= 1 AND (contains(low, 'welcome to the digital edition') OR contains(norm, 'cern courier digital edition')) THEN 'front_matter'
  WHEN idx <= 2 AND body_chars < 350 AND images <= 1 THEN 'cover_or_separator' WHEN idx = last AND body_chars < 350 THEN 'back_cover_or_separator' WHEN contains(norm[1:500], 'from the editor') THEN 'editorial'
  WHEN s >= 1 OR (c >= 2 AND (p >= 1 OR (images >= 2 AND body_chars < 1400))) OR (c >= 1 AND p >= 2) OR (c >= 1 AND p >= 1 AND body_chars < 1200) THEN 'advertisement' ELSE 'content' END AS page_role FROM h)
SELECT doc_id, idx, page_role, CASE page_role WHEN 'table_of_contents' THEN 1.0 WHEN 'front_matter' THEN 0.98 WHEN 'cover_or_separator' THEN 0.78 WHEN 'back_cover_or_separator' THEN 0.76 WHEN 'editorial' THEN 0.92 WHEN 'advertisement' THEN round(least(1.0, 0.62 + 0.16 * s + 0.08 * c + 0.08 * p), 6) END::DOUBLE AS role_score FROM r"""
)
def commercial_page_roles(spark, sf):
    return articles.commercial_roles(_paged(spark, sf)).select("doc_id", "idx", "page_role", "role_score")


@query(
    f"""WITH {PAGED}, k AS (SELECT doc_id, string_agg(array_to_string(regexp_extract_all(lower(first), '[a-z0-9]+'), ' '), ' ' ORDER BY idx) AS toc FROM pg WHERE idx % 3 = 0 GROUP BY doc_id),
t AS (SELECT doc_id, idx, CASE WHEN (doc_id + idx) % 2 = 0 THEN 'title' ELSE 'sub_title' END AS kind, CASE WHEN (doc_id * 7 + idx * 13) % 10 <> 9 THEN ((doc_id * 7 + idx * 13) % 100) / 100.0 END AS y, coalesce(CASE (doc_id + idx) % 9 """
    + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(TITLES))
    + """ END, first) AS text FROM pg),
n AS (SELECT t.*, coalesce(toc, '') AS toc, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS norm FROM t LEFT JOIN k USING (doc_id)), w AS (SELECT *, string_split(norm, ' ') AS words, list_filter(string_split(norm, ' '), lambda x: length(x) >= 5) AS big FROM n),
m AS (SELECT *, norm IN ('', """
    + ", ".join(f"'{x}'" for x in articles.NON_ARTICLE_TITLES)
    + r""") OR regexp_matches(norm, '^(?:cern ?courier|cernourier)(?: .*)?$') OR regexp_matches(norm, '^(?:volume|vol) \d+.*$') OR length(norm) <= 3 OR regexp_matches(norm, '^\d+$') AS noise,
  length(norm) >= 12 AND toc <> '' AND (contains(toc, norm) OR (len(words) >= 4 AND len(big) >= 3 AND len(list_filter(big, lambda x: contains(toc, x))) / greatest(1, len(big)) >= 0.8)) AS listed FROM w),
s AS (SELECT *, NOT noise AND listed AS toc_match, CASE WHEN noise THEN 0 ELSE round(greatest(0, least(1, CASE kind WHEN 'title' THEN 0.48 ELSE 0.22 END + CASE WHEN y IS NULL THEN 0 WHEN y <= 0.3 THEN 0.26 WHEN y <= 0.45 THEN 0.08 ELSE -0.2 END
  + CASE WHEN length(norm) BETWEEN 12 AND 110 THEN 0.08 WHEN length(norm) > 140 OR len(words) > 20 THEN -0.3 ELSE 0 END + CASE WHEN norm IN ('appointments and awards', 'recruitment') THEN 0.28 ELSE 0 END + CASE WHEN listed THEN 0.3 ELSE 0 END
  - CASE WHEN regexp_matches(text, '\p{Lu}') AND NOT regexp_matches(text, '\p{Ll}') AND len(words) <= 4 AND NOT listed THEN 0.22 ELSE 0 END)), 6) END::DOUBLE AS score FROM m)
SELECT doc_id, idx, noise, toc_match, score, score >= CASE kind WHEN 'title' THEN 0.64 ELSE 0.74 END AS starts FROM s"""
)
def title_scores(spark, sf):
    p = _paged(spark, sf)
    k = F.col("doc_id") + F.col("idx")
    place = F.col("doc_id") * 7 + F.col("idx") * 13
    titles = p.select("doc_id", "idx", F.when(k % 2 == 0, "title").otherwise("sub_title").alias("kind"), F.when(place % 10 != 9, place % 100 / 100.0).alias("y"), F.coalesce(_key(k % 9, TITLES), "first").alias("text"))
    toc = p.where("idx % 3 = 0").groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", articles.normal(F.col("first")).alias("s")))), lambda x: x["s"]), " ").alias("toc"))
    return articles.title_scores(titles, toc).select("doc_id", "idx", "noise", "toc_match", "score", "starts")


STRUCT = (
    "WITH "
    + LINES
    + r""", s AS (SELECT doc_id, page, block_no AS idx, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS s, block_no % 23 = 9 AS visual, block_no % 19 = 6 AS explicit FROM blocks)"""
)


@query(
    STRUCT
    + f""", n AS (SELECT *, CASE WHEN lead(page) OVER w = page THEN length(lead(s) OVER w) ELSE 0 END AS after, regexp_extract_all(s, '[A-Za-z][A-Za-z0-9''’-]*') AS tok FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY idx))
SELECT doc_id, idx, CASE WHEN regexp_matches(s, '{articles.RUNNING}') THEN 'RUNNING_HEADER' WHEN regexp_matches(s, '{articles.FURTHER_READING}') THEN 'FURTHER_READING' WHEN regexp_matches(s, '{articles.BYLINE}') THEN 'BYLINE' WHEN visual OR regexp_matches(s, '{articles.CAPTION}') THEN 'CAPTION'
  WHEN regexp_matches(s, '{articles.DEPARTMENT}') OR (s <> '' AND len(string_split(s, ' ')) <= 6 AND length(s) <= 75 AND regexp_matches(s, '\\p{{Lu}}') AND NOT regexp_matches(s, '\\p{{Ll}}')) THEN 'DEPARTMENT_LABEL'
  WHEN explicit OR (after >= 180 AND len(tok) BETWEEN 2 AND 14 AND length(s) <= 130 AND NOT regexp_matches(s, '[.,;?!]$') AND (length(regexp_replace(s, '[^\\p{{Lu}}]+', '', 'g')) / greatest(1, length(regexp_replace(s, '[^\\p{{L}}]+', '', 'g'))) >= 0.72 OR len(list_filter(tok, lambda x: regexp_matches(x, '^[A-Z]'))) / greatest(1, len(tok)) >= 0.78)) THEN 'TITLE'
  WHEN regexp_matches(s, '{articles.ADVERTISING}') AND length(s) <= 500 THEN 'ADVERTISEMENT' ELSE 'BODY' END AS role FROM n"""
)
def structural_roles(spark, sf):
    b = nodes.blocks(t(spark, sf, "documents").repartition("doc_id")).select("doc_id", "page", F.col("block_no").alias("idx"), "text", (F.col("block_no") % 23 == 9).alias("visual"), (F.col("block_no") % 19 == 6).alias("explicit"))
    return articles.structural_roles(b).select("doc_id", "idx", "role")


@query(
    STRUCT
    + """, a AS (SELECT doc_id, idx, page, CASE WHEN (doc_id + idx) % 29 = 0 THEN 'In this issue' ELSE 'x' END AS title, CASE (doc_id + idx) % 3 WHEN 0 THEN 'LIKELY_STARTS_NEW_ITEM' WHEN 1 THEN 'SECTION_OR_RUNNING_LABEL' ELSE 'UNCERTAIN' END AS cls, (doc_id % 10) / 10.0 AS margin FROM s WHERE (doc_id + idx) % 4 <> 1),
l AS (SELECT doc_id, page FROM s GROUP BY ALL HAVING contains(lower(string_agg(s, ' ' ORDER BY idx)), 'in this issue') UNION SELECT doc_id, page FROM a WHERE title = 'In this issue'),
g AS (SELECT doc_id, idx, page, count(*) AS titles, bool_or(cls = 'LIKELY_STARTS_NEW_ITEM') AS strong, max(margin)::DOUBLE AS margin FROM a ANTI JOIN l USING (doc_id, page) WHERE cls <> 'SECTION_OR_RUNNING_LABEL' GROUP BY ALL)
SELECT g.doc_id, g.idx AS anchor, min(s.idx) AS zone_start, max(s.idx) AS zone_end, count(*) AS members, any_value(titles) AS titles, any_value(strong) AS strong, any_value(margin) AS margin FROM g JOIN s ON g.doc_id = s.doc_id AND g.page = s.page AND s.idx BETWEEN g.idx - 2 AND g.idx + 3 GROUP BY g.doc_id, g.idx"""
)
def boundary_zones(spark, sf):
    b = nodes.blocks(t(spark, sf, "documents")).select("doc_id", "page", F.col("block_no").alias("idx"), "text")
    k = F.col("doc_id") + F.col("idx")
    cls = F.when(k % 3 == 0, "LIKELY_STARTS_NEW_ITEM").when(k % 3 == 1, "SECTION_OR_RUNNING_LABEL").otherwise("UNCERTAIN")
    titles = b.where(k % 4 != 1).select("doc_id", "idx", "page", F.when(k % 29 == 0, "In this issue").otherwise("x").alias("title"), cls.alias("classification"), (F.col("doc_id") % 10 / 10.0).alias("margin"))
    return articles.boundary_zones(b, titles)
