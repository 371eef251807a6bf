"""Registered queries over magazine pages, made from orders and their lines, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafweave.operators import adverts
from leafweave.plans.registry import query, t

#: Nodes of a magazine: a customer's orders, five to a page.
FIELDS = {
    "label": "k % 3 <> 0 AND k % 11 < 7",
    "p": "(k * 7 % 100) / 100.0",
    "page": "CASE WHEN doc_id % 9 = 0 THEN 'cover' ELSE 'page_000' || (1 + (idx - 1 - (idx - 1) % 5) / 5) END",
    "text": "CASE WHEN k % 29 = 0 THEN 'In This Issue' WHEN k % 5 = 0 THEN repeat('long prose ', 30) WHEN k % 7 = 0 THEN 'BUY NOW' ELSE 'Some Words of no great Length here, ' || k END",
}
NODES = "o AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS idx, o_orderkey AS k FROM orders), n AS (SELECT doc_id, idx, k, " + ", ".join(f"{e} AS {k}" for k, e in FIELDS.items()).replace("(1 + (idx - 1 - (idx - 1) % 5) / 5)", "(1 + (idx - 1) // 5)") + ", CASE WHEN doc_id % 9 = 0 THEN NULL ELSE 1 + (idx - 1) // 5 END AS number FROM o)"


def _nodes(spark, sf):
    o = t(spark, sf, "orders").selectExpr("o_custkey as doc_id", "cast(row_number() over (partition by o_custkey order by o_orderkey) as bigint) as idx", "o_orderkey as k")
    return o.selectExpr("*", *(f"{e} as {k}" for k, e in FIELDS.items())).withColumn("p", F.col("p").cast("double")).withColumn("page", F.regexp_replace("page", r"\.0$", ""))


@query(
    f"""WITH {NODES}, g AS (SELECT doc_id, page, any_value(number) AS number, avg(label::INT) AS share, avg(p) AS mean, bool_or(contains(lower(text), 'in this issue')) AS toc FROM n GROUP BY doc_id, page)
SELECT doc_id, idx, label OR (coalesce(g.number, 0) > 2 AND NOT toc AND round(share, 9) >= 0.4 AND round(mean, 9) >= 0.5) AS promoted FROM n JOIN g USING (doc_id, page)"""
)
def promoted_ad_pages(spark, sf):
    return adverts.promoted(_nodes(spark, sf), 0.4, 0.5).select("doc_id", "idx", "promoted")


RUNS = "c AS (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY doc_id ORDER BY idx) IS NOT DISTINCT FROM label THEN 0 ELSE 1 END AS ch FROM n), r AS (SELECT *, sum(ch) OVER (PARTITION BY doc_id ORDER BY idx) AS run FROM c)"


@query(f"WITH {NODES}, {RUNS}, g AS (SELECT doc_id, run, count(*) AS k2, avg(p) AS mean FROM r GROUP BY doc_id, run) SELECT doc_id, idx, label AND k2 >= 2 AND round(mean, 9) >= 0.5 AS kept FROM r JOIN g USING (doc_id, run)")
def filtered_ad_runs(spark, sf):
    return adverts.kept_runs(_nodes(spark, sf), 2, 0.5).select("doc_id", "idx", "kept")


PAGES = "pg AS (SELECT doc_id, page, any_value(number) AS number, sum(k) % 3 <> 0 AS predicted, count(*) AS nodes, count(*) FILTER (WHERE length(text) > 240) AS prose FROM n GROUP BY doc_id, page)"


def _pages(spark, sf):
    return _nodes(spark, sf).groupBy("doc_id", "page").agg((F.sum("k") % 3 != 0).alias("predicted"))


@query(f"WITH {NODES}, {PAGES} SELECT doc_id, page, predicted, predicted AND coalesce(number > 2, true) AND nodes >= 2 AND prose <= 1 AS whole FROM pg")
def whole_ad_pages(spark, sf):
    return adverts.whole_pages(_nodes(spark, sf), _pages(spark, sf), 1)


@query(f"WITH {NODES}, {PAGES} SELECT doc_id, idx, predicted AND nodes >= 2 AS label FROM n JOIN pg USING (doc_id, page)")
def page_labels_to_nodes(spark, sf):
    p = adverts.whole_pages(_nodes(spark, sf), _pages(spark, sf), 10**6)
    p = p.join(_nodes(spark, sf).groupBy("doc_id", "page").agg(F.count("*").alias("c")), ["doc_id", "page"]).where("c >= 2")
    return adverts.page_labels_to_nodes(_nodes(spark, sf).drop("label"), p.select("doc_id", "page", "predicted")).select("doc_id", "idx", "label")


@query(
    f"""WITH {NODES}, s AS (SELECT *, length(text) AS len, length(regexp_replace(text, '[^\\p{{L}}]+', '', 'g')) AS letters, length(regexp_replace(text, '[^\\p{{Lu}}]+', '', 'g')) AS caps, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS words FROM n),
w AS (SELECT *, count(*) OVER g AS c, sum(len) OVER g AS total, count(*) FILTER (WHERE len <= 80) OVER g AS short FROM s WINDOW g AS (PARTITION BY doc_id, page))
SELECT doc_id, idx, round(ln(1 + len), 8) AS node_length, round(ln(1 + words), 8) AS node_words, (words <= 12)::INT::DOUBLE AS node_short, (words <= 4)::INT::DOUBLE AS node_very_short, (letters > 0 AND upper(text) = text)::INT::DOUBLE AS node_upper, round(caps / greatest(1, letters), 8) AS node_upper_ratio,
  round(ln(1 + c), 8) AS page_nodes, round(ln(1 + total + c - 1), 8) AS page_chars, round(ln(1 + total / c), 8) AS page_mean_chars, round(short / c, 8) AS page_short_ratio FROM w"""
)
def ad_surface_features(spark, sf):
    return adverts.surface_features(_nodes(spark, sf))


WEIGHTS = ([1.5, 30.0, 0.5], [0.5, 20.0, 0.25], [1.2, -0.8, 0.3], -0.4)


@query("SELECT l_orderkey AS page, l_linenumber AS n, round(1 / (1 + exp(-greatest(-30, least(30, -0.4 + 1.2 * ((l_tax * 20 - 1.5) / 0.5) - 0.8 * ((l_quantity - 30) / 20) + 0.3 * ((l_discount * 10 - 0.5) / 0.25))))), 8) AS p FROM lineitem")
def ad_probabilities(spark, sf):
    x = F.array(F.col("l_tax") * 20, F.col("l_quantity").cast("double"), F.col("l_discount") * 10)
    return t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("n"), F.round(adverts.probability(x, *WEIGHTS), 8).alias("p"))


@query(
    f"""WITH {NODES}, {RUNS}, m AS (SELECT *, lag(page) OVER w AS pp, lead(page) OVER w AS np, max(idx) OVER (PARTITION BY doc_id) AS last FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
s AS (SELECT doc_id, min(idx) AS b, max(idx) AS e, avg(p) AS mean, min_by(coalesce(pp <> page, true), idx) AS ats, max_by(coalesce(np <> page, true), idx) AS ate, any_value(last) AS last FROM m WHERE label GROUP BY doc_id, run), bd AS (SELECT doc_id, idx FROM n WHERE k % 4 = 0),
x AS (SELECT *, (SELECT idx FROM bd WHERE bd.doc_id = s.doc_id AND abs(bd.idx - s.b) <= 2 ORDER BY abs(bd.idx - s.b), idx LIMIT 1) AS nb, (SELECT idx FROM bd WHERE bd.doc_id = s.doc_id AND abs(bd.idx - s.e - 1) <= 2 ORDER BY abs(bd.idx - s.e - 1), idx LIMIT 1) AS ne FROM s)
SELECT doc_id, b AS "begin", e AS "end", round(mean, 6) AS mean, CASE WHEN ats THEN b ELSE coalesce(nb, CASE WHEN mean >= 0.6 THEN b END) END AS snapped_begin, CASE WHEN e < last THEN CASE WHEN ate THEN e + 1 ELSE coalesce(ne, CASE WHEN mean >= 0.6 THEN e + 1 END) END END AS snapped_end FROM x"""
)
def snapped_ad_spans(spark, sf):
    n = _nodes(spark, sf)
    return adverts.snapped_spans(n, n.where("k % 4 = 0").select("doc_id", "idx"), 2, 0.6)


RECORDS = "rec AS (SELECT doc_id, idx, CASE k % 6 WHEN 0 THEN 'visible_anchor' WHEN 1 THEN 'inferred' WHEN 2 THEN 'front_matter' WHEN 3 THEN 'conflict' WHEN 4 THEN 'unknown' ELSE 'odd' END AS status, CASE WHEN k % 12 < 2 THEN 7 WHEN k % 6 < 2 THEN idx END AS inferred, CASE WHEN k % 2 = 0 THEN 'content' ELSE 'cover' END AS page_type FROM n)"


@query(
    f"""WITH {NODES}, {RECORDS}, g AS (SELECT *, CASE WHEN status IN ('visible_anchor', 'inferred') AND inferred > 0 THEN 'known' WHEN status IN ('front_matter', 'conflict', 'unknown') THEN status ELSE 'unnumbered' END AS grp FROM rec),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, grp ORDER BY idx) AS c FROM g), l AS (SELECT *, CASE grp WHEN 'known' THEN format('p{{:04d}}', inferred) WHEN 'front_matter' THEN format('front_{{:03d}}', c) WHEN 'unnumbered' THEN format('unnum_{{:03d}}', c) ELSE grp || format('_{{:03d}}', c) END AS page_label FROM c),
a AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_label, page_type ORDER BY idx) AS again FROM l)
SELECT doc_id, idx, page_label, page_label || '__' || page_type || CASE WHEN again > 1 THEN format('__{{:02d}}', again) ELSE '' END || '.png' AS filename, CASE WHEN grp = 'unnumbered' THEN 'unnumbered' ELSE status END AS status FROM a"""
)
def page_names(spark, sf):
    n = _nodes(spark, sf)
    k = F.col("k")
    status = F.when(k % 6 == 0, "visible_anchor").when(k % 6 == 1, "inferred").when(k % 6 == 2, "front_matter").when(k % 6 == 3, "conflict").when(k % 6 == 4, "unknown").otherwise("odd")
    inferred = F.when(k % 12 < 2, 7).when(k % 6 < 2, F.col("idx"))
    return adverts.page_names(n.select("doc_id", "idx", status.alias("status"), inferred.alias("inferred"), F.when(k % 2 == 0, "content").otherwise("cover").alias("page_type")))


READ = "CASE p_partkey % 9 WHEN 0 THEN ' 12 ' WHEN 1 THEN '007' WHEN 2 THEN '0' WHEN 3 THEN '123456' WHEN 4 THEN 'xii' WHEN 5 THEN '-3' WHEN 6 THEN NULL ELSE '' || p_size END"


KIND = "CASE p_partkey % 5 WHEN 0 THEN ' Cover' WHEN 1 THEN 'ARTICLE_PAGE' WHEN 2 THEN 'poster' WHEN 3 THEN NULL ELSE 'mixed' END"


@query(f"SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'cover' WHEN 1 THEN 'article_page' WHEN 4 THEN 'mixed' ELSE 'unknown' END AS page_type, CASE WHEN p_partkey % 4 <> 0 AND regexp_full_match(trim({READ}), '[0-9]{{1,5}}') AND trim({READ})::INT > 0 THEN trim({READ})::INT::VARCHAR END AS number FROM part")
def visible_page_numbers(spark, sf):
    return t(spark, sf, "part").select(F.col("p_partkey").alias("id"), adverts.page_type(F.expr(KIND)).alias("page_type"), adverts.visible_number(F.expr(READ), F.col("p_partkey") % 4 != 0).alias("number"))


#: Instances of contents: customers as documents, dates as pages, lines as contents.
INSTANCES = """i AS (SELECT l_suppkey AS doc_id, l_orderkey % 50 AS page_no, l_partkey % 40 AS content_id, l_linenumber % 3 AS label, CASE WHEN l_orderkey % 3 = 0 THEN 'NEW' WHEN l_orderkey % 3 = 1 THEN 'CONTINUE' ELSE 'STATIC' END AS relation, 1 + l_linenumber % 6 AS nb, (l_quantity::INT % 90) / 100.0 AS x, l_orderkey % 17 AS z FROM lineitem)"""


def _instances(spark, sf):
    l = t(spark, sf, "lineitem")
    x = (F.col("l_quantity").cast("int") % 90 / 100.0).cast("double")
    k = F.col("l_orderkey")
    box = lambda j: F.struct(x.alias("x1"), (x / 2).alias("y1"), (x + F.when(k % 17 == 0, 0.0).when(k % 17 == 1, 0.005).when(k % 17 == 2, 0.9).otherwise(0.1 + 0.01 * j)).alias("x2"), (x / 2 + F.when(k % 17 == 1, 0.005).otherwise(0.2)).alias("y2"))
    boxes = F.transform(F.sequence(F.lit(1), 1 + F.col("l_linenumber") % 6), lambda j: box(F.when(k % 17 == 3, 1).otherwise(j)))
    relation = F.when(k % 3 == 0, "NEW").when(k % 3 == 1, "CONTINUE").otherwise("STATIC")
    return l.select(F.col("l_suppkey").alias("doc_id"), (k % 50).alias("page_no"), (F.col("l_partkey") % 40).alias("content_id"), (F.col("l_linenumber") % 3).alias("label"), relation.alias("relation"), boxes.alias("boxes"))


@query(
    f"""WITH {INSTANCES}, pages AS (SELECT doc_id, page_no, count(DISTINCT content_id) AS k FROM i GROUP BY ALL), lab AS (SELECT doc_id, content_id, count(DISTINCT label) AS k FROM i GROUP BY ALL)
SELECT (SELECT count(DISTINCT doc_id) FROM i) AS documents, count(*) AS instances, count(*) FILTER (WHERE relation = 'NEW') AS "new", count(*) FILTER (WHERE relation = 'CONTINUE') AS continued, {', '.join(f'count(*) FILTER (WHERE nb = {k}) AS boxes_{k}' for k in (1, 2, 3, 4))}, count(*) FILTER (WHERE nb >= 5) AS boxes_5, max(nb)::BIGINT AS most_boxes, round(avg(nb), 8) AS mean_boxes,
  count(*) FILTER (WHERE z = 0) AS degenerate, count(*) FILTER (WHERE (z = 2 AND x + 0.9 > 1) OR (z > 2 AND x + 0.1 + 0.01 * CASE WHEN z = 3 THEN 1 ELSE nb END > 1)) AS off_page, count(*) FILTER (WHERE nb > 1 AND z <= 3) AS repeated_boxes, count(*) FILTER (WHERE z <= 1) AS tiny,
  (SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM pages WHERE k > 1) AS multi_pages, (SELECT count(*) FROM lab WHERE k > 1) AS conflicting_labels FROM i"""
)
def dataset_audit(spark, sf):
    return adverts.dataset_audit(_instances(spark, sf))


@query(f"WITH {INSTANCES}, d AS (SELECT DISTINCT doc_id, page_no, content_id FROM i) SELECT d.doc_id, d.page_no, d.content_id, e.page_no AS previous, CASE WHEN e.page_no IS NULL THEN 'NEW' ELSE 'CONTINUE' END AS relation FROM d LEFT JOIN d e ON d.doc_id = e.doc_id AND d.content_id = e.content_id AND e.page_no = d.page_no - 1")
def instance_pointers(spark, sf):
    return adverts.pointers(_instances(spark, sf))


@query(
    f"""WITH {INSTANCES}, d AS (SELECT doc_id, content_id, page_no, max(relation) AS relation FROM i GROUP BY ALL), w AS (SELECT *, page_no - lag(page_no) OVER v > 1 AS gap, row_number() OVER v = 1 AS first FROM d WINDOW v AS (PARTITION BY doc_id, content_id ORDER BY page_no))
SELECT doc_id, content_id, count(*) AS pages, count(*) FILTER (WHERE gap) AS gaps, count(*) FILTER (WHERE first AND relation = 'CONTINUE') AS begins_continued, count(*) FILTER (WHERE NOT first AND relation = 'NEW') AS begins_again, CASE WHEN count(*) >= 3 THEN '3+' ELSE count(*)::VARCHAR END AS length FROM w GROUP BY ALL"""
)
def chain_audit(spark, sf):
    return adverts.chain_audit(_instances(spark, sf))
