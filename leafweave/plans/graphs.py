"""Registered queries over page sources, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafweave.functions import geometry as g
from leafweave.operators import layout as _layout
from leafweave.plans.layout import _in
from leafweave.plans.registry import BOX, _boxes, lines_by_order, query, t
from leafweave.sources import graphs

LABEL = "CASE (page + n) % 6 WHEN 0 THEN 'Text' WHEN 1 THEN 'paragraph_title' WHEN 2 THEN 'figure' WHEN 3 THEN 'table' WHEN 4 THEN 'caption' ELSE 'aside' END"


@query(
    f"""WITH {BOX}, u AS (SELECT page, n, min(x1) AS x1, min(y1) AS y1, min(x2) AS x2, min(y2) AS y2 FROM raw GROUP BY ALL), c AS (SELECT page, n, round(least(300, x1 - 100), 2) AS a, y1 AS b, round(least(300, x2 - 100), 2) AS c, y2 AS d, lower({LABEL}) AS l FROM u),
k AS (SELECT *, greatest(0, a) AS x1, least(700, b) AS y1, greatest(0, c) AS x2, least(700, d) AS y2 FROM c), f AS (SELECT * FROM k WHERE x2 > x1 AND y2 > y1)
SELECT page, CASE WHEN n % 3 = 0 THEN 'own' || n ELSE format('layout_{{:03d}}', n) END AS region_id, CASE WHEN {_in('l', _layout.CAPTIONS)} THEN 'caption' WHEN l = 'table' THEN 'table' WHEN {_in('l', _layout.HEADINGS)} THEN 'heading' WHEN {_in('l', _layout.CONTAINERS)} THEN 'visual' WHEN {_in('l', _layout.TEXT_LIKE)} THEN 'text' ELSE l END AS role, x1, y2, row_number() OVER (PARTITION BY page ORDER BY y1, x1, n) AS geometry_order FROM f"""
)
def layout_regions(spark, sf):
    b = _boxes(spark, sf).groupBy("page", "n").agg(*(F.min(f"box.{k}").alias(k) for k in ("x1", "y1", "x2", "y2")))
    b = b.select("page", F.col("n").alias("place"), F.when(F.col("n") % 3 == 0, F.concat(F.lit("own"), "n")).alias("layout_id"), F.expr(LABEL).alias("label"), F.lit(None).cast("string").alias("label_group"), F.lit(1.0).alias("score"), g.box(F.col("x1") - 100, F.col("y1"), F.col("x2") - 100, F.col("y2")).alias("box"), F.lit(300.0).alias("width"), F.lit(700.0).alias("height"))
    return graphs.layout_regions(b).select("page", "region_id", "role", F.col("box.x1").alias("x1"), F.col("box.y2").alias("y2"), "geometry_order")


def _network(spark, sf):
    u = lines_by_order(spark, sf, "l_linenumber", "l_partkey", "l_suppkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    doc, page, n = (F.col("l_orderkey") % 100).alias("doc_id"), F.col("l_orderkey").alias("page"), F.col("l_linenumber")
    regions = u.where("l_linenumber % 2 = 0").select(doc, page, n.alias("layout_id"))
    blocks = u.select(doc, page, n.alias("place"), F.when(F.col("p") % 9 == 0, F.lit(1)).otherwise(n).alias("block_id"), F.when(F.col("s") % 4 == 0, F.col("s") % 3).alias("split_index"), F.when(F.col("p") % 3 != 0, (F.col("p") % 8).cast("int")).alias("anchor"), F.when(F.col("s") % 4 == 0, n - 1).alias("parent"))
    return graphs.provenance_graph(regions, blocks)


NET = """u AS (SELECT l_orderkey AS page, l_linenumber AS n, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY ALL), v AS (SELECT *, 'document:' || (page % 100) AS doc, 'document:' || (page % 100) || '/page:' || page AS pid FROM u),
r AS (SELECT pid, n AS lid, pid || '/layout:' || n AS id FROM v WHERE n % 2 = 0), b0 AS (SELECT pid, n, (CASE WHEN p % 9 = 0 THEN 1 ELSE n END) || CASE WHEN s % 4 = 0 THEN '.' || (s % 3) ELSE '' END AS loc, CASE WHEN p % 3 <> 0 THEN p % 8 END AS anchor, CASE WHEN s % 4 = 0 THEN n - 1 END AS parent FROM v),
b1 AS (SELECT *, pid || '/block:' || loc AS id, row_number() OVER (PARTITION BY pid, loc ORDER BY n) AS turn FROM b0), b AS (SELECT * FROM b1 WHERE turn = 1), a AS (SELECT b.id, r.id AS rid FROM b LEFT JOIN r ON r.pid = b.pid AND r.lid = b.anchor WHERE anchor IS NOT NULL)"""


@query(f"WITH {NET} SELECT 'document' AS kind, count(DISTINCT doc) AS nodes FROM v UNION ALL SELECT 'page', count(DISTINCT pid) FROM v UNION ALL SELECT 'layout_region', count(*) FROM r UNION ALL SELECT 'parsed_block', count(*) FROM b")
def provenance_nodes(spark, sf):
    return _network(spark, sf)[0].groupBy("kind").agg(F.count("*").alias("nodes"))


@query(
    f"""WITH {NET} SELECT doc AS source, pid AS target, 'contains' AS relation FROM (SELECT DISTINCT doc, pid FROM v) UNION ALL SELECT pid, id, 'contains' FROM r UNION ALL SELECT pid, id, 'contains' FROM b UNION ALL SELECT id, rid, 'anchored_to' FROM a WHERE rid IS NOT NULL
UNION ALL SELECT id, nx, 'precedes' FROM (SELECT id, lead(id) OVER (PARTITION BY pid ORDER BY n) AS nx FROM b) WHERE nx IS NOT NULL UNION ALL SELECT f.id, b.id, 'split_into' FROM b JOIN b f ON f.pid = b.pid AND f.loc = b.parent::VARCHAR"""
)
def provenance_edges(spark, sf):
    return _network(spark, sf)[1]


@query(f"WITH {NET} SELECT left(w, 9) AS warning, count(*) AS n FROM (SELECT 'Duplicate' AS w FROM b1 WHERE turn > 1 UNION ALL SELECT 'Missing anchor' FROM a WHERE rid IS NULL) GROUP BY 1")
def provenance_warnings(spark, sf):
    return _network(spark, sf)[2].groupBy(F.substring("text", 1, 9).alias("warning")).agg(F.count("*").alias("n"))


@query(
    """WITH u AS (SELECT l_orderkey AS page, l_linenumber AS n, min(l_partkey) AS p FROM lineitem GROUP BY ALL), x AS (SELECT page, 'b' || n AS sid, 'text_chunk' AS kind, 0 AS part, CASE WHEN p % 5 = 0 THEN 1000000000 ELSE p END AS o FROM u UNION ALL SELECT page, 'r' || n, 'visual', 1, n FROM u WHERE p % 2 = 0)
SELECT page % 100 AS doc_id, page, row_number() OVER w - 1 AS local_order, sid AS source_id, kind, lag(sid) OVER w AS previous, lead(sid) OVER w AS following FROM x WINDOW w AS (PARTITION BY page ORDER BY part, o, sid)"""
)
def fused_groups(spark, sf):
    u = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("p")).withColumn("doc_id", F.col("page") % 100)
    blocks = u.select("doc_id", "page", F.concat(F.lit("b"), "n").alias("block_id"), F.when(F.col("p") % 5 != 0, F.col("p")).alias("final_order"))
    regions = u.select("doc_id", "page", F.concat(F.lit("r"), "n").alias("region_id"), F.col("n").alias("layout_order"), F.when(F.col("p") % 2 == 0, "Visual").otherwise("text").alias("role"))
    return graphs.fused_groups(blocks, regions)


@query("WITH p AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders) SELECT doc_id, 2 * i + k AS output_page_index, i AS source_page_index, CASE k WHEN 0 THEN 'left' ELSE 'right' END AS side FROM p, generate_series(0, 1) s(k)")
def page_halves(spark, sf):
    p = t(spark, sf, "orders").selectExpr("o_custkey as doc_id", "cast(row_number() over (partition by o_custkey order by o_orderkey) - 1 as bigint) as page_index")
    return graphs.page_halves(p)


@query("WITH t AS (SELECT c_custkey AS k FROM customer), s AS (SELECT k, 0 AS source_rank, 'md' AS v FROM t WHERE k % 3 = 0 UNION ALL SELECT k, 1, 'official' FROM t WHERE k % 2 = 0 UNION ALL SELECT k, 2, 'items' FROM t WHERE k % 5 <> 1) SELECT k, source_rank, v FROM s QUALIFY rank() OVER (PARTITION BY k ORDER BY source_rank) = 1")
def fallback_sources(spark, sf):
    c = t(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    return graphs.fallback([c.where("k % 3 = 0").withColumn("v", F.lit("md")), c.where("k % 2 = 0").withColumn("v", F.lit("official")), c.where("k % 5 <> 1").withColumn("v", F.lit("items"))], "k")


@query("WITH p AS (SELECT DISTINCT user_id AS task_id, event_type AS status FROM events WHERE event_id % 3 <> 0), x AS (SELECT DISTINCT user_id AS task_id FROM events) SELECT task_id FROM x WHERE task_id IN (SELECT task_id FROM p WHERE status = 'error')")
def retry_tasks(spark, sf):
    e = t(spark, sf, "events")
    bad = e.where("event_id % 3 <> 0 and event_type = 'error'").select(F.col("user_id").alias("task_id"))
    return e.select(F.col("user_id").alias("task_id")).distinct().join(bad, "task_id", "left_semi")
