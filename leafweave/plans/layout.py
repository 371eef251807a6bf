"""Registered queries over layout boxes, which are made from lines of orders, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafweave.functions import geometry as g
from leafweave.operators import layout
from leafweave.plans.registry import BOX, INSIDE, INTER, _boxes, _sides, query, t

W, H = 500.0, 800.0
LABELS = ["text", "paragraph_title", "title", "header", "footer", "caption", "table_caption", "table_title", "list", "image", "figure", "chart", "logo", "Table", "aside", ""]
LABEL = "CASE p_partkey % 16 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(LABELS)) + " END"
GROUP = "CASE p_size % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'figure' WHEN 2 THEN 'table' WHEN 3 THEN 'image' ELSE '' END"
BLOCK = "CASE p_size % 4 WHEN 0 THEN 'heading' WHEN 1 THEN 'caption' WHEN 2 THEN 'table' ELSE 'text' END"


def _in(x: str, values: list[str]) -> str:
    return f"{x} IN ({', '.join(repr(v) for v in values)})"


@query(
    f"""WITH p AS (SELECT p_partkey AS id, lower({LABEL}) AS l, {GROUP} AS p, {BLOCK} AS bt FROM part),
r AS (SELECT *, CASE WHEN {_in('l', layout.CAPTIONS)} THEN 'caption' WHEN {_in('l', layout.TABLES)} OR p = 'table' THEN 'table' WHEN {_in('l', layout.HEADINGS)} THEN 'heading' WHEN p = 'figure' OR {_in('l', layout.CONTAINERS)} THEN 'visual' WHEN {_in('l', layout.TEXT_LIKE)} OR p = 'text' THEN 'text' WHEN l <> '' THEN l WHEN p <> '' THEN p ELSE 'unknown' END AS role FROM p)
SELECT id, role, role IN ('text', 'heading', 'caption', 'table') OR {_in('l', layout.TEXT_LIKE)} OR p = 'text' AS text_like, role IN ('visual', 'table') OR {_in('p', layout.CONTAINER_GROUPS)} OR {_in('l', layout.CONTAINERS)} AS container,
  CASE bt WHEN 'heading' THEN CASE WHEN {_in('l', layout.HEADINGS)} OR role = 'heading' THEN 1.0 WHEN role = 'text' THEN 0.55 ELSE 0.1 END WHEN 'caption' THEN CASE WHEN {_in('l', layout.CAPTIONS)} OR role = 'caption' THEN 1.0 WHEN role IN ('text', 'visual') THEN 0.35 ELSE 0.1 END
  WHEN 'table' THEN CASE WHEN role = 'table' OR {_in('l', layout.TABLES)} THEN 1.0 WHEN role = 'text' THEN 0.25 ELSE 0.1 END ELSE CASE WHEN role = 'text' THEN 1.0 WHEN role IN ('heading', 'caption') THEN 0.25 ELSE 0.1 END END::DOUBLE AS fit FROM r"""
)
def region_types(spark, sf):
    p = t(spark, sf, "part").selectExpr("p_partkey as id", f"{LABEL} as label", f"{GROUP} as grp", f"{BLOCK} as bt")
    l, p_ = F.col("label"), F.col("grp")
    p = p.withColumn("role", layout.region_role(l, p_))
    return p.select("id", "role", layout.text_like(l, p_, F.col("role")).alias("text_like"), layout.visual_container(l, p_, F.col("role")).alias("container"), layout.type_fit(F.col("bt"), l, F.col("role")).alias("fit"))


@query(
    f"""WITH {BOX}, j AS (SELECT *, {INTER} AS i, (x2 - x1) * (y2 - y1) AS ab, (u2 - u1) * (v2 - v1) AS ar, {INSIDE} AS inside FROM b JOIN r USING (page) WHERE x1 < 500 AND y1 < 800 AND (x2 - x1) * (y2 - y1) <= 280000),
s AS (SELECT *, round(0.75 * (i / ab) + 0.20 * inside::INT + 0.05 * (i / (ab + ar - i)), 8) AS score FROM j WHERE i / ab >= 0.40 OR inside), m AS (SELECT *, row_number() OVER (PARTITION BY page, block_id ORDER BY score DESC, ar, region_id) AS rank FROM s)
SELECT page, block_id, region_id, floor(score * 10000 + 1e-6)::BIGINT AS score_e4 FROM m WHERE rank = 1 AND score >= 0.40"""
)
def visual_container_match(spark, sf):
    r = layout.match_containers(*_sides(spark, sf), W, H)
    return r.select("page", "block_id", "region_id", F.floor(F.col("score") * 10000 + 1e-6).cast("long").alias("score_e4"))


KIND = "CASE {0} WHEN 0 THEN 'text' WHEN 1 THEN 'title' WHEN 2 THEN 'caption' WHEN 3 THEN 'figure' ELSE 'table' END"
BK, LK = KIND.format("(page + block_id) % 5"), KIND.format("(page + region_id) % 4")


@query(
    f"""WITH {BOX}, k AS (SELECT *, {BK} AS bk, {LK} AS lk, (page % 10) / 10.0 AS conf FROM b JOIN r USING (page)),
j AS (SELECT *, {INTER} AS i, (x2 - x1) * (y2 - y1) AS ab, (u2 - u1) * (v2 - v1) AS al, {INSIDE} AS inside, sqrt(((x1 + x2) / 2 - (u1 + u2) / 2) ** 2 + ((y1 + y2) / 2 - (v1 + v2) / 2) ** 2) AS far,
  CASE WHEN bk = lk THEN 1.0 WHEN bk = 'caption' AND lk = 'text' THEN 0.85 WHEN bk = 'text' AND lk IN ('caption', 'title') THEN 0.75 WHEN bk = 'title' AND lk = 'text' THEN 0.75 WHEN bk IN ('figure', 'table') THEN 0.0 ELSE 0.2 END AS fit FROM k),
s AS (SELECT *, round(2.0 * (i / (ab + al - i)) + 1.1 * (i / ab) + 0.7 * (i / al) + 0.4 * inside::INT + 0.4 * conf + 0.8 * fit + 0.25 * (greatest(0.0, least(x2, u2) - greatest(x1, u1)) / least(x2 - x1, u2 - u1)) + 0.25 * (greatest(0.0, least(y2, v2) - greatest(y1, v1)) / least(y2 - y1, v2 - v1))
  - 0.25 * ln(greatest(1.0, greatest(al / ab, ab / al))) - 1.5 * far / sqrt(890000), 6) AS score FROM j WHERE (i > 0 OR far <= 80) AND (fit > 0 OR i > 0)),
m AS (SELECT *, row_number() OVER (PARTITION BY page, block_id ORDER BY score DESC, region_id) AS rank FROM s)
SELECT page, block_id, region_id, rank, floor(score * 1000 + 1e-3)::BIGINT AS score_e3 FROM m WHERE rank <= 2"""
)
def repair_candidates(spark, sf):
    b, r = _sides(spark, sf)
    b = b.withColumn("kind", F.expr(BK))
    r = r.withColumn("kind", F.expr(LK)).withColumn("confidence", F.col("page") % 10 / 10.0)
    c = layout.repair_candidates(b, r, W, H, 2)
    return c.select("page", "block_id", "region_id", "rank", F.floor(F.col("score") * 1000 + 1e-3).cast("long").alias("score_e3"))


ACTION = "CASE (page + block_id) % 7 WHEN 0 THEN 'snap_to_layout' WHEN 1 THEN 'clip_to_layout' WHEN 2 THEN 'snap_x_to_layout' WHEN 3 THEN 'snap_y_to_layout' WHEN 4 THEN 'expand_within_layout' WHEN 5 THEN 'keep' ELSE 'anchor_to_layout' END"


@query(
    f"""WITH {BOX}, j AS (SELECT *, {ACTION} AS action, {INTER} AS i FROM b JOIN r USING (page) WHERE region_id = block_id + 1),
c AS (SELECT page, block_id, CASE action WHEN 'snap_to_layout' THEN [u1, v1, u2, v2] WHEN 'clip_to_layout' THEN CASE WHEN i > 0 THEN [greatest(x1, u1), greatest(y1, v1), least(x2, u2), least(y2, v2)] ELSE [x1, y1, x2, y2] END WHEN 'snap_x_to_layout' THEN [u1, y1, u2, y2] WHEN 'snap_y_to_layout' THEN [x1, v1, x2, v2]
  WHEN 'expand_within_layout' THEN [greatest(u1, x1 - 40), greatest(v1, y1 - 40), least(u2, x2 + 40), least(v2, y2 + 40)] ELSE [x1, y1, x2, y2] END AS q FROM j),
d AS (SELECT page, block_id, greatest(0, least(500, q[1])) AS x1, greatest(0, least(800, q[2])) AS y1, greatest(0, least(500, q[3])) AS x2, greatest(0, least(800, q[4])) AS y2 FROM c)
SELECT page, block_id, CASE WHEN x2 > x1 AND y2 > y1 THEN round(x1, 2) END AS x1, CASE WHEN x2 > x1 AND y2 > y1 THEN round(y1, 2) END AS y1, CASE WHEN x2 > x1 AND y2 > y1 THEN round(x2, 2) END AS x2, CASE WHEN x2 > x1 AND y2 > y1 THEN round(y2, 2) END AS y2 FROM d"""
)
def repaired_boxes(spark, sf):
    b, r = _sides(spark, sf)
    j = b.join(r.select("page", "region_id", F.col("box").alias("l")), "page").where("region_id = block_id + 1")
    return j.select("page", "block_id", layout.repaired(F.col("box"), F.expr(ACTION), F.col("l"), W, H).alias("q")).select("page", "block_id", *(F.col(f"q.{k}").alias(k) for k in ("x1", "y1", "x2", "y2")))


@query(
    f"""WITH {BOX}, v AS (SELECT page, n, CASE WHEN n % 3 = 0 THEN [x1, y1, x2, y2] WHEN n % 3 = 1 THEN [x1 / 999.0 * 500, y1 / 999.0 * 800, x2 / 999.0 * 500, y2 / 999.0 * 800] END AS q FROM raw),
c AS (SELECT page, n, round_even(greatest(0, least(500, q[1])), 0)::BIGINT AS a, round_even(greatest(0, least(800, q[2])), 0)::BIGINT AS b, round_even(greatest(0, least(500, q[3])), 0)::BIGINT AS c, round_even(greatest(0, least(800, q[4])), 0)::BIGINT AS d FROM v)
SELECT page, n, least(a, c) AS x1, least(b, d) AS y1, greatest(a, c) AS x2, greatest(b, d) AS y2 FROM c WHERE greatest(a, c) > least(a, c) AND greatest(b, d) > least(b, d)"""
)
def pixel_boxes(spark, sf):
    b = _boxes(spark, sf)
    out = layout.pixel_box(F.when(F.col("n") % 3 == 0, F.col("box")), F.when(F.col("n") % 3 == 1, F.col("box")), F.lit(500), F.lit(800))
    return b.select("page", F.col("n"), out.alias("q")).where("q is not null").select("page", "n", "q.*")


@query(f"WITH {BOX}, u AS (SELECT page, greatest(0, min(x1) - 12) AS x1, greatest(0, min(y1) - 12) AS y1, least(500, max(x2) + 12) AS x2, least(800, max(y2) + 12) AS y2 FROM raw GROUP BY page) SELECT * FROM u WHERE x2 > x1 AND y2 > y1")
def padded_unions(spark, sf):
    u = _boxes(spark, sf).groupBy("page").agg(g.union_all(F.col("box")).alias("u")).select("page", layout.padded(F.col("u"), 12.0, W, H).alias("q"))
    return u.where("q is not null").select("page", "q.*")


@query(
    f"""WITH {BOX}, s AS (SELECT page, block_id, region_id, x1 / 500 AS a1, y1 / 800 AS b1, x2 / 500 AS a2, y2 / 800 AS b2, u1 / 500 AS c1, v1 / 800 AS d1, u2 / 500 AS c2, v2 / 800 AS d2 FROM b JOIN r USING (page))
SELECT page, block_id, region_id, round(greatest(0.0, 1 - least(1.0, 3 * sqrt(((a1 + a2) / 2 - (c1 + c2) / 2) ** 2 + ((b1 + b2) / 2 - (d1 + d2) / 2) ** 2) + abs((a2 - a1) - (c2 - c1)) + abs((b2 - b1) - (d2 - d1)))), 6) AS likeness,
  round(sqrt((b1 - d1) ** 2 + (b2 - d2) ** 2 + ((a2 - a1) - (c2 - c1)) ** 2 + (0.5 * ((a1 + a2) / 2 - (c1 + c2) / 2)) ** 2), 6) AS distance,
  round(greatest(0.0, least(b2, d2) - greatest(b1, d1)) / least(b2 - b1, d2 - d1), 6) AS y_share FROM s"""
)
def box_likeness(spark, sf):
    part = lambda c: g.box(c["x1"] / W, c["y1"] / H, c["x2"] / W, c["y2"] / H)
    b, r = _sides(spark, sf)
    j = b.select("page", "block_id", part(F.col("box")).alias("a")).join(r.select("page", "region_id", part(F.col("box")).alias("b")), "page")
    a, b = F.col("a"), F.col("b")
    return j.select("page", "block_id", "region_id", F.round(layout.likeness(a, b), 6).alias("likeness"), F.round(layout.shape_distance(a, b), 6).alias("distance"), F.round(g.y_overlap_fraction(a, b), 6).alias("y_share"))


BANDS = "w AS (SELECT page, n, (page % 9) * 10.0 AS x1, 640 + (page % 40) * 4.0 AS y1, (page % 9) * 10.0 + 380 + n * 10 AS x2, 700 + (page % 40) * 2.0 + n AS y2, ((page * 7 + n) % 100) / 100.0 AS score FROM raw)"


@query(
    f"""WITH {BOX}, {BANDS}, a AS (SELECT * FROM w WHERE y1 / 800 >= 0.82 AND (x2 - x1) / 500 >= 0.8 AND greatest(0, x2 - x1) * greatest(0, y2 - y1) / 400000 <= 0.2 AND n <> 2),
f AS (SELECT page, score AS fs, x1 AS u1, y1 AS v1, x2 AS u2, y2 AS v2 FROM w WHERE n = 2), j AS (SELECT * FROM a LEFT JOIN f USING (page)), k AS (SELECT *, {INTER} AS i, greatest(0, x2 - x1) * greatest(0, y2 - y1) AS aa, greatest(0, u2 - u1) * greatest(0, v2 - v1) AS fa FROM j)
SELECT page, n AS ad_id, score::DOUBLE AS score, fs IS NOT NULL AS footer_found, CASE WHEN fs IS NULL THEN 0.0 WHEN aa + fa - i > 0 THEN round(i / (aa + fa - i), 6) ELSE 0.0 END AS iou, round(score - fs, 6)::DOUBLE AS score_margin, CASE WHEN fs > 0 THEN round(score::DOUBLE / fs::DOUBLE, 6) END AS score_ratio FROM k"""
)
def footer_class_check(spark, sf):
    b = _boxes(spark, sf)
    x = (F.col("page") % 9) * 10.0
    y = 640 + (F.col("page") % 40) * 4.0
    w = b.select("page", "n", g.box(x, y, x + 380 + F.col("n") * 10, 700 + (F.col("page") % 40) * 2.0 + F.col("n")).alias("box"), ((F.col("page") * 7 + F.col("n")) % 100 / 100.0).cast("double").alias("score"))
    adverts = w.where("n <> 2").withColumnRenamed("n", "ad_id")
    return layout.footer_class_check(adverts, w.where("n = 2").select("page", F.col("score").alias("footer_score"), F.col("box").alias("footer")), W, H)


@query(
    f"""WITH {BOX}, j AS (SELECT page, block_id, region_id, abs((y1 + y2) / 2 - (v1 + v2) / 2) AS dy FROM b JOIN r USING (page) WHERE abs((x1 + x2) / 2 - (u1 + u2) / 2) / 500 < 0.18)
SELECT page, block_id AS element_id, region_id AS seed_id FROM j QUALIFY row_number() OVER (PARTITION BY page, block_id ORDER BY dy, region_id) = 1"""
)
def nearest_title_seeds(spark, sf):
    b, r = _sides(spark, sf)
    return layout.nearest_seeds(b.withColumnRenamed("block_id", "element_id"), r.select("page", F.col("region_id").alias("seed_id"), "box", F.col("region_id").alias("order")), W)


@query(
    f"""WITH {BOX}, m AS (SELECT page % 500 AS cluster_id, page, ((page * 3 + n) % 100) / 100.0 AS score, n % 3 AS label, x1 / 500 AS x1, y1 / 800 AS y1, x2 / 500 AS x2, y2 / 800 AS y2 FROM raw),
a AS (SELECT cluster_id, count(DISTINCT page) AS pages, count(DISTINCT label) AS labels, min(score)::DOUBLE AS lo, max(score)::DOUBLE AS hi, avg(score::DOUBLE) AS mean, avg(x1) AS mx1, avg(y1) AS my1, avg(x2) AS mx2, avg(y2) AS my2 FROM m GROUP BY cluster_id),
d AS (SELECT cluster_id, max(greatest(abs(x1 - mx1), abs(y1 - my1), abs(x2 - mx2), abs(y2 - my2))) AS deviation FROM m JOIN a USING (cluster_id) GROUP BY cluster_id),
be AS (SELECT cluster_id, page AS best_page FROM m QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, page) = 1)
SELECT cluster_id, pages, labels, round(pages / 1000, 8) AS support, round(lo, 6) AS score_min, round(hi, 6) AS score_max, floor(mean * 1000 + 1e-6)::BIGINT AS mean_e3, floor(mx1 * 1000 + 1e-6)::BIGINT AS x1_e3, floor(my1 * 1000 + 1e-6)::BIGINT AS y1_e3, floor(mx2 * 1000 + 1e-6)::BIGINT AS x2_e3, floor(my2 * 1000 + 1e-6)::BIGINT AS y2_e3, floor(deviation * 1000 + 1e-3)::BIGINT AS deviation_e3, best_page, pages >= 4 AS accepted FROM a JOIN d USING (cluster_id) JOIN be USING (cluster_id)"""
)
def template_cluster_summary(spark, sf):
    b = _boxes(spark, sf)
    box = F.col("box")
    m = b.select((F.col("page") % 500).alias("cluster_id"), "page", ((F.col("page") * 3 + F.col("n")) % 100 / 100.0).cast("double").alias("score"), (F.col("n") % 3).alias("label"), g.box(box["x1"] / W, box["y1"] / H, box["x2"] / W, box["y2"] / H).alias("box"))
    r = layout.template_clusters(m, 1000, 4, None)
    e3 = lambda k, off=1e-6: F.floor(F.col(k) * 1000 + off).cast("long")
    return r.select("cluster_id", "pages", "labels", "support", g.rounded("score_min", 6).alias("score_min"), g.rounded("score_max", 6).alias("score_max"), e3("score_mean").alias("mean_e3"), *(e3(k).alias(f"{k}_e3") for k in ("x1", "y1", "x2", "y2")), e3("deviation", 1e-3).alias("deviation_e3"), "best_page", "accepted")


@query()
def kept_detections(spark, sf):
    """Greedy, so without SQL: tested against a plain loop."""
    b = _boxes(spark, sf)
    return layout.kept_detections(b.select("page", F.col("n").cast("long").alias("det_id"), ((F.col("page") * 7 + F.col("n")) % 10 / 10.0).alias("score"), "box.*"), 0.3)
