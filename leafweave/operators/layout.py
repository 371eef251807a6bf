"""Layout regions: what their labels mean, which block fits which region, how a block's box is repaired, what repeats across pages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafweave.functions import geometry as g
from leafweave.functions.groups import by_whole_groups, codes

# Labels of layout regions.
TEXT_LIKE = ["text", "paragraph_title", "title", "header", "header_text", "footer", "footnote", "caption", "figure_caption", "table_caption", "table_title", "list", "formula", "reference"]
CONTAINER_GROUPS = ["figure", "table", "image"]
CONTAINERS = ["image", "figure", "table", "chart", "header_image", "cover", "logo", "seal", "icon", "footer", "background"]
HEADINGS = ["title", "paragraph_title", "header", "header_text"]
CAPTIONS = ["caption", "figure_caption", "table_caption"]
TABLES = ["table", "table_title", "table_caption"]


def region_role(label: Column, group: Column) -> Column:
    """caption, table, heading, visual or text, the first that fits, else the label itself."""
    l, p = F.lower(F.coalesce(label, F.lit(""))), F.lower(F.coalesce(group, F.lit("")))
    return (
        F.when(l.isin(CAPTIONS), "caption")
        .when(l.isin(TABLES) | (p == "table"), "table")
        .when(l.isin(HEADINGS), "heading")
        .when((p == "figure") | l.isin(CONTAINERS), "visual")
        .when(l.isin(TEXT_LIKE) | (p == "text"), "text")
        .otherwise(F.coalesce(F.nullif(l, F.lit("")), F.nullif(p, F.lit("")), F.lit("unknown")))
    )


def text_like(label: Column, group: Column, role: Column) -> Column:
    l, p, r = (F.lower(F.coalesce(x, F.lit(""))) for x in (label, group, role))
    return r.isin("text", "heading", "caption", "table") | l.isin(TEXT_LIKE) | (p == "text")


def visual_container(label: Column, group: Column, role: Column) -> Column:
    l, p, r = (F.lower(F.coalesce(x, F.lit(""))) for x in (label, group, role))
    return r.isin("visual", "table") | p.isin(CONTAINER_GROUPS) | l.isin(CONTAINERS)


def type_fit(block_type: Column, label: Column, role: Column) -> Column:
    """How well a block of a type belongs into a region, 0 to 1."""
    l, r = F.lower(F.coalesce(label, F.lit(""))), F.lower(F.coalesce(role, F.lit("")))
    heading = F.when(l.isin(HEADINGS) | (r == "heading"), 1.0).when(r == "text", 0.55).otherwise(0.1)
    caption = F.when(l.isin(CAPTIONS) | (r == "caption"), 1.0).when(r.isin("text", "visual"), 0.35).otherwise(0.1)
    table = F.when((r == "table") | l.isin(TABLES), 1.0).when(r == "text", 0.25).otherwise(0.1)
    plain = F.when(r == "text", 1.0).when(r.isin("heading", "caption"), 0.25).otherwise(0.1)
    return F.when(block_type == "heading", heading).when(block_type == "caption", caption).when(block_type == "table", table).otherwise(plain)


def match_containers(blocks: DataFrame, containers: DataFrame, width: float, height: float, least: float = 0.40) -> DataFrame:
    """Each usable block's best visual container of its page (page, block_id, box; page, region_id, box); of equal scores the smaller container, then the lesser id."""
    b = blocks.where(g.valid_for_matching(F.col("box"), F.lit(width), F.lit(height))).select("page", "block_id", F.col("box").alias("b"))
    j = b.join(containers.select("page", "region_id", F.col("box").alias("r")), "page")
    j = j.withColumn("contain", g.overlap_fraction(F.col("b"), F.col("r"))).withColumn("inside", g.center_inside(F.col("b"), F.col("r"))).where("contain >= 0.40 or inside")
    j = j.withColumn("score", g.rounded(0.75 * F.col("contain") + 0.20 * F.col("inside").cast("double") + 0.05 * g.iou(F.col("b"), F.col("r")), 8))
    w = Window.partitionBy("page", "block_id").orderBy(F.desc("score"), g.area(F.col("r")), "region_id")
    return j.withColumn("rank", F.row_number().over(w)).where((F.col("rank") == 1) & (F.col("score") >= least)).select("page", "block_id", "region_id", "score")


def kind_fit(block: Column, layout: Column) -> Column:
    """How well kinds (text, title, caption, figure, table) go together when a box is repaired."""
    return (
        F.when(block == layout, 1.0)
        .when((block == "caption") & (layout == "text"), 0.85)
        .when((block == "text") & layout.isin("caption", "title"), 0.75)
        .when((block == "title") & (layout == "text"), 0.75)
        .when(block.isin("figure", "table"), 0.0)
        .otherwise(0.2)
    )


def _center(b: Column) -> tuple[Column, Column]:
    return (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2


def repair_candidates(blocks: DataFrame, layouts: DataFrame, width: float, height: float, k: int = 8) -> DataFrame:
    """Up to k layout boxes for each block of a page, by a score of overlap, kind, size and distance. blocks: page, block_id, kind, box; layouts: page, region_id, kind, confidence, box."""
    j = blocks.select("page", "block_id", F.col("kind").alias("bk"), F.col("box").alias("b")).join(layouts.select("page", "region_id", F.col("kind").alias("lk"), "confidence", F.col("box").alias("l")), "page")
    b, l = F.col("b"), F.col("l")
    ba, la, inter = g.area(b), g.area(l), g.intersection(b, l)
    (bx, by), (lx, ly) = _center(b), _center(l)
    j = j.where((ba > 0) & (la > 0)).withColumn("inter", inter).withColumn("far", F.hypot(bx - lx, by - ly)).withColumn("fit", kind_fit(F.col("bk"), F.col("lk")))
    near = F.col("far") <= max(80.0, 0.05 * min(width, height))
    j = j.where(((F.col("inter") > 0) | near) & ((F.col("fit") > 0) | (F.col("inter") > 0)))
    ratio = F.greatest(la / ba, ba / la)
    score = 2.0 * g.iou(b, l) + 1.1 * F.col("inter") / ba + 0.7 * F.col("inter") / la + 0.4 * g.center_inside(b, l).cast("double") + 0.4 * F.col("confidence") + 0.8 * F.col("fit")
    score = score + 0.25 * g.x_overlap_fraction(b, l) + 0.25 * g.y_overlap_fraction(b, l) - 0.25 * F.log(F.greatest(F.lit(1.0), ratio)) - 1.5 * F.col("far") / F.lit((width**2 + height**2) ** 0.5)
    j = j.withColumn("score", g.rounded(score, 6))
    w = Window.partitionBy("page", "block_id").orderBy(F.desc("score"), "region_id")
    return j.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("page", "block_id", "region_id", "rank", "score")


def repaired(b: Column, action: Column, l: Column, width: float, height: float, most: float = 40.0) -> Column:
    """A block's box after an action towards a layout box, clipped to the page; null if nothing is left. Without a layout box it stays."""
    part = lambda **k: F.struct(*((k[x] if x in k else b[x]).alias(x) for x in ("x1", "y1", "x2", "y2")))
    cut = part(x1=F.greatest(b["x1"], l["x1"]), y1=F.greatest(b["y1"], l["y1"]), x2=F.least(b["x2"], l["x2"]), y2=F.least(b["y2"], l["y2"]))
    wide = part(x1=F.greatest(l["x1"], b["x1"] - most), y1=F.greatest(l["y1"], b["y1"] - most), x2=F.least(l["x2"], b["x2"] + most), y2=F.least(l["y2"], b["y2"] + most))
    to = (
        F.when(l.isNull(), part())
        .when(action.isin("snap_to_layout", "snap_to_layout_safe"), part(**{x: l[x] for x in ("x1", "y1", "x2", "y2")}))
        .when((action == "clip_to_layout") & (g.intersection(b, l) > 0), cut)
        .when(action == "snap_x_to_layout", part(x1=l["x1"], x2=l["x2"]))
        .when(action == "snap_y_to_layout", part(y1=l["y1"], y2=l["y2"]))
        .when(action == "expand_within_layout", wide)
        .otherwise(part())
    )
    return g.clamp(to, F.lit(width), F.lit(height))


def pixel_box(pixel: Column, raw: Column, width: Column, height: Column) -> Column:
    """The pixel box if there is one, else the raw one of 0 to 999 scaled; clipped, corners in order, whole numbers rounded half to even; null if nothing is left."""
    scaled = g.box(raw["x1"] / 999.0 * width, raw["y1"] / 999.0 * height, raw["x2"] / 999.0 * width, raw["y2"] / 999.0 * height)
    v = F.coalesce(pixel, F.when(raw.isNotNull() & (width > 0) & (height > 0), scaled))
    clip = lambda c, most: F.when(most > 0, F.greatest(F.lit(0.0), F.least(most.cast("double"), c))).otherwise(c)
    x = [F.bround(clip(v[k], width)).cast("long") for k in ("x1", "x2")]
    y = [F.bround(clip(v[k], height)).cast("long") for k in ("y1", "y2")]
    out = F.struct(F.least(*x).alias("x1"), F.least(*y).alias("y1"), F.greatest(*x).alias("x2"), F.greatest(*y).alias("y2"))
    return F.when(v.isNotNull() & (out["x2"] > out["x1"]) & (out["y2"] > out["y1"]), out)


def padded(u: Column, padding: float, width: float, height: float) -> Column:
    """A union box with a margin, clipped to the page; null if nothing is left."""
    out = g.box(F.greatest(F.lit(0.0), u["x1"] - padding), F.greatest(F.lit(0.0), u["y1"] - padding), F.least(F.lit(width), u["x2"] + padding), F.least(F.lit(height), u["y2"] + padding))
    return F.when((out["x2"] > out["x1"]) & (out["y2"] > out["y1"]), out)


def likeness(a: Column, b: Column) -> Column:
    """Of two boxes in shares of the page: 1 less three times the distance of their centres and the differences of their sides, 0 at least; 0 if either is null."""
    (ax, ay), (bx, by) = _center(a), _center(b)
    side = lambda p, q: F.abs((a[q] - a[p]) - (b[q] - b[p]))
    d = F.hypot(ax - bx, ay - by) * 3.0 + side("x1", "x2") + side("y1", "y2")
    return F.coalesce(F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), d)), F.lit(0.0))


def shape_distance(a: Column, b: Column) -> Column:
    """How far two page-wide boxes differ in top, bottom, width and, half, in centre."""
    (ax, _), (bx, _) = _center(a), _center(b)
    zero = lambda c: F.greatest(F.lit(0.0), c)
    t, u = a["y1"] - b["y1"], a["y2"] - b["y2"]
    w, c = zero(a["x2"] - a["x1"]) - zero(b["x2"] - b["x1"]), 0.5 * (ax - bx)
    return F.sqrt(t * t + u * u + w * w + c * c)


def likely_footer(b: Column, area_ratio: Column, width: Column, height: Column) -> Column:
    """A band low on the page, almost as wide as it, and flat."""
    return (b["y1"] / height >= 0.82) & ((b["x2"] - b["x1"]) / width >= 0.80) & (area_ratio <= 0.20)


def footer_class_check(adverts: DataFrame, footers: DataFrame, width: float, height: float) -> DataFrame:
    """Footer-like adverts (page, ad_id, score, box) beside their page's raw footer (page, footer_score, footer), null where it has none; shares of no score are null."""
    share = g.area(F.col("box")) / F.lit(width * height)
    a = adverts.where(likely_footer(F.col("box"), share, F.lit(width), F.lit(height)))
    j = a.join(footers.select("page", "footer_score", "footer"), "page", "left")
    over = F.when(F.col("footer").isNotNull(), g.iou(F.col("box"), F.col("footer"))).otherwise(0.0)
    ratio = F.when(F.col("footer_score") > 0, F.col("score") / F.col("footer_score"))
    return j.select("page", "ad_id", "score", F.col("footer").isNotNull().alias("footer_found"), g.rounded(over, 6).alias("iou"), g.rounded(F.col("score") - F.col("footer_score"), 6).alias("score_margin"), g.rounded(ratio, 6).alias("score_ratio"))


def same_column(a: Column, b: Column, width: Column) -> Column:
    """Centres nearer than .18 of the page's width, or than 100 where it is unknown; never for a null box."""
    d = F.abs(_center(a)[0] - _center(b)[0])
    return F.coalesce(F.when(width > 0, d / width < 0.18).otherwise(d < 100), F.lit(False))


def nearest_seeds(elements: DataFrame, seeds: DataFrame, width: float | None) -> DataFrame:
    """Each element's nearest title seed of its page and column, by centres' heights; of equals the one of least order. elements: page, element_id, box; seeds: page, seed_id, box, order."""
    j = elements.select("page", "element_id", F.col("box").alias("e")).join(seeds.select("page", "seed_id", F.col("box").alias("s"), "order"), "page")
    j = j.where(same_column(F.col("e"), F.col("s"), F.lit(width)))
    dy = F.abs(_center(F.col("e"))[1] - _center(F.col("s"))[1])
    return j.groupBy("page", "element_id").agg(F.min_by("seed_id", F.struct(dy.alias("dy"), F.col("order").alias("order"))).alias("seed_id"))


def suppress(page: np.ndarray, ids: np.ndarray, score: np.ndarray, b: np.ndarray, overlap: float) -> np.ndarray:
    """Positions that greedy suppression keeps of many pages' detections at once: round k judges the k-th detection of every page that has one against those kept before it."""
    order = np.lexsort((*b.T[::-1], ids, -score, page))
    p, b = page[order], b[order]
    size = np.maximum(b[:, 2] - b[:, 0], 0) * np.maximum(b[:, 3] - b[:, 1], 0)
    starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    counts = np.diff(np.r_[starts, len(p)])
    keep = np.zeros(len(p), np.int64)  # a page's kept ones, from its start on
    used = np.zeros(len(starts), np.int64)
    live = np.arange(len(starts))
    for k in range(counts.max()):
        live = live[counts[live] > k]
        i, held = starts[live] + k, used[live]
        mine = np.repeat(np.arange(len(live)), held)
        own, other = i[mine], keep[np.repeat(starts[live] - np.cumsum(held) + held, held) + np.arange(len(mine))]
        w = np.maximum(np.minimum(b[own, 2], b[other, 2]) - np.maximum(b[own, 0], b[other, 0]), 0)
        h = np.maximum(np.minimum(b[own, 3], b[other, 3]) - np.maximum(b[own, 1], b[other, 1]), 0)
        ok = np.ones(len(live), bool)
        ok[mine[w * h >= overlap * np.maximum(size[own] + size[other] - w * h, 1e-12)]] = False
        keep[(starts[live] + held)[ok]] = i[ok]
        used[live[ok]] += 1
    return np.sort(order[keep[np.repeat(starts - np.cumsum(used) + used, used) + np.arange(used.sum())]])


def kept_detections(rows: DataFrame, overlap: float = 0.85) -> DataFrame:
    """Greedy suppression within a page: by score, then id, then box, a detection stays if it overlaps no kept one by `overlap`. A page is a small group; many are judged at once. rows: page, det_id, score, x1, y1, x2, y2."""

    def judge(t: pa.Table) -> pa.Table:
        col = lambda k: t.column(k).to_numpy()
        kept = suppress(codes(t, "page"), col("det_id"), col("score"), np.column_stack([col(k) for k in ("x1", "y1", "x2", "y2")]), overlap)
        return t.select(["page", "det_id"]).take(pa.array(kept))

    d = rows.select("page", "det_id", F.col("score").cast("double").alias("score"), *(F.col(k).cast("double").alias(k) for k in ("x1", "y1", "x2", "y2")))
    return by_whole_groups(d, "page", judge, "page long, det_id long")


def template_clusters(clusters: DataFrame, total_pages: int, least_pages: int, places: int | None = 8) -> DataFrame:
    """Members of clusters (cluster_id, page, score, label, box in shares of the page) summed up: pages, support, scores, mean box, its largest deviation, the best member's page, acceptance. Means and deviation are rounded to `places`, or exact where it is None, for callers that cut them further."""
    sides = ("x1", "y1", "x2", "y2")
    m = clusters.groupBy("cluster_id").agg(F.countDistinct("page").alias("pages"), F.countDistinct("label").alias("labels"), F.min("score").alias("lo"), F.max("score").alias("hi"), F.avg("score").alias("mean"), F.max_by("page", F.struct("score", (-F.col("page")).alias("p"))).alias("best_page"), *(F.avg(f"box.{k}").alias(k) for k in sides))
    off = F.greatest(*(F.abs(F.col(f"box.{k}") - F.col(k)) for k in sides))
    d = clusters.select("cluster_id", "box").join(m.select("cluster_id", *sides), "cluster_id").groupBy("cluster_id").agg(F.max(off).alias("deviation"))
    r = m.join(d, "cluster_id")
    cut = lambda k: F.col(k) if places is None else g.rounded(k, places)
    return r.select("cluster_id", "pages", "labels", g.rounded(F.col("pages") / total_pages, 8).alias("support"), *(cut(k).alias(f"score_{n}") for k, n in (("lo", "min"), ("hi", "max"), ("mean", "mean"))), *(cut(k).alias(k) for k in sides), cut("deviation").alias("deviation"), "best_page", (F.col("pages") >= least_pages).alias("accepted"))
