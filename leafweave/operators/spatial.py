"""Joins of boxes within a page. The page is the equality key; overlap and score are conditions on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafweave.functions import geometry as g


def match_regions(blocks: DataFrame, regions: DataFrame, least: float = 0.25) -> DataFrame:
    """Each block's best region of its page (page, block_id, box; page, region_id, box): score, or no row if none reaches `least`."""
    j = blocks.select("page", "block_id", F.col("box").alias("b")).join(regions.select("page", "region_id", F.col("box").alias("r")), "page")
    b, r = F.col("b"), F.col("r")
    contain, inside, over = g.overlap_fraction(b, r), g.center_inside(b, r), g.iou(b, r)
    j = j.withColumn("contain", contain).withColumn("inside", inside).withColumn("iou", over).where((F.col("contain") >= 0.20) | F.col("inside"))
    score = 0.60 * F.col("contain") + 0.20 * F.col("inside").cast("double") + 0.15 * F.col("iou") + 0.05
    j = j.withColumn("score", g.rounded(score, 8))
    w = Window.partitionBy("page", "block_id").orderBy(F.desc("score"), F.desc(g.rounded("contain", 8)), F.desc(g.rounded("iou", 8)), "region_id")
    return j.withColumn("rank", F.row_number().over(w)).where((F.col("rank") == 1) & (F.col("score") >= least)).select("page", "block_id", "region_id", "score")


def parents(regions: DataFrame, page_area: float) -> DataFrame:
    """The smallest region that holds a region: covers .82 of it, or .68 with its center; at least 1.2 times its area, at most .92 of the page."""
    c, p = regions.select("page", F.col("region_id").alias("child"), F.col("box").alias("c")), regions.select("page", F.col("region_id").alias("parent"), F.col("box").alias("p"))
    j = c.join(p, "page").where("child <> parent").withColumn("ca", g.area(F.col("c"))).withColumn("pa", g.area(F.col("p"))).withColumn("cover", g.overlap_fraction(F.col("c"), F.col("p")))
    ok = (F.col("cover") >= 0.82) | ((F.col("cover") >= 0.68) & g.center_inside(F.col("c"), F.col("p")))
    j = j.where((F.col("ca") > 0) & ok & (F.col("pa") >= 1.2 * F.col("ca")) & (F.col("pa") <= 0.92 * page_area))
    w = Window.partitionBy("page", "child").orderBy("pa", "parent", F.desc(g.rounded("cover", 6)))
    return j.withColumn("rank", F.row_number().over(w)).where("rank = 1").select("page", "child", "parent", g.rounded("cover", 6).alias("coverage"))


def captions(visuals: DataFrame, blocks: DataFrame, k: int = 3) -> DataFrame:
    """Up to k blocks just below a visual (gap -25 to 160, .18 of the smaller width shared), by score."""
    j = visuals.select("page", "region_id", F.col("box").alias("v")).join(blocks.select("page", "block_id", F.col("box").alias("b")), "page")
    j = j.withColumn("gap", F.col("b.y1") - F.col("v.y2")).withColumn("share", g.x_overlap_fraction(F.col("v"), F.col("b")))
    j = j.where(F.col("gap").between(-25, 160) & (F.col("share") >= 0.18))
    near = F.greatest(F.lit(0.0), 1 - F.greatest(F.col("gap"), F.lit(0.0)) / 160.0)
    j = j.withColumn("score", g.rounded(0.60 * F.col("share") + 0.30 * near, 6))
    w = Window.partitionBy("page", "region_id").orderBy(F.desc("score"), "block_id")
    return j.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("page", "region_id", "block_id", "rank", "score")
