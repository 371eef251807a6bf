"""Pages as tables: normalised layout regions, provenance graphs, fused groups, halves of spreads, shards of tasks; reports and tables as files."""

from __future__ import annotations

import heapq
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafweave.functions import geometry as g
from leafweave.operators import layout


def layout_regions(boxes: DataFrame) -> DataFrame:
    """Detector boxes (page, place from 1, layout_id, label, label_group, score, box, width, height) as regions: clipped, degenerate ones gone, with role and the order of their geometry."""
    b = boxes.withColumn("box", g.clamp(F.col("box"), F.col("width"), F.col("height"))).where("box is not null")
    low = lambda k: F.lower(F.coalesce(k, F.lit("")))
    b = b.withColumn("label", low("label")).withColumn("label_group", low("label_group"))
    w = Window.partitionBy("page").orderBy("box.y1", "box.x1", "place")
    id_ = F.coalesce(F.nullif("layout_id", F.lit("")), F.format_string("layout_%03d", "place"))
    return b.select("page", id_.alias("region_id"), F.col("place").alias("layout_order"), "box", "label", "label_group", layout.region_role(F.col("label"), F.col("label_group")).alias("role"), "score", F.row_number().over(w).cast("long").alias("geometry_order"))


def provenance_graph(regions: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (id, kind), edges (source, target, relation) and warnings (text) of documents' pages, regions and blocks.

    regions: doc_id, page, layout_id; blocks: doc_id, page, place, block_id, split_index (null for whole blocks), anchor (a layout_id or null), parent (a block_id or null). Of blocks with one id the first stays.
    """
    doc = F.concat(F.lit("document:"), F.col("doc_id").cast("string"))
    page = F.concat(doc, F.lit("/page:"), F.col("page").cast("string"))
    r = regions.withColumn("pid", page).withColumn("id", F.concat("pid", F.lit("/layout:"), F.col("layout_id").cast("string")))
    local = F.concat(F.col("block_id").cast("string"), F.coalesce(F.concat(F.lit("."), F.col("split_index").cast("string")), F.lit("")))
    b = blocks.withColumn("pid", page).withColumn("local", local).withColumn("id", F.concat("pid", F.lit("/block:"), "local"))
    b = b.withColumn("turn", F.row_number().over(Window.partitionBy("id").orderBy("place")))
    again = b.where("turn > 1").select(F.concat(F.lit("Duplicate block id skipped: "), "id").alias("text"))
    b = b.where("turn = 1")
    pages = regions.select("doc_id", "page").unionByName(blocks.select("doc_id", "page")).distinct().withColumn("id", page).withColumn("doc", doc)
    node = lambda df, k: df.select("id", F.lit(k).alias("kind"))
    nodes = node(pages.select(F.col("doc").alias("id")).distinct(), "document").unionByName(node(pages, "page")).unionByName(node(r.select("id").distinct(), "layout_region")).unionByName(node(b, "parsed_block"))
    edge = lambda df, s, t, k: df.select(F.col(s).alias("source"), F.col(t).alias("target"), F.lit(k).alias("relation"))
    a = b.where("anchor is not null").join(r.select("pid", F.col("layout_id").alias("anchor"), F.col("id").alias("rid")).distinct(), ["pid", "anchor"], "left")
    missing = a.where("rid is null").select(F.format_string("Missing anchor %s referenced by %s", F.col("anchor").cast("string"), "id").alias("text"))
    after = b.withColumn("next", F.lead("id").over(Window.partitionBy("pid").orderBy("place"))).where("next is not null")
    parents = b.where("parent is not null").select("pid", F.col("parent").cast("string").alias("local"), "id").join(b.select("pid", "local", F.col("id").alias("from")), ["pid", "local"])
    edges = edge(pages, "doc", "id", "contains").unionByName(edge(r.select("pid", "id").distinct(), "pid", "id", "contains")).unionByName(edge(b, "pid", "id", "contains")).unionByName(edge(a.where("rid is not null"), "id", "rid", "anchored_to")).unionByName(edge(after, "id", "next", "precedes")).unionByName(edge(parents, "from", "id", "split_into"))
    return nodes, edges, again.unionByName(missing)


def fused_groups(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """A page's blocks in reading order, then its visual regions in layout order, as linked groups: doc_id, page, local_order, source_id, kind, previous, following. blocks: doc_id, page, block_id, final_order; regions: doc_id, page, region_id, layout_order, role."""
    last = F.lit(10**9)
    b = blocks.select("doc_id", "page", F.col("block_id").cast("string").alias("source_id"), F.lit("text_chunk").alias("kind"), F.lit(0).alias("part"), F.coalesce("final_order", last).alias("o"))
    r = regions.where(F.lower("role") == "visual").select("doc_id", "page", F.col("region_id").cast("string").alias("source_id"), F.lit("visual").alias("kind"), F.lit(1).alias("part"), F.coalesce("layout_order", last).alias("o"))
    w = Window.partitionBy("doc_id", "page").orderBy("part", "o", "source_id")
    x = b.unionByName(r).withColumn("local_order", (F.row_number().over(w) - 1).cast("long"))
    return x.select("doc_id", "page", "local_order", "source_id", "kind", F.lag("source_id").over(w).alias("previous"), F.lead("source_id").over(w).alias("following"))


def page_halves(pages: DataFrame) -> DataFrame:
    """Spreads (doc_id, page_index) cut into left and right: output_page_index, source_page_index, side."""
    h = pages.select("doc_id", F.col("page_index").alias("source_page_index"), F.posexplode(F.array(F.lit("left"), F.lit("right"))).alias("k", "side"))
    w = Window.partitionBy("doc_id").orderBy("source_page_index", "k")
    return h.select("doc_id", (F.row_number().over(w) - 1).cast("long").alias("output_page_index"), "source_page_index", "side")


def balanced(loads: list[tuple[str, int]], shards: int) -> dict[str, int]:
    """Tasks to shards, the largest first, each to the least loaded, the lowest number of equals."""
    heap = [(0, k) for k in range(shards)]
    out = {}
    for task, load in sorted(loads, key=lambda x: (-x[1], x[0])):
        total, k = heapq.heappop(heap)
        out[task] = k
        heapq.heappush(heap, (total + load, k))
    return out


def balanced_shards(tasks: DataFrame, shards: int, most: int = 1_000_000) -> DataFrame:
    """Tasks (task_id, load) with a shard. The deal is sequential, so ids and loads come to the driver; more than `most` are refused."""
    rows = tasks.select(F.col("task_id").cast("string"), F.col("load").cast("long")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} tasks; deal them by hash instead")
    deal = tasks.sparkSession.createDataFrame(list(balanced([tuple(r) for r in rows], shards).items()), "t string, shard int")
    return tasks.join(deal, tasks["task_id"].cast("string") == deal["t"]).drop("t")


def fallback(sources: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first of several sources that has any for a key, with the number of the source."""
    all_ = None
    for k, s in enumerate(sources):
        s = s.withColumn("source_rank", F.lit(k))
        all_ = s if all_ is None else all_.unionByName(s, allowMissingColumns=True)
    best = all_.groupBy(key).agg(F.min("source_rank").alias("source_rank"))
    return all_.join(best, [key, "source_rank"])


def write_report(spark: SparkSession, path: str, value) -> None:
    """A small report as one pretty JSON file, through the session's file system."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray((json.dumps(value, ensure_ascii=False, indent=2) + "\n").encode()))
    finally:
        out.close()


def read_report(spark: SparkSession, path: str):
    """What write_report wrote, or any whole-file JSON value."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def write_table(rows: DataFrame, path: str, separator: str = "\t") -> None:
    """Rows as text with a header line in every file."""
    rows.write.mode("overwrite").option("header", True).option("sep", separator).csv(path)
