"""What several operators share: reading tables, durable intermediate tables, components."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes of [\x20\x09-\x0D].
SPACES = b" \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Of text that a Python worker holds as objects at a time, and that travels to it in one Arrow batch.
SLICE_BYTES, BATCH_BYTES = 2 << 20, 4 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Paths of the tables that materialise has written in this process.
MADE: list[str] = []


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches bounded by bytes, so that very long texts do not meet in one."""
    spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches, most: int = SLICE_BYTES, column: int = 1):
    """Batches cut by rows to about `most` bytes of a text column, at least one row each; nothing is copied."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, end - at)
            at = end
            pa.default_memory_pool().release_unused()


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares (spark.checkpoint.dir); one of our own only in local mode where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='leafweave-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: a lost executor costs no recomputation and lineage ends here."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    MADE.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that materialise wrote and nothing reads any more."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in list(paths):
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
        MADE.remove(p)


def sweep(spark: SparkSession) -> None:
    """Has the driver collect its garbage: shuffle files of finished jobs stay on the executors' disks until it does."""
    gc.collect()
    spark._jvm.System.gc()


def release(spark: SparkSession) -> None:
    """Deletes every table written so far; for a caller that is done with all results."""
    drop(spark, MADE)


def buckets_for(rows: int, per_bucket: int) -> int:
    return max(1, -(-rows // per_bucket))


def held_out(doc_id: Column | str) -> Column:
    """True for the rows labels are never learnt from: crc32 of the id's digits mod 5 is 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 40) -> DataFrame:
    """(node, root) for every node of an edge list, root being the smallest node reachable.

    Alternates large-star and small-star steps until the edge set stops changing. Each step is
    one aggregation with map-side combine and one equi-join whose hot side adaptive execution
    can split; every round ends in a written table, so no lineage grows and nothing but two
    counters comes to the driver. An empty edge list gives an empty result.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    e = materialise(e, "cc")

    def mark(df):
        r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    seen = mark(e)
    if seen[0] == 0:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(max_rounds):
        s = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        m = s.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = s.join(m, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        m = large.groupBy("a").agg(F.min("b").alias("m"))
        j = large.join(m, "a")
        small = j.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        e = materialise(small, "cc")
        drop(spark, [MADE[-2]])  # the round before
        now = mark(e)
        if now == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
