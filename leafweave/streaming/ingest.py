"""Pages that arrive as files, taken in as they come: each micro-batch replaces what it brings, so a batch done twice changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def take(batch: DataFrame, out: str) -> None:
    """Writes a batch's pages into a folder for each document and page; of several versions of a page the last that arrived stays."""
    last = batch.groupBy("doc_id", "page").agg(F.max_by(F.struct(*[c for c in batch.columns if c not in ("doc_id", "page")]), "arrived").alias("r")).select("doc_id", "page", "r.*")
    last.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id", "page").parquet(out)


def ingest(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, files: int = 1000) -> StreamingQuery:
    """A query over page files (JSON lines with doc_id and page) below a folder, at most `files` a batch, that ends when all are taken; call it again for more."""
    pages = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder).withColumn("arrived", F.col("_metadata.file_modification_time"))
    return pages.writeStream.foreachBatch(lambda batch, _: take(batch, out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
