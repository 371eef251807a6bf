"""Corpus pipeline: toxicity, exact dedup, near-dedup (SimHash of five-word shingles, Jaccard 0.8), benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame, written as
Parquet and read again as the next stage's docs. All but the last return the columns of documents.

Rows with a null doc_id pass near-dedup (their copies with an id are judged among themselves) and no other filter: they go if
toxic, if a copy with an id stays, or if they hold a benchmark passage. Rows repeated with one doc_id go or stay together in
near-dedup and decontamination. Null and empty texts are clean, equal to each other and packed as one token. Very long texts
are read whole by every stage. Extra columns are carried along; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafweave.llm.common import LOWER, MADE, UPPER, drop, materialise, table
from leafweave.llm.decontaminate import decontaminate
from leafweave.llm.exact_dedup import exact_dedup
from leafweave.llm.near_dedup import near_components
from leafweave.llm.packing import pack
from leafweave.llm.toxicity import keep_clean, train

TOXIC = 0.5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5."""
    return keep_clean(docs, train(docs, table(spark, sf_dir, "labels")), TOXIC)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id. Rows are known by id and text, so one id with two texts may keep either."""
    kept = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("_kept"), F.col("text_sha256").alias("_sha"))
    own = F.sha2(F.translate(F.coalesce(docs["text"], F.lit("")), UPPER, LOWER), 256)
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]) & (own == kept["_sha"]), "left_semi")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id: SimHash by deletion variants, verified, and completed exactly."""
    kept = near_components(docs).where("doc_id is null or doc_id = component_id").select(F.col("doc_id").alias("_kept"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage. Rows without an id are known by their text."""
    row = F.when(docs["doc_id"].isNotNull(), F.xxhash64(docs["doc_id"].cast("long"))).otherwise(F.xxhash64(F.lit("text"), docs["text"]))
    found = decontaminate(docs.select(row.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_found")).distinct()
    return docs.join(found, row == found["_found"], "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of 1024 tokens, sources in their own shares."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("simhash", near), ("decontaminate", clean), ("packing", packing)]
#: SQL can express neither the learnt grammar nor the SVD; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = len(MADE)
        docs = materialise(stage(spark, docs, sf_dir), name)
        drop(spark, MADE[max(0, before - (name != STAGES[0][0])) : -1])  # what only this stage read
    return STAGES[-1][1](spark, docs, sf_dir)
