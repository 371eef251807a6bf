"""Line dedup: hash each document's normalised lines, count distinct documents a hash, drop lines over the threshold, reassemble by position.

A line's key is the line stripped of [\\x20\\x09-\\x0D] at both ends with A-Z lower-cased. Only 16-byte hashes travel
to be counted, one a document and key; counting is by (hash, document) and then by hash with map-side combine, so a
line that a third of all documents hold is a few rows a task. Texts move once, to meet the hashes that they lose.

Defined cases: null or empty text is one empty line; rows with a null doc_id are neither counted nor changed; rows
repeated with one doc_id count as one document and lose the same keys; a key is lost everywhere but in the largest
doc_id that holds it; a very long text or line is read whole, a slice of rows at a time; exactly `min_docs` documents lose
their lines; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafweave.llm.common import LOWER, SPACES, UPPER, materialise, slices, table


def _key(line: bytes, min_chars: int) -> bytes | None:
    """The hash of a line's key, or None for a key too short to count."""
    k = line.strip(SPACES).lower()
    if len(k) < min_chars or (not k.isascii() and len(k.decode()) < min_chars):
        return None
    return hashlib.blake2b(k, digest_size=16).digest()


def _occurrences(min_chars: int):
    def rows(batches):
        for b in slices(batches):
            ids, keys = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if i is None or t is None or len(t) < min_chars:
                    continue
                found = {_key(x, min_chars) for x in t.encode().split(b"\n")} - {None}
                ids += [i] * len(found)
                keys += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "key"])

    return rows


def _rebuild(min_chars: int):
    def rows(batches):
        for b in slices(batches):
            n, dropped, kept = [], [], []
            for t, gone in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = (t or "").encode()
                total = raw.count(b"\n") + 1
                lost = 0
                if gone:
                    gone = set(gone)
                    lines = [x for x in raw.split(b"\n") if _key(x, min_chars) not in gone]
                    lost, raw = total - len(lines), b"\n".join(lines)
                n.append(total)
                dropped.append(lost)
                kept.append(raw.decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(dropped, pa.int64())], names=["doc_id", "text", "n_lines", "n_dropped"])

    return rows


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, text (kept lines), n_lines, n_dropped for every row of docs."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    occ = materialise(d.mapInArrow(_occurrences(min_chars), "doc_id long, key binary"), "lines")
    common = occ.groupBy("key", "doc_id").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep_id")).where(F.col("n") >= min_docs)
    common = materialise(common, "common")  # both sides of the join are then plain exchanges, whose hot keys can be split
    gone = occ.join(common, "key").where("doc_id <> keep_id").groupBy("doc_id").agg(F.collect_set("key").alias("gone"))
    return d.join(gone, "doc_id", "left").select("doc_id", "text", "gone").mapInArrow(_rebuild(min_chars), "doc_id long, text string, n_lines long, n_dropped long")


def op10_line_dedup(spark, sf_dir):
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP10_SQL = f"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
l AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS pos FROM s),
k AS (SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keep_id FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.keep_id AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
