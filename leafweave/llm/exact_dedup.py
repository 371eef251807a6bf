"""Exact dedup by a minimal perfect hash over historical distinct digests.

Texts are equal when identical after lower-casing A-Z. The history's distinct digests go into one
minimal perfect hash per digest bucket; a slot holds the full 32-byte digest, the locator (doc_id)
of the winner so far and the number of rows. New rows are aggregated by digest before anything is
looked up, so a group of any size is one row a task; a lookup compares all 32 bytes. Members extend
their slot's group, nonmembers form groups of their own. Rows then take their group's winner by an
equi-join whose hot side adaptive execution can split.

Defined cases: null text counts as empty; a null doc_id never wins unless all of its group are null;
rows repeated with one doc_id and text count each in group_size and are all kept when that id wins;
a very long text is hashed whole, a slice of rows at a time; of equal ids that tie all are kept; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafweave.llm.common import LOWER, UPPER, buckets_for, materialise, slices

GAMMA, LEVELS = 1.5, 48


def normalised(text: str | None) -> bytes:
    return b"" if text is None else text.encode().lower()


def digest_rows(batches):
    for b in slices(batches):
        ids, texts = b.column(0), b.column(1)
        d = [hashlib.sha256(normalised(t)).digest() for t in texts.to_pylist()]
        yield pa.RecordBatch.from_arrays([ids, pa.array(d, pa.binary())], names=["doc_id", "digest"])


def digests(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(digest_rows, "doc_id long, digest binary")


# --- minimal perfect hash ---------------------------------------------------------------------


def _words(digest_list: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digest_list), dtype="<u8").reshape(-1, 4)


def _place(w: np.ndarray, level: int, size: int) -> np.ndarray:
    """The position of each digest at a level; digests are uniform, so mixing two of their words suffices."""
    with np.errstate(over="ignore"):
        x = w[:, 1] + np.uint64(level) * (w[:, 2] | np.uint64(1))
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        return (x % np.uint64(size)).astype(np.int64)


def build_mph(w: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Levels of bits and the slot of each digest, a bijection onto 0..n-1. Digests that no level separates take the last slots in the order of their bytes."""
    left, levels, slot, base = np.arange(len(w)), [], np.full(len(w), -1, np.int64), 0
    while len(left) and len(levels) < LEVELS:
        size = max(1, int(GAMMA * len(left)))
        at = _place(w[left], len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        rank, mine = np.cumsum(alone) - 1, alone[at]
        slot[left[mine]] = base + rank[at[mine]]
        base += int(alone.sum())
        left = left[~mine]
    slot[left] = base + np.arange(len(left))
    return levels, slot


def find_slots(levels: list[np.ndarray], n: int, w: np.ndarray) -> np.ndarray:
    """The only slot each digest can have, or -1; the caller compares the slot's bytes. Digests past all levels are sought by the caller."""
    slot, open_, base = np.full(len(w), -1, np.int64), np.arange(len(w)), 0
    for k, alone in enumerate(levels):
        at = _place(w[open_], k, len(alone))
        hit = alone[at]
        slot[open_[hit]] = base + (np.cumsum(alone) - 1)[at[hit]]
        base += int(alone.sum())
        open_ = open_[~hit]
    return slot


INDEX = "bucket long, n long, level_bits array<binary>, level_sizes array<long>, slot_digest binary, slot_winner array<long>, slot_rows array<long>"


def _build_bucket(t: pa.Table) -> pa.Table:
    d = t.column("digest").to_pylist()
    levels, slot = build_mph(_words(d))
    order = np.argsort(slot, kind="stable")
    win, rows = t.column("winner").take(order).to_pylist(), t.column("rows").take(order).to_pylist()
    return pa.table(
        {
            "bucket": pa.array([t.column("bucket")[0].as_py()], pa.int64()),
            "n": pa.array([len(d)], pa.int64()),
            "level_bits": pa.array([[np.packbits(x).tobytes() for x in levels]], pa.list_(pa.binary())),
            "level_sizes": pa.array([[len(x) for x in levels]], pa.list_(pa.int64())),
            "slot_digest": pa.array([b"".join(d[i] for i in order)], pa.binary()),
            "slot_winner": pa.array([win], pa.list_(pa.int64())),
            "slot_rows": pa.array([rows], pa.list_(pa.int64())),
        }
    )


def bucket_of(digest: Column | str, n: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(n)).cast("long")


def build_index(history: DataFrame, n_buckets: int) -> DataFrame:
    """One row per bucket from the history's (digest, winner, rows), all digests distinct."""
    return history.withColumn("bucket", bucket_of("digest", n_buckets)).groupBy("bucket").applyInArrow(_build_bucket, INDEX)


GROUPS = "digest binary, keep_id long, group_size long, member boolean"


def _look_up(new: pa.Table, index: pa.Table) -> pa.Table:
    """Groups of one bucket: slots, extended by the new digests found in them, and the nonmembers."""
    nd, nw, nr = (new.column(c).to_pylist() for c in ("digest", "winner", "rows")) if new.num_rows else ([], [], [])
    sd, sw, sr, levels = b"", [], [], []
    if index.num_rows:
        r = index.to_pylist()[0]
        sd, sw, sr = r["slot_digest"], r["slot_winner"], r["slot_rows"]
        levels = [np.unpackbits(np.frombuffer(x, np.uint8))[:n].astype(bool) for x, n in zip(r["level_bits"], r["level_sizes"], strict=True)]
    rest = {}
    if levels:
        rest = {sd[32 * i : 32 * i + 32]: i for i in range(int(sum(x.sum() for x in levels)), len(sw))}
    slots = find_slots(levels, len(sw), _words(nd)) if nd and levels else np.full(len(nd), -1)
    out = [[], [], [], []]
    for d, w, n, s in zip(nd, nw, nr, slots.tolist(), strict=True):
        if s < 0:
            s = rest.get(d, -1)
        if s >= 0 and sd[32 * s : 32 * s + 32] == d:
            sw[s] = w if sw[s] is None else sw[s] if w is None else max(sw[s], w)
            sr[s] += n
        else:
            for o, v in zip(out, (d, w, n, False), strict=True):
                o.append(v)
    return pa.table(
        {
            "digest": pa.array(out[0] + [sd[32 * i : 32 * i + 32] for i in range(len(sw))], pa.binary()),
            "keep_id": pa.array(out[1] + sw, pa.int64()),
            "group_size": pa.array(out[2] + sr, pa.int64()),
            "member": pa.array(out[3] + [True] * len(sw), pa.bool_()),
        }
    )


def exact_dedup(docs: DataFrame, history: Column | None = None, per_bucket: int = 50_000) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    history: which rows count as the history, a condition on doc_id; by default the lower half of the range of ids, as ids rise with time.
    """
    d = materialise(digests(docs), "digests")
    if history is None:
        lo, hi = d.agg(F.min("doc_id"), F.max("doc_id")).first()
        history = F.col("doc_id") <= ((lo + hi) // 2 if lo is not None else 0)
    d = d.withColumn("old", F.coalesce(history, F.lit(False)))

    def distinct(df):
        return df.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count("*").alias("rows"))

    n = buckets_for(d.count(), per_bucket)
    index = build_index(distinct(d.where("old")), n)
    new = distinct(d.where("not old")).withColumn("bucket", bucket_of("digest", n))
    groups = new.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(_look_up, GROUPS)
    return d.join(groups, "digest").select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op6_exact_dedup(spark, sf_dir):
    from leafweave.llm.common import table

    return exact_dedup(table(spark, sf_dir, "documents"))


OP6_SQL = f"""
WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""
