"""Benchmark decontamination by latent semantic retrieval.

Documents are read once into the places of benchmark words (all other words can neither add to a cosine with an item nor
to a common subsequence). Passages are pairs of neighbouring half-passages of `half` words, so they overlap by half. Their
TF-IDF matrix, with frequencies counted over all half-passages of all documents, is decomposed by a randomised Nystrom
SVD: tasks sum A'(A Omega) over their rows, partial sums meet in two levels by slices of the vocabulary, and the small rest is done on
the driver, whose arrays are bounded by `block` items, their words by `block` + 32 directions. A benchmark of any size is taken
`at_once` items at a time, which bounds the vocabulary that documents are read into and all that the driver holds. The items
themselves are rows of the matrix with a weight of the corpus' own, so their directions are in the space however rare
they are in the corpus. Passages whose latent cosine with an item reaches `cosine` are candidates.

A candidate is verified on the words: the longest common subsequence of the item and the passage, widened by the item's
length on both sides, must hold `same` of the item's words; or, for a paraphrase, `alike` of them with the answer
check: the item's rarest words, which identify its answer, all occur there in their order.

Defined cases: null and empty texts hold no passage; items of fewer than `SHORT` words are too short to judge (a name or a date
is in many clean documents), match nothing and are listed by too_short; a null item_id is not searched for; very long texts are cut
into passages like any other; rows repeated with one doc_id are one result, and so are all rows with a null doc_id, which are
searched like any other; items with one text are each reported, those repeated with one item_id once; of passages that tie the
result is the same; an empty table on either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafweave.llm.common import MADE, buckets_for, drop, materialise, slices, table

WORD = re.compile(r"[^\W_]+")
HALF, BLOCK, COSINE, SAME, ALIKE, RARE = 48, 256, 0.3, 0.8, 0.6, 4
SHORT, AT_ONCE = 5, 4096
#: Words of over this share of half-passages stay out of the vectors (but for the rarer half of an item's), not out of the subsequences.
COMMON = 0.01
SLICES, FAN = 16, 32


#: Characters past ASCII that are no part of a word; a text without them is cut by bytes.
OTHER = re.compile(r"[^\x00-\x7f\w]")
GAPS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of letters and digits, lower-cased, in UTF-8."""
    t = (text or "").lower()
    return [w.encode() for w in WORD.findall(t)] if OTHER.search(t) else t.encode().translate(GAPS).split()


def _places(vocabulary: dict[bytes, int]):
    def rows(batches):
        get = vocabulary.get
        for b in slices(batches):
            out = [[], [], [], []]
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = words(t)
                if not w:
                    continue
                term = np.fromiter(map(get, w, repeat(-1)), np.int32, len(w))
                at = np.flatnonzero(term >= 0).astype(np.int32)
                for o, x in zip(out, (i, len(w), at.tobytes(), term[at].tobytes()), strict=True):
                    o.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], names=["doc_id", "n", "at", "term"])

    return rows


def _halves(at: np.ndarray, term: np.ndarray, size: int, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (half-passage, term) of one document and how often."""
    key, tf = np.unique(at.astype(np.int64) // half * size + term, return_counts=True)
    return key // size, key % size, tf


def _batches(b, size: int, half: int, remap: np.ndarray):
    """Rows of a batch as one run of half-passages, numbered on with a gap between documents: (half, term, tf, of each document its first)."""
    h, t, f, first, at0 = [], [], [], [], 0
    for n, a, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
        a, x = np.frombuffer(a, np.int32), remap[np.frombuffer(x, np.int32)]
        first.append(at0)
        if (ok := x >= 0).any():
            hh, tt, ff = _halves(a[ok], x[ok], size, half)
            h.append(hh + at0)
            t.append(tt)
            f.append(ff)
        at0 += (n - 1) // half + 2
    cat = lambda v: np.concatenate(v) if v else np.zeros(0, np.int64)
    return cat(h), cat(t), cat(f), np.array(first + [at0])


def _parts(batches, words: int = 100_000):
    """Batches cut by documents into parts of about so many words, which bounds a task's arrays."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(np.asarray(b.column(1)))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + words, "right")))
            yield b.slice(at, end - at)
            at = end


def _frequencies(size: int, half: int):
    def rows(batches):
        df, n = np.zeros(size, np.int64), 0
        one = np.arange(size)
        for b in batches:
            h, t, _, _ = _batches(b, size, half, one)
            df += np.bincount(t, minlength=size)
            n += int((-(-np.asarray(b.column(1)) // half)).sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(size), -1), pa.int64()), pa.array(np.append(df, n), pa.int64())], names=["term", "df"])

    return rows


def _latent(h: np.ndarray, t: np.ndarray, v: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The half-passages that have a term, and their sums of weighted rows of a basis."""
    start = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    if not len(start):
        return start, np.empty((0, basis.shape[1]), np.float32)
    return h[start], np.add.reduceat(basis[t] * v[:, None], start, axis=0)


def _sketch(idf, omega, size: int, half: int, remap: np.ndarray):
    """A task's sum of A'(A Omega) over its half-passages, rows of A being unit TF-IDF vectors, in slices of the vocabulary."""

    def rows(batches):
        w, o = idf.value, omega.value
        total = np.zeros(o.shape, np.float32)
        for b in _parts(batches):
            h, t, f, _ = _batches(b, size, half, remap)
            v = ((1 + np.log(f)) * w[t]).astype(np.float32)
            keep = v > 0
            h, t, v = h[keep], t[keep], v[keep]
            if not len(h):
                continue
            row = np.cumsum(np.append(False, h[1:] != h[:-1]))
            v /= np.sqrt(np.bincount(row, v * v))[row].astype(np.float32)
            _, z = _latent(h, t, v, o)
            by = np.argsort(t, kind="stable")
            t, v, row = t[by], v[by], row[by]
            start = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            total[t[start]] += np.add.reduceat(z[row] * v[:, None], start, axis=0)
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() // FAN
        cut = np.array_split(total, SLICES)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int64()), pa.array([part] * SLICES, pa.int64()), pa.array([x.tobytes() for x in cut], pa.binary())], names=["slice", "part", "sum"])

    return rows


def _add(t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in t.column("sum").to_pylist())
    return pa.table({"slice": t.column("slice")[:1], "part": pa.array([t.column("part")[0].as_py() // FAN], pa.int64()), "sum": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


SUMS = "slice long, part long, sum binary"


def nystrom(y: np.ndarray, omega: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors and values of A from y = A'A omega."""
    y, omega = y.astype(np.float64), omega.astype(np.float64)
    shift = max(np.finfo(np.float32).eps * np.linalg.norm(y), 1e-12)
    y = y + shift * omega
    c = omega.T @ y
    e, u = np.linalg.eigh((c + c.T) / 2)
    b = y @ (u / np.sqrt(np.maximum(e, shift)))
    u, s, _ = np.linalg.svd(b, full_matrices=False)
    return u, np.sqrt(np.maximum(s * s - shift, 0))


def common_subsequence(masks: dict[int, int], size: int, sequence) -> int:
    """Length of the longest common subsequence of an item, given as bit masks by word, and a sequence; by bits, a word a step."""
    v = full = (1 << size) - 1
    for t in sequence:
        if m := masks.get(t):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def masks_of(item: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, t in enumerate(item):
        out[t] = out.get(t, 0) | 1 << k
    return out


def _search(idf, basis, latent, items, size: int, half: int, remap: np.ndarray, cosine: float, same: float, alike: float):
    """items: (item_id, words, masks, answer's words and masks)."""

    def rows(batches):
        w, basis_, lat = idf.value, basis.value, latent.value
        for b in _parts(batches):
            h, t, f, first = _batches(b, size, half, remap)
            v = ((1 + np.log(f)) * w[t]).astype(np.float32)
            keep = v > 0
            at, x = _latent(h[keep], t[keep], v[keep], basis_)
            found: dict = {}
            if len(at):
                # A passage is a half and the next; a half whose next is empty stands alone.
                following = np.append(at[1:] == at[:-1] + 1, False)
                p = x.copy()
                p[following] += x[np.flatnonzero(following) + 1]
                norm = np.sqrt((p * p).sum(1))
                docs = np.searchsorted(first, at, "right") - 1
                ids, n, places, terms = (b.column(k).to_pylist() for k in range(4))
                for k in range(0, len(p), 4096):
                    c = p[k : k + 4096] @ lat.T / np.maximum(norm[k : k + 4096], 1e-9)[:, None]
                    for i, j in zip(*np.nonzero(c >= cosine), strict=True):
                        d = int(docs[k + i])
                        where, what = np.frombuffer(places[d], np.int32), np.frombuffer(terms[d], np.int32)
                        item_id, item, masks, answer, answer_masks = items[j]
                        lo = (int(at[k + i]) - int(first[d])) * half
                        s = what[np.searchsorted(where, lo - len(item)) : np.searchsorted(where, lo + 2 * half + len(item))].tolist()
                        if len(masks.keys() & set(s)) < alike * len(masks):
                            continue
                        got = common_subsequence(masks, len(item), s)
                        if got >= same * len(item) or (got >= alike * len(item) and common_subsequence(answer_masks, len(answer), s) == len(answer)):
                            key, new = (ids[d], item_id), (got / len(item), float(c[i, j]))
                            found[key] = max(found.get(key, new), new)
            k, s = list(found), list(found.values())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in k], pa.int64()), pa.array([x[1] for x in k], pa.int64()), pa.array([x[0] for x in s], pa.float64()), pa.array([x[1] for x in s], pa.float64())], names=["doc_id", "item_id", "common", "cosine"])

    return rows


FOUND = "doc_id long, item_id long, common double, cosine double"


def _numbered(benchmark: DataFrame) -> DataFrame:
    """item_id, text of the items that have an id, each pair once."""
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null").distinct()


def too_short(benchmark: DataFrame) -> DataFrame:
    """item_id, text of the items that are not searched for."""

    def rows(batches):
        for b in batches:
            yield b.filter(pa.array([len(words(t)) < SHORT for t in b.column(1).to_pylist()], pa.bool_()))

    return _numbered(benchmark).mapInArrow(rows, "item_id long, text string")


def decontaminate(docs: DataFrame, benchmark: DataFrame, half: int = HALF, block: int = BLOCK, cosine: float = COSINE, same: float = SAME, alike: float = ALIKE, at_once: int = AT_ONCE) -> DataFrame:
    """doc_id, item_id, common (share of the item's words in the common subsequence), cosine of every document that holds an item."""
    spark = docs.sparkSession
    b = materialise(_numbered(benchmark), "items")
    spent = MADE[-1]
    passes = buckets_for(b.count(), at_once)
    b = b.withColumn("pass", F.pmod(F.xxhash64("item_id"), F.lit(passes)))
    found = None
    for k in range(passes):
        items = [(r[0], words(r[1])) for r in b.where(F.col("pass") == k).select("item_id", "text").orderBy("item_id", "text").collect()]
        items = [x for x in items if len(x[1]) >= SHORT]
        f = _searched(docs, items, half, block, cosine, same, alike) if items else spark.createDataFrame([], FOUND)
        f = materialise(f, "found") if passes > 1 else f
        found = f if found is None else found.unionByName(f)
    drop(spark, [spent])
    return found


def _searched(docs: DataFrame, items: list, half: int, block: int, cosine: float, same: float, alike: float) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {w: k for k, w in enumerate(sorted({w for _, x in items for w in x}))}
    size = len(vocabulary)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    places = materialise(d.mapInArrow(_places(vocabulary), "doc_id long, n long, at binary, term binary"), "places")
    counts = {r[0]: r[1] for r in places.mapInArrow(_frequencies(size, half), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}
    total = max(1, counts.get(-1, 0))
    df = np.array([counts.get(k, 0) for k in range(size)])
    # Words of over COMMON of the half-passages stay out, but never the rarer half of an item's words: an item may itself be common.
    own_words = np.zeros(size, bool)
    for _, x in items:
        g = sorted({vocabulary[w] for w in x}, key=lambda t: (df[t], t))
        own_words[g[: max(RARE, -(-len(g) // 2))]] = True
    every = np.where((df > COMMON * total) & ~own_words, 0.0, np.log((total + 1) / (df + 1)) + 0.05)
    found = None
    for at in range(0, len(items), block):
        part = items[at : at + block]
        own = sorted({vocabulary[w] for _, x in part for w in x})
        remap = np.full(size, -1, np.int64)
        remap[own] = np.arange(len(own))
        idf = every[own]
        q = np.zeros((len(part), len(own)))
        for k, (_, x) in enumerate(part):
            for t, n in zip(*np.unique(remap[[vocabulary[w] for w in x]], return_counts=True), strict=True):
                q[k, t] = (1 + np.log(n)) * idf[t]
        unit = q / np.maximum(np.linalg.norm(q, axis=1), 1e-9)[:, None]
        rank = min(len(own), len(part) + 32)
        omega = np.random.default_rng(11).standard_normal((len(own), rank)).astype(np.float32)
        send = spark.sparkContext.broadcast
        idf_b = send(idf)
        sums = places.mapInArrow(_sketch(idf_b, send(omega), len(own), half, remap), SUMS)
        sums = sums.groupBy("slice", "part").applyInArrow(_add, SUMS).groupBy("slice").applyInArrow(_add, SUMS)
        got = {r["slice"]: r["sum"] for r in sums.collect()}
        y = np.frombuffer(b"".join(got[k] for k in sorted(got)), np.float32).reshape(-1, rank) if got else np.zeros_like(omega)
        weight = total / len(part)
        basis, _ = nystrom(y + weight * (unit.T @ (unit @ omega)), omega)
        latent = unit @ basis
        latent /= np.maximum(np.linalg.norm(latent, axis=1), 1e-9)[:, None]
        given = []
        for i, x in part:
            g = [vocabulary[w] for w in x]
            rare = set(sorted(set(g), key=lambda t: (-every[t], t))[:RARE])
            answer = [t for t in g if t in rare]
            given.append((i, g, masks_of(g), answer, masks_of(answer)))
        f = places.mapInArrow(_search(idf_b, send(basis.astype(np.float32)), send(latent.astype(np.float32)), given, len(own), half, remap, cosine, same, alike), FOUND)
        found = f if found is None else found.unionByName(f)
    return found.groupBy("doc_id", "item_id").agg(F.max("common").alias("common"), F.max("cosine").alias("cosine"))


def op8_decontaminate(spark, sf_dir):
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
