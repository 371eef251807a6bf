"""SimHash near-dedup by deletion-variant signatures.

A fingerprint has 64 bits. Two that differ in at most k = 2 bits, cut into k // 2 + 1 = 2 segments of 32, have a segment
in which they differ by at most one bit; so each segment is indexed under its 32 one-wildcard variants, variants meet
by equality, and every meeting is verified over all 64 bits. Copies never meet: distinct fingerprints are indexed.

One half of a segment keeps its 16 bits under a wildcard in the other half. Fingerprints travel once under each of their
four halves and get that half's 16 variants where they arrive, so 4 rows are exchanged and not 64. A half that over
`hot` fingerprints have is dealt by variant instead. A variant that more than `crowd` fingerprints share is not joined
in pairs: its members are indexed again under the variants of what is left of the fingerprint (the other segment and
the wildcard bit, 33 bits, two segments of one wildcard each), with the first variant as part of the key.

Nodes are fingerprints; those of one doc_id are linked. Components come from alternating star steps over written tables.

Defined cases: null and empty texts, and texts without words, have fingerprint zero, linked like any other; fewer than
three words are one shingle; very long texts are hashed whole, their bits counted in slices; rows repeated with one doc_id
are one document; a null doc_id keeps a null component unless linked to others, whose smallest id it takes; there are no
ties (a component's smallest id is its name); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafweave.llm.common import MADE, buckets_for, connected_components, drop, materialise, slices, table

BITS, SHINGLE, DISTANCE, SEED = 64, 3, 2, 42
CROWD, HOT = 64, 4096
#: Rows of halves in a task, each of which becomes 16 variants there.
PER_TASK = 50_000


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The SimHash of a whole text: bits set in over half of its shingles' hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    ends = (ends - 1).tolist()
    digest = xxhash.xxh64_digest
    return majority(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :], strict=False)]))


def majority(h: bytes) -> int:
    """Bits set in over half of the hashes, 8 bytes each, the highest first."""
    n = len(h) // 8
    bits, raw = np.zeros(BITS, np.int64), np.frombuffer(h, np.uint8).reshape(n, 8)
    for at in range(0, n, 1 << 14):
        part = np.unpackbits(raw[at : at + (1 << 14)], axis=1)
        bits += part.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * bits > n).tobytes(), "big")


def _rows(batches):
    for b in slices(batches):
        f = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f, pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_rows, "doc_id long, fp long")


def _variants(value: str, width: int, base: int) -> list[str]:
    """SQL for the keys of one segment: the wildcard's place above 40 bits, the segment without that bit below."""
    return [f"(({base + i}L << 40) | ({value} & ~(1L << {i})))" for i in range(width)]


def _half(k: int) -> str:
    """SQL for the k-th 16 bits, the highest first; halves 0 and 1 are the first segment."""
    return f"(shiftrightunsigned(fp, {48 - 16 * k}) & 65535L)"


def _met(reps: DataFrame, hot: int) -> DataFrame:
    """fp, key (wildcard's place above 40 bits, segment without that bit below), n of every variant that n > 1 fingerprints share."""
    # Half k stays, its neighbour in the segment has the wildcard; a wildcard's place counts from the segment's lowest bit.
    halves = reps.select("fp", F.expr(f"explode(array({', '.join(f'struct({k} as half, {_half(k)} as held)' for k in range(4))}))").alias("h")).select("fp", "h.*")
    many = materialise(halves.groupBy("half", "held").agg(F.count("*").alias("m")).where(F.col("m") > hot).select("half", "held"), "hot")
    segment = "(case when half < 2 then shiftrightunsigned(fp, 32) else (fp & 4294967295L) end)"
    place = "(case when half < 2 then 0 else 32 end + case when half % 2 = 0 then 0 else 16 end)"
    variants = [f"((cast({place} + {i} as long) << 40) | ({segment} & ~(1L << cast({place} % 32 + {i} as int))))" for i in range(16)]
    variants = F.expr(f"explode(array({', '.join(variants)}))").alias("key")
    # At most four rows a `hot` fingerprints, and no more than four times 65536 whatever the input.
    tasks = buckets_for(4 * reps.count(), PER_TASK)
    few = halves.join(F.broadcast(many), ["half", "held"], "left_anti").repartition(tasks, "half", "held").select("fp", "half", "held", variants)
    few = few.withColumn("n", F.count("*").over(Window.partitionBy("half", "held", "key"))).where("n > 1").select("fp", "key", "n")
    keyed = halves.join(F.broadcast(many), ["half", "held"], "left_semi").select("fp", variants)
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return materialise(few.unionByName(keyed.join(materialise(shared, "variants"), "key").select("fp", "key", "n")), "met")


def links(reps: DataFrame, crowd: int = CROWD, hot: int = HOT) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints, a < b, that differ in at most two bits."""
    hi, lo = "shiftrightunsigned(fp, 32)", "(fp & 4294967295L)"

    def pairs(df, *keys):
        x, y = df.select(*keys, F.col("fp").alias("a")), df.select(*keys, F.col("fp").alias("b"))
        # Of the variants a pair shares, the one at its differing bit, or the first of an equal segment, speaks for it.
        own = "(case when (key >> 40) < 32 then shiftrightunsigned(a ^ b, 32) else (a ^ b) & 4294967295L end)"
        bit = "cast((key >> 40) & 31 as int)"
        return x.join(y, list(keys)).where(f"a < b and bit_count(a ^ b) <= 2 and ({own} = shiftleft(1L, {bit}) or ({own} = 0 and {bit} = 0))").select("a", "b")

    met = _met(reps, hot)
    few, many = met.where(F.col("n") <= crowd), met.where(F.col("n") > crowd)
    # What the first key leaves open: the other segment's 32 bits and the wildcard's own bit.
    place = "(key >> 40)"
    rest = f"(case when {place} < 32 then (({lo}) << 1) | (({hi} >> cast({place} as int)) & 1L) else (({hi}) << 1) | (({lo} >> cast({place} - 32 as int)) & 1L) end)"
    many = many.withColumn("rest", F.expr(rest))
    again = _variants("shiftrightunsigned(rest, 17)", 16, 0) + _variants("(rest & 131071L)", 17, 16)
    many = many.select("fp", "key", F.expr(f"explode(array({', '.join(again)}))").alias("key2"))
    return pairs(few, "key").unionByName(pairs(many, "key", "key2")).distinct()


def halves(distance: int) -> list[tuple[int, int, int, int]]:
    """(lowest bit, bits) of what is held and of what has the wildcard, for both halves of each of distance // 2 + 1 segments."""
    k, out, top = distance // 2 + 1, [], BITS
    for s in range(k):
        width = BITS // k + (s < BITS % k)
        top -= width
        low = (top, width // 2)
        high = (top + low[1], width - low[1])
        out += [(*high, *low), (*low, *high)]
    return out


def _partners(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each node's pairs those with the `most` partners that come first in an order by hash."""
    x, y = np.concatenate([a, b]), np.concatenate([b, a])
    by = np.lexsort((y.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15), x))
    x, y = x[by], y[by]
    kept = np.ones(len(x), bool)
    kept[most:] = x[most:] != x[:-most]
    return x[kept], y[kept]


def _within(distance: int, crowd: int, most: int | None):
    def rows(batches):
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches if b.num_rows]
        if not got:
            return
        node, fp, half = (np.concatenate(c) for c in zip(*got, strict=True))
        for k, (held, m, free, n) in enumerate(halves(distance)):
            mine = half == k
            ids, u = node[mine], fp[mine].view(np.uint64)
            whole = np.uint64(((1 << m) - 1) << held | ((1 << n) - 1) << free)
            found = [(ids[:0], ids[:0])]
            for place in range(free, free + n):
                wild = np.uint64(1 << place)
                key = u & whole & ~wild
                by = np.lexsort((u, key))
                key, v, w = key[by], u[by], ids[by]
                for d in range(1, min(crowd, len(v) - 1) + 1):
                    at = np.flatnonzero(key[:-d] == key[d:])
                    if not len(at):
                        break
                    x = v[at] ^ v[at + d]
                    own = x & whole
                    # Of the variants a pair shares, the one at its differing bit, or the first of an equal segment, speaks for it.
                    own = (own == wild) | (own == 0) if place == free and k % 2 == 0 else own == wild
                    at = at[own & (np.bitwise_count(x) <= distance)]
                    found.append((w[at], w[at + d]))
            a, b = (np.concatenate(c) for c in zip(*found, strict=True))
            a, b = _partners(a, b, most) if most else (a, b)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return rows


def pairs_within(nodes: DataFrame, distance: int, crowd: int = CROWD, most: int | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of nodes (node, fp; a node once) whose fingerprints differ in at most `distance` bits.

    For wider distances than op2's: distance // 2 + 1 segments with one wildcard each. Fingerprints travel under the held
    halves of the segments only and get their variants on arrival, where pairs are made at once. Of the nodes of one variant
    each is held against the next `crowd` in the order of fingerprints, so that pairs do not grow with the square of a group:
    all pairs up to crowd + 1 nodes a variant; a caller that needs those beyond has to find them otherwise. With `most`, each
    node brings so many of its pairs from a half, which is enough to hold large groups together.
    """
    of = halves(distance)
    held = [f"struct({k} as half, shiftrightunsigned(fp, {low}) & {(1 << n) - 1}L as held)" for k, (low, n, _, _) in enumerate(of)]
    rows = nodes.select("node", "fp", F.expr(f"explode(array({', '.join(held)}))").alias("h")).select("node", "fp", "h.*")
    dealt = rows.repartition(buckets_for(len(of) * nodes.count(), PER_TASK), "half", "held").select("node", "fp", "half")
    return dealt.mapInArrow(_within(distance, crowd, most), "a long, b long").distinct()


def simhash_dedup(docs: DataFrame, crowd: int = CROWD, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    before = len(MADE)
    fps = materialise(fingerprints(docs), "fingerprints")
    e = links(materialise(fps.select("fp").distinct(), "reps"), crowd, hot)
    # A document's rows are one, whatever their texts.
    first = fps.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z").select("doc_id", "a")
    same = fps.join(first, "doc_id").select("a", F.col("fp").alias("b")).where("a <> b")
    roots = connected_components(e.unionByName(same))
    of = materialise(fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("doc_id", "fp", F.coalesce("root", "fp").alias("root")), "classes")
    # Written, so that the join has a plain exchange on both sides and the rows of a large component can be split.
    least = materialise(of.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    drop(docs.sparkSession, MADE[before:-2])  # only these two are read from here on
    return of.join(least, "root").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_simhash(spark, sf_dir):
    return simhash_dedup(table(spark, sf_dir, "documents"))
