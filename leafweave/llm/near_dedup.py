"""Near copies by SimHash: texts whose sets of five-word shingles have Jaccard similarity 0.8 or more.

Each set has a SimHash. Sets whose fingerprints are at most NEAR bits apart are found by deletion variants (simhash.py);
of each set's pairs a few are verified over both whole texts and join it to a component. Fingerprints promise nothing on sets just similar enough, which
lie up to 24 bits apart (a quarter of the links is within 5, half within 7; 64 bits index no wider distance), so what they
leave, pairs of sets in different components, is completed exactly:

Shingles stand in one total order. Two sets of similarity t or more share a shingle among the first n - ceil(t n) + 1 of
each, so only those are exchanged. Where a pair meets in its first common shingle, no more can be common than what follows
there in either set; pairs for which that is too little go. So do pairs whose parities (how often, even or odd, shingles
fall on each of some bits) differ in more bits than sets that similar can have shingles apart. The rest, few beyond the
true pairs, are verified over both whole texts; only for them texts travel. No pair is lost, whatever the order; shingles
common in a sample of documents come last in it, so that few pairs meet by chance, and the sample grows with the input.

Of a key with over `crowd` members the pairs are not made at once: as far as SimHash has not joined them, its members are first held against one hub after
another, and only pairs still in different components are made in the end, and of those only between members whose
sizes and places of the key allow it, which whole classes of members decide. Components are thus those of all pairs.

Defined cases: texts are lowered in ASCII and split at white space; fewer than five words are one shingle; texts without
words are alike; very long texts are shingled whole; a similarity of exactly 0.8 links; equal sets are one node; rows repeated
with one doc_id are one document; a null doc_id keeps a null component unless linked to others, whose smallest id it takes;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafweave.llm.common import MADE, connected_components, drop, materialise, slices, sweep
from leafweave.llm.simhash import majority, pairs_within

WIDTH, SIMILAR, SEED = 5, 0.8, 42
#: Bits between the fingerprints that SimHash links: three segments of 21 bits, one wildcard each.
NEAR = 5
#: Pairs of a node that are verified at once.
PARTNERS = 3
CROWD, ROUNDS = 32, 8
#: The order is by a sample of a twentieth, SAMPLED documents at least, and of its shingles the HOT commonest.
SAMPLED, SHARE, HOT = 10_000, 0.05, 200_000
#: Ids that are broadcast, 8 bytes each; beyond, tables are joined by exchange.
SMALL = 200_000
PREFIX = "doc_id long, node long, n int, fp long, parity binary, keys array<long>, text string"


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles of a whole text as sorted 64-bit hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.int64)
    digest = xxhash.xxh64_digest
    if len(words) <= width:
        h = digest(b" ".join(words), SEED)
    else:
        joined = b" ".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        h = b"".join([digest(joined[a:b], SEED) for a, b in zip((ends - sizes).tolist(), ends[width - 1 :].tolist(), strict=False)])
    return np.unique(np.frombuffer(h, ">u8").astype(np.uint64).view(np.int64))


def least_common(a: int, b: int, similar: float) -> int:
    """Shingles that sets of a and b have in common at least, if they are that similar."""
    return math.ceil(similar / (1 + similar) * (a + b) - 1e-9)


def parity(s: np.ndarray) -> bytes:
    """Of each bit, the lowest first, whether an odd number of a set's shingles fall on it; two bits for three shingles, 64 at least."""
    bits = max(64, 1 << math.ceil(math.log2(max(1, len(s)) / 1.5)))
    return np.packbits(np.bincount(s & (bits - 1), minlength=bits) & 1, bitorder="little").tobytes()


def most_common(n: int, x: bytes, m: int, y: bytes) -> int:
    """Shingles that sets of n and m with these parities have in common at most."""
    (x, y), bits = sorted((x, y), key=len), 8 * max(len(x), len(y))
    x, y, least = int.from_bytes(x, "little"), int.from_bytes(y, "little"), 8 * len(x)
    while bits > least:  # halves laid upon each other are the parities of half as many bits
        bits //= 2
        y = (y >> bits) ^ (y & ((1 << bits) - 1))
    return (n + m - (x ^ y).bit_count()) // 2


def _sampled(batches):
    for b in slices(batches, column=0):
        for t in b.column(0).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(shingles(t), pa.int64())], names=["key"])


def common(docs: DataFrame) -> np.ndarray:
    """Shingles in three documents or more of a sample, rarest first. They decide the order only."""
    share = min(1.0, max(SHARE, SAMPLED / max(1, docs.count())))
    c = docs.select("text").sample(share, seed=SEED).mapInArrow(_sampled, "key long").groupBy("key").agg(F.count("*").alias("n"))
    got = c.where("n > 2").orderBy(F.desc("n"), "key").limit(HOT).collect()
    return np.array([r["key"] for r in got[::-1]], np.int64)


def _prefixes(hot: np.ndarray, similar: float):
    by = np.argsort(hot)
    ordered = hot[by]

    def rows(batches):
        for b in slices(batches):
            node, size, fps, odd, keys = [], [], [], [], []
            for t in b.column(1).to_pylist():
                s = shingles(t)
                n = len(s)
                p = n - math.ceil(similar * n - 1e-9) + 1 if n else 0
                rank = np.full(n, -1, np.int64)
                if len(ordered) and n:
                    at = np.minimum(np.searchsorted(ordered, s), len(ordered) - 1)
                    rank = np.where(ordered[at] == s, by[at], -1)
                node.append(xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63))
                size.append(n)
                fps.append(majority(s.astype(">i8").tobytes()))
                odd.append(parity(s))
                keys.append(s[np.lexsort((s, rank))[:p]])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(node, pa.int64()), pa.array(size, pa.int32()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(odd, pa.binary()), pa.array(keys, pa.list_(pa.int64())), b.column(1)], names=["doc_id", "node", "n", "fp", "parity", "keys", "text"])

    return rows


def _likely(similar: float):
    def rows(batches):
        for b in batches:
            keep = [most_common(n, x, m, y) >= least_common(n, m, similar) for n, x, m, y in zip(*(b.column(j).to_pylist() for j in range(2, 6)), strict=True)]
            k = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(k), b.column(1).filter(k)], names=["a", "b"])

    return rows


def _verify(similar: float):
    def rows(batches):
        held: tuple[dict, dict] = ({}, {})

        def of(side: int, node: int, text: str) -> np.ndarray:
            got = held[side].get(node)
            if got is None:
                if len(held[side]) >= 64:
                    held[side].clear()
                got = held[side][node] = shingles(text)
            return got

        for b in slices(batches, column=2):
            keep = []
            for i, k, t, u in zip(*(b.column(j).to_pylist() for j in range(4)), strict=True):
                x, y = of(0, i, t), of(1, k, u)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least_common(len(x), len(y), similar))
            k = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(k), b.column(1).filter(k)], names=["a", "b"])

    return rows


def _few(ids: DataFrame) -> DataFrame:
    """A written table of ids, to be broadcast only if it is small."""
    ids = materialise(ids.distinct(), "ids")
    return F.broadcast(ids) if ids.count() <= SMALL else ids


def _chosen(pairs: DataFrame) -> DataFrame:
    """Of each node's pairs PARTNERS at most, enough to hold large groups together; others are in one component then, or left to prefixes."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    of = both.groupBy("a").agg(F.array(*(F.min_by("b", F.xxhash64("b", F.lit(k))) for k in range(PARTNERS))).alias("bs"))
    return of.select("a", F.explode("bs").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_components(docs: DataFrame, similar: float = SIMILAR, crowd: int = CROWD) -> DataFrame:
    """doc_id, node, component_id of every row."""
    spark, before_all = docs.sparkSession, len(MADE)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    read = materialise(d.mapInArrow(_prefixes(common(d), similar), PREFIX), "prefixes")
    sets = materialise(read.groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys")), "sets")
    parities = materialise(read.select("node", "n", "fp", "parity").distinct(), "parities")
    # The keys are the larger part of what is not text; from here on they are in the sets alone, and those go when keys have met.
    rows = materialise(read.select("doc_id", "node", "text"), "rows")
    drop(spark, MADE[before_all : before_all + 1])
    keyed = sets.select(F.posexplode("keys").alias("i", "key"), "node", "n")
    counts = materialise(keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "keys")
    sweep(spark)
    met = materialise(keyed.join(counts, "key"), "met")
    drop(spark, [MADE[before_all], MADE[-2]])  # sets and keys
    sweep(spark)

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that are similar: by their parities first, then by the texts of the nodes that are left."""
        at = len(MADE)
        held = parities.select("node", "n", "parity")
        x, y = held.toDF("a", "na", "xa"), held.toDF("b", "nb", "xb")
        j = pairs.join(x, "a").join(y, "b").select("a", "b", "na", "xa", "nb", "xb")
        likely = materialise(j.mapInArrow(_likely(similar), "a long, b long"), "likely")
        ids = _few(likely.select(F.explode(F.array("a", "b")).alias("node")))
        of = materialise(rows.select("node", "text").join(ids, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text")), "texts")
        x, y = of.toDF("a", "ta"), of.toDF("b", "tb")
        j = likely.join(x, "a").join(y, "b").select("a", "b", "ta", "tb")
        out = materialise(j.mapInArrow(_verify(similar), "a long, b long"), "links")
        drop(spark, MADE[at:-1])
        sweep(spark)
        return out

    # By size, and by what follows the key in both sets.
    need = f"{similar / (1 + similar)!r} * (n + hn) - 1e-6"
    sized, placed = f"least(n, hn) >= {similar!r} * greatest(n, hn) - 1e-9", f"least(n - i, hn - hi) >= {need}"
    fits = f"{sized} and {placed}"
    def rooted_by(df: DataFrame, roots: DataFrame) -> DataFrame:
        return df.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    edges = verified(_chosen(pairs_within(parities.select("node", "fp"), NEAR, most=PARTNERS)))
    roots = connected_components(edges)
    crowded, before = met.where(F.col("m") > crowd), None
    rooted = rooted_by(crowded, roots)
    for k in range(ROUNDS):
        # Pairs of members in different components, as far as they are left to make.
        r = rooted.groupBy("key", "root").agg(F.count("*").alias("k")).groupBy("key").agg((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))).alias("open"), F.sum("k").alias("m"))
        open_, members = r.agg(F.sum("open"), F.sum("m")).first()
        if not open_ or open_ <= crowd * members or (before is not None and open_ > 0.9 * before):
            break
        before = open_
        # A set with few shingles before the key, rarer than it, has little of its own and is likest to the others.
        turn = F.struct(F.floor(F.col("i") / (2 * k + 1)), F.xxhash64("node", F.lit(k)), "node")
        hubs = rooted.groupBy("key").agg(F.min_by(F.struct(F.col("node").alias("h"), F.col("n").alias("hn"), F.col("i").alias("hi"), F.col("root").alias("hr")), turn).alias("x")).select("key", "x.*")
        near = materialise(rooted.join(hubs, "key").where(f"root <> hr and {fits}").groupBy("node").agg(F.min_by("h", F.xxhash64("h", F.lit(k))).alias("h")), "hubs")
        edges = materialise(edges.unionByName(verified(near.select(F.least("node", "h").alias("a"), F.greatest("node", "h").alias("b")).distinct())), "links")
        roots = connected_components(edges)
        rooted = rooted_by(crowded, roots)
    met = materialise(rooted_by(met, roots), "met")
    few, many = met.where(F.col("m") <= crowd), met.where(F.col("m") > crowd)

    def sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        return (df.select("key", "n", "i", F.col("node").alias("a"), "root"), df.select("key", F.col("n").alias("hn"), F.col("i").alias("hi"), F.col("node").alias("b"), F.col("root").alias("hr")))

    # Of a pair that meets in keys of few members all meetings are counted. What it has in common is among them, in crowded
    # keys of both, or behind the first part of the set whose first part ends earlier.
    x, y = sides(few)
    pairs = x.join(y, "key").where(f"a < b and root <> hr and {sized}").groupBy("a", "b", "n", "hn").agg(F.count("*").alias("shared"), F.max(F.expr(placed)).alias("placed")).where("placed")
    crowds = materialise(many.groupBy("node").agg(F.count("*").alias("k")), "crowds")
    for side in "ab":
        pairs = pairs.join(crowds.select(F.col("node").alias(side), F.col("k").alias(f"k{side}")), side, "left")
    behind = f"greatest(ceil({similar!r} * n - 1e-9), ceil({similar!r} * hn - 1e-9)) - 1"
    pairs = pairs.where(f"shared + least(coalesce(ka, 0), coalesce(kb, 0)) + {behind} >= {need}").select("a", "b")
    # Members of one size and place are one class; of a crowded key only classes are held against each other.
    x, y = sides(many)
    classes = materialise(many.groupBy("key", "n", "i").agg(F.min("root").alias("lo"), F.max("root").alias("hi_")), "classes")
    other = classes.select("key", F.col("n").alias("hn"), F.col("i").alias("hi"), F.col("lo").alias("hlo"), F.col("hi_").alias("hhi"))
    allowed = classes.join(other, "key").where(f"{fits} and not (lo = hi_ and hlo = hhi and lo = hlo)").select("key", "n", "i", "hn", "hi")
    pairs = pairs.unionByName(x.join(allowed, ["key", "n", "i"]).join(y, ["key", "hn", "hi"]).where("a < b and root <> hr").select("a", "b"))
    pairs = materialise(pairs.distinct(), "pairs")
    sweep(spark)
    if not pairs.isEmpty():
        edges = edges.unionByName(verified(pairs))
    # A document's rows are one, whatever their texts.
    first = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("doc_id", "a")
    same = rows.join(first, "doc_id").select("a", F.col("node").alias("b")).where("a <> b")
    roots = connected_components(edges.unionByName(same))
    of = materialise(rows.select("doc_id", "node").join(roots, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root")), "classes")
    least = materialise(of.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    drop(spark, MADE[before_all:-2])  # only these two are read from here on
    return of.join(least, "root").select("doc_id", "node", "component_id")
