"""The SimHash part of the near stage against all pairs of fingerprints, and that the stage gets links from it."""

import random

import numpy as np
import xxhash

import corpus_pipeline
from leafweave.llm import near_dedup, simhash


def test_pairs_within_against_all_pairs(spark):
    r, fps = random.Random(11), []
    for _ in range(60):
        f = r.getrandbits(64)
        fps += [f, f]  # two nodes of one fingerprint
        for _ in range(6):
            for b in r.sample(range(64), r.randrange(1, 9)):
                f ^= 1 << b
            fps.append(f)
    fps += [0, 1, 1 << 63, (1 << 64) - 1]
    df = spark.createDataFrame([(i, f - (f >> 63 << 64)) for i, f in enumerate(fps)], "node long, fp long")
    for distance in (2, 3, 5, 7):
        want = {(i, j) for j in range(len(fps)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= distance}
        got = [(x["a"], x["b"]) for x in simhash.pairs_within(df, distance).collect()]
        assert sorted(got) == sorted(want)
        few = [(x["a"], x["b"]) for x in simhash.pairs_within(df, distance, most=2).collect()]
        assert set(few) <= want and {i for p in few for i in p} == {i for p in want for i in p}
    assert simhash.pairs_within(df.limit(0), 5).count() == 0


def test_halves_cover_all_bits():
    for distance in (2, 3, 5, 7):
        of = simhash.halves(distance)
        assert len(of) == 2 * (distance // 2 + 1)
        for first in (0, 1):  # each half is held once and has the wildcard once
            bits = sorted(b for low, n in [x[:2] if first else x[2:] for x in of] for b in range(low, low + n))
            assert bits == list(range(64))


def test_stage_gets_links_from_fingerprints(spark, monkeypatch):
    """With no keys for prefixes to meet in, the stage still links what SimHash finds, and only what is similar."""
    r = random.Random(12)
    w = [f"w{r.randrange(10**6)}" for _ in range(2000)]
    other = [f"v{r.randrange(10**6)}" for _ in range(300)]
    rows = [(0, " ".join(w)), (1, " ".join([*w[:-1], "end"])), (2, " ".join(["start", *w[1:]])), (3, " ".join(other)), (4, None)]
    sets = {i: near_dedup.shingles(t) for i, t in rows}
    fps = {i: simhash.majority(s.astype(">i8").tobytes()) for i, s in sets.items()}
    assert max((fps[0] ^ fps[i]).bit_count() for i in (1, 2)) <= near_dedup.NEAR
    plain = near_dedup._prefixes

    def without_keys(hot, similar):
        for_batches = plain(hot, similar)
        none = lambda b: near_dedup.pa.array([[]] * b.num_rows, near_dedup.pa.list_(near_dedup.pa.int64()))
        return lambda batches: (b.set_column(b.schema.get_field_index("keys"), "keys", none(b)) for b in for_batches(batches))

    monkeypatch.setattr(near_dedup, "_prefixes", without_keys)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x["doc_id"] for x in corpus_pipeline.near(spark, df, "").collect()} == {0, 3, 4}


def test_fingerprint_of_a_set_is_simhash():
    t = " ".join(f"w{k}" for k in range(40))
    assert simhash.majority(near_dedup.shingles(t).astype(">i8").tobytes()) == simhash.fingerprint(t, 5)
    assert simhash.majority(np.zeros(0, ">i8").tobytes()) == 0
    assert simhash.majority(xxhash.xxh64_digest(b"one", 42)) == simhash.fingerprint("one", 5)
