import random

import xxhash

from leafweave.llm.simhash import fingerprint, simhash_dedup


def plain(text):
    w = [x for x in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ") if x]
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def components(fp):
    root = {i: i for i in fp}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fp)
    for i in ids:
        for j in ids:
            if i < j and bin(fp[i] ^ fp[j]).count("1") <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_against_all_pairs(spark):
    r = random.Random(5)
    base = [" ".join(f"w{r.randrange(4000)}" for _ in range(r.choice([4, 30, 300]))) for _ in range(40)]
    texts = []
    for t in base:
        texts.append(t)
        for _ in range(r.randrange(6)):
            w = t.split()
            w[r.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    texts += ["", None, " \n", "Short", "sHORT", "two words", "É", "é", base[0].upper(), base[0]]
    rows = [(i, t) for i, t in enumerate(texts)]
    fp = {i: plain(t) for i, t in rows}
    assert all(fingerprint(t) == fp[i] for i, t in rows)
    for crowd, hot in ((3, 4096), (64, 1), (2, 0)):
        got = simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string"), crowd=crowd, hot=hot).collect()
        assert {r["doc_id"]: int(r["fingerprint"], 16) for r in got} == fp
        assert {r["doc_id"]: r["component_id"] for r in got} == components(fp)


def test_crowded_variants_lose_no_link(spark):
    # Many fingerprints that share one half: all in the same variants.
    from leafweave.llm.simhash import links

    r = random.Random(1)
    fps = sorted({(123456789 << 32) | (77 ^ (1 << r.randrange(32)) ^ (1 << r.randrange(32)) ^ (1 << r.randrange(12))) for _ in range(150)})
    want = {(a, b) for a in fps for b in fps if a < b and bin(a ^ b).count("1") <= 2}
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    for crowd, hot in ((2, 4096), (1000, 4096), (2, 10), (1000, 0)):
        assert {(x["a"], x["b"]) for x in links(df, crowd, hot).collect()} == want


def test_null_repeated_and_long(spark):
    """Null ids name no component and join none; rows of one id are one document; a very long text is read whole."""
    r = random.Random(9)
    a, b, c, d = (" ".join(f"{x}{r.randrange(10**6)}" for _ in range(60)) for x in "abcd")
    long = " ".join(f"l{r.randrange(10**6)}" for _ in range(60_000))
    rows = [(None, a), (None, b), (5, a + " "), (9, b), (None, c), (11, d), (11, c), (12, long), (13, long + "\n"), (14, d), (14, d), (None, "alone here now")]
    got = simhash_dedup(spark.createDataFrame([(*x, "f", 1, 7) for x in rows], "doc_id long, text string, fingerprint string, component_id int, fp long")).collect()
    assert sorted(((x["doc_id"], x["component_id"]) for x in got), key=str) == sorted([(None, 5), (None, 9), (5, 5), (9, 9), (None, 11), (11, 11), (11, 11), (12, 12), (13, 12), (14, 11), (14, 11), (None, None)], key=str)
    assert {x["fingerprint"] for x in got} == {f"{plain(t):016x}" for _, t in rows}


def test_empty(spark):
    assert simhash_dedup(spark.createDataFrame([], "doc_id long, text string, fp long")).count() == 0
