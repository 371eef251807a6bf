"""The near stage against all pairs of texts by their sets of five-word shingles."""

import random

import corpus_pipeline
from leafweave.llm import near_dedup
from leafweave.llm.near_dedup import near_components


def plain_set(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_components(texts):
    sets, root = {i: plain_set(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(texts):
        for j in sorted(texts):
            if i < j and (sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in texts}


def corpus(seed=3):
    r, texts = random.Random(seed), []
    for _ in range(25):
        t = [f"w{r.randrange(3000)}" for _ in range(r.choice([3, 12, 60, 300]))]
        texts.append(" ".join(t))
        for _ in range(r.randrange(7)):
            w = list(t)
            for _ in range(r.randrange(1, 2 + len(w) // 30)):
                w[r.randrange(len(w))] = f"x{r.randrange(999)}"
            texts.append(" ".join(w))
    return {i: t for i, t in enumerate([*texts, "", None, " \n", "Two words", "tWO  words", "É", "é"])}


def test_components_against_all_pairs(spark):
    texts = corpus()
    want = plain_components(texts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for crowd in (1, 2, 64):
        assert {r["doc_id"]: r["component_id"] for r in near_components(df, crowd=crowd).collect()} == want


def test_stage_drops_copies_with_a_few_changed_words(spark):
    r = random.Random(8)
    w = [f"w{r.randrange(5000)}" for _ in range(300)]
    near = [*w[:100], "one", *w[101:200], "two", *w[201:]]
    far = [*w[:150], *(f"v{k}" for k in range(150))]
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate((w, near, far))], "doc_id long, text string")
    assert {x["doc_id"] for x in corpus_pipeline.near(spark, df, "").collect()} == {0, 2}


def test_null_and_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(50)) for x in "abc")
    df = spark.createDataFrame([(None, a), (None, b), (4, a + " more"), (7, b + " more"), (8, c), (9, c + " x"), (9, "other words of a kind")], "doc_id long, text string")
    got = {(x["doc_id"], x["component_id"]) for x in near_components(df).collect()}
    assert got == {(None, 4), (None, 7), (4, 4), (7, 7), (8, 8), (9, 8)}
    assert near_components(df.limit(0)).count() == 0
    assert near_dedup.least_common(9, 9, 0.8) == 8


def test_texts_travel_only_for_likely_pairs(spark, monkeypatch):
    """Documents that share a passage meet in its shingles; their parities tell them apart before texts are joined to pairs."""
    r, read, write = random.Random(5), {}, near_dedup.materialise
    shared = [f"s{k}" for k in range(60)]
    texts = [" ".join([*shared, *(f"w{r.randrange(10**6)}" for _ in range(120))]) for _ in range(150)]
    texts.append(texts[0] + " end")

    def counted(df, name):
        out = write(df, name)
        read[name] = read.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(near_dedup, "materialise", counted)
    monkeypatch.setattr(near_dedup, "common", lambda docs: near_dedup.np.zeros(0, "int64"))
    got = near_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == {i: i % 150 for i in range(151)}
    assert read["met"] > 150 and read["texts"] <= 4


def test_parities_never_deny_what_is_common():
    r = random.Random(6)
    for n in (0, 1, 5, 60, 96, 97, 400, 5000):
        a = {r.getrandbits(63) - (1 << 62) for _ in range(n)}
        for part, more in ((1, 0), (0.9, n // 9), (0.5, n), (0, 50), (1, n // 4)):
            b = {x for x in a if r.random() < part} | {r.getrandbits(63) - (1 << 62) for _ in range(more)}
            x, y = (near_dedup.np.array(sorted(s), near_dedup.np.int64) for s in (a, b))
            assert len(a & b) <= near_dedup.most_common(len(a), near_dedup.parity(x), len(b), near_dedup.parity(y)) <= (len(a) + len(b)) // 2
