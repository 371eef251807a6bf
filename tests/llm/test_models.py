"""Learnt operators: held-out accuracy, defined cases, and decontamination against brute force."""

import numpy as np
import pytest

from leafweave.llm import decontaminate, quality, toxicity

SF = "/root/testdata/sf0.01"


def held(spark, f, label):
    r = f(spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    r = r[r.held_out]
    return (r.predicted == r[label]).mean()


def test_held_out_accuracy(spark):
    assert held(spark, quality.op1_quality, "quality") >= 0.93
    assert held(spark, toxicity.op3_toxicity, "toxic") >= 0.93


@pytest.mark.parametrize(
    ("text", "pattern"),
    [("You are an idiot.", "aimed_insult"), ("Total idiot here", "bare_insult"), ("He is not an idiot.", "negated_insult"), ("It was said that idiot came", "reported_insult"), ("I will kill you", "aimed_threat"), ("Clean words only.", None), ("You there. Idiot", "bare_insult")],
)
def test_clauses(text, pattern):
    g = toxicity.Grammar(*toxicity.lexicon([]))
    x = g.clauses(text)
    assert [toxicity.PATTERNS[k] for k in np.flatnonzero(x)] == ([pattern] if pattern else [])


def test_without_labels(spark):
    d = spark.createDataFrame([(1, "You are an idiot.", 0.1), (2, None, 0.1), (3, "", 0.1), (3, "x " * 30_000, 0.1)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    s = toxicity.score(d, toxicity.train(d, none)).collect()
    assert {r["doc_id"] for r in s if r["score"] >= 0.5} == {1} and len(s) == 4
    q = quality.score(d, quality.train(d, none)).collect()
    assert len(q) == 4 and all(r["score"] == 0.5 for r in q)
    assert toxicity.score(d.limit(0), toxicity.train(d, none)).count() == 0
    q = quality.score(d, quality.train(d, none))
    assert q.where(quality.keep_best(q, 0.5)).count() == 4  # all tie
    assert q.limit(0).where(quality.keep_best(q.limit(0), 0.5)).count() == 0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_common_subsequence():
    r = np.random.default_rng(0)
    for _ in range(50):
        a, b = r.integers(0, 6, 12).tolist(), r.integers(0, 6, 30).tolist()
        assert decontaminate.common_subsequence(decontaminate.masks_of(a), len(a), b) == lcs(a, b)


def test_decontamination(spark):
    r = np.random.default_rng(4)
    word = lambda: "".join(r.choice(list("abcdefghij"), 5))
    items = [[word() for _ in range(n)] for n in (12, 20, 35, 60)]
    docs, want = [], set()
    for i in range(60):
        w = [word() for _ in range(int(r.integers(20, 300)))]
        if i % 3 == 0:
            k = i // 3 % 4
            q = list(items[k])
            if i % 2:  # a paraphrase: one word in ten differs
                for j in range(0, len(q), 10):
                    q[j] = word()
            at = int(r.integers(0, len(w)))
            w[at:at] = [x.upper() + "," for x in q]
            want.add((i, k))
        docs.append((i, " ".join(w), 0.5))
    docs += [(900, None, 0.5), (901, "", 0.5), (None, " ".join(items[0]), 0.5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, cosine double")
    b = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(9, None), (10, " ")], "item_id long, text string")
    want.add((None, 0))
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.decontaminate(df, b).collect()}
    brute = {(i, k) for i, t, _ in docs for k, q in enumerate(items) if lcs(q, [x.decode() for x in decontaminate.words(t)]) >= 0.8 * len(q)}
    assert got == want == brute
    assert {(x["doc_id"], x["item_id"]) for x in decontaminate.decontaminate(df, b, block=2).collect()} == want
    assert {(x["doc_id"], x["item_id"]) for x in decontaminate.decontaminate(df, b, at_once=2).collect()} == want
    assert decontaminate.decontaminate(df.limit(0), b).count() == 0
    assert decontaminate.decontaminate(df, b.limit(0)).count() == 0


def test_short_equal_and_long(spark):
    """Items of one to four words are too short to judge; items of one text are each reported; very long texts are searched to their end."""
    word = lambda k: f"w{k}"
    item = "the quick brown fox jumps over one lazy dog today"
    long = " ".join(word(k) for k in range(50_000))
    docs = [(1, "He lived in Paris for a year.", 1), (2, f"{long} {item}", 1), (2, long, 1), (3, item.upper(), 1), (3, item, 1), (4, long, 1)]
    bench = [(1, "Paris", "x"), (2, "lived in Paris", "x"), (3, item, "x"), (4, item, "x"), (4, item, "y"), (None, item, "x"), (5, "in Paris for a", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    b = spark.createDataFrame(bench, "item_id long, text string, doc_id string")
    got = sorted((x["doc_id"], x["item_id"]) for x in decontaminate.decontaminate(df, b).collect())
    assert got == [(2, 3), (2, 4), (3, 3), (3, 4)]
    assert sorted(r["item_id"] for r in decontaminate.too_short(b).collect()) == [1, 2, 5]


def plain_hits(docs, items, rare):
    """Every passage of every document beside every item: the module's rule on words alone, without vectors."""
    half, out = decontaminate.HALF, set()
    for i, t in docs:
        w = decontaminate.words(t)
        for k, q in items.items():
            m = decontaminate.masks_of(q)
            answer = [x for x in q if x in rare[k]]
            ma = decontaminate.masks_of(answer)
            for lo in range(0, len(w), half):
                s = w[max(0, lo - len(q)) : lo + 2 * half + len(q)]
                got = decontaminate.common_subsequence(m, len(q), s)
                if got >= 0.8 * len(q) or (got >= 0.6 * len(q) and decontaminate.common_subsequence(ma, len(answer), s) == len(answer)):
                    out.add((i, k))
                    break
    return out


def test_recall_of_paraphrases(spark):
    """Of the documents that the plain rule finds over all passages, the latent search finds nine in ten or more, whatever share of words is changed."""
    sf = "/root/testdata/sf0.001"
    r = np.random.default_rng(3)
    docs = [(x["doc_id"], x["text"] or "") for x in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = {x["item_id"]: decontaminate.words(x["text"]) for x in bench.collect()}
    pool = sorted({w for _, t in docs for w in decontaminate.words(t)})
    for share in (0.1, 0.2, 0.3):
        rows = []
        for n, (i, t) in enumerate(docs):
            q = list(items[sorted(items)[n % len(items)]])
            for j in r.choice(len(q), int(round(share * len(q))), replace=False):
                q[j] = pool[int(r.integers(len(pool)))]
            w = t.split()
            at = int(r.integers(0, len(w) + 1))
            rows.append((i, " ".join(w[:at] + [x.decode() for x in q] + w[at:])))
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {(x["doc_id"], x["item_id"]) for x in decontaminate.decontaminate(df, bench).collect()}
        # The answer's words are the rarest by half-passages, ties by the word.
        count = {}
        for _, t in rows:
            w = decontaminate.words(t)
            for lo in range(0, len(w), decontaminate.HALF):
                for x in set(w[lo : lo + decontaminate.HALF]):
                    count[x] = count.get(x, 0) + 1
        rare = {k: set(sorted(set(q), key=lambda x: (count.get(x, 0), x))[: decontaminate.RARE]) for k, q in items.items()}
        brute = plain_hits(rows, items, rare)
        recall = len(got & brute) / max(1, len(brute))
        print(f"changed {share:.0%}: plain rule {len(brute)} of {len(rows)} planted, recall {recall:.3f}")
        assert recall >= 0.9
        assert len(got - brute) <= 0.02 * len(brute) + 1


def test_quality_of_odd_rows(spark):
    """Null, empty, very long and repeated texts, clashing columns and empty tables on either side."""
    d = spark.createDataFrame([(1, None, 0.0, 1), (2, "", 0.0, 1), (3, "Good words. " * 100_000, 0.0, 1), (3, "a", 0.0, 1), (None, "a", 0.0, 1)], "doc_id long, text string, score double, strength int")
    n = spark.createDataFrame([(1, 0, None), (3, 1, None), (3, 1, None), (None, 1, None), (8, None, None)], "doc_id long, quality int, text string")
    q = quality.score(d, quality.train(d, n)).collect()
    assert len(q) == 5 and all(0 <= r["score"] <= 1 for r in q)
    assert len({r["score"] for r in q if r["doc_id"] in (1, 2)}) == 1
    assert quality.score(d.limit(0), quality.train(d.limit(0), n)).count() == 0
