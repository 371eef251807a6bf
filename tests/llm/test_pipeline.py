"""run() beside a plain version: each stage's choice made by brute force over the rows that the stages before kept."""

import hashlib

import corpus_pipeline
from leafweave.llm import decontaminate, toxicity
from leafweave.llm.common import fresh_path, table
from tests.llm.test_near import plain_components

SF = "/root/testdata/sf0.001"


def low(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


def plain_run(rows, grammar, bench):
    """(doc_id, text) of the rows that reach packing."""
    rows = [(i, t) for i, t in rows if grammar.score([t])[0][0] < 0.5]
    top = {}
    for i, t in rows:
        top[low(t)] = max(-1 if i is None else i, top.get(low(t), -1))
    rows = [(i, t) for i, t in rows if top[low(t)] == (-1 if i is None else i)]
    # Rows of one id are one document; nodes that only rows without an id have count, but name nothing.
    named = {(i, n): t for n, (i, t) in enumerate(rows)}
    c = plain_components({k: t for k, (_, t) in enumerate(named.items())})
    group = {}
    for k, (i, _) in enumerate(named):
        group.setdefault(c[k], set()).add(i)
    for i in {i for i, _ in named if i is not None}:  # an id in two groups joins them
        hit = [g for g in group.values() if i in g]
        for g in hit[1:]:
            hit[0] |= g
            g.clear()
    least = {i: min(x for x in g if x is not None) for g in group.values() for i in g if i is not None}
    rows = [(i, t) for i, t in rows if i is None or least[i] == i]
    items = [b" ".join(w) for r in bench if len(w := decontaminate.words(r)) >= decontaminate.SHORT]
    holds = {i if i is not None else ("text", t) for i, t in rows if any(x in b" ".join(decontaminate.words(t)) for x in items)}
    return [(i, t) for i, t in rows if (i if i is not None else ("text", t)) not in holds]


def test_same_documents_as_plain(spark):
    docs, labels, bench = (table(spark, SF, n) for n in ("documents", "labels", "benchmark"))
    left = plain_run([(r["doc_id"], r["text"]) for r in docs.collect()], toxicity.train(docs, labels), [r["text"] for r in bench.collect()])
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert set(got.doc_id) == {i for i, _ in left}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "decontaminate", "packing"]


def odd_tables(spark, rows):
    folder = fresh_path(spark, "odd").removeprefix("file://")
    spark.createDataFrame([(*r, "en", "s", 1, "k", 2, "f") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _kept string, _found long, digest string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 0, 1), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "the only benchmark passage of nine words in here", 5), (2, None, 5), (3, "Paris", 5)], "item_id long, text string, doc_id long").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_odd_rows(spark):
    """Nulls, empty and very long texts, repeated rows and ids, clashing columns, and empty tables."""
    words = lambda x, n: " ".join(f"{x}{k}" for k in range(n))
    near = words("n", 100)
    rows = [(1, None), (2, ""), (None, ""), (3, "You are an idiot."), (4, "Same Text here"), (5, "same text here"), (5, "same text here"), (None, "same text here"), (6, near), (7, near + " end"), (None, near + " other"), (8, words("l", 60_000)), (9, words("L", 60_000)), (10, "Paris is nice"), (11, words("a", 30) + " The only benchmark passage of nine words in here"), (None, "see the only benchmark passage of nine words in here now"), (None, "alone without an id"), (12, words("x", 50)), (12, words("y", 50)), (13, words("y", 50) + " z")]
    folder = odd_tables(spark, rows)
    grammar = toxicity.train(table(spark, folder, "documents"), table(spark, folder, "labels"))
    want = plain_run(rows, grammar, ["the only benchmark passage of nine words in here", None, "Paris"])
    docs = table(spark, folder, "documents")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, folder), "stage")
        assert docs.columns == columns
    key = lambda r: (str(r[0]), hashlib.md5((r[1] or "").encode()).hexdigest())
    assert sorted(key((r["doc_id"], r["text"])) for r in docs.collect()) == sorted(map(key, want))
    assert not {3, 4, 7, 8, 11} & {i for i, _ in want} and {5, 6, 9, 10} <= {i for i, _ in want}
    assert corpus_pipeline.run(spark, odd_tables(spark, [])).count() == 0
