import hashlib
from collections import defaultdict

import numpy as np

from leafweave.llm.exact_dedup import build_mph, exact_dedup, find_slots
from leafweave.llm.line_dedup import line_dedup

DOCS = "doc_id long, text string, digest string, bucket long, key string"


def low(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


def rows():
    texts = ["A b", "a B", "É", "é", "", None, "x" * 5000, "X" * 5000, "unique", " a b"] + [f"t{i % 40}" for i in range(200)]
    r = [(i, t, "clash", 1, "k") for i, t in enumerate(texts)]
    return r + [(5, None, "clash", 2, "k"), (None, "t3", "", 0, ""), (None, "alone", "", 0, "")]


def test_exact(spark):
    groups = defaultdict(list)
    for i, t, *_ in rows():
        groups[low(t)].append(i)
    want = []
    for i, t, *_ in rows():
        g = groups[low(t)]
        top = max((x for x in g if x is not None), default=None)
        want.append((i, top, len(g), i == top, hashlib.sha256(low(t).encode()).hexdigest()))
    for per in (3, 50_000):
        got = [tuple(r) for r in exact_dedup(spark.createDataFrame(rows(), DOCS), per_bucket=per).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_exact_empty(spark):
    assert exact_dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_hash_is_minimal_and_perfect():
    w = np.random.default_rng(0).integers(0, 2**63, (5000, 4)).astype(np.uint64)
    levels, slot = build_mph(w)
    assert sorted(slot.tolist()) == list(range(5000))
    assert (find_slots(levels, 5000, w) == slot).all()


def plain_lines(docs, chars, least):
    strip = " \t\n\x0b\x0c\r"
    held = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            k = low(x.strip(strip))
            if i is not None and len(k) >= chars:
                held[k].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or not (len(held[k := low(x.strip(strip))]) >= least and i != max(held[k]))]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_lines(spark):
    long, wide = "This line is shared by MANY documents, again and again", "é" * 41
    docs = [(i, f"own {i}\n  {long.upper() if i % 2 else long}\t\n\nshort\r\n{long}") for i in range(6)]
    docs += [(10 + i, f"{wide}\n{'é' * 39}\ntail") for i in range(5)]
    docs += [(20, None), (21, ""), (22, "\n\n"), (3, long), (None, long), (30, "x" * 60), (31, "x" * 60)]
    df = spark.createDataFrame([(i, t, 1, "") for i, t in docs], "doc_id long, text string, n long, gone string")
    assert sorted((tuple(r) for r in line_dedup(df).collect()), key=str) == sorted(plain_lines(docs, 40, 5), key=str)
    assert line_dedup(df.limit(0)).count() == 0


def test_very_long_texts_and_lines(spark):
    """Megabytes in one text, and in one line, are read to their end."""
    line = "a long shared line " * 60_000
    docs = [(i, f"{line}\n{i}\n{'A' * 50}\n{'É' * 45}") for i in range(6)] + [(9, line.upper() + "\n\n9")]
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in docs], "doc_id long, text string, n_lines long, key string")
    assert sorted(tuple(r) for r in line_dedup(df).collect()) == sorted(plain_lines(docs, 40, 5))
    long = [(1, line + "x"), (2, line.upper() + "X"), (3, line + "y"), (3, line + "y")]
    got = sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(spark.createDataFrame(long, "doc_id long, text string")).collect())
    assert got == [(1, 2, 2, False), (2, 2, 2, True), (3, 3, 2, True), (3, 3, 2, True)]


def test_exactly_five_documents(spark):
    for n in (4, 5):
        df = spark.createDataFrame([(i, "x" * 40 + f"\nown {i}") for i in range(n)], "doc_id long, text string")
        assert sorted(r["n_dropped"] for r in line_dedup(df).collect()) == ([0] * 4 if n == 4 else [0, 1, 1, 1, 1])
