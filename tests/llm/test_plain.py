"""Quality and toxicity beside plain versions: learner, fit, clauses and whole scores."""

import math
import zlib

import numpy as np

from leafweave.llm import quality, toxicity
from leafweave.llm.common import table

SF = "/root/testdata/sf0.001"


def labelled(spark, label):
    text = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    rows = {r["doc_id"]: r[label] for r in table(spark, SF, "labels").collect() if r[label] is not None}
    return text, [(text[i], y == 1) for i, y in sorted(rows.items()) if i in text and zlib.crc32(str(i).encode()) % 5]


def plain_contexts(rows):
    held = {}
    for t, y in rows:
        before = "^"
        for w in toxicity.TOKEN.findall((t or "").lower()):
            if len(w) == 1 and w in ".!?;:\n":
                continue
            for form, stem in [(w, False)] + [(w[:n], True) for n in (4, 5, 6) if len(w) > n]:
                held.setdefault((form, stem), {}).setdefault(before, set()).add(y)
            before = w
    return {k: (sum(1 for v in c.values() if v == {True}), sum(1 for v in c.values() if False in v)) for k, c in held.items()}


def plain_learner(rows):
    c = plain_contexts(rows)
    whole = [v for (_, stem), v in c.items() if not stem]
    p, n = sum(v[0] for v in whole), sum(v[1] for v in whole)
    share, need = p / (p + n), 2 * math.log(len(whole) + 1) + 2
    found = {}
    for k, (a, b) in c.items():
        m = a + b
        if a and a >= 0.9 * m:
            g = 2 * (a * math.log(a / (m * share)) + (b * math.log(b / (m * (1 - share))) if b else 0))
            if g > need:
                found[k] = a
    exact = {f for (f, stem), a in found.items() if stem and any(o != (f, stem) and o[0].startswith(f) and x >= 0.9 * a for o, x in found.items())}
    left = sorted((not stem, len(f), f) for f, stem in found if not (stem and f in exact))
    kept = []
    for word, _, f in left:
        if not any(s and f.startswith(o) for o, s in kept):
            kept.append((f, not word))
    return kept


def plain_class(w, words, stems):
    return words.get(w) or next((stems[w[:n]] for n in range(1, len(w) + 1) if w[:n] in stems), None)


def plain_clauses(text, words, stems):
    """Patterns by looking back and forth over each clause."""
    out, clause = [0] * 8, []
    for w in [*toxicity.TOKEN.findall((text or "").lower()), "."]:
        if not (len(w) == 1 and w in ".!?;:\n"):
            clause.append(plain_class(w, words, stems))
            continue
        for base, kind in ((0, "I"), (4, "T")):
            grades = []
            for at, k in enumerate(clause):
                if k == kind:
                    negated, told = "N" in clause[max(0, at - 3) : at], "R" in clause[:at]
                    grades.append((0, 2) if negated else (1, 3) if told else (2, 1 if "Y" in clause else 0))
            if grades:
                out[base + max(grades)[1]] += 1
        clause = []
    return out


def test_toxicity(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    text, rows = labelled(spark, "toxic")
    learnt = toxicity.learn_insults(toxicity.sample_labels(docs, labels, "toxic", 4000))
    assert learnt == plain_learner(rows)
    words, stems = toxicity.lexicon(learnt)
    grammar = toxicity.train(docs, labels)
    assert (grammar.words, grammar.stems) == (words, stems)
    hard = ["Not you, idiot! You idiot", "he said: idiot", "he said idiot; never a b c idiot", "no idiot kill you", "they told him to kill an idiot", "IDIOT\nidiot\nidiot you", None, "", "é" * 30_000 + " you idiot"]
    for t in [*text.values(), *hard]:
        assert grammar.clauses(t).tolist() == plain_clauses(t, words, stems)
    # The fit: its gradient vanishes, written out row by row.
    w = np.array([*grammar._weights(), grammar.bias])
    x = [[*(math.log1p(n) for n in plain_clauses(t, words, stems)), 1.0] for t, _ in rows]
    for k in range(9):
        g = w[k] - [*toxicity.PRIOR, toxicity.PRIOR_BIAS][k]
        for v, (_, y) in zip(x, rows, strict=True):
            g += (1 / (1 + math.exp(-sum(a * b for a, b in zip(v, w, strict=True)))) - y) * v[k]
        assert abs(g) < 1e-4
    got = {r["doc_id"]: r for r in toxicity.op3_toxicity(spark, SF).collect()}
    for i, t in text.items():
        z = sum(a * math.log1p(n) for a, n in zip(w, plain_clauses(t, words, stems), strict=False)) + w[-1]
        assert abs(got[i]["score"] - 1 / (1 + math.exp(-z))) < 1e-9
        assert got[i]["predicted"] == (got[i]["score"] >= 0.5) and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_quality(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    text, rows = labelled(spark, "quality")
    m = quality.train(docs, labels)

    def steps(t):
        at, out = 0, []
        for v, e in zip(quality.measure(t), m.edges, strict=True):
            out.append(at + sum(1 for b in e if b <= v))
            at += len(e) + 1
        return out

    # The Bradley-Terry loss of the drawn pairs is at its least: its gradient vanishes, pair by pair.
    x, y = np.array([quality.measure(t) for t, _ in rows]), np.array([float(v) for _, v in rows])
    again = quality.fit(x, y)
    draw = np.random.default_rng(7)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    pairs = list(zip(draw.choice(good, quality.PAIRS).tolist(), draw.choice(bad, quality.PAIRS).tolist(), strict=True))
    of = [steps(t) for t, _ in rows]
    strength = [sum(again.weights[k] for k in s) for s in of]
    g = 2.0 * again.weights
    for a, b in pairs:
        d = (1 / (1 + math.exp(-(strength[a] - strength[b]))) - 1) * len(rows) / len(pairs)
        for k in of[a]:
            g[k] += d
        for k in of[b]:
            g[k] -= d
    assert np.abs(g).max() < 1e-3
    got = {r["doc_id"]: r for r in quality.op1_quality(spark, SF).collect()}
    for i, t in text.items():
        s = sum(m.weights[k] for k in steps(t))
        assert abs(got[i]["strength"] - s) < 1e-9
        assert abs(got[i]["score"] - 1 / (1 + math.exp(-(m.slope * s + m.bias)))) < 1e-9
        assert got[i]["predicted"] == (got[i]["score"] >= 0.3)
    kept = sum(r["kept"] for r in got.values()) / len(got)
    assert abs(kept - quality.KEEP) <= 0.01
    least = min(r["strength"] for r in got.values() if r["kept"])
    assert all(r["kept"] == (r["strength"] >= least) for r in got.values())
