"""Quality by Bradley-Terry pairwise ranking.

Preference pairs set a document labelled good against one labelled bad; the strength of a document is linear in its
features, and the weights minimise the logistic loss of the feature differences of pairs, with a ridge. Features are
measurements of the whole text, each cut at sample quantiles into steps, so strengths are additive step functions. A
document's score is its chance to be labelled good, a logistic function of its strength fitted to the same sample, so a
threshold on the score is one on the strength. Documents at or above the quantile of the strengths that leaves `KEEP` of them are kept.

Labels come only from rows that are not held out, and from a bounded sample: the `sample` rows of each label with the
smallest hash; pairs are `pairs` draws of them with a fixed seed. The logistic function is fitted with each label at its
share among all rows that are not held out.

Defined cases: null and empty texts are measured as empty; very long texts are measured whole, a slice of rows at a time;
documents tied at the quantile are all kept; without labelled rows of both kinds every strength is zero and every
score the share of good labels (0.5 without any); rows repeated in documents are each scored; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafweave.llm.common import held_out, materialise, slices, table
from leafweave.llm.toxicity import label_weights, sample_labels

SAMPLE, PAIRS, STEPS = 4000, 40_000, 12
#: The share of documents that the quantile keeps.
KEEP = 0.8
MARKS = b"|!*$&%#<>{}=@"


def measure(text: str | None) -> list[float]:
    """Measurements of a whole text, none of which grows with its length but the first two."""
    raw = (text or "").encode()
    words = raw.split()
    n, size = len(words), max(1, len(raw))
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, np.int64)
    upper, lower, digit = count[65:91].sum(), count[97:123].sum(), count[48:58].sum()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    m = max(1, n)
    distinct = set(words)
    out = [
        np.log1p(n),
        np.log1p(len(lines)),
        upper / max(1, upper + lower),
        digit / size,
        count[128:].sum() / size,
        (count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum()) / size,
        (count[46] + count[44]) / m,
        len(distinct) / m,
        len(set(zip(words, words[1:], strict=False))) / max(1, n - 1),
        sum(map(bytes.__eq__, words, words[1:])) / m if n else 0.0,
        len(set(lines)) / max(1, len(lines)),
        n / max(1, len(lines)),
        sum(map(len, words)) / m,
        max(map(len, words), default=0),
        sum(1 for x in lines if x.rstrip()[-1:] in (b".", b"!", b"?")) / max(1, len(lines)),
        sum(map(bytes.isupper, words)) / m,
        sum(map(bytes.istitle, words)) / m,
        sum(map(bytes.isalpha, words)) / m,
        (m / max(1, len(distinct))) / np.sqrt(m),
    ]
    return [float(x) for x in out] + [float(count[c] / m) for c in MARKS]


def _measured(batches):
    for b in slices(batches, column=0):
        x = [measure(t) for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], names=["x", "y"])


class Model:
    """edges: step borders of each measurement; weights: strengths of the steps; slope and bias: the way to a score."""

    def __init__(self, edges: list[np.ndarray], weights: np.ndarray, slope: float, bias: float):
        self.edges, self.weights, self.slope, self.bias = edges, weights, slope, bias

    def steps(self, x: np.ndarray) -> np.ndarray:
        """Each row's steps as columns of the weights: one a measurement."""
        at, cols = 0, []
        for k, e in enumerate(self.edges):
            cols.append(at + np.searchsorted(e, x[:, k], "right"))
            at += len(e) + 1
        return np.column_stack(cols)

    def strength(self, x: np.ndarray) -> np.ndarray:
        return self.weights[self.steps(x)].sum(1)

    def score(self, strength: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * strength + self.bias, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = 2.0, weights: np.ndarray | None = None) -> Model:
    """Bradley-Terry weights from pairs (good over bad), then the logistic map of strengths to labels, each row at its weight."""
    width = x.shape[1] if x.ndim == 2 else 0
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 0.001), 0.999)
        return Model([np.zeros(0)] * width, np.zeros(width), 1.0, float(np.log(share / (1 - share))))
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, STEPS + 1)[1:-1])) for k in range(width)]
    # Rare marks are zero in most rows: a border just above zero, and quantiles of the rest.
    for k in range(width):
        v = x[:, k]
        if (v == 0).mean() > 0.5 and (v > 0).any():
            edges[k] = np.unique(np.concatenate([[np.nextafter(0, 1)], np.quantile(v[v > 0], [0.25, 0.5, 0.75])]))
    model = Model(edges, np.zeros(sum(len(e) + 1 for e in edges)), 1.0, 0.0)
    steps, d = model.steps(x), len(model.weights)
    one = np.zeros((len(x), d), np.float32)
    np.put_along_axis(one, steps, 1, 1)
    draw = np.random.default_rng(7)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    diff = (one[draw.choice(good, pairs)] - one[draw.choice(bad, pairs)]).astype(np.float64)
    w, scale = np.zeros(d), pairs / len(x)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -40, 40)))
        g = diff.T @ (p - 1) / scale + ridge * w
        h = (diff * (p * (1 - p))[:, None]).T @ diff / scale + ridge * np.eye(d)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    model.weights = w
    s = np.column_stack([model.strength(x), np.ones(len(x))])
    v = np.array([1.0, 0.0])
    # The sample takes labels in other shares than the rows do; the caller's weights undo that.
    rows = np.ones(len(x)) if weights is None else weights
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(s @ v, -40, 40)))
        h = (s * (rows * p * (1 - p))[:, None]).T @ s + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, s.T @ (rows * (p - y)) + 1e-3 * (v - [1.0, 0.0]))
        v -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    model.slope, model.bias = max(float(v[0]), 1e-3), float(v[1])
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    got = sample_labels(docs, labels, "quality", sample).mapInArrow(_measured, "x array<double>, y boolean").collect()
    x = np.array([r["x"] for r in got]) if got else np.zeros((0, len(measure(""))))
    y = np.array([r["y"] for r in got], float)
    return fit(x, y, weights=label_weights(docs, labels, "quality", y))


def _score(model: Model):
    def rows(batches):
        for b in slices(batches):
            x = np.array([measure(t) for t in b.column(1).to_pylist()]).reshape(b.num_rows, -1)
            s = model.strength(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(s), pa.float64()), pa.array(s, pa.float64())], names=["doc_id", "score", "strength"])

    return rows


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, strength of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(model), "doc_id long, score double, strength double")


def keep_best(scored: DataFrame, share: float) -> Column:
    """Whether a row's strength is at or above the quantile that leaves `share` of the rows, to within a thousandth of them. Ties with the quantile all stay."""
    cut = scored.approxQuantile("strength", [1 - share], 0.001)
    return F.col("strength") >= (cut[0] if cut else 0.0)


def op1_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    s = materialise(score(docs, train(docs, table(spark, sf_dir, "labels"))), "scores")
    return s.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "strength", keep_best(s, KEEP).alias("kept"))
