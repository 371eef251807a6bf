"""Documents cut into spans at once: the cheapest cuts by dynamic programming, over vectors and boundary evidence, a document a task; and the boundary model."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-8)


def spread(v: np.ndarray) -> np.ndarray:
    """For every two places i < j, how far the unit vectors between them are from their mean: length - |sum|^2 / length."""
    sums = np.vstack([np.zeros((1, v.shape[1])), np.cumsum(_unit(v.astype(float)), axis=0)])
    dots = sums @ sums.T
    own = np.diag(dots)
    squared = np.maximum(0.0, own[:, None] + own[None, :] - 2 * dots)
    length = np.arange(len(sums))[None, :] - np.arange(len(sums))[:, None]
    return np.where(length > 0, np.maximum(0.0, length - squared / np.maximum(length, 1)), 0.0)


def cheapest_cuts(cost: np.ndarray, most: int) -> list[int]:
    """First places of spans but the first, so that the costs cost[i, j] of spans from i up to before j, at most `most` long, add up to the least; of equals the earliest begin."""
    n = len(cost) - 1
    best, back = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0] = 0.0
    for end in range(1, n + 1):
        begin = np.arange(max(0, end - most), end)
        total = best[begin] + cost[begin, end]
        k = int(np.argmin(total))
        best[end], back[end] = total[k], begin[k]
    cuts, end = [], n
    while end > 0:
        end = int(back[end])
        if end > 0:
            cuts.append(end)
    return cuts[::-1]


def segment_cost(v: np.ndarray, reward: np.ndarray, penalty: float) -> np.ndarray:
    """Costs of spans: spread, a little for length, a penalty each, less the reward of the boundary they begin at."""
    n = len(v)
    length = np.maximum(0, np.arange(n + 1)[None, :] - np.arange(n + 1)[:, None])
    begins = np.append(reward, 0.0)[:, None]
    begins[0] = 0.0
    return spread(v) + 0.035 * length * np.log1p(length) + penalty - begins


def span_cost(v: np.ndarray, p: np.ndarray, threshold: float, weight: float) -> np.ndarray:
    """Costs of spans: the log odds by which a boundary falls short of the threshold, and a weight times the mean spread. p: the probability of a boundary before each place (the first is ignored)."""
    n = len(v)
    length = np.maximum(1, np.arange(n + 1)[None, :] - np.arange(n + 1)[:, None])
    odds = lambda x: np.log(np.maximum(x, 1e-8) / np.maximum(1 - x, 1e-8))
    begins = np.append(odds(np.array([threshold])) - odds(p), 0.0)[:, None]
    begins[0] = 0.0
    return weight * spread(v) / length + begins


def boundary_rewards(score: np.ndarray, page_change: np.ndarray, anaphoric: np.ndarray, metadata: np.ndarray, title: np.ndarray) -> np.ndarray:
    """What a boundary is worth before its titles' share is given: context above .30, a new page, less for openings that point back and for running metadata."""
    return 1.15 * np.maximum(0.0, score - 0.30) + 0.08 * page_change - 0.32 * anaphoric - 0.8 * metadata + title


def _by_document(rows: DataFrame, cuts) -> DataFrame:
    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by("idx")
        v = np.array(t.column("v").to_pylist(), float)
        inside = np.zeros(len(v), np.int64)
        inside[cuts(t, v)] = 1
        return pa.table({"doc_id": t.column("doc_id"), "idx": t.column("idx"), "segment": pa.array(1 + np.cumsum(inside), pa.int64())})

    return rows.groupBy("doc_id").applyInArrow(one, "doc_id long, idx long, segment long")


def optimal_segments(rows: DataFrame, penalty: float, most: int = 200) -> DataFrame:
    """doc_id, idx, segment. rows: doc_id, idx, v (a vector), reward (of a boundary before the node)."""
    return _by_document(rows.select("doc_id", "idx", "v", "reward"), lambda t, v: cheapest_cuts(segment_cost(v, t.column("reward").to_numpy().astype(float), penalty), most))


def decoded_spans(rows: DataFrame, threshold: float, most: int = 140, weight: float = 0.18) -> DataFrame:
    """doc_id, idx, segment. rows: doc_id, idx, v, p (the probability of a boundary before the node)."""
    return _by_document(rows.select("doc_id", "idx", "v", "p"), lambda t, v: cheapest_cuts(span_cost(v, t.column("p").to_numpy().astype(float), threshold, weight), most))


def stable_penalty(penalties: list[float], counts: list[int]) -> float:
    """The middle of the longest stretch of penalties that give one number of segments; of equals the first."""
    best, begin = (0, 0), 0
    for k in range(1, len(counts) + 1):
        if k == len(counts) or counts[k] != counts[begin]:
            if k - begin > best[1] - best[0]:
                best = (begin, k)
            begin = k
    return penalties[(best[0] + best[1] - 1) // 2]


def fit_boundaries(x: np.ndarray, y: np.ndarray, ridge: float = 1.5) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """mean, scale, weights (the first an intercept) of a logistic model by Newton steps, boundaries weighing as much as the rest, and the threshold of the best F1, the highest of equals."""
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale < 1e-8, 1.0, scale)
    a = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    rows = np.where(y == 1, max(1.0, (y == 0).sum() / max(1.0, (y == 1).sum())), 1.0)
    pull = ridge * np.eye(a.shape[1])
    pull[0, 0] = 0.0
    w = np.zeros(a.shape[1])
    chance = lambda: 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
    for _ in range(60):
        p = chance()
        h = (a * (rows * p * (1 - p) + 1e-6)[:, None]).T @ a + pull
        step = np.linalg.solve(h, a.T @ (rows * (p - y)) + pull @ w)
        w = w - step
        if np.linalg.norm(step) < 1e-7:
            break
    p = chance()

    def f1(t: float) -> float:
        said = p >= t
        tp = (said & (y == 1)).sum()
        return 2 * tp / max(1, said.sum() + (y == 1).sum())

    return mean, scale, w, max({*np.round(p, 6).tolist(), 0.5}, key=lambda t: (f1(t), t))
