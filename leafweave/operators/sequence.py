"""Order within a document: boundaries, runs, interpolation, and the two-state decoder."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def runs(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Numbers the runs of equal values: adds boundary (1 where a run starts) and segment (from 1)."""
    w = Window.partitionBy(key).orderBy(*order)
    b = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    return rows.withColumn("boundary", b).withColumn("segment", F.sum("boundary").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def interpolate_numbers(pages: DataFrame) -> DataFrame:
    """Page numbers from visible anchors (doc_id, idx, number or null): a gap between two anchors is filled where index and number gap agree.

    status: visible_anchor, interpolated, conflict (anchors do not increase), front_matter (before printed page 1), unknown.
    """
    back = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    on = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(1, Window.unboundedFollowing)
    anchor = F.when(F.col("number").isNotNull(), F.struct("idx", "number"))
    p = pages.withColumn("l", F.last(anchor, True).over(back)).withColumn("r", F.first(anchor, True).over(on))
    one = F.min(F.when(F.col("number") == 1, F.col("idx"))).over(Window.partitionBy("doc_id"))
    p = p.withColumn("one", one)
    fits = (F.col("r.number") - F.col("l.number") == F.col("r.idx") - F.col("l.idx")) & (F.col("r.number") > F.col("l.number"))
    clash = F.col("r.number") <= F.col("l.number")
    seen = F.col("number").isNotNull()
    bad = (seen & (F.coalesce(F.col("r.number") <= F.col("number"), F.lit(False)) | F.coalesce(F.col("number") <= F.col("l.number"), F.lit(False)))) | (~seen & F.coalesce(clash, F.lit(False)))
    status = F.when(bad, "conflict").when(seen, "visible_anchor").when(F.coalesce(fits, F.lit(False)), "interpolated").when(F.coalesce(F.col("idx") < F.col("one"), F.lit(False)), "front_matter").otherwise("unknown")
    value = F.when(seen, F.col("number")).when(F.coalesce(fits, F.lit(False)), F.col("l.number") + F.col("idx") - F.col("l.idx"))
    return p.select("doc_id", "idx", value.alias("inferred"), status.alias("status"))


def viterbi(p: np.ndarray, new_page: np.ndarray, penalty: float, bias: float = 0.0, page_factor: float = 0.35) -> np.ndarray:
    """The best run of two states for probabilities p: log odds for state 1, a penalty for each change, less at a page's start."""
    q = np.clip(p, 1e-6, 1 - 1e-6)
    gain = np.column_stack([np.log(1 - q), np.log(q) + bias])
    best, back = gain[0].copy(), np.zeros((len(p), 2), int)
    for i in range(1, len(p)):
        c = penalty * (page_factor if new_page[i] else 1.0)
        stay, move = best, best[::-1] - c
        back[i] = np.where(move > stay, [1, 0], [0, 1])
        best = np.maximum(stay, move) + gain[i]
    out = np.empty(len(p), int)
    out[-1] = int(best[1] > best[0])
    for i in range(len(p) - 1, 0, -1):
        out[i - 1] = back[i][out[i]]
    return out


def smooth(rows: DataFrame, penalty: float = 2.0) -> DataFrame:
    """The decoder per document over rows (doc_id, idx, page, p): adds label. Ordered state within a document, hence a grouped function."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        page = pdf["page"].to_numpy()
        new = np.append(True, page[1:] != page[:-1])
        pdf["label"] = viterbi(pdf["p"].to_numpy(float), new, penalty)
        return pdf[["doc_id", "idx", "page", "p", "label"]]

    return rows.select("doc_id", "idx", "page", "p").groupBy("doc_id").applyInPandas(one, "doc_id long, idx long, page long, p double, label long")
