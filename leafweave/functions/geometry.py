"""Boxes as Columns: a box is a struct (x1, y1, x2, y2) of doubles. Every function is null-safe only where it says so."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1, y1, x2, y2) -> Column:
    return F.struct(*(F.expr(v).cast("double").alias(k) if isinstance(v, str) else v.cast("double").alias(k) for k, v in zip(("x1", "y1", "x2", "y2"), (x1, y1, x2, y2), strict=True)))


def rounded(c: Column | str, places: int) -> Column:
    """A double to some places as the SQL rounds it: the scaled value, half away from zero. F.round looks at the shortest decimal digits instead and parts from it at halves."""
    return F.round((F.col(c) if isinstance(c, str) else c) * 10.0**places) / 10.0**places


def _zero(c: Column) -> Column:
    return F.greatest(F.lit(0.0), c)


def area(b: Column) -> Column:
    return _zero(b["x2"] - b["x1"]) * _zero(b["y2"] - b["y1"])


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return _zero(w) * _zero(h)


def iou(a: Column, b: Column) -> Column:
    """0 where there is no union."""
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def overlap_fraction(inner: Column, outer: Column) -> Column:
    """Share of the inner box that the outer one covers."""
    a = area(inner)
    return F.when(a > 0, intersection(inner, outer) / a).otherwise(0.0)


def center_inside(inner: Column, outer: Column) -> Column:
    cx, cy = (inner["x1"] + inner["x2"]) / 2, (inner["y1"] + inner["y2"]) / 2
    return (cx >= outer["x1"]) & (cx <= outer["x2"]) & (cy >= outer["y1"]) & (cy <= outer["y2"])


def x_overlap_fraction(a: Column, b: Column) -> Column:
    """Shared width over the smaller width."""
    w = F.least(a["x2"] - a["x1"], b["x2"] - b["x1"])
    return F.when(w > 0, _zero(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])) / w).otherwise(0.0)


def y_overlap_fraction(a: Column, b: Column) -> Column:
    h = F.least(a["y2"] - a["y1"], b["y2"] - b["y1"])
    return F.when(h > 0, _zero(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])) / h).otherwise(0.0)


def clamp(b: Column, width: Column, height: Column) -> Column:
    """The box clipped to its page, rounded to two places; null if nothing is left."""
    c = box(F.greatest(F.lit(0.0), F.least(b["x1"], width)), F.greatest(F.lit(0.0), F.least(b["y1"], height)), F.greatest(F.lit(0.0), F.least(b["x2"], width)), F.greatest(F.lit(0.0), F.least(b["y2"], height)))
    return F.when((c["x2"] > c["x1"]) & (c["y2"] > c["y1"]), F.struct(*(rounded(c[k], 2).alias(k) for k in ("x1", "y1", "x2", "y2"))))


def union_all(b: Column) -> Column:
    """Aggregate: the smallest box around a group's boxes."""
    return F.struct(F.min(b["x1"]).alias("x1"), F.min(b["y1"]).alias("y1"), F.max(b["x2"]).alias("x2"), F.max(b["y2"]).alias("y2"))


def valid_for_matching(b: Column, width: Column, height: Column, most: float = 0.7) -> Column:
    """Not degenerate, on the page, and of at most a share of its area."""
    return (b["x2"] > b["x1"]) & (b["y2"] > b["y1"]) & (b["x2"] > 0) & (b["y2"] > 0) & (b["x1"] < width) & (b["y1"] < height) & (area(b) <= most * width * height)
