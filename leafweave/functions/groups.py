"""Python functions over many small groups at a time: a call for each group costs more than its work."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, least: int) -> Iterator[pa.Table]:
    """Batches sorted by key as tables of about `least` rows or more that cut no run of equal keys (nulls are one key)."""
    held: list[pa.RecordBatch] = []
    rows, wanted = 0, least
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows < wanted:
            continue
        t = pa.Table.from_batches(held)
        k = t.column(key)
        last = k[-1].as_py()
        cut = int(np.argmax((pc.is_null(k) if last is None else pc.fill_null(pc.equal(k, last), False)).to_numpy()))
        if cut:
            yield t.slice(0, cut)
            held, rows = t.slice(cut).to_batches(), rows - cut
        wanted = max(least, 2 * rows)  # a group larger than that is looked at rarely
    if rows:
        yield pa.Table.from_batches(held)


def codes(t: pa.Table, key: str) -> np.ndarray:
    """Numbers of a table's groups, in order of appearance."""
    return t.column(key).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()


def by_whole_groups(rows: DataFrame, key: str, f: Callable[[pa.Table], pa.Table], schema: str, least: int = 50_000) -> DataFrame:
    """What f makes of tables that hold whole groups of `key`, sorted by it; a group must fit a worker, as it must for a grouped function."""

    def run(batches):
        for t in whole_groups(batches, key, least):
            yield from f(t).to_batches()

    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)
