"""Models that callers bring: a registry of providers, and replies to prompts by batches. Nothing here downloads or trains a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

#: By name, what makes a model: a function without arguments that returns a function from prompts to replies.
PROVIDERS: dict[str, Callable[[], Callable[[list[str]], list[str]]]] = {}


def register(name: str, factory: Callable[[], Callable[[list[str]], list[str]]]) -> None:
    PROVIDERS[name] = factory


def provider(name: str) -> Callable[[], Callable[[list[str]], list[str]]]:
    if name not in PROVIDERS:
        raise KeyError(f"no provider {name!r}; known: {', '.join(sorted(PROVIDERS)) or 'none'}")
    return PROVIDERS[name]


def with_replies(tasks: DataFrame, name: str, batch: int = 8) -> DataFrame:
    """Adds `reply` to tasks with a `prompt`. A task's worker loads the model once and asks it `batch` prompts at a time; if that fails, one by one, and a prompt that fails alone has a null reply."""
    factory, columns = provider(name), tasks.columns
    at = columns.index("prompt")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for b in batches:
            prompts, out = b.column(at).to_pylist(), []
            for k in range(0, len(prompts), batch):
                part = prompts[k : k + batch]
                try:
                    got = list(model(part))
                    if len(got) != len(part):
                        raise ValueError("replies do not match prompts")
                except Exception:  # noqa: BLE001  (whatever a model raises)
                    got = []
                    for p in part:
                        try:
                            got += model([p])[:1] or [None]
                        except Exception:  # noqa: BLE001
                            got.append(None)
                out += got
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*columns, "reply"])

    return tasks.mapInArrow(rows, StructType([*tasks.schema.fields, StructField("reply", StringType())]))
