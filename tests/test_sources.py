"""Files, streams and models: round trips, repeated batches, replies that fail."""

import json
import random

import pytest

from leafweave.functions import models
from leafweave.sources import graphs
from leafweave.streaming import ingest


def test_reports_and_tables(spark, tmp_path):
    value = {"valid": True, "errors": [{"type": "é", "n": 1}], "none": None}
    path = f"file://{tmp_path}/report.json"
    graphs.write_report(spark, path, value)
    assert graphs.read_report(spark, path) == value and json.loads((tmp_path / "report.json").read_text()) == value
    rows = [(1, "front\tpage", None), (2, "é", 0.5)]
    graphs.write_table(spark.createDataFrame(rows, "page long, label string, score double"), f"file://{tmp_path}/t")
    back = spark.read.option("header", True).option("sep", "\t").schema("page long, label string, score double").csv(f"file://{tmp_path}/t")
    assert sorted(tuple(r) for r in back.collect()) == rows


def test_balanced_shards(spark):
    r = random.Random(3)
    loads = [(f"t{k:03d}", r.randrange(1, 40)) for k in range(200)]
    got = {x["task_id"]: x["shard"] for x in graphs.balanced_shards(spark.createDataFrame(loads, "task_id string, load int"), 4).collect()}
    total, want = [0] * 4, {}
    for t, n in sorted(loads, key=lambda x: (-x[1], x[0])):
        k = min(range(4), key=lambda i: (total[i], i))
        want[t], total[k] = k, total[k] + n
    assert got == want and max(total) - min(total) <= 40
    with pytest.raises(ValueError, match="more than"):
        graphs.balanced_shards(spark.createDataFrame(loads, "task_id string, load int"), 4, 10)


def test_pages_arrive_twice(spark, tmp_path):
    src, out, ck = tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/ck"
    src.mkdir()

    def put(name, rows):
        (src / name).write_text("".join(json.dumps(dict(zip(("doc_id", "page", "text"), r, strict=True))) + "\n" for r in rows))

    def run():
        ingest.ingest(spark, f"file://{src}", "doc_id string, page string, text string", out, ck).awaitTermination()
        return sorted(tuple(r) for r in spark.read.schema("text string, arrived timestamp, doc_id string, page string").parquet(out).select("doc_id", "page", "text").collect())

    put("a.json", [("d", "p1", "one"), ("d", "p2", "two")])
    assert run() == [("d", "p1", "one"), ("d", "p2", "two")]
    put("b.json", [("d", "p2", "two again"), ("e", "p1", "other")])
    assert run() == [("d", "p1", "one"), ("d", "p2", "two again"), ("e", "p1", "other")]
    assert len(run()) == 3


def _stub():
    def model(prompts):
        if any("break" in p for p in prompts):
            raise RuntimeError("no")
        return [p.upper() for p in prompts]

    return model


def test_models(spark):
    models.register("stub", _stub)
    rows = [(k, "break" if k == 5 else f"p{k}") for k in range(20)]
    got = {r["id"]: r["reply"] for r in models.with_replies(spark.createDataFrame(rows, "id long, prompt string"), "stub", 4).collect()}
    assert got == {k: None if k == 5 else f"P{k}" for k in range(20)}
    with pytest.raises(KeyError, match="stub"):
        models.provider("other")
