"""Every registered query beside its SQL at the smallest size, and operators on small rows."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import Row

from leafweave.operators import evaluation, graph, nodes, sequence
from leafweave.plans import registry
from tools.compare import TABLES, digest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_as_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    cur = con.execute(registry.ORACLE[name])
    cols = [d[0] for d in cur.description]
    want, rows = cur.fetchall(), df.collect()
    assert sorted(df.columns) == sorted(cols)
    assert len(rows) == len(want)
    assert digest(rows, df.columns) == digest(want, cols)


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() > 0


@pytest.mark.parametrize(
    ("text", "role"),
    [
        ("# Paper title", "document_title"),
        ("## I. INTRODUCTION", "section_heading"),
        ("DOI: 10.1/example", "identifier_metadata"),
        ("(Received 1 January 2020; published 2 February 2020)", "publication_metadata"),
        ("(A Scientific Collaboration)", "author_metadata"),
        ("5°", "ocr_noise"),
        ("Exact *Markdown* with $x$.", "evidence_content"),
    ],
)
def test_roles(spark, text, role):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(text,)], "m string").select(nodes.role(F.col("m"))).first()[0] == role


def test_remap_keeps_one_and_says_why(spark):
    e = spark.createDataFrame([(1, "caption", "visual", "CAPTION_OF"), (2, "body", "doc", "IN_DOCUMENT"), (3, "caption", "doc", "IN_DOCUMENT"), (4, "a", "missing", "NEXT"), (5, "visual", "caption", "NEXT")], "seq long, source string, target string, edge_type string")
    a = spark.createDataFrame([("visual", "caption"), ("body", "caption")], "source_node_id string, canonical_node_id string")
    n = spark.createDataFrame([("caption",), ("doc",), ("a",)], "node_id string")
    got = {r["seq"]: r["outcome"] for r in graph.remap(e, a, n, ["CAPTION_OF"]).collect()}
    assert got == {1: "dropped_by_type", 2: "output", 3: "dropped_duplicate_after_remap", 4: "dropped_dangling_after_remap", 5: "dropped_self_loop_after_remap"}


def test_numerals(spark):
    from pyspark.sql import functions as F

    from leafweave.functions.text import number_of

    rows = [("IV", 4), ("xii", 12), ("7", 7), ("0", 0), ("MCMXC", 1990), ("abc", None), ("", None)]
    got = spark.createDataFrame([(a,) for a, _ in rows], "s string").select(number_of(F.col("s"))).collect()
    assert [r[0] for r in got] == [b for _, b in rows]


def test_viterbi_is_the_best_of_all_runs():
    r = np.random.default_rng(3)
    for _ in range(30):
        p, new = r.random(8), r.random(8) < 0.4
        new[0] = True

        def worth(y):
            s = sum(np.log(p[i] if y[i] else 1 - p[i]) for i in range(8))
            return s - sum(2.0 * (0.35 if new[i] else 1) for i in range(1, 8) if y[i] != y[i - 1])

        best = max(worth([(k >> i) & 1 for i in range(8)]) for k in range(256))
        assert abs(worth(list(sequence.viterbi(p, new, 2.0))) - best) < 1e-9


def test_empty_rows(spark):
    e = spark.createDataFrame([], "doc_id long, text string")
    b = nodes.blocks(e)
    assert b.count() == 0
    assert evaluation.class_metrics(spark.createDataFrame([], "gold string, pred string")).count() == 0
    assert spark.createDataFrame([Row(doc_id=1, text=None)], "doc_id long, text string").transform(nodes.blocks).count() == 0
