"""Operators without SQL beside plain versions: claims, cuts, suppression, quotas; and small cases of the others."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafweave.functions import words
from leafweave.operators import adverts, evaluation, evidence, layout, nodes, scoring, segmentation
from leafweave.plans import registry

SF = "/root/testdata/sf0.001"


def test_claims(spark):
    r = random.Random(1)
    rows = [(d, o, r.choice("ab"), c := r.random() < 0.5, not c) for d in range(30) for o in range(12)]
    want = set()
    for d in range(30):
        taken = set()
        for _, o, s, c, _ in [x for x in rows if x[0] == d]:
            for _, p, u, _, b in [x for x in rows if x[0] == d]:
                if c and b and o < p <= o + 2 and s == u and p not in taken:
                    taken.add(p)
                    want.add((d, o, p))
                    break
    got = evidence.table_bodies(spark.createDataFrame(rows, "doc_id long, document_order long, scope string, is_caption boolean, is_body boolean"))
    assert {tuple(x) for x in got.collect()} == want


@pytest.mark.parametrize("most", [3, 9])
def test_cheapest_cuts(most):
    r = np.random.default_rng(most)
    for _ in range(20):
        n = int(r.integers(1, 9))
        v, reward, p = r.normal(size=(n, 3)), r.random(n), r.random(n) * 0.9 + 0.05
        for cost in (segmentation.segment_cost(v, reward, 0.4), segmentation.span_cost(v, p, 0.5, 0.18)):
            total = lambda cuts: sum(cost[i, j] for i, j in itertools.pairwise([0, *cuts, n]))
            every = [c for k in range(n) for c in itertools.combinations(range(1, n), k) if all(j - i <= most for i, j in itertools.pairwise([0, *c, n]))]
            assert total(segmentation.cheapest_cuts(cost, most)) == pytest.approx(min(map(total, every)))


def test_spread_is_the_squared_distance_from_the_mean_direction():
    v = np.random.default_rng(0).normal(size=(6, 4))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = segmentation.spread(v)
    for i in range(6):
        for j in range(i + 1, 7):
            part = u[i:j]
            assert s[i, j] == pytest.approx(((part - part.mean(0)) ** 2).sum())


def test_stable_penalty_and_boundary_model():
    assert segmentation.stable_penalty([1, 2, 3, 4, 5, 6], [9, 5, 5, 5, 2, 2]) == 3
    r = np.random.default_rng(2)
    x = r.normal(size=(200, 3))
    y = (x[:, 0] > 1).astype(float)
    mean, scale, w, t = segmentation.fit_boundaries(x, y)
    p = 1 / (1 + np.exp(-(w[0] + ((x - mean) / scale) @ w[1:])))
    assert ((p >= t) == (y == 1)).mean() > 0.97
    rows = np.where(y == 1, (y == 0).sum() / y.sum(), 1.0)
    a = np.column_stack([np.ones(200), (x - mean) / scale])
    assert np.abs(a.T @ (rows * (p - y)) + 1.5 * np.array([0, *w[1:]])).max() < 1e-4


def test_bridges_and_detections(spark):
    rows = [(3, 0.5, 1, 1, 2), (3, 0.5, 1, 1, 3), (4, 0.1, 2, 1, 4), (2, 0.9, 1, 2, 3), (1, 0.0, 1, 5, 6)]
    assert evidence.keep_bridges(rows, 2) == [2, 0, 3, 4]
    r = random.Random(4)
    boxes = [(p, k, r.choice([0.5, 0.7, 0.9]), x := r.randrange(50), y := r.randrange(50), x + 30, y + 30) for p in range(20) for k in range(8)]
    want = set()
    for p in range(20):
        kept = []
        for b in sorted((b for b in boxes if b[0] == p), key=lambda b: (-b[2], b[1])):
            over = lambda a, c: max(0, min(a[5], c[5]) - max(a[3], c[3])) * max(0, min(a[6], c[6]) - max(a[4], c[4]))
            if all(over(b, c) < 0.3 * (1800 - over(b, c)) for c in kept):
                kept.append(b)
        want |= {(p, b[1]) for b in kept}
    got = layout.kept_detections(spark.createDataFrame(boxes, "page long, det_id long, score double, x1 int, y1 int, x2 int, y2 int"), 0.3)
    assert {tuple(x) for x in got.collect()} == want


def test_candidates_keep_their_quotas(spark):
    got = registry.QUERIES["semantic_candidates"](spark, SF).collect()
    used = defaultdict(int)
    for r in got:
        why = set(r["reasons"].split(","))
        assert why & {"structural_neighbor", "embedding_top_k", "same_section", "shared_entities"} and r["a"] < r["b"]
        if r["scope"] == "CROSS_CONTENT_UNIT":
            assert "cross_content_unit_bridge" in why and r["a"] // 3 != r["b"] // 3
            used[r["doc_id"], r["a"]] += 1
            used[r["doc_id"], r["b"]] += 1
        else:
            assert "same_content_unit" in why
    assert got and max(used.values(), default=0) <= 2


def test_capped_candidates(spark):
    n = spark.createDataFrame([(1, k, k // 4) for k in range(8)], "doc_id long, node_id long, unit long")
    rows = [(1, a, b, ["x"] * (1 + (a * b) % 3), (a + b) / 20) for a in range(8) for b in range(a + 1, 8)]
    got = {(r["a"], r["b"]) for r in evidence.capped_candidates(n, spark.createDataFrame(rows, "doc_id long, a long, b long, reasons array<string>, similarity double"), 2).collect()}
    want = set()
    for k in range(8):
        own = [r for r in rows if k in r[1:3]]
        own.sort(key=lambda r: (-(len(r[3]) + r[4] + 2 * (r[1] // 4 == r[2] // 4)), r[2] - r[1], r[1], r[2]))
        want |= {r[1:3] for r in own[:2]}
    assert got == want


def test_sections_of_every_level(spark):
    marks = ["# T", "## a", "### b", "#### c", "###### d", "### e", "## f", "##### g", "x"]
    b = spark.createDataFrame([(1, k, m) for k, m in enumerate(marks)], "doc_id long, block_no long, markdown string").withColumn("role", nodes.role(F.col("markdown")))
    got = [(r["parent_no"], [x["title"] for x in r["path"]]) for r in nodes.with_sections(b).orderBy("block_no").collect()]
    assert got[1:] == [(None, ["a"]), (1, ["a", "b"]), (2, ["a", "b", "c"]), (3, ["a", "b", "c", "d"]), (1, ["a", "e"]), (None, ["f"]), (6, ["f", "g"]), (None, ["f", "g"])]


def test_roles_from_layout(spark):
    rows = [("x y z", "Header", None, None, None, "header"), ("# T", None, "footer", None, None, "footer"), ("n", "footnote", None, None, None, "footnote"), ("words of it", None, None, "heading", None, "section_heading"), ("A. B. Writer et al. (", None, None, None, None, "author_metadata"), ("some good words", None, None, None, "garbage", "ocr_noise"), (r"\(a\)", None, None, None, None, "ocr_noise"), ("Plain words.", "text", None, "text", None, "evidence_content")]
    df = spark.createDataFrame(rows, "m string, l string, r string, k string, f string, want string")
    for r in df.select("want", nodes.role(F.col("m"), F.col("l"), F.col("r"), F.col("k"), F.col("f")).alias("got"), "m").collect():
        assert r["got"] == r["want"], r["m"]
    assert [r[0] for r in spark.createDataFrame([("", "t"), (None, "t"), (None, None)], "m string, t string").select(nodes.block_text(F.col("m"), F.col("t"))).collect()] == ["", "t", ""]


def test_two_sided(spark):
    from math import comb

    rows = [(a, b) for a in (0, 1, 3, 10, 40, 900) for b in (0, 2, 10, 37, 1000)]
    got = spark.createDataFrame(rows, "a long, b long").select("a", "b", scoring.two_sided(F.col("a"), F.col("b")).alias("p")).collect()
    for r in got:
        n, k = r["a"] + r["b"], min(r["a"], r["b"])
        want = 1.0 if n == 0 else min(1.0, float(2 * sum(comb(n, i) for i in range(k + 1)) / 2**n))
        assert r["p"] == pytest.approx(want, rel=1e-8, abs=1e-300)


def test_thresholds_and_json(spark):
    empty = spark.createDataFrame([], "score double, gold int")
    assert evaluation.precise_threshold(empty).first()["threshold"] in (None, 0.99)
    assert words.json_in('x {"a": [1, {"b": "]"}]} y') == '{"a": [1, {"b": "]"}]}'
    assert words.json_in("```json\n[1]\n```") == "[1]" and words.json_in("{") is None and words.json_in(None) is None
    d = spark.createDataFrame([(1, 1, "c", "NEW"), (1, 2, "c", "CONTINUE"), (1, 4, "c", "NEW"), (2, 1, "d", "CONTINUE")], "doc_id long, page_no long, content_id string, relation string")
    assert {(r["content_id"], r["pages"], r["gaps"], r["begins_continued"], r["begins_again"]) for r in adverts.chain_audit(d).collect()} == {("c", 3, 1, 0, 1), ("d", 1, 0, 1, 0)}
