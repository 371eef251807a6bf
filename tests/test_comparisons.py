"""Comparisons of edges and selections on small rows."""

from leafweave.operators import evaluation, graph, selection


def test_strongest_edges(spark):
    e = spark.createDataFrame([(1, 1, 2, "a", 0.5), (2, 1, 2, "b", 0.9), (3, 1, 2, "c", 0.9), (4, 2, 2, "d", 1.0), (5, 2, 1, None, None)], "seq long, source long, target long, cue string, confidence double")
    assert sorted(tuple(r) for r in graph.strongest_edges(e).collect()) == [(1, 2, 2, "b", 0.9), (2, 1, 5, None, None)]


def test_scores_and_changes(spark):
    p = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "gold boolean, found boolean")
    assert tuple(evaluation.closed_scores(p).first()) == (1, 1, 1, 1, 0.5, 0.5, 0.5, 0.5)
    assert tuple(evaluation.closed_scores(p.where("false")).first()) == (0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0)
    s = lambda *x: spark.createDataFrame(list(x), "a long, b long")
    got = {r["change"]: (r["pairs"], r["gold"]) for r in evaluation.set_changes(s((1, 2), (1, 3), (1, 3)), s((1, 3), (1, 4)), s((1, 4), (9, 9))).collect()}
    assert got == {"removed": (1, 0), "kept": (1, 0), "added": (1, 1), "missed": (1, 1)}


def test_ranking_tasks(spark):
    p = spark.createDataFrame([(1, 5, 9), (1, 2, 5), (1, 5, 9)], "doc_id long, a long, b long")
    assert {r["node"]: r["candidates"] for r in selection.ranking_tasks(p).collect()} == {5: [2, 9], 9: [5], 2: [5]}
