"""Scores where the sample of labels is smaller than the rows it stands for."""

import numpy as np

from leafweave.llm import quality, toxicity


def test_scores_keep_the_share_of_labels(spark):
    # One text throughout, so a score can only be the share of a label: 1 row in 10 is good and 9 in 10 are toxic.
    y = [i % 10 == 0 for i in range(1500)]
    d = spark.createDataFrame([(i, "the same words") for i in range(1500)], "doc_id long, text string")
    n = spark.createDataFrame([(i, int(y[i]), int(not y[i])) for i in range(1500)], "doc_id long, quality int, toxic int")
    for sample in (60, 4000):
        assert abs(quality.score(d, quality.train(d, n, sample)).first()["score"] - 0.1) < 0.03
        assert toxicity.score(d, toxicity.train(d, n, sample)).first()["score"] > 0.8


def test_weights_are_those_of_all_rows():
    x, y = np.zeros((4000, len(toxicity.PATTERNS))), np.repeat([1.0, 0.0], [450, 3550])
    half = np.concatenate([np.flatnonzero(y == 1)[:400], np.flatnonzero(y == 0)[:400]])
    w = np.where(y[half] == 1, 450 / 400, 3550 / 400)
    a, b = toxicity.fit_weights(x, y)[-1], toxicity.fit_weights(x[half], y[half], weights=w / w.mean())[-1]
    assert abs(a - b) < 0.1
