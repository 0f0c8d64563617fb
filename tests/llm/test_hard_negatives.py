"""Hard negatives against scoring every row for every anchor."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.llm import hard_negatives as module
from loam.llm.hard_negatives import best, hard_negatives, scores

SCHEMA = "vec_id long, embedding array<double>, label int, id long, anchor long, v string, dim int, score int"


def plain(rows, asks, positives=5, negatives=10, low=30, high=90):
    rows = list({(i, tuple(math.floor(256 * x) for x in v), label) for i, v, label in rows
                 if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)})
    out = []
    for i, v, label in rows:
        if not asks(i):
            continue
        met = sorted(((-sum(a * b for a, b in zip(v, w)), j, k) for j, w, k in rows if j != i and len(v) == len(w)))
        for s, j, _ in [m for m in met if m[2] == label][:positives]:
            window = [m for m in met if m[2] != label and low * -s <= 100 * -m[0] <= high * -s][:negatives]
            out += [(i, j, r, k, -s, -t) for r, (t, k, _) in enumerate(window, 1)]
    return sorted(out)


def got(spark, rows, asks, **more):
    frame = spark.createDataFrame([(i, v, label, 1, 2, "x", 3, 4) for i, v, label in rows], SCHEMA)
    found = hard_negatives(frame, asks, **more)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


def corpus(seed, n, dim=6):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        rows.append((i, [round(x + rng.gauss(0, 0.4), 2) for x in c], rng.randrange(3)))
    for i in range(n, n + 40):  # ties: copies under other ids and labels
        rows.append((i, rows[0][1], i % 3))
    return rows


ODD = [(900, None, 1), (901, [], 1), (902, [1.0, None], 1), (903, [math.nan] * 6, 1), (904, [math.inf] * 6, 1), (905, [1.0] * 6, None), (None, [1.0] * 6, 1),
       (910, [1.0, 2.0], 1), (911, [1.0, 2.0], 2), (912, [1.0, 1.0], 1), (913, [0.5, 1.0], 0), (920, [0.0] * 6, 2), (921, [0.0] * 6, 0), (930, [-1e3] * 6, 1)]


@pytest.mark.parametrize("sizes", [(8192, 1024), (16, 7)])
def test_equals_all_scores(spark, monkeypatch, sizes):
    monkeypatch.setattr(module, "ROWS", sizes[0])
    monkeypatch.setattr(module, "ANCHORS", sizes[1])
    rows = corpus(1, 150)
    rows += ODD + rows[:20] + [(10, rows[11][1], 2)]  # repeated rows, and an id with another vector
    want = plain(rows, lambda i: i % 10 == 0)
    assert len(want) > 300
    assert got(spark, rows, F.col("vec_id") % 10 == 0) == want


def test_other_windows(spark):
    rows = corpus(2, 80, 3)
    for k in ({"positives": 2, "negatives": 3, "low": 0, "high": 100}, {"positives": 9, "negatives": 50, "low": 55, "high": 55}):
        assert got(spark, rows, F.col("vec_id") % 7 == 0, **k) == plain(rows, lambda i: i % 7 == 0, **k)


def test_large_components(spark):
    rows = [(i, [10.0 ** (5 + i % 3), float(i), 1e6], i % 2) for i in range(30)]
    assert got(spark, rows, F.col("vec_id") % 5 == 0) == plain(rows, lambda i: i % 5 == 0)
    a = np.array([[2.0 ** 40, 1.0]])
    assert scores(a, np.array([[2.0 ** 20, 3.0]])).tolist() == [[2 ** 60 + 3]]
    with pytest.raises(ArithmeticError):
        scores(a, a)


def test_no_anchors_and_no_rows(spark):
    assert got(spark, corpus(3, 5), F.lit(False)) == []
    assert got(spark, [], F.lit(True)) == []
    assert got(spark, ODD[:7], F.lit(None).cast("boolean")) == []


def test_best_keeps_places_in_order():
    rng = np.random.default_rng(1)
    for _ in range(200):
        x = rng.integers(0, 6, rng.integers(0, 90))
        assert best(x, 5).tolist() == sorted(range(len(x)), key=lambda i: (-x[i], i))[:5]
