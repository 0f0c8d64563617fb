"""Interval joins against comparing every value with every interval."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loam.plans import intervals as plans
from loam.plans.intervals import interval_join, interval_totals


def joined(spark, values, intervals):
    v = spark.createDataFrame(values, "id int, v double").repartition(3)
    i = spark.createDataFrame(intervals, "name int, lo double, hi double").repartition(3)
    return interval_join(v, "v", i, "lo", "hi")


def held(values, intervals):
    return sorted((i, name) for i, v in values for name, lo, hi in intervals
                  if None not in (v, lo, hi) and lo <= v < hi < float("inf") and abs(v) < float("inf"))


def test_pairs_match_brute_force(spark, rows):
    """Widths over 60 powers of two, borders hit exactly, a third of the values alike, odd values."""
    rng = random.Random(11)
    ends = [rng.choice([rng.uniform(-50, 50), float(rng.randrange(-8, 8)), rng.uniform(-1, 1) * 2.0 ** rng.randrange(-30, 30)]) for _ in range(300)]
    intervals = [(n, lo, lo + rng.choice([2.0 ** rng.randrange(-30, 30), rng.uniform(0, 3), 0.0, -1.0])) for n, lo in enumerate(ends)]
    intervals += [(1000, None, 1.0), (1001, 0.0, None), (1002, 0.0, float("nan")), (1003, -1e15, 1e15), (1004, 0.0, 5e-324), (1005, 1e300, 1.1e300)]
    values = [(n, rng.choice([1.5, rng.choice(ends), rng.uniform(-60, 60)])) for n in range(600)]
    values += [(1000 + n, v) for n, v in enumerate([None, float("nan"), float("inf"), float("-inf"), 1e300, -1e300, 0.0, -0.0, 5e-324, 1e308])]
    assert rows(joined(spark, values, intervals), "id", "name") == sorted(held(values, intervals), key=repr)


def test_nothing_is_compared_pair_by_pair(spark, plan):
    text = plan(joined(spark, [(1, 1.0)], [(1, 0.0, 2.0)]))
    assert "NestedLoop" not in text and "Cartesian" not in text and "HashJoin" in text or "SortMergeJoin" in text


def test_odd_tables(spark):
    assert joined(spark, [], [(1, 0.0, 1.0)]).count() == 0
    assert joined(spark, [(1, 0.5)], []).count() == 0
    assert joined(spark, [(1, 0.5)] * 3, [(1, 0.0, 1.0)] * 2).count() == 6
    with pytest.raises(PySparkException):
        joined(spark, [(1, 0.5)], [(1, 0.0, float("inf"))]).collect()
    with pytest.raises(ValueError):
        interval_join(spark.range(1), "id", spark.range(1), "id", "id")


def totals(values, intervals):
    return interval_totals(values, "v", "kind", intervals, "lo", "hi", "level", "name")


@pytest.mark.parametrize("at_once", [32, 2])
def test_totals_are_those_of_the_joined_pairs(spark, rows, monkeypatch, at_once):
    """Null and repeated names, kinds and levels; ends on values; signed zeros; rows that come twice."""
    monkeypatch.setattr(plans, "AT_ONCE", at_once)
    rng = random.Random(5)
    spot = lambda: rng.choice([rng.uniform(-9, 9), float(rng.randrange(-4, 5)), 0.0, -0.0])
    data = [(rng.choice("abc") if rng.random() < 0.9 else None, spot()) for _ in range(400)]
    data += data[:40] + [("a", None), ("b", float("nan")), ("c", float("inf")), ("only", 100.0)]
    ends = [spot() for _ in range(300)]
    held_by = [(rng.choice([None, *range(40)]), rng.choice(["low", "mid", "high", "top", None]), lo,
                lo + rng.choice([0.0, -1.0, 0.5, 1.0, rng.uniform(0, 6)])) for lo in ends]
    held_by += held_by[:20] + [(1, "low", None, 1.0), (2, "low", 0.0, float("nan")), (None, "no name", 99.0, 101.0)]
    values = spark.createDataFrame(data, "kind string, v double").repartition(3)
    intervals = spark.createDataFrame(held_by, "name int, level string, lo double, hi double").repartition(3)
    pairs = interval_join(values, "v", intervals, "lo", "hi").groupBy("level", "kind").agg(
        F.count("*").alias("n"), F.count_distinct("name").alias("names"), F.round(F.sum("v"), 6).alias("total"))
    got = totals(values, intervals).withColumn("total", F.round("total", 6))
    assert got.columns == pairs.columns
    assert rows(got) == rows(pairs)


def test_totals_do_not_list_pairs(spark, rows):
    """Every value in every interval: 4 * 10^10 pairs."""
    values = spark.range(200_000).selectExpr("'x' AS kind", "double(id % 1000) AS v")
    intervals = spark.range(200_000).selectExpr("id AS name", "'y' AS level", "double(-id) AS lo", "1000e0 AS hi")
    assert rows(totals(values, intervals)) == [("y", "x", 40_000_000_000, 200_000, 200_000 * 200 * 499_500.0)]


def test_totals_of_odd_tables(spark):
    none = spark.createDataFrame([], "kind string, v double"), spark.createDataFrame([], "name int, level string, lo double, hi double")
    some = spark.createDataFrame([("a", 0.5)], none[0].schema), spark.createDataFrame([(1, "b", 0.0, 1.0)], none[1].schema)
    assert totals(none[0], some[1]).count() == totals(some[0], none[1]).count() == totals(*none).count() == 0
    with pytest.raises(PySparkException):
        totals(some[0], spark.createDataFrame([(1, "b", 0.0, float("inf"))], none[1].schema)).collect()
