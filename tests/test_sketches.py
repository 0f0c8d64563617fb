"""Stored sketches against exact answers, whatever is merged in which order; newest days of a sensor."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from loam.operators import readings
from loam.operators.sketches import DailySketches

START = datetime.datetime(2026, 3, 1)


def sample(n=20000, seed=7):
    """A third of the rows on one day; two types; nulls, NaN and a row without a time."""
    rng = random.Random(seed)
    data = [("a" if rng.random() < 0.7 else "b", START + datetime.timedelta(days=rng.choice([3, *range(20)]) if rng.random() < 0.7 else 3, seconds=rng.randrange(86400)),
             rng.randrange(3000), rng.expovariate(0.1)) for _ in range(n)]
    return [*data, ("a", None, 1, 2.0), ("a", START, None, None), ("b", START, 5, float("nan"))]


def near(rows, told, users):
    values = sorted(v for *_, v in rows if v is not None and v == v)
    for rank, value in zip((0.1, 0.5, 0.99), told):
        below, up_to = sum(v < value for v in values), sum(v <= value for v in values)
        assert below <= (rank + 0.03) * len(values) + 1 and up_to >= (rank - 0.03) * len(values) - 1
    exact = len({u for *_, u, _ in rows if u is not None})
    assert abs(users - exact) <= 1 + 0.065 * exact


@pytest.fixture
def table(spark, tmp_path):
    kept = DailySketches(spark, str(tmp_path / "sketches"), ["kind"], ["user"], ["value"])
    kept.refresh(spark.createDataFrame(sample(), "kind string, at timestamp, user int, value double").repartition(8), "at")
    return kept


def test_any_range_of_days_is_merged(table):
    data = sample()
    for first, last in ((None, None), ("2026-03-03", "2026-03-09"), ("2026-03-04", "2026-03-04")):
        held = [r for r in data if first is None or (r[1] and first <= str(r[1].date()) <= last)]
        got = {r.kind: r for r in table.estimates(["kind"], [0.1, 0.5, 0.99], first, last).collect()}
        for kind in ("a", "b"):
            rows = [r for r in held if r[0] == kind]
            assert got[kind].n == len(rows)
            near(rows, got[kind].value_at, got[kind].user_distinct)
    assert "day" in table.estimates(["kind", "day"], [0.5]).columns


def test_merging_in_any_order_keeps_the_bound(spark, table):
    """Days merged pair by pair in a shuffled order, down to one sketch."""
    days = table.days().where("kind = 'a'").collect()
    random.Random(1).shuffle(days)
    merged = spark.createDataFrame([(i, r.n, r.distinct_user, r.quantiles_value) for i, r in enumerate(days)], "i int, n long, d binary, q binary")
    while merged.count() > 1:
        merged = spark.createDataFrame(merged.groupBy((F.col("i") / 2).cast("int").alias("i")).agg(
            F.sum("n").alias("n"), F.hll_union_agg("d").alias("d"), F.kll_merge_agg_double("q").alias("q")).collect(), merged.schema)
    got = merged.select("n", F.hll_sketch_estimate("d"), F.array(*[F.kll_sketch_get_quantile_double("q", F.lit(r)) for r in (0.1, 0.5, 0.99)])).first()
    rows = [r for r in sample() if r[0] == "a"]
    assert got[0] == len(rows)
    near(rows, got[2], got[1])


def test_a_refresh_replaces_only_its_days(spark, table):
    before = {(r.day, r.kind): r.n for r in table.days().collect()}
    day = datetime.date(2026, 3, 5)
    for _ in range(2):
        table.refresh(spark.createDataFrame([("a", START.replace(day=5), 1, 1.0)], "kind string, at timestamp, user int, value double"), "at")
    after = {(r.day, r.kind): r.n for r in table.days().collect()}
    assert after == {**{k: n for k, n in before.items() if k[0] != day}, (day, "a"): 1} and (None, "a") in after


def test_columns_without_values(spark, tmp_path):
    kept = DailySketches(spark, str(tmp_path / "s"), ["kind"], ["user"], ["value"])
    kept.refresh(spark.createDataFrame([("a", START, None, None)], "kind string, at timestamp, user int, value double"), "at")
    got = kept.estimates(["kind"], [0.5]).first()
    assert (got.n, got.user_distinct, got.value_at) == (1, 0, None)


def test_only_the_newest_days_are_read(spark, plan):
    """A sensor with rows on most of 60 days, one that fell silent, one without times."""
    data = [(i, "7", "busy", START + datetime.timedelta(days=i % 60, seconds=i)) for i in range(1200)]
    data += [(5000 + i, "7", "silent", START + datetime.timedelta(days=2, seconds=i)) for i in range(9)]
    data += [(6000 + i, "7", "blank", None) for i in range(4)] + [(7000, "8", "busy", START + datetime.timedelta(days=59))]
    frame = spark.createDataFrame(data, "event_id long, tenant_id string, sensor_id string, event_time timestamp")
    spark.sql("DROP TABLE IF EXISTS days_of_sensors")
    frame.withColumn("event_date", F.coalesce(F.to_date("event_time"), F.lit("2026-04-20").cast("date"))).write \
        .partitionBy("event_date").saveAsTable("days_of_sensors")
    try:
        for sensor, n in (("busy", 30), ("busy", 500), ("silent", 5), ("silent", 100), ("blank", 3), ("none", 3)):
            want = sorted((r for r in data if r[1:3] == ("7", sensor)), key=lambda r: (r[3] or datetime.datetime.min, r[0]), reverse=True)[:n]
            got = readings.newest_of_sensor(spark, "days_of_sensors", sensor, "7", n)
            assert [r.event_id for r in got.collect()] == [r[0] for r in want], (sensor, n)
        assert "event_date" in plan(readings.newest_of_sensor(spark, "days_of_sensors", "busy", "7", 30)).split("PartitionFilters: [")[1].split("]")[0]
    finally:
        spark.sql("DROP TABLE days_of_sensors")
