"""Scans in stretches give what a plain window gives, also when one key holds most rows."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from loam.operators import billing, monitoring, registry
from loam.plans import ordered, paging, panes
from loam.plans.ordered import GROUP, Ordered, last_known, previous, running_min, running_sum


def skewed(spark, n=3000, seed=5):
    """A third of the rows in one key, a null key, many ties in the order column."""
    rng = random.Random(seed)
    keys = ["hot", "a", "b", "c", None]
    data = [(rng.choices(keys, [40, 20, 20, 15, 5])[0], rng.randrange(40), i,
             rng.choice([None, *range(-9, 10)])) for i in range(n)]
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "k string, t int, id int, v int").repartition(7)


def expected(data):
    state, out = {}, []
    for k, t, i, v in sorted(data, key=lambda r: (r[1], r[2])):
        s = state.setdefault(k, {"sum": 0, "min": None, "last": None, "prev": None, "n": 0})
        before_sum, before_last = s["sum"], s["last"]
        s["sum"] += v or 0
        if v is not None:
            s["min"] = v if s["min"] is None else min(s["min"], v)
            s["last"] = v
        out.append((k, i, s["sum"], before_sum, s["min"], s["last"], before_last, s["prev"]))
        s["prev"] = v
    return sorted(out, key=repr)


@pytest.mark.parametrize("width", [None, 10, 1])
def test_scan_matches_brute_force(spark, rows, width):
    data, frame = skewed(spark)
    scanned = Ordered.of(frame, ["k"], ["t", "id"], F.floor(F.col("t") / width) if width else None)
    v = F.col("v")
    got = scanned.scan(s=running_sum(v), before=running_sum(v, inclusive=False), low=running_min(v),
                       known=last_known(v), known_before=last_known(v, inclusive=False),
                       prev=previous(v)).result()
    assert GROUP not in got.columns
    assert rows(got, "k", "id", "s", "before", "low", "known", "known_before", "prev") == expected(data)


def test_a_hot_key_is_spread_over_tasks(spark):
    data = [("hot", i, i) for i in range(4000)]
    frame = spark.createDataFrame(data, "k string, t int, id int").repartition(4)
    conf = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = Ordered.of(frame, ["k"], ["t", "id"], F.floor(F.col("t") / 100)).scan(n=running_sum(F.lit(1))).result()
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) > 3 and max(sizes) < 2500
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", conf)


def test_building_a_scan_starts_no_job(spark):
    _, frame = skewed(spark)
    spark.sparkContext.setJobGroup("scan", "scan")
    try:
        Ordered.of(frame, ["k"], ["t", "id"]).scan(s=running_sum(F.col("v"))).scan(low=running_min(F.col("s"))).result()
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("scan")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_rows_are_shuffled_once(spark, plan):
    _, frame = skewed(spark)
    conf = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(Ordered.of(frame, ["k"], ["t", "id"]).scan(s=running_sum(F.col("v"))).result())
        # rows, totals by key and stretch, totals by key, and those back by key and stretch
        assert text.count("ENSURE_REQUIREMENTS") <= 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", conf)


def test_scans_can_follow_each_other(spark, rows):
    data, frame = skewed(spark)
    frame = frame.na.fill({"v": 0, "k": "none"})
    got = billing.clamped_counts(frame, ["k"], ["t", "id"], "v")
    count, want = {}, []
    for k, t, i, v in sorted(data, key=lambda r: (r[1], r[2])):
        k = k or "none"
        count[k] = max(0, count.get(k, 0) + (v or 0))
        want.append((k, i, count[k]))
    assert rows(got, "k", "id", "sensor_count") == sorted(want, key=repr)


def test_operators_agree_whatever_the_stretches(tables, rows, monkeypatch):
    def all_results():
        series = ["topic", "kafka_partition"]
        found = [billing.balance_after(tables.ledger), registry.audit_trail(tables.changes),
                 billing.deactivate_over_budget(tables.readings, tables.sensors), registry.device_snapshot(tables.sensors, 4),
                 monitoring.sustained_alerts(tables.samples, series, "consumer_lag", 300, 7200),
                 monitoring.counter_rate(tables.samples, series, "consumer_lag", ["topic"], 7200)]
        found += [billing.overdraft_freeze(tables.epoch_events, tables.balances, tables.subscriptions, mode)
                  for mode in ("reference", "additive")]
        return [rows(f) for f in found]
    short = all_results()
    monkeypatch.setattr(ordered, "SECONDS", 10 ** 11)
    assert all(short) and all_results() == short


def test_paged_lists_are_bounded_and_ordered(spark):
    frame = spark.range(25).select(F.lit("t").alias("k"), F.col("id"))
    pages = paging.paged_lists(frame, ["k"], ["id"], F.col("id"), page_size=10).orderBy("page").collect()
    assert [list(p["items"]) for p in pages] == [list(range(10)), list(range(10, 20)), list(range(20, 25))]


def test_sliding_panes_match_the_window_function(tables, rows):
    readings = tables.readings
    got = panes.sliding_counts(readings, "event_time", ["farm_id"], 300, 15)
    native = readings.groupBy(F.window("event_time", "5 minutes", "15 seconds").alias("w"), "farm_id").count()
    assert rows(got, "window_start", "farm_id", "event_count") == rows(native, "w.start", "farm_id", "count")
    with pytest.raises(ValueError):
        panes.sliding_counts(readings, "event_time", [], 300, 17)


def test_trailing_stats_include_both_ends(spark, rows):
    start = 1_700_000_000
    data = [("a", start, 5.0), ("a", start, 1.0), ("a", start + 100, 9.0), ("a", start + 101, 2.0),
            ("b", start + 50, 4.0)]
    frame = spark.createDataFrame(data, "k string, s long, v double").withColumn("ts", F.timestamp_seconds("s"))
    got = panes.trailing_stats(frame, "ts", ["k"], "v", span_s=100)
    assert rows(got, "k", F.col("second") - start, "min_value", "max_value", "avg_value") == sorted([
        ("a", 0, 1.0, 5.0, 3.0), ("a", 100, 1.0, 9.0, 5.0), ("a", 101, 2.0, 9.0, 5.5), ("b", 50, 4.0, 4.0, 4.0)],
        key=repr)


def test_rates_at_every_step(spark):
    """Overlapping ranges with resets, gaps and samples off the grid, against every pair of samples."""
    rng = random.Random(5)
    data = []
    for series in ("a", "b", "c"):
        at, value = 0, 0
        for _ in range(0 if series == "c" else 120):
            at += rng.choice([1, 7, 15, 60, 400])
            value = rng.randrange(5) if rng.random() < 0.1 else value + rng.randrange(50)
            data.append(("t", series, datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=at), value))
    data += [("t", "c", datetime.datetime(2026, 1, 1), 4), ("t", "a", None, 9), ("t", "b", data[0][2], None)]
    want = {}
    for series in ("a", "b", "c"):
        own = sorted((int((when - datetime.datetime(2026, 1, 1)).total_seconds()), v) for _, s, when, v in data if s == series and when and v is not None)
        for reach in (60, 300):
            for step in range(0, own[-1][0] + reach + 15, 15):
                inside = [i for i, (at, _) in enumerate(own) if step - reach < at <= step]
                if len(inside) > 1:
                    rise = sum(own[i][1] if own[i][1] < own[i - 1][1] else own[i][1] - own[i - 1][1] for i in inside[1:])
                    want[reach, step] = want.get((reach, step), 0) + rise
    frame = spark.createDataFrame(data, "topic string, part string, ts timestamp, counter long")
    got = monitoring.rates_at_steps(frame, ["topic", "part"], "counter", ["topic"], [60, 300], 15).collect()
    assert {(r.range_s, int((r.step - datetime.datetime(2026, 1, 1)).total_seconds())): round(r.rate * r.range_s) for r in got} == want
    with pytest.raises(ValueError):
        monitoring.rates_at_steps(frame, ["part"], "counter", ["topic"], [100], 15)


def test_stretches_of_texts_are_dealt_or_named(spark, rows):
    data, frame = skewed(spark)
    texts = frame.withColumn("t", F.format_string("sensor-in-a-long-row-%05d", "t"))
    got = Ordered.dealt(texts, ["k"], ["t", "id"]).scan(
        s=running_sum(F.col("v")), low=running_min(F.col("v")), prev=previous(F.col("v"))).result()
    want = [(k, i, s, low, prev) for k, i, s, _, low, _, _, prev in expected(data)]
    assert got.columns == [*texts.columns, "s", "low", "prev"] and rows(got, "k", "id", "s", "low", "prev") == want
    with pytest.raises(ValueError):
        Ordered.of(texts, ["k"], ["t", "id"])
