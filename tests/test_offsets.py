"""Replays found by runs of offsets: gaps, overlaps, cut commits, rows from outside the log."""

import random

import pytest
from pyspark.sql import functions as F

from loam import schemas
from loam.sources import offsets
from loam.streaming import ingest
from tests.test_streams import fresh_lake, message


def batch(spark, numbers, sensor="s-1", topic=None):
    rows = [message(sensor, n, n % 50) for n in numbers]
    return spark.createDataFrame([(topic or r[0], *r[1:]) for r in rows], schemas.MESSAGE)


def stored(spark, target):
    spark.catalog.refreshTable(target.readings)
    return sorted(r[0] for r in spark.table(target.readings).select("_offset").collect())


def held(target):
    return {(r["first"], r["last"]) for r in target.offsets.read().collect()}


def test_runs_of_random_offsets(spark, monkeypatch):
    monkeypatch.setattr(offsets, "BLOCK", 16)
    rng, want = random.Random(2), {}
    data = [(rng.choice("ab"), rng.randrange(2), rng.randrange(90)) for _ in range(150)] * 2
    for topic, part, n in data:
        want.setdefault((topic, part, n // 16), set()).add(n)
    runs = {(*k, n) for k, own in want.items() for n in own if n - 1 not in own}
    ends = {(*k, n) for k, own in want.items() for n in own if n + 1 not in own}
    frame = spark.createDataFrame([*data, (None, 1, 1), ("a", None, 1), ("a", 1, None)], "raw_topic string, _partition int, _offset long")
    got = offsets.spans(frame).collect()
    assert {(r.raw_topic, r._partition, r.block, r["first"]) for r in got} == runs and len(got) == len(runs)
    assert {(r.raw_topic, r._partition, r.block, r["last"]) for r in got} == ends


def test_nested_and_touching_runs_become_one(spark):
    data = [("a", 0, 0, *run) for run in [(0, 50), (3, 4), (51, 60), (62, 70), (5, 40)]] + [("b", 0, 0, 61, 61)]
    got = offsets.merged(spark.createDataFrame(data, offsets.SPANS)).collect()
    assert {(r.raw_topic, r["first"], r["last"]) for r in got} == {("a", 0, 60), ("a", 62, 70), ("b", 61, 61)}


def test_gaps_are_filled_and_overlaps_left_out(spark, monkeypatch):
    monkeypatch.setattr(offsets, "BLOCK", 8)
    monkeypatch.setattr(offsets, "COMPACT_EVERY", 3)
    target, seen = fresh_lake(spark), set()
    write = ingest.write_batch(target, True)
    for number, own in enumerate([range(0, 10), range(20, 30), range(5, 25), range(0, 30), range(40, 45), [12, 46, 46]]):
        write(batch(spark, own), number)
        seen |= set(own)
        assert stored(spark, target) == sorted(seen)
    assert held(target) == {(0, 7), (8, 15), (16, 23), (24, 29), (40, 44), (46, 46)}
    write(batch(spark, range(3), topic="iot.x"), 6)  # dead letters are recorded like readings
    write(batch(spark, range(3), topic="iot.x"), 7)
    assert spark.table(target.dead_letters).count() == 3
    write(batch(spark, range(3), "s-2"), 8)  # equal offsets of another topic
    assert len(stored(spark, target)) == len(seen) + 3


def test_new_records_read_no_stored_row(spark, monkeypatch):
    target = fresh_lake(spark)
    write = ingest.write_batch(target, True)
    write(batch(spark, range(5)), 0)
    monkeypatch.setattr(target.offsets, "_stored", lambda commit: pytest.fail("read the lake"))
    write(batch(spark, range(3, 9)), 1)
    ingest.write_batch(target, True)(batch(spark, range(9, 12)), 2)
    assert stored(spark, target) == list(range(12))


@pytest.mark.parametrize("lost_at", ["append", "append_dead", "finish"])
def test_a_commit_cut_short_is_found_by_any_later_writer(spark, monkeypatch, lost_at):
    """Lost before the readings, between the two tables, or before it was recorded."""
    target = fresh_lake(spark)
    ingest.write_batch(target, True)(batch(spark, range(4)), 0)
    both = batch(spark, range(4, 8)).unionByName(batch(spark, range(4), topic="iot.x"))

    def lost(*_, **__):
        raise RuntimeError("lost")
    with monkeypatch.context() as broken, pytest.raises(RuntimeError):
        broken.setattr(target.offsets if lost_at == "finish" else target, lost_at, lost)
        ingest.write_batch(target, True)(both, 1)
    again = type(target)(spark, target.database, target.root)
    ingest.write_batch(again, True)(both.unionByName(batch(spark, [8, 9])), 7)
    assert stored(spark, again) == list(range(10)) and spark.table(again.dead_letters).count() == 4
    assert {(0, 9)} <= held(again)


def test_rows_from_outside_the_log_are_found(spark):
    """A lake without a log, and writers that do not look for replays, between others that do."""
    target = fresh_lake(spark)
    plain, checked = ingest.write_batch(target), ingest.write_batch(target, True)
    plain(batch(spark, range(5)), 0)
    checked(batch(spark, range(3, 8)), 1)
    plain(batch(spark, range(8, 10)), 2)
    ingest.write_batch(type(target)(spark, target.database, target.root))(batch(spark, [10]), 3)
    checked(batch(spark, range(12)), 4)
    assert stored(spark, target) == list(range(12))


def test_records_without_identity_are_kept(spark):
    target = fresh_lake(spark)
    row = message("s-1", None)
    for number in range(2):
        ingest.write_batch(target, True)(spark.createDataFrame([row], schemas.MESSAGE), number)
    assert spark.table(target.readings).filter(F.col("_offset").isNull()).count() == 2
