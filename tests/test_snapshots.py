"""Tables kept up by micro-batches: newest rows, compaction, lost writers."""

import random

import pytest
from pyspark.sql import functions as F

from loam.session import scratch
from loam.streaming.snapshots import Snapshots, upserts

SCHEMA = "k string, n long, note string"


def table(spark, **more):
    schema = spark.createDataFrame([], SCHEMA).schema
    return Snapshots(spark, scratch(spark, "snapshots"), schema, ["k"], **{"buckets": 4, **more})


def batch(spark, own):
    return spark.createDataFrame([(k, n, None if n % 3 else f"note {n}") for k, n in own.items()], SCHEMA)


def content(t):
    return {r.k: r.n for r in t.read().collect()}


def test_newest_row_of_each_key_through_compactions(spark):
    rng, t, want = random.Random(3), table(spark), {}
    write = upserts(t, compact_every=3)
    assert content(t) == {}
    for number in range(8):
        own = {rng.choice([None, *"abcdefghij"]): number * 100 + i for i in range(rng.randrange(6))}
        write(batch(spark, own), number)
        want |= own
        assert content(t) == want
    assert t.manifest()[0] == 5 and t._batches()[-1] == 7


def test_a_read_takes_one_snapshot_and_the_deltas_since(spark):
    t = table(spark)
    for number in range(4):
        t.write(batch(spark, {"a": number, "b": number + 1}), number)
    t.compact()
    t.write(batch(spark, {"c": 9}), 4)
    files = [f.split("/rows/")[-1] for f in t.read().inputFiles()]
    assert not [f for f in files if any(f"_batch={b}/" in f for b in range(4))]
    assert [f for f in files if "_batch=4/" in f] and [f for f in files if "version=3/" in f]


def test_compaction_rewrites_only_the_touched_buckets(spark):
    t = table(spark, buckets=16)
    t.write(batch(spark, {str(i): i for i in range(200)}), 0)
    assert t.compact() == 16
    t.write(batch(spark, {"7": 1000}), 1)
    assert t.compact() == 1 and t.compact() == 0
    assert sorted(t.manifest()[1].values()).count(0) == 15
    assert content(t) == {str(i): i for i in range(200)} | {"7": 1000}


@pytest.mark.parametrize("lost_in", ["files", "manifest"])
def test_a_writer_lost_during_compaction_loses_nothing(spark, monkeypatch, lost_in):
    t, want = table(spark), {"a": 2, "b": 1, "c": 2}
    t.write(batch(spark, {"a": 1, "b": 1}), 0)
    t.compact()
    t.write(batch(spark, {"a": 2, "c": 2}), 1)

    def lost(*_):
        raise RuntimeError("lost")
    with monkeypatch.context() as broken, pytest.raises(RuntimeError):
        if lost_in == "files":  # some of the new files are there, but not all
            spark.createDataFrame([("z", 5, "")], SCHEMA).write.parquet(f"{t.path}/snapshots/version=1/_bucket=0")
            broken.setattr(t, "_rows", lost)
        else:
            broken.setattr(t, "_publish", lost)
        t.compact()
    assert t.manifest()[0] == 0 and content(t) == want
    t.write(batch(spark, {"a": 2, "c": 2}), 1)  # the stream repeats its batch
    t.compact()
    assert t.manifest()[0] == 1 and content(t) == want


def test_an_unfinished_delta_is_not_read_and_a_repeated_one_replaces(spark):
    t = table(spark)
    t.write(batch(spark, {"a": 1}), 0)
    spark.createDataFrame([("b", 1, "", 0)], SCHEMA + ", _bucket int").write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{t.path}/deltas/_batch=1")
    assert content(t) == {"a": 1}
    for own in ({"b": 2, "c": 2}, {"b": 3}):
        t.write(batch(spark, own), 1)
    assert content(t) == {"a": 1, "b": 3}


def test_vacuum_keeps_what_the_two_newest_manifests_name(spark):
    t = table(spark, buckets=2)
    for number in range(5):
        t.write(batch(spark, {f"k{number}": number, "all": number}), number)
        t.compact()
        older = t.read() if number == 3 else None
        t.vacuum()
        if number == 3:
            kept = older
    assert kept.count() == 5  # planned before the last compaction
    assert t._batches() == [4] and content(t) == {f"k{i}": i for i in range(5)} | {"all": 4}
    assert t._complete("manifests") == [3, 4]


def test_other_merges(spark):
    """Sums instead of newest rows."""
    add = lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n"), F.max("note").alias("note"))
    t = table(spark, merge=add)
    for number in range(3):
        t.write(batch(spark, {"a": 1, "b": number}), number)
        if number == 1:
            t.compact()
    assert content(t) == {"a": 3, "b": 3}
