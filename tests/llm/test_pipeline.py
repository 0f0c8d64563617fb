"""Every stage of the pipeline against a plain version on its own input."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from loam.llm import language_id, quality_model
from loam.llm.mixing import mix
from loam.llm.queries import all_queries, all_sql
from tests.conftest import SMALL
from tests.llm.test_joins import groups, shingle_set
from tests.llm.test_packing import check


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(10 ** 6, None, "en", "src0", 0), (10 ** 6 + 1, "", "en", None, None), (10 ** 6 + 2, "1 2 3", None, "src1", 5)], docs.schema)
    found = [docs.union(odd).union(docs.limit(2))]
    for _, stage in P.STAGES:
        found.append(stage(spark, found[-1], SMALL).cache())
    return found


def test_order_and_columns(stages):
    assert [n for n, _ in P.STAGES] == ["language", "quality", "near copies", "mixture", "packing"]
    assert all(f.columns == stages[0].columns and f.schema == stages[0].schema for f in stages[1:5])


def test_language_stage(stages):
    model = language_id.fit(stages[0], F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    judged = language_id.identify(stages[0], model, F.col("doc_id")).collect()
    want = collections.Counter(r.k0 for r in judged if not r.rejected)
    assert collections.Counter(r.doc_id for r in stages[1].collect()) == want
    assert not {10 ** 6, 10 ** 6 + 1, 10 ** 6 + 2} & want.keys()
    assert sum(want.values()) >= 0.98 * (stages[0].count() - 3)


def test_quality_stage(spark, stages):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = quality_model.fit(stages[1], labels, F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    judged = quality_model.score(stages[1], model, F.col("doc_id")).collect()
    assert collections.Counter(r.doc_id for r in stages[2].collect()) == collections.Counter(r.k0 for r in judged if r.predicted)
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    before, after = ({r.doc_id for r in f.collect()} & good for f in stages[1:3])
    assert len(after) >= 0.95 * len(before)


def test_near_copy_stage(stages):
    sets = {r.doc_id: shingle_set(r.text, 5) for r in stages[2].collect()}
    linked = [(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) > 0]
    least = groups(list(sets), linked)
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted({least[i] for i in sets})


def test_near_copies_of_repeated_ids(spark, make_docs):
    """Texts of one id are judged apart, and do not tie groups together."""
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [(5, one, "en", "s"), (5, two, "en", "s"), (6, one + " x", "en", "s"), (7, two + " y", "en", "s"), (8, three, "en", "s"), (8, three, "en", "s"),
            (None, three + " z", "en", "s"), (None, "words of no other", "en", "s"), (4, None, "en", "s"), (4, None, "en", "s"), (3, "", "en", "s")]
    got = P.near_copies(spark, make_docs(rows), SMALL)
    assert got.columns == make_docs([]).columns
    want = [(5, one), (5, two), (8, three), (None, "words of no other"), (4, None), (4, None), (3, "")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert P.near_copies(spark, make_docs([]), SMALL).count() == 0


@pytest.mark.parametrize("stage", [P.language, P.near_copies])
def test_a_stage_alone_has_workers_that_import_the_package(spark, make_docs, monkeypatch, stage):
    """All stages share workers: none starts with an environment of its own."""
    known = dict(spark.sparkContext.environment)
    monkeypatch.setattr(spark.sparkContext, "environment", {k: v for k, v in known.items() if k != "PYTHONPATH"})
    assert stage(spark, make_docs([(1, "some words of a text", "en", "s")]), SMALL).columns == make_docs([]).columns
    assert "PYTHONPATH" in spark.sparkContext.environment


def test_no_documents(spark, stages):
    found = stages[0].limit(0)
    for _, stage in P.STAGES:
        found = stage(spark, found, SMALL)
        assert found.count() == 0


def test_mixture_stage(stages):
    want = {r.doc_id: r.copies for r in mix(stages[3]).collect() if r.copies}
    assert collections.Counter(r.doc_id for r in stages[4].collect()) == want


def test_packing_stage(stages):
    rows = [(r.doc_id, r.text) for r in stages[4].collect()]
    check(rows, stages[5].collect())


def test_run_equals_its_stages(spark, stages):
    got = P.run(spark, SMALL)
    assert got.columns == stages[5].columns and got.count() > 0


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in all_queries()) == list(range(1, 14))
    assert all_sql().keys() <= all_queries().keys()
