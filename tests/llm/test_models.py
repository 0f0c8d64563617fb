"""Language identification and the quality machine: held-out accuracy and odd rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from loam.llm import language_id, quality_model
from tests.conftest import SMALL

ODD = [(10 ** 6, None, None, None), (10 ** 6 + 1, "", "en", "a"), (10 ** 6 + 2, "123 !!!  ", "de", None), (10 ** 6 + 2, "123 !!!", "de", None),
       (10 ** 6 + 3, "漢字仮名交じり文" * 400, None, None), (10 ** 6 + 4, "the " * 200000, None, None), (None, "the and of", "en", "b")]


def test_languages_of_held_out_documents(spark, make_docs):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = language_id.language_id(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in got if r.held_out and r.lang]
    assert len(got) == docs.count() and held
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_texts_have_a_defined_language(spark, make_docs):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    frame = make_docs([tuple(r) for r in docs] + ODD)
    got = language_id.language_id(frame).where("doc_id >= 1000000 or doc_id is null").collect()
    assert len(got) == len(ODD)
    for r in got:
        if r.doc_id in (10 ** 6, 10 ** 6 + 1, 10 ** 6 + 2):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred in ("en", "de", "fr", "es")
        if r.doc_id == 10 ** 6 + 3:
            assert r.rejected
    assert language_id.language_id(make_docs([])).collect() == []
    assert [r.lang_pred for r in language_id.language_id(make_docs([(1, "abc", None, None)])).collect()] == ["und"]


def test_predictions_use_the_text_alone(spark, make_docs):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    model = language_id.fit(make_docs(rows), F.lit(True))
    bare = make_docs([(7, t, None, None) for _, t, _, _ in rows])
    a = sorted((r.lang_pred, r.score) for r in language_id.identify(make_docs(rows), model).collect())
    assert a == sorted((r.lang_pred, r.score) for r in language_id.identify(bare, model).collect())


def test_several_centroids_a_language():
    draw = np.random.default_rng(1)
    heads = np.eye(6)
    v = np.concatenate([h + draw.normal(0, 0.01, (20, 6)) for h in heads[:3]])
    found = language_id.clustered(v / np.linalg.norm(v, axis=1, keepdims=True), 3)
    assert sorted(np.abs(found).argmax(axis=1).tolist()) == [0, 1, 2]


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    got = quality_model.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_odd_texts_have_a_score(spark, make_docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(3, 0, 1), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    rows = [(i, ("good words here " if i % 2 else "$ | $ ") * 9, None, None) for i in range(40)] + ODD
    got = quality_model.quality_scores(make_docs(rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert quality_model.quality_scores(make_docs([]), labels).collect() == []
    assert [r.score for r in quality_model.quality_scores(make_docs([(1, "a", None, None)]), labels.limit(0)).collect()] != []


def test_linear_time_identity():
    rng, draw = random.Random(5), np.random.default_rng(5)
    m = quality_model.Machine(draw.normal(size=30), draw.normal(size=(30, 4)))
    at, x = np.array(rng.sample(range(30), 8)), draw.normal(size=8) * 0.2
    pairs = sum((m.v[at[i]] @ m.v[at[j]]) * x[i] * x[j] for i in range(8) for j in range(i))
    assert np.isclose(m.score(at, x), 1 / (1 + np.exp(-(m.w[at] @ x + pairs))))


def test_few_hashes_hold_the_least_ones(spark):
    ids = spark.range(40000).select("id", F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 300 == 0, "rare").otherwise("b").alias("lang"))
    got = [(r.lang, r.h) for r in language_id.few_hashes(ids, "lang", 150).select("lang", F.xxhash64("id").alias("h")).collect()]
    everything = [(r.lang, r.h) for r in ids.select("lang", F.xxhash64("id").alias("h")).collect()]
    for lang in ("hot", "b", "rare"):
        own, full = (sorted(h for name, h in rows if name == lang) for rows in (got, everything))
        assert own[:150] == full[:150] and len(own) <= 600
    assert language_id.few_hashes(ids, "lang", 99).count() == 40000


def test_rows_that_repeat_a_picked_id_count_once(spark, make_docs):
    """One id holds most of the rows: the samples, so the models, are those of one row an id."""
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    docs = list({d[0]: d for d in docs}.values())
    once, often = make_docs(docs), make_docs(docs + [docs[0]] * 2000 + [docs[1]] * 300)
    a, b = (language_id.fit(frame, F.lit(True)) for frame in (once, often))
    assert a.languages == b.languages and np.array_equal(a.matrix, b.matrix) and np.array_equal(a.floor, b.floor)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    a, b = (quality_model.score(once, quality_model.fit(frame, labels, F.lit(True)), F.col("doc_id")).collect() for frame in (once, often))
    assert sorted(a, key=repr) == sorted(b, key=repr)
