from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import prose
from pyspark.sql import functions as F

from gleaner.llm import classifier


def junk(rng, words):
    made = prose(rng, words).split()
    kind = rng.randrange(3)
    if kind == 0:
        return " ".join(w + rng.choice(["%%%", "###", "$$$"]) for w in made)
    if kind == 1:
        return " ".join(w.upper() + "!!" for w in made)
    return " ".join([w for w in made[:4] for _ in range(max(3, words // 4))])


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(11)
    docs, labels = [], []
    for i in range(600):
        good = int(rng.random() < 0.7)
        docs.append((i, prose(rng, rng.randint(15, 120)) if good else junk(rng, rng.randint(15, 120))))
        labels.append((i, good))
    labels += [(5, None), (None, 1), (3, labels[3][1]), (10_000, 0)]
    return (
        spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4),
        spark.createDataFrame(labels, "doc_id bigint, quality int"),
    )


def test_held_out_documents_are_told_apart(labelled):
    docs, labels = labelled
    model = classifier.fit(classifier.training_rows(docs, labels, usable=~classifier.held_out()))
    scored = classifier.score(docs, model).join(labels, "doc_id").where("quality is not null").where(classifier.held_out())
    rows = scored.select("doc_id", "quality", "score").collect()
    assert len(rows) > 150
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows)
    right = sum((r["score"] >= 0.5) == bool(r["quality"]) for r in rows)
    assert right / len(rows) > 0.97


def test_training_is_repeatable_and_bounded(labelled):
    docs, labels = labelled
    few = classifier.training_rows(docs, labels, sample_rows=100)
    assert 60 < few.count() < 140
    again = classifier.fit(few.repartition(7)), classifier.fit(few.repartition(2))
    assert np.array_equal(*again)


def test_scores_are_sparse_dot_products(labelled):
    texts = ["some words here", "", "UP!! UP!! again again again again again again", None, "x" * 5_000]
    column = pa.array(texts, pa.string())
    model = np.random.default_rng(1).normal(size=classifier.DIMENSIONS + 1)
    df = labelled[0].sparkSession.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("score", F.lit("old"))
    got = {r["doc_id"]: r["score"] for r in classifier.score(df, model).collect()}
    begins, cells, values = classifier.features(column)
    for i in range(len(texts)):
        dense = np.zeros(classifier.DIMENSIONS)
        dense[cells[begins[i] : begins[i + 1]]] = values[begins[i] : begins[i + 1]]
        assert got[i] == pytest.approx(1 / (1 + np.exp(-np.clip(dense @ model[:-1] + model[-1], -35, 35))), rel=1e-6)
    assert got[1] == got[3]


def test_features_do_not_depend_on_neighbours():
    texts = ["one Two, three", "", "four five", "one Two, three", "a b c d a b c d a b c d"]
    begins, cells, values = classifier.features(pa.array(texts))
    for i, text in enumerate(texts):
        b, c, v = classifier.features(pa.array([text]))
        assert c.tolist() == cells[begins[i] : begins[i + 1]].tolist()
        assert v.tolist() == pytest.approx(values[begins[i] : begins[i + 1]].tolist())


def test_edges(odd, none, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id bigint, quality int")
    assert classifier.keep_good(odd, labels).columns == odd.columns
    no_labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert classifier.keep_good(odd, no_labels).count() == odd.count()
    assert classifier.keep_good(none, labels).collect() == []
