from __future__ import annotations

import corpus_pipeline
import pytest
from llm_helpers import plain_kept
from pyspark.sql import functions as F

from gleaner.llm import classifier, decontaminate, lines, mixing, queries


@pytest.fixture(scope="module")
def stages(spark, tiny, tmp_path_factory):
    """What each stage gets and gives on the smallest tables."""
    folder = tmp_path_factory.mktemp("stages")
    docs, seen = spark.read.parquet(f"{tiny}/documents.parquet"), []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, tiny).write.parquet(f"{folder}/{number}")
        out = spark.read.parquet(f"{folder}/{number}")
        seen.append((docs, out))
        docs = out
    return seen


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_columns(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes
    assert stages[-1][1].columns == [*stages[-1][0].columns, "size", "source_size", "target", "taken"]


def test_every_stage_decides_as_its_operator(spark, tiny, stages):
    before, after = stages[0]
    labels = spark.read.parquet(f"{tiny}/labels.parquet")
    model = classifier.fit(classifier.training_rows(before, labels, usable=~classifier.held_out()))
    assert rows(after) == rows(classifier.score(before, model).where("score >= 0.5").drop("score"))
    before, after = stages[1]
    texts = {r["doc_id"]: r["text"] for r in lines.drop_boilerplate(before).collect()}
    assert {r["doc_id"]: r["text"] for r in after.collect()} == texts
    assert after.where(F.col("n_chars") != F.length("text")).count() == 0
    before, after = stages[2]
    # One document of each group of texts whose five-word shingles agree to 0.8, all compared with all.
    assert {r["doc_id"] for r in after.collect()} == plain_kept([(r["doc_id"], r["text"]) for r in before.collect()])
    assert after.count() == after.select("doc_id").distinct().count()
    before, after = stages[3]
    found = decontaminate.scan(before, spark.read.parquet(f"{tiny}/benchmark.parquet")).where("size(contamination.spans) = 0")
    assert rows(after) == rows(found.select(*before.columns))
    before, after = stages[4]
    assert rows(after) == rows(mixing.mix(before).where("taken > 0"))


def test_run_gives_what_the_stages_give(spark, tiny, stages):
    assert rows(corpus_pipeline.run(spark, tiny)) == rows(stages[-1][1])


def test_stages_bear_odd_rows(spark, tiny, odd, none):
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, tiny)
        assert set(odd.columns) <= set(out.columns) and out.count() <= odd.count()
        assert stage(spark, none, tiny).collect() == []


def test_the_registry_names_every_operator():
    names = sorted(int(n.partition("_")[0][2:]) for n in queries.REGISTRY)
    assert names == list(range(1, 14)) and set(queries.ORACLES) <= set(queries.REGISTRY)
