from __future__ import annotations

import os
import random
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
import pytest
from llm_helpers import plain_kept, plain_set, prose
from pyspark.sql import functions as F

from gleaner.llm import near, simhash

ROOT = Path(__file__).resolve().parents[2]


def changed(rng, text, words):
    out = text.split(" ")
    for place in rng.sample(range(len(out)), words):
        out[place] = f"new{rng.random()}"
    return " ".join(out)


@pytest.fixture(scope="module")
def copies():
    """Texts with copies at similarities from 0.5 to 0.95, and one large group of them."""
    rng = random.Random(11)
    rows = []
    for i in range(60):
        text = prose(rng, 300).replace("\n", " ")
        rows.append(text)
        rows.append(changed(rng, text, rng.choice([1, 3, 5, 6, 7, 9, 15])))
    base = prose(rng, 200).replace("\n", " ")
    rows += [changed(rng, base, rng.choice([1, 2, 3, 5])) for _ in range(80)]
    rows += ["", " ", "a b", "A  b"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_every_pair_at_the_bar_is_linked_and_none_below(spark, copies):
    df = spark.createDataFrame(copies, "doc_id int, text string").repartition(3)
    got = [r["doc_id"] for r in simhash.keep_one(df, similarity=0.8).collect()]
    assert sorted(got) == sorted(plain_kept(copies))
    # The fingerprints of three-word shingles miss most of them.
    assert simhash.keep_one(df).count() > len(got)


def test_large_buckets_are_cut(spark, copies, monkeypatch):
    monkeypatch.setattr(near, "SMALL", 3)
    df = spark.createDataFrame(copies, "doc_id int, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(df, similarity=0.8).collect()) == sorted(plain_kept(copies))


def test_the_stage_drops_what_all_pairs_say(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, tiny).collect()} == plain_kept(rows)


@pytest.mark.parametrize("similarity", [None, 0.8])
def test_unlinked_texts_under_one_id_all_stay(spark, similarity):
    rng = random.Random(5)
    one, two, three = (prose(rng, 80) for _ in range(3))
    rows = [(1, one), (2, two), (2, one), (2, three), (2, three), (None, two), (None, "nobody knows whose text this one is")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one(df, similarity=similarity).collect()), key=repr)
    assert got == sorted([(1, one), (2, two), (2, three), rows[-1]], key=repr)


def test_of_linked_texts_under_one_id_one_stays(spark):
    text = prose(random.Random(6), 80)
    df = spark.createDataFrame([(1, text), (1, text.replace(" ", "  ")), (1, text), (2, text)], "doc_id int, text string")
    assert [r["doc_id"] for r in simhash.keep_one(df).collect()] == [1]
    assert [r["doc_id"] for r in simhash.keep_one(df, similarity=0.8).collect()] == [1]


@pytest.fixture(scope="module")
def template():
    """Pages of one site: a common frame, so all are alike to 0.78, and copies in pairs at 0.82 and more."""
    rng = random.Random(21)
    frame = [f"w{i}" for i in range(300)]
    rows = []
    for page in range(150):
        own = [f"p{page}x{i}" for i in range(36)]
        text = frame[:150] + own + frame[150:]
        other = list(text)
        other[150 + rng.randrange(20)] = f"q{page}"
        rows += [" ".join(text), " ".join(other)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [near.BLOCK, 20])
def test_pairs_in_a_crowd_of_one_template_are_all_linked(spark, template, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    sets = [plain_set(t) for _, t in template[:40]]
    alike = sorted(len(a & b) / len(a | b) for n, a in enumerate(sets) for b in sets[:n])
    assert 0.7 < alike[0] < 0.8
    df = spark.createDataFrame(template, "doc_id int, text string").repartition(3)
    got = sorted(r["doc_id"] for r in simhash.keep_one(df, similarity=0.8).collect())
    assert len(got) == 150
    assert got == sorted(plain_kept(template))


def test_fingerprints_are_those_of_simhash():
    rng = random.Random(2)
    texts = [prose(rng, n) for n in (1, 4, 5, 9, 200)]
    expected = simhash.fingerprints_of(texts, 5).view("int64").tolist()
    assert [near.fingerprint(simhash.shingle_hashes(t, 5)) for t in texts] == expected


def test_clashing_columns(spark):
    text = prose(random.Random(6), 80)
    rows = [(1, text, 7), (1, text, 7), (2, text, 7), (3, "", 7)]
    df = spark.createDataFrame(rows, "doc_id int, text string, _place int").withColumn("_their_id", F.col("_place")).withColumn("_id", F.lit(5))
    for similarity in (None, 0.8):
        got = simhash.keep_one(df, similarity=similarity)
        assert got.columns == df.columns
        assert sorted(map(tuple, got.collect())) == [(1, text, 7, 7, 5), (3, "", 7, 7, 5)]


def test_workers_need_no_copy_of_the_package(tmp_path):
    """The library on the driver's path only, the workers elsewhere."""
    code = (
        f"import sys; sys.path.insert(0, {str(ROOT)!r})\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '1')"
        f".config('spark.checkpoint.dir', {str(tmp_path)!r}).config('spark.sql.warehouse.dir', {str(tmp_path)!r}).getOrCreate()\n"
        "from gleaner.llm import simhash\n"
        "df = spark.createDataFrame([(1, 'a b c d e f'), (2, 'a b c d e f'), (3, 'g')], 'doc_id int, text string')\n"
        "print('kept', sorted(r[0] for r in simhash.keep_one(df, similarity=0.8).collect()))\n"
    )
    beside = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=beside, capture_output=True, text=True, timeout=240)
    assert "kept [1, 3]" in done.stdout, done.stderr[-2000:]
