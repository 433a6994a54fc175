from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gleaner.operators import tables
from gleaner.sources import buckets
from gleaner.sources.buckets import BucketTable, Conflict
from gleaner.streaming.incremental import score_into

SCHEMA = "url string, n int, note string"


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.createDataFrame([(f"u{i}", i, "old") for i in range(200)], SCHEMA)
    made = BucketTable(spark, str(tmp_path / "t"), rows.schema, ("url",), 32)
    assert made.newest() == -1 and made.read().collect() == []
    made.replace(rows)
    return made


def rows(df):
    return sorted(map(tuple, df.collect()))


def files(table):
    return {f for folder in table.folders().values() for f in Path(table.path, folder).glob("*.parquet")}


def test_only_touched_buckets_are_rewritten(spark, table):
    before, known = files(table), table.folders()
    new = spark.createDataFrame([("u7", 70), ("u8", 80), ("new", 1)], "url string, n int")
    stored = rows(table.read())
    buckets.upsert(table, new, ["url"])
    touched = table.touched(new)
    assert 0 < len(touched) <= 3
    now = table.folders()
    assert {b for b in now if now[b] != known.get(b)} == touched
    assert len(before & files(table)) >= len(before) - len(touched) and len(now) <= 32
    changed = {r[0]: r for r in rows(table.read())}
    assert changed["u7"] == ("u7", 70, "old") and changed["u8"] == ("u8", 80, "old") and changed["new"] == ("new", 1, None)
    assert [r for r in stored if r[0] not in ("u7", "u8")] == [r for r in rows(table.read()) if r[0] not in ("u7", "u8", "new")]
    # The table as it was stays readable.
    assert rows(table.read(snapshot=0)) == stored


def test_a_job_lost_before_publishing_leaves_the_table_as_it_was(spark, table, monkeypatch):
    stored = rows(table.read())
    new = spark.createDataFrame([("u7", 70)], "url string, n int")

    def lost(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as broken:
        broken.setattr(BucketTable, "_publish", lost)
        with pytest.raises(KeyboardInterrupt):
            buckets.upsert(table, new, ["url"])
    assert rows(table.read()) == stored and table.newest() == 0
    # An unfinished publishing is no snapshot, and is written over.
    Path(table.path, "snapshots", "snapshot=1", "_temporary").mkdir(parents=True)
    assert table.newest() == 0
    buckets.upsert(table, new, ["url"])
    assert table.newest() == 1 and dict((r[0], r[1]) for r in rows(table.read()))["u7"] == 70


def test_the_second_of_two_writers_fails(spark, table):
    new = spark.createDataFrame([("u7", 70)], "url string, n int")
    base = table.newest()
    folder = table._write(table.read(base, table.touched(new)))
    buckets.upsert(table, new, ["url"])
    with pytest.raises(Conflict):
        table._publish(base, folder, dict.fromkeys(table.touched(new)))
    assert dict((r[0], r[1]) for r in rows(table.read()))["u7"] == 70


def test_random_writes_equal_the_table_steps(spark, table):
    rng = random.Random(4)
    plain = table.read()
    for turn in range(4):
        some = [(f"u{rng.randrange(260)}", rng.randrange(99)) for _ in range(rng.choice([1, 8, 40]))]
        new = spark.createDataFrame(list(dict(some).items()), "url string, n int")
        gone = spark.createDataFrame([(f"u{rng.randrange(260)}",) for _ in range(5)], "url string")
        buckets.upsert(table, new, ["url"])
        buckets.delete(table, gone)
        plain = spark.createDataFrame(tables.delete_gold(gone, tables.upsert(plain, new, ["url"])).collect(), SCHEMA)
        assert rows(table.read()) == rows(plain)
    nothing = spark.createDataFrame([], "url string, n int")
    number = table.newest()
    assert buckets.upsert(table, nothing, ["url"]) == number
    buckets.delete(table, table.read().select("url"))
    assert table.read().collect() == [] and table.folders() == {} and table.newest() == number + 1


def test_rows_may_not_leave_their_buckets(spark, table):
    new = spark.createDataFrame([("u7", 70, "x")], SCHEMA)
    with pytest.raises(ValueError, match="did not read"):
        table.merge(new, lambda stored, rows: table.read())


def test_pages_with_gold_and_guard(spark, tmp_path):
    pages = BucketTable(spark, str(tmp_path / "p"), spark.createDataFrame([], "url string, domain string, title string, html_text string").schema, ("url",), 4)
    gold = BucketTable(spark, str(tmp_path / "g"), spark.createDataFrame([], "url string, gold_text string").schema, ("url",), 4)
    entries = spark.createDataFrame(
        [("http://a.b/1", "<title>x</title>", "g1", 1), ("http://a.b/1", "<title>y</title>", "g2", 2)],
        "url string, html_text string, gold_text string, seq int",
    )
    buckets.save_pages_with_gold(pages, gold, entries, "seq")
    assert rows(pages.read().select("url", "domain", "title")) == [("http://a.b/1", "a.b", "y")]
    assert rows(gold.read()) == [("http://a.b/1", "g2")]
    new = spark.createDataFrame([("http://a.b/1", "g3"), ("http://no.where/", "g4")], "url string, gold_text string")
    assert rows(buckets.upsert_gold(gold, pages, new).select("url")) == [("http://no.where/",)]
    assert rows(gold.read()) == [("http://a.b/1", "g3")]


def test_stream_scores_into_buckets_once(spark, tmp_path):
    from gleaner.schema import EVALUATIONS

    evaluations = BucketTable(spark, str(tmp_path / "e"), EVALUATIONS, ("url",), 8)
    entries = tmp_path / "in"
    entries.mkdir()

    def arrive(name, urls):
        listed = [{"url": u, "domain": "x.org", "title": "t", "html_text": f"<p>text of {u}</p>", "gold_text": f"text of {u}"} for u in urls]
        (entries / name).write_text(__import__("json").dumps(listed))
        score_into(spark, str(entries), str(tmp_path / "c"), evaluations).awaitTermination()

    arrive("one_gs.json", ["http://x.org/1", "http://x.org/2", "http://x.org/1"])
    assert rows(evaluations.read().select("url", "f1")) == [("http://x.org/1", 1.0), ("http://x.org/2", 1.0)]
    first = evaluations.folders()
    arrive("two_gs.json", ["http://x.org/3", "http://x.org/2"])
    found = rows(evaluations.read().select("url", "f1"))
    assert [r[0] for r in found] == ["http://x.org/1", "http://x.org/2", "http://x.org/3"]
    moved = evaluations.touched(spark.createDataFrame([("http://x.org/3",)], "url string"))
    assert {b for b, f in evaluations.folders().items() if first.get(b) != f} == moved
