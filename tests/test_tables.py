from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gleaner.config import SETTLED_CHECK, SETTLED_PARSE
from gleaner.operators import tables
from gleaner.operators.joins import spread_join
from gleaner.plans import evaluate, extract
from gleaner.schema import EVALUATIONS, PAGE_RESULTS, RUNS, conform


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(
        [("http://a/1", "a", "old", "<p>1"), ("http://a/2", "a", "old", "<p>2")],
        "url string, domain string, title string, html_text string",
    )


@pytest.fixture
def gold(spark):
    return spark.createDataFrame([("http://a/1", "g1")], "url string, gold_text string")


def test_insert_absent(spark, pages):
    new = spark.createDataFrame(
        [("http://a/2", "x", "new", "n", 1), ("http://a/3", "x", "second", "n", 2), ("http://a/3", "x", "first", "n", 1)],
        "url string, domain string, title string, html_text string, at int",
    )
    got = tables.insert_absent(pages, new, ["url"], order="at")
    assert got.columns == pages.columns
    assert rows(got, "url", "title") == [("http://a/1", "old"), ("http://a/2", "old"), ("http://a/3", "first")]


def test_upsert_pages_reads_domain_and_title(spark, pages):
    stored = pages.withColumn("created_at", F.lit("then"))
    fetched = spark.createDataFrame(
        [("http://a/2", "<title> two </title>"), ("http://B.org:80/x", "none")], "url string, html_text string"
    )
    got = rows(tables.upsert_pages(stored, fetched), "url", "domain", "title", "created_at")
    assert got == [
        ("http://B.org:80/x", "B.org:80", "", None), ("http://a/1", "a", "old", "then"), ("http://a/2", "a", "two", "then"),
    ]


def test_upsert_takes_the_last_of_several_copies(spark, gold):
    new = spark.createDataFrame([("http://a/1", "x", 2), ("http://a/1", "y", 3), ("http://a/1", "z", 1)], "url string, gold_text string, at int")
    assert rows(tables.upsert(gold, new, ["url"], order="at"), "url", "gold_text") == [("http://a/1", "y")]
    assert tables.upsert(gold, new.drop("at"), ["url"]).count() == 1


def test_gold_needs_its_page(spark, pages, gold):
    new = spark.createDataFrame([("http://a/1", "n"), ("http://a/2", "n"), ("http://a/9", "n")], "url string, gold_text string")
    written = tables.upsert_gold(gold, pages, new)
    assert rows(written.table, "url", "gold_text") == [("http://a/1", "n"), ("http://a/2", "n")]
    assert rows(written.rejected, "url") == [("http://a/9",)]


def test_deletes_cascade(spark, pages, gold):
    urls = spark.createDataFrame([("http://a/1",), ("http://a/1",), ("http://gone/",)], "url string")
    kept_pages, kept_gold = tables.delete_pages(urls, pages, gold)
    assert rows(kept_pages, "url") == [("http://a/2",)] and rows(kept_gold, "url") == []
    assert tables.removed_rows(urls, pages).count() == 1
    assert rows(tables.delete_gold(urls, gold), "url") == []


def test_column_groups_are_independent(spark):
    stored = conform(
        spark.createDataFrame([("a", 0.5, 3), ("b", None, 2)], "url string, f1 double, judge_score int"), EVALUATIONS
    )
    scores = spark.createDataFrame([("b",), ("c",)], "url string").select(
        "url", *[F.lit(0.25).alias(m) for m in ("precision_val", "recall_val", "f1", "cosine", "jaccard", "excess_ratio")]
    )
    got = tables.save_metrics(stored, scores)
    assert rows(got, "url", "f1", "judge_score") == [("a", 0.5, 3), ("b", 0.25, 2), ("c", 0.25, None)]
    judged = tables.save_judge_scores(got, spark.createDataFrame([("a", None), ("d", 5)], "url string, judge_score int"))
    assert rows(judged, "url", "f1", "judge_score") == [("a", 0.5, None), ("b", 0.25, 2), ("c", 0.25, None), ("d", None, 5)]


def test_replace_runs(spark):
    runs = conform(spark.createDataFrame([(1, "x"), (2, "y")], "run_id long, label string"), RUNS)
    results = spark.createDataFrame([(1, "u", "ok"), (1, "v", "ok"), (2, "u", "ok")], "run_id long, url string, status string")
    new_runs = spark.createDataFrame([(9, "x")], "run_id long, label string")
    new_results = spark.createDataFrame([(9, "u", "error")], "run_id long, url string, status string")
    got_runs, got_results = tables.replace_runs(runs, results, new_runs, new_results)
    assert rows(got_runs, "run_id", "label") == [(2, "y"), (9, "x")]
    assert rows(got_results, "run_id", "url", "status") == [(2, "u", "ok"), (9, "u", "error")]


def test_attach_checks(spark):
    results = conform(
        spark.createDataFrame(
            [(1, "u", 0.5), (1, "v", 0.75), (1, "w", 0.1), (2, "u", 0.2)], "run_id long, url string, grounded double"
        ),
        PAGE_RESULTS,
    )
    checks = spark.createDataFrame(
        [(1, "u", "ok", None, ["q"], True), (1, "v", "ok", 0.9, [], False), (1, "w", "error", 0.9, [], True), (1, "z", "ok", 0.9, [], True)],
        "run_id long, url string, status string, grounded double, claimed_missing array<string>, coherent boolean",
    )
    attached = tables.attach_checks(results, checks)
    got = rows(attached.table, "run_id", "url", "grounded", "check_claimed_missing", "check_coherent")
    assert got == [
        (1, "u", 0.5, ["q"], True), (1, "v", 0.9, None, False), (1, "w", 0.1, None, None), (2, "u", 0.2, None, None),
    ]
    assert rows(attached.rejected, "url") == [("z",)]
    assert attached.table.schema == results.schema


def test_measured_cost(spark):
    runs = spark.createDataFrame([(1, "x", None), (2, "y", 1.0)], "run_id long, label string, measured_cost_eur double")
    costs = spark.createDataFrame([("x", 2.5), ("none", 9.0)], "label string, cost_eur double")
    assert rows(tables.set_measured_cost(runs, costs), "label", "measured_cost_eur") == [("x", 2.5), ("y", 1.0)]


def test_old_rows_and_evolution(spark):
    stored = conform(spark.createDataFrame([(1, "u", "ok")], "run_id long, url string, status string"), PAGE_RESULTS)
    old = spark.createDataFrame([(2, "v", 7, "?")], "run_id long, url string, chars long, unknown string")
    loaded = tables.load_rows(stored, old)
    assert loaded.schema == stored.schema
    assert rows(loaded, "run_id", "url", "chars", "f1") == [(1, "u", None, None), (2, "v", 7, None)]
    once = tables.evolve(old, PAGE_RESULTS)
    assert tables.evolve(once, PAGE_RESULTS).schema == once.schema == PAGE_RESULTS


def test_seed_only_when_empty(spark, pages):
    seed = pages.withColumn("title", F.lit("seed"))
    assert rows(tables.seed_if_empty(pages, seed), "title") == [("old",), ("old",)]
    assert rows(tables.seed_if_empty(pages.where("false"), seed), "title") == [("seed",), ("seed",)]


def test_selections(spark, pages, gold):
    more = pages.unionByName(pages.withColumns({"url": F.lit("http://b/1"), "domain": F.lit("b")}).limit(1))
    assert rows(tables.supported_pages(more, gold), "url") == [("http://a/1",), ("http://a/2",)]
    wanted = spark.createDataFrame([("http://a/1",), ("http://b/1",), ("http://typo/",)], "url string")
    chosen = tables.work_list(more, wanted, domain="b")
    assert rows(tables.work_list(more, wanted, first=1).table, "url") == [("http://a/1",)]
    assert rows(chosen.table, "url") == [("http://b/1",)] and rows(chosen.rejected, "url") == [("http://typo/",)]
    done = spark.createDataFrame([("http://a/1", "empty"), ("http://a/2", "error")], "url string, status string")
    assert rows(tables.unsettled(more, done, SETTLED_PARSE), "url") == [("http://a/2",), ("http://b/1",)]
    assert tables.unsettled(more, done, SETTLED_CHECK).count() == 3
    texts = spark.createDataFrame([("a", "ok", "t"), ("b", "ok", ""), ("c", "ok", None), ("d", "error", "t")], "url string, status string, parsed_text string")
    assert rows(tables.checkable(texts), "url") == [("a",)]


def test_fallback(spark, pages):
    fetched = spark.createDataFrame([("http://a/1", None), ("http://a/2", "live"), ("http://n/", "new"), ("http://m/", None)], "url string, html_text string")
    got = tables.with_stored_fallback(fetched, pages)
    assert rows(got.table, "url", "html_text", "fallback_used", "first_seen") == [
        ("http://a/1", "<p>1", True, False), ("http://a/2", "live", False, False), ("http://n/", "new", False, True),
    ]
    assert rows(got.rejected, "url") == [("http://m/",)]


def test_parse_fetched_stores_first_seen_pages(spark, pages, gold):
    fetched = spark.createDataFrame(
        [("http://a/1", None), ("http://a/7", "<title>t</title><p>**seven**"), ("http://zzz/1", "<p>no gold")], "url string, html_text string"
    )
    parsed, stored, _ = extract.parse_fetched(fetched, pages, gold)
    assert rows(parsed, "url", "fallback_used", "cleaned_text") == [("http://a/1", True, "1"), ("http://a/7", False, "seven")]
    assert rows(stored, "url", "title") == [("http://a/1", "old"), ("http://a/2", "old"), ("http://a/7", "t")]


def test_stored_or_live(spark):
    urls = spark.createDataFrame([("a",), ("b",), ("c",)], "url string")
    stored = spark.createDataFrame([("a", "s")], "url string, parsed_text string")
    live = spark.createDataFrame([("a", "l"), ("b", "l")], "url string, parsed_text string")
    assert rows(extract.stored_or_live(urls, stored, live), "url", "parsed_text", "source") == [
        ("a", "s", "stored"), ("b", "l", "live"), ("c", None, None),
    ]
    assert rows(extract.stored_or_live(urls, stored, live, fresh=True), "url", "source")[0] == ("a", "live")


def test_unknown_record_stops_the_job(spark, pages):
    known = spark.createDataFrame([("http://a/1",)], "url string")
    assert evaluate.assert_all_known(known, pages).count() == 1
    unknown = spark.createDataFrame([("http://x/",)], "url string")
    with pytest.raises(Exception, match="not in the corpus: http://x/"):
        evaluate.assert_all_known(unknown, pages).collect()


def test_spread_join_keeps_every_row_of_a_hot_key(spark):
    facts = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"), "id"
    )
    lookup = facts.where("key <> 'k7'").groupBy("key").agg(F.max("id").alias("top"))
    plain = facts.join(lookup, "key").orderBy("id").collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        spread = spread_join(facts, lookup, ["key"], ["id"])
        assert spread.orderBy("id").select("key", "id", "top").collect() == plain
        assert spread_join(facts, lookup, ["key"], ["id"], "left").count() == 3000
        assert spread_join(facts, lookup, ["key"], ["id"], "left_semi").count() == len(plain)
        assert spread_join(facts, lookup, ["key"], ["id"], "left_anti").count() == 3000 - len(plain)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(ValueError, match="keeps the side"):
        spread_join(facts, lookup, ["key"], ["id"], "full")
