from __future__ import annotations

import io
import json
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from gleaner.plans import reports
from gleaner.schema import EVALUATIONS, PAGE_RESULTS, PAGES, RUNS, conform
from gleaner.sources import json_files, tables
from gleaner.streaming.incremental import score_arrivals


def write(path, content):
    path.write_text(content if isinstance(content, str) else json.dumps(content, indent=1), encoding="utf-8")


def entry(url, **more):
    return {"url": url, "domain": "d", "title": "t", "html_text": "<p>one", "gold_text": "one", **more}


def test_gold_files(spark, tmp_path):
    write(tmp_path / "b_gs.json", [entry("http://d/2"), entry("http://d/1", unknown=1)])
    write(tmp_path / "a_gs.json", [entry("http://a/1", domain="a")])
    write(tmp_path / "empty_gs.json", "")
    write(tmp_path / "other.json", [entry("http://x/")])
    rows = json_files.read_gold(spark, f"{tmp_path}/*_gs.json", ordered=True).collect()
    assert [r["url"] for r in rows] == ["http://a/1", "http://d/1", "http://d/2"]
    assert json_files.read_gold(spark, f"{tmp_path}/*_gs.json").count() == 3


def test_run_and_check_files(spark, tmp_path):
    record = {"url": "u", "domain": "d", "status": "ok", "precision": 0.5, "recall": 0.25, "f1": 0.3, "raw_responses": ["r1", "r2"], "call_costs_usd": [0.1]}
    failed = {"url": "v", "domain": "d", "status": "error", "error": "E: x", "input_tokens": 5}
    write(tmp_path / "my.run.json", {"model": "m", "provider": "p", "condition": "A", "budget_tokens": 9, "eur_per_usd": 0.9, "records": [record, failed]})
    runs, results = json_files.read_runs(spark, f"{tmp_path}/my.run.json")
    run = runs.first()
    assert (run["label"], run["model_name"], run["condition_name"], run["eur_per_usd"]) == ("my.run", "m", "A", 0.9)
    assert runs.dtypes == [(f.name, f.dataType.simpleString()) for f in RUNS.fields]
    assert results.columns == PAGE_RESULTS.names
    rows = {r["url"]: r for r in results.collect()}
    assert rows["u"]["run_id"] == run["run_id"] and rows["u"]["precision_val"] == 0.5 and rows["u"]["call_costs_usd"] == [0.1]
    assert rows["v"]["note"] == "E: x" and rows["v"]["f1"] is None
    assert json_files.read_runs(spark, str(tmp_path / "my.run.json"), "other")[0].first()["label"] == "other"
    raw = json_files.read_raw_replies(spark, str(tmp_path / "my.run.json")).orderBy("n").collect()
    assert [(r["label"], r["n"], r["raw"]) for r in raw] == [("my.run", 0, "r1"), ("my.run", 1, "r2")]

    write(tmp_path / "check.json", {"model": "m", "results": [{"url": "u", "status": "ok", "coherent": True, "coherence": 4, "claimed_missing": ["q"], "quote_checks": [{"quote": "q", "verdict": "presente", "in_page": True, "in_extraction": True}]}]})
    checks = json_files.read_checks(spark, str(tmp_path / "check.json"), "my.run").first()
    assert checks["run_id"] == run["run_id"] and checks["quote_checks"][0]["verdict"] == "presente"


def sample_runs(spark, pages=25):
    runs = conform(
        spark.createDataFrame([("Run À 1", "m", "2024-01-02 03:04:05"), ("none", "m", None)], "label string, model_name string, created_at string").withColumns(
            {"run_id": json_files.run_id_of(F.col("label")), "created_at": F.col("created_at").try_cast("timestamp_ntz")}
        ),
        RUNS,
    )
    results = conform(
        spark.range(pages).select(
            json_files.run_id_of(F.lit("Run À 1")).alias("run_id"), F.concat(F.lit("u"), "id").alias("url"),
            F.lit("ok").alias("status"), (F.col("id") / 7).alias("f1"), F.array(F.lit("p")).alias("providers"),
        ),
        PAGE_RESULTS,
    )
    return runs, results


def test_seed_round_trip_without_gathering_a_run(spark, tmp_path):
    runs, results = sample_runs(spark)
    documents = json_files.seed_documents(runs, results, pages_per_document=5).collect()
    parts = [d for d in documents if d["label"] == "Run À 1"]
    assert len(parts) == 5 and sum(len(d["pages"]) for d in parts) == 25
    assert {d["slug"] for d in documents} == {"run_à_1", "none"}
    json_files.write_seeds(runs, results, str(tmp_path / "seeds"), pages_per_document=5)
    back_runs, back = json_files.read_seeds(spark, str(tmp_path / "seeds"), one_per_line=True)
    assert {(r["run_id"], r["label"], str(r["created_at"])) for r in back_runs.collect()} == {
        (r["run_id"], r["label"], str(r["created_at"])) for r in runs.collect()
    }
    assert back.orderBy("url").collect() == results.orderBy("url").collect()


def test_seed_with_fewer_columns(spark, tmp_path):
    write(tmp_path / "s.json", {"label": "x", "model_name": "m", "created_at": "2024-05-06 07:08:09", "pages": [{"url": "u", "f1": 0.5, "gone": 1}]})
    write(tmp_path / "empty.json", "")
    runs, results = json_files.read_seeds(spark, f"{tmp_path}/*.json")
    assert str(runs.first()["created_at"]) == "2024-05-06 07:08:09"
    row = results.first()
    assert (row["url"], row["f1"], row["status"]) == ("u", 0.5, None)


def test_run_results(spark, tmp_path):
    pages = spark.createDataFrame([("http://b", "b"), ("http://a", "a")], "url string, domain string")
    records = spark.createDataFrame(
        [("http://b", "b", "ok"), ("http://a", "a", "empty"), ("http://c", "c", "ok"), ("http://a2", "a", "error")],
        "url string, domain string, status string",
    )
    json_files.write_run_results(pages, records, str(tmp_path / "out"), "json")
    assert {r["url"] for r in spark.read.json(str(tmp_path / "out")).collect()} == {"http://a", "http://b"}
    write(tmp_path / "urls.txt", "# note\n http://a \n\nhttp://b\nhttp://a\n")
    assert sorted(r["url"] for r in json_files.read_url_list(spark, str(tmp_path / "urls.txt")).collect()) == ["http://a", "http://b"]


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_keyed_tables_join_without_a_shuffle(spark):
    pages = conform(spark.range(100).select(F.concat(F.lit("u"), "id").alias("url"), F.lit("d").alias("domain"), F.lit("h").alias("html_text")), PAGES)
    tables.save_keyed(pages, "web_resources", 4)
    tables.save_keyed(pages.select("url", F.col("html_text").alias("gold_text")), "gold_standard", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = reports.gold_entries(spark.table("gold_standard"), spark.table("web_resources"))
        assert "Exchange" not in plan_of(joined)
        assert joined.count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE web_resources")
        spark.sql("DROP TABLE gold_standard")


def test_page_lookup_is_pushed_down(spark, tmp_path):
    path = str(tmp_path / "pages")
    spark.createDataFrame([("a", "x"), ("b", "y")], "url string, html_text string").write.parquet(path)
    found = tables.page(tables.read_table(spark, path), "b")
    assert "EqualTo(url,b)" in plan_of(found) and found.first()["html_text"] == "y"


def test_page_results_are_read_by_run(spark, tmp_path):
    _, results = sample_runs(spark)
    path = str(tmp_path / "results")
    tables.save_page_results(results, path)
    chosen = tables.read_table(spark, path).where(F.col("run_id") == results.first()["run_id"])
    assert "PartitionFilters: [isnotnull(run_id" in plan_of(chosen) and chosen.count() == 25


def test_arrivals_are_scored_once(spark, tmp_path):
    incoming, store = tmp_path / "in", str(tmp_path / "evaluations")
    incoming.mkdir()
    empty = conform(spark.range(0).select(F.lit("").alias("url")), EVALUATIONS)
    empty.write.parquet(store)

    def save(scores, batch_id):
        conform(
            scores.withColumnsRenamed({"precision": "precision_val", "recall": "recall_val"}), EVALUATIONS
        ).write.mode("append").parquet(store)

    def run():
        query = score_arrivals(spark, str(incoming), str(tmp_path / "state"), lambda: spark.read.parquet(store), save)
        assert query.awaitTermination(120)

    write(incoming / "a.json", [entry("http://d/1"), entry("http://d/2", gold_text="two")])
    run()
    write(incoming / "b.json", [entry("http://d/2"), entry("http://d/3")])
    run()
    rows = sorted((r["url"], r["f1"]) for r in spark.read.parquet(store).collect())
    assert rows == [("http://d/1", 1.0), ("http://d/2", 0.0), ("http://d/3", 1.0)]


def test_bad_records_fail_and_are_reported(spark, tmp_path):
    from gleaner.schema import GOLD_ENTRY

    write(tmp_path / "good_gs.json", [entry("http://a/1")])
    write(tmp_path / "bad_gs.json", '[{"url": "http://a/2", ')
    with pytest.raises(Exception, match="(?i)malformed|parse|bad"):
        json_files.read_gold(spark, f"{tmp_path}/*_gs.json").collect()
    bad = json_files.bad_records(spark, f"{tmp_path}/*_gs.json", GOLD_ENTRY).collect()
    assert [r["file"] for r in bad] == ["bad_gs.json"] and bad[0]["text"].startswith("[{")
    (tmp_path / "lines.json").write_text('{"url": "u1"}\n{broken\n{"url": "u2"}\n')
    bad = json_files.bad_records(spark, str(tmp_path / "lines.json"), GOLD_ENTRY, one_per_line=True).collect()
    assert [r["text"] for r in bad] == ["{broken"]
    write(tmp_path / "nameless.json", [{"domain": "d"}])
    with pytest.raises(Exception, match="without a URL"):
        json_files.read_gold(spark, str(tmp_path / "nameless.json")).collect()


def test_a_label_names_the_run_of_one_file_only(spark, tmp_path):
    for name in ("one", "two"):
        write(tmp_path / f"{name}.json", {"model": "m", "records": [{"url": name, "domain": "d", "status": "ok"}]})
    runs, results = json_files.read_runs(spark, f"{tmp_path}/*.json", "mine")
    assert sorted(r["label"] for r in runs.collect()) == ["one", "two"] and results.select("run_id").distinct().count() == 2
    assert json_files.read_runs(spark, str(tmp_path / "one.json"), "mine")[0].first()["label"] == "mine"


def test_seed_documents_are_bounded_by_characters(spark):
    runs, results = sample_runs(spark)
    results = results.withColumn("parsed_text", F.lit("x" * 100))
    few = json_files.seed_documents(runs, results).count()
    assert json_files.seed_documents(runs, results, chars_per_document=10).count() > few
