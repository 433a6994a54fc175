from __future__ import annotations

import json
import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from gleaner.schema import GOLD_ENTRY, RUN_FILE
from gleaner.sources import json_arrays, json_files
from workload import queries

ODD = ['a "quoted" word', "back\\slash\\", "{[}]", "é漢🙂", "\\\\\"", "", "line\nbreak", "},{", '"}', "\\" * 9 + '"']


def entries(rng, count):
    return [
        {"url": f"u{i}", "domain": "d", "title": rng.choice(ODD), "html_text": "".join(rng.choices(ODD, k=rng.randint(0, 6))), "gold_text": rng.choice(ODD)}
        for i in range(count)
    ]


def shown(df):
    return sorted(df.select("url", "title", "html_text", "gold_text").collect())


@pytest.mark.parametrize("range_bytes", [7, 64, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_arrays_are_read_in_ranges(spark, tmp_path, range_bytes, indent):
    rng = random.Random(range_bytes)
    for n in range(3):
        text = json.dumps(entries(rng, 6 * n), indent=indent, ensure_ascii=n == 1)
        (tmp_path / f"{n}_gs.json").write_text(text, encoding="utf-8")
    (tmp_path / "empty_gs.json").write_text("")
    found = json_arrays.read_array(spark, str(tmp_path), GOLD_ENTRY, range_bytes)
    whole = json_files.read_gold(spark, str(tmp_path))
    assert shown(found) == shown(whole) and found.count() == 18
    assert {r["file"] for r in found.select("file").distinct().collect()} == {"1_gs.json", "2_gs.json"}


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path):
    rows = [{"url": f"u{i}", "html_text": "x" * 400, "gold_text": "}\""} for i in range(3000)]
    (tmp_path / "one.json").write_text(json.dumps(rows, indent=1))
    found = json_arrays.list_elements(spark, str(tmp_path), 1, 1 << 16)
    assert found.count() == 3000
    from pyspark.sql import functions as F

    assert found.select(F.spark_partition_id()).distinct().count() > 1


@pytest.mark.parametrize("range_bytes", [11, 1 << 20])
def test_runs_are_read_in_ranges(spark, tmp_path, range_bytes):
    record = {"url": "u", "domain": "d", "status": "ok", "f1": 0.5, "parsed_text": "a {\"b\": [1]} \\", "call_costs_usd": [0.1], "raw_responses": ["r[", "{"]}
    run = {"model": "m", "provider": "p", "condition": "A", "budget_tokens": 9, "records": [record | {"url": f"u{i}"} for i in range(9)], "eur_per_usd": 0.9}
    (tmp_path / "a.json").write_text(json.dumps(run, indent=2))
    (tmp_path / "b.json").write_text(json.dumps({"model": "n", "records": []}))
    documents, objects = json_arrays.read_listed(spark, str(tmp_path), "records", RUN_FILE, range_bytes)
    got = sorted((r["file"], r["model"], r["budget_tokens"], r["eur_per_usd"]) for r in documents.collect())
    assert got == [("a.json", "m", 9, 0.9), ("b.json", "n", None, None)]
    rows = objects.collect()
    assert sorted(r["url"] for r in rows) == [f"u{i}" for i in range(9)]
    assert {(r["parsed_text"], tuple(r["raw_responses"])) for r in rows} == {(record["parsed_text"], ("r[", "{"))}


@pytest.mark.parametrize("text", ['[{"url": "a"}, 3]', '[{"url": "a"}', '{"url": "a", "x": "y"}', '["a"]', '[{"url": {}}, {"url": tru}]'])
def test_broken_documents_fail(spark, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises((PySparkException, Py4JJavaError)):
        json_arrays.read_array(spark, str(tmp_path), GOLD_ENTRY, 5).collect()


@pytest.mark.parametrize("before, after", [("[", "]"), ('{"model": "m", "records": [', '], "budget_tokens": 9}')])
def test_every_task_writes_a_document(spark, tmp_path, before, after):
    rows = spark.createDataFrame([(f"u{i}", ODD[i % len(ODD)]) for i in range(40)], "url string, title string")
    path = str(tmp_path / "out")
    queries._write_list(rows.repartitionByRange(3, "url").where("url <> 'u39' OR title IS NULL"), path, before, after)
    texts = [f.read_text(encoding="utf-8") for f in (tmp_path / "out").glob("part-*")]
    assert len(texts) == 3
    lists = [d if isinstance(d, list) else d["records"] for d in map(json.loads, texts)]
    assert sorted(r["url"] for found in lists for r in found) == sorted(f"u{i}" for i in range(39))
    if before == "[":
        read = json_arrays.read_array(spark, path, GOLD_ENTRY, 64)
    else:
        documents, read = json_arrays.read_listed(spark, path, "records", RUN_FILE, 64)
        assert [(r["model"], r["budget_tokens"]) for r in documents.collect()] == [("m", 9)] * 3
    assert read.count() == 39


def test_a_task_without_rows_writes_an_empty_list(spark, tmp_path):
    rows = spark.createDataFrame([("u", "t")], "url string, title string").repartition(4, "url")
    path = str(tmp_path / "out")
    queries._write_list(rows.where("url = 'u'"), path)
    assert json_arrays.read_array(spark, path, GOLD_ENTRY, 3).count() == 1
