from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from llm_helpers import prose
from pyspark.sql import functions as F

from gleaner.llm import rules

BLANKS = " \t\n\x0b\x0c\r"


def words_of(text):
    for b in BLANKS:
        text = text.replace(b, " ")
    return [w for w in text.split(" ") if w]


def plain(text):
    text = text or ""
    words = words_of(text)
    runs = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {p for i in range(len(words) - 2) if runs[tuple(words[i : i + 3])] > 1 for p in range(i, i + 3)}
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if words_of(line):
            lines += 1
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), lines, dup, len(covered))


def test_measures_agree_with_a_plain_count(spark, odd_rows):
    rng = random.Random(8)
    texts = [r[1] for r in odd_rows] + ["a\na\n a\n\n\na", "x y z x y z x", "😀 é#|\n😀 é#|", "\n", "a", "# # #", "p q r" * 3]
    texts += ["".join(rng.choice(["a", "b", " ", "\n", "#", "é", "\t"]) for _ in range(rng.randint(0, 80))) for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("n_words", F.lit("old"))
    got = {r["doc_id"]: tuple(r[m] for m in rules.MEASURES) for r in rules.measured(df).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_verdicts_on_hosts(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 80), "good") for i in range(60)] + [(100 + i, "too short", "bad") for i in range(50)]
    rows += [(200 + i, prose(rng, 80), "bad") for i in range(5)] + [(300, "short", "small"), (301, prose(rng, 80), "small")]
    rows += [(400 + i, prose(rng, 80), None) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string")
    got = {r["doc_id"]: r for r in rules.judge(df).collect()}
    assert len(got) == len(rows)
    failed, total = defaultdict(int), defaultdict(int)
    for doc, _, host in rows:
        total[host] += 1
        failed[host] += got[doc]["failed"]
    hosts = spark.createDataFrame([(h, total[h], failed[h]) for h in total], "h string, docs long, failed long")
    a, b = rules.beta_prior(hosts)
    for doc, _, host in rows:
        assert got[doc]["host_rate"] == pytest.approx((failed[host] + a) / (total[host] + a + b))
    # One failure of two is no reason to refuse a host; fifty of fifty-five is.
    assert got[301]["kept"] and not got[300]["kept"] and not got[200]["kept"] and got[3]["kept"] and got[400]["kept"]


def test_a_host_that_knows_little_leans_on_all(spark):
    hosts = spark.createDataFrame([("a", 1000, 100), ("b", 900, 80), ("c", 1100, 120), ("d", 2, 2)], "h string, docs long, failed long")
    a, b = rules.beta_prior(hosts)
    assert 0.05 < a / (a + b) < 0.15 and (2 + a) / (2 + a + b) < 0.5
    assert rules.beta_prior(hosts.where("docs < 0")) == (1.0, 1.0)


def test_edges(odd, none):
    assert rules.judge(none).collect() == []
    judged = rules.judge(odd.withColumns({"host_rate": F.lit(1), "kept": F.lit(None), "failed": F.lit("x")}).drop("host_rate", "kept", "failed"))
    assert judged.count() == odd.count()


def test_clashing_columns(spark, odd):
    names = ("doc_id", "n_words", "host_rate", "kept")
    plain = sorted(map(repr, rules.judge(odd).select(*names).collect()))
    extra = odd.withColumns({c: F.lit(7) for c in ("_host", "host_rate", "failed", "kept", "n_lines", "docs", "_x_host")})
    found = rules.judge(extra)
    assert sorted(map(repr, found.select(*names).collect())) == plain
    assert found.select("_host", "docs").distinct().collect() == [(7, 7)]
