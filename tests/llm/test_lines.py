from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gleaner.llm import lines

BLANKS = " \t\r\x0b\x0c"


def plain(rows, ratio, least):
    pages = defaultdict(set)
    for _, text, _, host, _ in rows:
        pages[host].add(text or "")
    gone = defaultdict(set)
    for host, texts in pages.items():
        held = Counter(line for t in texts for line in {x.strip(BLANKS) for x in t.split("\n")} if line)
        gone[host] = {x for x, n in held.items() if n >= least and n > ratio * len(texts)}
    out = []
    for doc, text, _, host, _ in rows:
        every = [] if text is None else text.split("\n")
        kept = [x for x in every if x.strip(BLANKS) not in gone[host]]
        out.append((doc, None if text is None else "\n".join(kept), len(every), len(every) - len(kept)))
    return sorted(out, key=repr)


@pytest.fixture
def paged(spark, odd_rows):
    rows = [
        (d, None if t is None else t + ("\nCookie notice  " if i % 2 else "\n Cookie notice") + ("\nrare line" if i % 20 == 0 else ""), lang, s, n)
        for i, (d, t, lang, s, n) in enumerate(odd_rows)
    ]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)


@pytest.mark.parametrize("most", [lines.BROADCAST_LINES, 0])
@pytest.mark.parametrize(("ratio", "least"), [(0.1, 5), (0.5, 1), (0.0, 2)])
def test_agrees_with_a_plain_count(paged, monkeypatch, ratio, least, most):
    rows, df = paged
    monkeypatch.setattr(lines, "BROADCAST_LINES", most)
    cleaned = lines.drop_boilerplate(df.withColumns({"n_lines": F.lit("x"), "_line": F.lit(1)}), ratio=ratio, least_pages=least, counts=True)
    got = [tuple(r) for r in cleaned.select("doc_id", "text", "n_lines", "n_dropped").collect()]
    assert sorted(got, key=repr) == plain(rows, ratio, least)


def test_copies_of_a_page_are_one_page(spark):
    rows = [(i, "same\ntext", "h") for i in range(50)] + [(100 + i, f"own {i}\nfooter", "h") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string")
    got = {r["doc_id"]: r["text"] for r in lines.drop_boilerplate(df).collect()}
    assert got[3] == "same\ntext" and got[104] == "own 4"


def test_edges(none, odd):
    assert lines.drop_boilerplate(none).collect() == []
    assert lines.drop_boilerplate(odd).columns == odd.columns
    assert lines.drop_boilerplate(odd).count() == odd.count()


def test_clashing_columns(spark, odd):
    plain = sorted(map(repr, lines.drop_boilerplate(odd, ratio=0.01, least_pages=2, counts=True).collect()))
    extra = odd.withColumns({c: F.lit(7) for c in ("_gone", "_site", "_cut", "_host", "_lines", "_x_gone")})
    found = lines.drop_boilerplate(extra, ratio=0.01, least_pages=2, counts=True)
    assert found.select("_gone", "_cut", "_x_gone").distinct().collect() == [(7, 7, 7)]
    assert sorted(map(repr, found.drop("_gone", "_site", "_cut", "_host", "_lines", "_x_gone").collect())) == plain
