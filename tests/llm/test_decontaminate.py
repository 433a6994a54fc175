from __future__ import annotations

import hashlib
import random
import re

import pytest
from llm_helpers import prose
from pyspark.sql import functions as F

from gleaner.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain(docs, items, size=10):
    windows = {}
    for item, text in items:
        words = WORD.findall(lowered(text))
        width = min(size, len(words))
        for i in range(len(words) - width + 1 if words else 0):
            windows.setdefault(tuple(words[i : i + width]), set()).add(str(item))
    out = []
    for doc, text in docs:
        words = WORD.findall(lowered(text))
        hit, found = set(), set()
        for width in {len(w) for w in windows}:
            for i in range(len(words) - width + 1):
                if tuple(words[i : i + width]) in windows:
                    hit.update(range(i, i + width))
                    found |= windows[tuple(words[i : i + width])]
        out.append((doc, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture
def case(spark, odd_rows):
    rng = random.Random(4)
    items = [(i, prose(rng, rng.randint(10, 30))) for i in range(30)]
    items += [(30, items[0][1]), (31, "only three words"), (32, ""), (33, None), (34, "É"), (35, items[1][1].upper())]
    docs = [(r[0], r[1]) for r in odd_rows]
    for i in range(20):
        passage = items[i][1].replace(" ", rng.choice([" ", ", ", "\n- "]))
        docs.append((500 + i, prose(rng, 40) + " " + passage + " " + prose(rng, 10)))
    docs += [(600, "ONLY three, words! É"), (601, items[2][1] + " " + items[3][1]), (602, " ".join(items[4][1].split()[:9]))]
    return docs, items, spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")


@pytest.mark.parametrize("block_windows", [decontaminate.BLOCK_WINDOWS, 60])
def test_hits_agree_with_a_plain_search(case, block_windows):
    docs, items, df, benchmark = case
    found = decontaminate.scan(df.withColumn("contamination", F.lit(1)), benchmark, block_windows=block_windows)
    rows = found.select(
        "doc_id", "contamination.n_words", decontaminate.n_hit(), F.size("contamination.items"),
        F.sha2(F.concat_ws(",", "contamination.items"), 256),
    ).collect()
    assert sorted((tuple(r) for r in rows), key=repr) == plain(docs, items)


@pytest.mark.parametrize("block_windows", [decontaminate.BLOCK_WINDOWS, 60])
def test_spans_and_documents_go(case, block_windows):
    docs, items, df, benchmark = case
    hit = {(d, n) for d, n, h, _, _ in plain(docs, items) if h}
    kept = decontaminate.decontaminate(df, benchmark, block_windows=block_windows).collect()
    assert len(kept) == len(docs) - sum((d, n) in hit for d, n, *_ in plain(docs, items))
    cut = decontaminate.decontaminate(df, benchmark, remove="spans", block_windows=block_windows)
    assert cut.columns == ["doc_id", "text"] and cut.count() == len(docs)
    texts = {(r["doc_id"], r["text"]) for r in cut.collect()}
    assert {(d, t) for d, t in docs if (d, len(WORD.findall(lowered(t)))) not in hit} <= texts
    words = {r["doc_id"]: r["n"] for r in decontaminate.scan(cut, benchmark).select("doc_id", F.col("contamination.n_words").alias("n")).collect()}
    for doc, total, gone, *_ in plain(docs, items):
        if gone:
            assert words[doc] == total - gone


def test_edges(spark, none, case):
    assert decontaminate.decontaminate(none, case[3]).collect() == []
    nothing = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.decontaminate(case[2], nothing).count() == len(case[0])
    unnamed = spark.createDataFrame([(None, "ka lo mi")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "a KA lo, mi b")], "doc_id bigint, text string")
    row = decontaminate.scan(docs, unnamed).first()["contamination"]
    assert [tuple(s) for s in row["spans"]] == [(1, 4)] and row["items"] == []
    with pytest.raises(ValueError, match="spans"):
        decontaminate.decontaminate(docs, unnamed, remove="lines")
