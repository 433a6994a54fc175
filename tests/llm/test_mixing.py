from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gleaner.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, weights=(5.0, 2.0, 1.0), rounds=3):
    sizes = [(d, s, len(WORD.findall(t or ""))) for d, t, _, s, _ in rows]
    own = defaultdict(int)
    for _, s, n in sizes:
        own[s] += n
    order = sorted((s for s in own if s is not None), key=lambda s: s.encode()) + ([None] if None in own else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = float(sum(own.values())), set()
    while True:
        free = sum(weight[s] for s in order if s not in capped)
        level = (total - sum(rounds * own[s] for s in capped)) / free if free else 0.0
        more = {s for s in order if s not in capped and rounds * own[s] < level * weight[s]}
        if not more:
            break
        capped |= more
    target = {s: float(rounds * own[s]) if s in capped else level * weight[s] for s in order}
    taken = []
    for s in order:
        line = sorted((hashlib.md5(f"mix:{'' if d is None else d}".encode()).hexdigest(), n, i) for i, (d, x, n) in enumerate(sizes) if x == s)
        budget, before = round(target[s]), 0
        whole, rest = divmod(budget, own[s]) if own[s] else (0, 0)
        for _, n, i in line:
            taken.append((i, whole * n + max(0, min(n, rest - before))))
            before += n
    took = dict(taken)
    return [(d, n, own[s], target[s], took[i]) for i, (d, s, n) in enumerate(sizes)]


@pytest.mark.parametrize("range_rows", [mixing.RANGE_ROWS, 3])
@pytest.mark.parametrize("hot", [False, True])
def test_agrees_with_a_plain_mix(spark, odd_rows, range_rows, hot):
    rows = [r for i, r in enumerate(odd_rows) if odd_rows.index(r) == i]
    if hot:
        rows = [(1000 + i, "w " * (i % 50 + 100), "en", "s9", 1) for i in range(300)] + rows
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    mixed = mixing.mix(df.withColumns({"size": F.lit("x"), "_place": F.lit(1)}), range_rows=range_rows)
    got = sorted((tuple(r) for r in mixed.select("doc_id", "size", "source_size", "target", "taken").collect()), key=repr)
    expected = sorted(plain(rows), key=repr)
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in expected]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in expected])
    spent = {}
    for (_, _, own, target, taken) in got:
        spent[(own, round(target, 3))] = spent.get((own, round(target, 3)), 0) + taken
    assert all(abs(taken - target) <= 1 for (own, target), taken in spent.items())
    assert all(r[4] <= 3 * r[1] for r in got)


def test_repeated_rows_are_taken_alike(odd):
    rows = mixing.mix(odd).where("doc_id = 5").collect()
    assert len(rows) == 3 and len({r["taken"] for r in rows}) == 1


def test_edges(spark, none):
    assert mixing.mix(none).collect() == []
    blank = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id int, text string, source string")
    assert sorted((r["doc_id"], r["size"], r["target"], r["taken"]) for r in mixing.mix(blank).collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


@pytest.mark.parametrize("range_rows", [mixing.RANGE_ROWS, 3])
def test_repeated_and_missing_ids_keep_the_budget(spark, range_rows):
    """Each source's words are the rounded target, whatever rows share an id, a size or all there is."""
    rows = [(None, "n " * (n % 7 + 1) + f"t{n}", "a", 9) for n in range(30)]
    rows += [(7, "same words again", "b", 9)] * 25 + [(7, f"other words {n}", "b", 9) for n in range(10)]
    rows += [(None, None, "b", 9), (8, "x y", None, 9)] + [(n, "big " * 400, "c", 9) for n in range(6)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string, n int").repartition(3)
    found = mixing.mix(docs, range_rows=range_rows).collect()
    again = mixing.mix(docs.repartition(5), range_rows=range_rows).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again))
    assert len(found) == len(rows)
    for source in ("a", "b", "c", None):
        some = [r for r in found if r["source"] == source]
        assert sum(r["taken"] for r in some) == round(some[0]["target"])
        assert sum(r["taken"] % r["size"] > 0 for r in some if r["size"]) <= 1
        assert all(r["taken"] <= 3 * r["size"] for r in some)


def test_clashing_columns(spark, odd):
    plain = sorted(map(repr, mixing.mix(odd).collect()))
    extra = odd.withColumns({c: F.lit(7) for c in ("_size", "_cut", "_source", "_w", "_p", "_left", "_x_", "_x__place", "taken")})
    found = mixing.mix(extra)
    assert found.select("_w", "_cut", "_x__place").distinct().collect() == [(7, 7, 7)]
    assert sorted(map(repr, found.select(*mixing.mix(odd).columns).collect())) == plain
