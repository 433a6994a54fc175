from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gleaner.llm import queries, spelling

UP_TO_LOW = str.maketrans(spelling.UPPER, spelling.LOWER)


def plain_words(rows, least_length=7, least_count=2, damage=31):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UP_TO_LOW)
            code = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if damage and code % damage == 0:
                at = code % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= least_length:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= least_count}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words, factor=10):
    """The result by comparing all pairs that share a deleted form."""
    rest = {}
    for w in words:
        for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            rest.setdefault(key, []).append(w)
    near = {w: set() for w in words}
    for some in rest.values():
        for a in some:
            near[a].update(b for b in some if one_edit(a, b))
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda o: (-words[o], o))
            if words[best] >= factor * words[w]:
                form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out)


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def result(df):
    assert tuple(df.columns) == COLUMNS
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def invented():
    """Words of few syllables, of which some are frequent, and misspellings of them."""
    rng = random.Random(11)
    base = ["".join(rng.choices(["sen", "dor", "mi", "ka", "é", "tu", "ß"], k=rng.randint(3, 5))) for _ in range(60)]
    base = [w for w in base if len(w) >= 7]
    words = Counter({w: rng.choice([2, 30, 400, 5000]) for w in base})
    for w in base:
        for _ in range(6):
            at = rng.randrange(len(w))
            words.setdefault(rng.choice([w[:at] + w[at + 1 :], w[:at] + "x" + w[at:], w[:at] + "y" + w[at + 1 :]]), rng.choice([1, 2, 20, 41]))
    return {w: n for w, n in words.items() if n >= 2}


def test_forms_and_roots_of_invented_words(spark, invented):
    found = spelling.variants(spark.createDataFrame(list(invented.items()), "word string, n bigint"))
    expected = plain(invented)
    assert sum(row[1] is not None for row in expected) > 20
    assert result(found) == expected


def test_ties_go_to_the_first_word_and_long_chains_end(spark):
    words = {"abcdefgh": 10**7, "abcdefgx": 10**6, "abcdefyx": 10**5, "abcdzfyx": 10**4, "abwdzfyx": 1000, "abwdzfyxx": 3}
    words |= {"tttttttt": 2, "tttttttu": 20, "ttttttta": 20, "éttttttt": 20}
    found = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n bigint"))
    rows = {r["word"]: r for r in found.collect()}
    assert sorted(tuple(r) for r in rows.values()) == plain(words)
    assert rows["abwdzfyxx"]["root"] == "abcdefgh"
    assert (rows["tttttttt"]["form"], rows["tttttttt"]["n_near"]) == ("ttttttta", 3)


def test_neighbours_are_the_whole_neighbourhood_once():
    """Reduced words as tuples of symbols: every replacement by a higher symbol and every deletion, each once."""
    words = ["sendorme", "aaaaaaab", "éßéßéßé", "kakakaka"]
    reduced = spelling.Reduced(words, 4)
    symbols = [tuple(reduced.symbol[b : b + n].tolist()) for b, n in zip(reduced.begin, reduced.length)]

    def key(row):
        return int(spelling.Reduced._key(spelling_total(row), np.array([len(row)]))[0])

    def spelling_total(row):
        total = sum((s + 1) * pow(spelling.BASE, i, 1 << 64) for i, s in enumerate(row)) % (1 << 64)
        return np.array([total], np.uint64)

    found = [[] for _ in words]
    for word, keys in reduced.neighbours():
        for w, k in zip(word.tolist(), keys.tolist()):
            found[w].append(k)
    assert reduced.keys().tolist() == [key(row) for row in symbols]
    for row, keys in zip(symbols, found):
        wanted = {row[:i] + (s,) + row[i + 1 :] for i in range(len(row)) for s in range(row[i] + 1, 4)}
        wanted |= {row[:i] + row[i + 1 :] for i in range(len(row))}
        assert sorted(keys) == sorted(map(key, wanted))


@pytest.mark.parametrize("symbols", [1, 3, 8])
def test_pairs_do_not_depend_on_the_alphabet(spark, monkeypatch, symbols):
    monkeypatch.setattr(spelling, "SYMBOLS", symbols)
    rng = random.Random(3)
    words = sorted({"".join(rng.choices("abcé", k=rng.randint(4, 6))) for _ in range(80)})
    table = spark.createDataFrame([(i, w, 1) for i, w in enumerate(words)], "id bigint, word string, n bigint")
    monkeypatch.setattr(spelling.Reduced.__init__, "__defaults__", (symbols,))
    found = [tuple(sorted((r["word"], r["other"]))) for r in spelling.near_pairs(table).collect()]
    assert sorted(found) == sorted((a, b) for a in words for b in words if a < b and one_edit(a, b))


def test_words_of_odd_rows(spark, odd_rows, odd):
    rows = [(r[0], r[1]) for r in odd_rows]
    found = {r["word"]: r["n"] for r in spelling.word_counts(odd).collect()}
    assert found == plain_words(rows)
    assert {r["word"]: r["n"] for r in spelling.word_counts(odd, least_length=3, least_count=1, damage=None).collect()} == plain_words(
        rows, 3, 1, None
    )
    assert result(spelling.spelling_variants(odd)) == plain(plain_words(rows))


def test_whole_table(spark, tiny):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    assert result(queries.op11_spelling_variants(spark, tiny)) == plain(plain_words(rows))


def test_clashing_columns_and_empty_tables(spark, none):
    docs = spark.createDataFrame(
        [(1, "Wonderful wonderful Ünbelievable", 5, "x", 7), (None, None, 5, "x", 7), (1, "", 5, "x", 7)],
        "doc_id bigint, text string, _id int, _run string, word int",
    )
    assert result(spelling.spelling_variants(docs, damage=None)) == [("wonderful", None, "wonderful", 2, 0, None)]
    assert result(spelling.spelling_variants(none)) == []
