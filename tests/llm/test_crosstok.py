from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from llm_helpers import prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleaner.llm import crosstok, queries

BYTES, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
PARTS = [
    "a", "foo", " ", "  ", "\n", "\t", "\r\n", "\xa0", "é", "ﬁ", "½", "漢字", "🙂", "<s>", "<|endoftext|>", "12345", " ", "\x1c",
    "\x00", "…", "don't", "xxxxxxxx", "▁", "!", "Å", "　", "=", "==", "--- ", "{\r",
]


@pytest.fixture(scope="module")
def plain():
    """A text's groups by the libraries and sets of ends; None if a library does not give the text back."""
    library = Tokenizer.from_file(BYTES)
    library.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    one, other = crosstok.byte_level(crosstok.content(BYTES)), crosstok.pieces(crosstok.content(PIECES))

    def groups(text):
        if not text:
            return None
        sides = [(one, library.encode(" " + text, add_special_tokens=False).ids), (other, model.encode(text))]
        ends = []
        for tokenizer, ids in sides:
            tokens = [tokenizer.data[tokenizer.first[i] : tokenizer.first[i + 1]].tobytes() for i in ids]
            if b"".join(tokens) != (" " + text).encode():
                return None
            ends.append(np.cumsum([len(t) for t in tokens]).tolist())
        shared = set(ends[0]) & set(ends[1])
        halves = []
        for (_, ids), end in zip(sides, ends):
            half = [[]]
            for number, e in zip(ids, end):
                half[-1].append(number)
                if e in shared:
                    half.append([])
            halves.append(half[:-1])
        return list(zip(*halves))

    return groups


def written(groups) -> str:
    return ";".join("|".join(",".join(map(str, side)) for side in group) for group in groups or [])


def table(plain, rows):
    """What the query returns, by plain loops."""
    found = [(i, plain(t)) for i, t in rows]
    linked = [Counter((a, b) for one, other in g or [] for a in one for b in other) for _, g in found]
    counts = Counter(pair for links in linked for pair in links)
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for (i, g), links in zip(found, linked):
        out.append((
            i, sum(len(x) for x, _ in g or []), sum(len(x) for _, x in g or []), len(g or []), sum(links.values()),
            hashlib.sha256(written(g).encode()).hexdigest() if g else "",
            sum(n for p, n in links.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in links.items()),
        ))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum")


def result(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_groups_and_links_of_odd_texts_in_lanes_of_any_size(plain):
    rng = random.Random(5)
    texts = ["", "a ", " ", "  ", " a", "\n", " \n", "x" * 700, "ab" * 400, "a b" * 300]
    texts += ["".join(rng.choices(PARTS, k=rng.randint(1, 30))) for _ in range(500)]
    one, other = crosstok.byte_level(crosstok.content(BYTES)), crosstok.pieces(crosstok.content(PIECES))
    for lane in (1, 5, 2048):
        found = crosstok.Aligner(one, other, lane).align(texts)
        for n, text in enumerate(texts):
            groups = plain(text)
            bounds, pairs = found["pairs"]
            times = found["times"][1]
            links = Counter(a * other.size + b for x, y in groups or [] for a in x for b in y)
            here = slice(bounds[n], bounds[n + 1])
            assert found["groups"][n] == written(groups), text
            assert dict(zip(pairs[here].tolist(), times[here].tolist())) == dict(links), text
            assert found["n_links"][n] == sum(links.values())


def test_wide_groups_are_counted_by_distinct_ids(monkeypatch):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 9, 60), rng.integers(0, 7, 50)
    ends_a, ends_b, text = np.array([3, 30, 60]), np.array([10, 11, 50]), np.array([0, 1, 1])
    whole = crosstok.linked_pairs(text, a, ends_a, b, ends_b, 9, 7)
    monkeypatch.setattr(crosstok, "WIDE_GROUP", 20)
    monkeypatch.setattr(crosstok, "LINKS_AT_ONCE", 4)
    cut = crosstok.linked_pairs(text, a, ends_a, b, ends_b, 9, 7)
    assert [x.tolist() for x in whole] == [x.tolist() for x in cut]
    assert whole[1].sum() == 3 * 10 + 27 + 30 * 39


def test_units_are_remembered_but_long_ones(monkeypatch):
    one, other = crosstok.byte_level(crosstok.content(BYTES)), crosstok.pieces(crosstok.content(PIECES))
    encoder = crosstok.Encoder(one, other, remembered=2)
    texts = ["a b c", "d " + "y" * 100, "a d " + "y" * 100 + " b"]
    for _ in range(2):
        for text in texts:
            fresh = crosstok.Encoder(one, other).encode([text])
            for (ids, first), (wanted, begins) in zip(encoder.encode([text]), fresh):
                assert ids.tolist() == wanted.tolist() and first.tolist() == begins.tolist()
            assert all(len(u) <= crosstok.LONGEST for u in encoder.place)


@pytest.mark.parametrize("most", [crosstok.BROADCAST_PAIRS, 0])
def test_query_columns_against_plain_loops(spark, plain, odd_rows, odd, most):
    found = crosstok.align(odd, BYTES, PIECES, digest=True, broadcast_pairs=most)
    assert result(found) == table(plain, [(r[0], r[1]) for r in odd_rows])


def test_whole_table(spark, plain, tiny):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    found = queries.op13_cross_tokenizer(spark, tiny).withColumnRenamed("groups_sha256", "groups")
    assert result(found) == table(plain, rows)


def test_clashing_columns_and_empty_table(spark, none):
    rng = random.Random(2)
    docs = spark.createDataFrame([(1, prose(rng, 20), 5, "x", 7), (1, None, 5, "x", 7)], "doc_id bigint, text string, _id int, groups string, pair int")
    found = crosstok.align(docs, BYTES, PIECES)
    assert found.columns == list(COLUMNS)
    assert sorted(r["n_groups"] > 0 for r in found.collect()) == [False, True]
    assert crosstok.align(none, BYTES, PIECES).count() == 0
    assert crosstok.align(none, BYTES, PIECES, broadcast_pairs=-1).count() == 0


def test_best_partner_is_the_lower_of_ties(spark):
    counts = spark.createDataFrame([(0 * 10 + 3, 5), (0 * 10 + 2, 5), (0 * 10 + 9, 1), (4 * 10 + 0, 2)], "pair bigint, n bigint")
    assert sorted(map(tuple, crosstok.best_partners(counts, 10).collect())) == [(0, 2, 5), (4, 0, 2)]
    assert crosstok.pair_counts(spark.createDataFrame([([1, 2],), ([2],)], "pairs array<bigint>")).where(F.col("pair") == 2).first()["n"] == 2
