from __future__ import annotations

import math
import os
import random
import tempfile
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.llm import classifier, lm, storage


def held():
    return classifier.held_out(folds=7, fold=2)


def tokens_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for b in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(b, " ")
    return [w for w in lowered.split(" ") if w] + [None]


def test_counts_and_base_scores(odd, odd_rows):
    train = Counter()
    for doc, text, *_ in odd_rows:
        if zlib.crc32(("" if doc is None else str(doc)).encode()) % 7 != 2:
            train.update(tokens_of(text))
    total, known = sum(train.values()), len(train)
    df = odd.withColumns({"score": F.lit("x"), "held_out": F.lit(1), "unit": F.lit(0)})
    got = lm.score(df, held(), unit_bytes=20_000).collect()
    assert len(got) == len(odd_rows)
    expected = []
    for doc, text, *_ in odd_rows:
        own = tokens_of(text)
        base = sum(math.log10((train[t] + 1) / (total + known + 1)) for t in own)
        expected.append((doc, len(own), sum(train[t] > 0 for t in own), total, round(base, 6)))
    assert sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=repr) == sorted(expected, key=repr)
    assert all(r["score"] < 0 for r in got)


def test_units_do_not_change_what_is_counted_and_reruns_agree(odd):
    one = {(r["doc_id"], r["n_tokens"]): r for r in lm.score(odd, held()).collect()}
    two = {(r["doc_id"], r["n_tokens"]): r for r in lm.score(odd.repartition(2), held()).collect()}
    assert {k: r["score"] for k, r in one.items()} == pytest.approx({k: r["score"] for k, r in two.items()})
    many = {(r["doc_id"], r["n_tokens"]): r for r in lm.score(odd, held(), unit_bytes=5_000).collect()}
    for key, row in one.items():
        assert many[key]["n_known"] == row["n_known"]
        assert many[key]["base_score"] == pytest.approx(row["base_score"])
    # Other units draw other seats; over a corpus of this size the scores agree to a hundredth or so.
    assert sum(r["score"] for r in many.values()) == pytest.approx(sum(r["score"] for r in one.values()), rel=0.02)


def test_held_out_texts_are_likelier_than_by_frequency(spark):
    rng = random.Random(1)
    follow = {w: rng.sample(range(40), 4) for w in range(40)}
    docs = []
    for i in range(400):
        word, text = rng.randrange(40), []
        for _ in range(60):
            text.append(f"w{word:02d}")
            word = rng.choice(follow[word])
        docs.append((i, " ".join(text)))
    rows = lm.score(spark.createDataFrame(docs, "doc_id int, text string"), held()).where("held_out").collect()
    base = 10 ** (-sum(r["base_score"] for r in rows) / sum(r["n_tokens"] for r in rows))
    model = 10 ** (-sum(r["score"] for r in rows) / sum(r["n_tokens"] for r in rows))
    assert base > 30 and model < 8


def small_share():
    rng = random.Random(4)
    words = np.arange(12, dtype=np.uint64) + np.uint64(5)
    pairs = sorted({(rng.randrange(12), rng.randrange(lm.CONTEXTS)) for _ in range(60)})
    of, context = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    words, of = words[np.unique(of)], np.unique(of, return_inverse=True)[1]
    count = np.array([rng.choice([1, 1, 2, 3, 70, 500]) for _ in pairs])
    return lm.Share(0, words, of, context, count)


def test_probabilities_of_a_context_add_up_to_one():
    share = small_share()
    seen = np.bincount(share.context, share.count, minlength=lm.CONTEXTS + 1).astype(float)
    tables = np.bincount(share.context, minlength=lm.CONTEXTS + 1).astype(float)
    totals = lm.Totals(seen, len(share.word), (0.6, 0.4), [tables], [len(share.count)], [len(share.word)])
    for sweep in range(3):
        last = None
        for last in lm.seat(share, totals, sweep + 1, seed=1):
            pass
        own, guests, roots = last
        assert ((own >= 1) & (own <= share.count)).all() and ((roots >= 1) & (roots <= guests)).all()
        assert (guests == np.bincount(share.of, own)).all()
        totals.tables.append(np.bincount(share.context, own, minlength=lm.CONTEXTS + 1).astype(float))
        totals.guests.append(int(guests.sum()))
        totals.roots.append(int(roots.sum()))
        root = totals.root(sweep + 1, guests, roots)
        unknown = totals.root(sweep + 1, np.zeros(1), np.zeros(1))[0]
        assert root.sum() + unknown == pytest.approx(1)
        back = totals.backoff(sweep + 1)
        for context in np.unique(share.context):
            here = share.context == context
            direct = ((share.count[here] - 0.6 * own[here]) / (lm.STRENGTH + seen[context])).sum()
            assert direct + back[context] * (root.sum() + unknown) == pytest.approx(1)


def test_tables_follow_their_distribution():
    discount, opening, customers = 0.5, 0.8, 6
    weights = {}

    def seat(sizes, weight, left):
        if not left:
            weights[len(sizes)] = weights.get(len(sizes), 0) + weight
            return
        for i, s in enumerate(sizes):
            seat(sizes[:i] + [s + 1] + sizes[i + 1 :], weight * (s - discount), left - 1)
        seat(sizes + [1], weight * opening, left - 1)

    seat([1], opening, customers - 1)
    total = sum(weights.values())
    drawn = lm.draw_tables(
        np.full(40_000, customers), np.full(40_000, opening), discount, lm.log_stirling(discount), np.random.default_rng(0)
    )
    for tables, weight in weights.items():
        assert (drawn == tables).mean() == pytest.approx(weight / total, abs=0.01)


def test_many_customers_continue_where_the_exact_draw_ends():
    random_ = np.random.default_rng(0)
    stirling = lm.log_stirling(0.5)
    means = [lm.draw_tables(np.full(4_000, c), np.full(4_000, 2.0), 0.5, stirling, random_).mean() for c in (64, 65, 80, 200, 100_000)]
    assert all(a <= b + 0.2 for a, b in zip(means, means[1:])) and means[1] - means[0] < 0.5
    assert (lm.draw_tables(np.array([1, 1]), np.array([9.0, 0.1]), 0.5, stirling, random_) == 1).all()


def test_contexts_are_endings():
    words = lm.split_words(pa.array(["walking talking king ing a the bathe"]), lm.BLANK_LOWER)
    ends = lm.endings(words).tolist()
    assert ends[0] == ends[1] == ends[2] and ends[3] != ends[2] and ends[5] != ends[6]


def test_edges(spark, none):
    assert lm.score(none, held()).collect() == []
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id int, text string")
    rows = {r["doc_id"]: r for r in lm.score(df, F.lit(True)).collect()}
    assert (rows[1]["n_tokens"], rows[1]["n_known"], rows[1]["train_tokens"], rows[1]["base_score"]) == (3, 0, 0, 0.0)
    assert rows[2]["n_tokens"] == 1


def test_words_that_end_alike_are_contexts_of_their_own(spark):
    docs = [(i, "walking stick " * 20 if i % 2 else "talking heads " * 20) for i in range(40)]
    docs += [(100, "walking stick"), (101, "walking heads"), (102, "talking heads"), (103, "talking stick")]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    score = {r["doc_id"]: r["score"] for r in lm.score(df, F.col("doc_id") >= 100, unit_bytes=2_000).collect()}
    assert score[100] > score[101] + 1 and score[102] > score[103] + 1


def test_probabilities_after_a_word_add_up_to_one():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["walking", "talking", "king", "a", "b", "cd"]) for _ in range(60)) for _ in range(30)]
    asked = [f"{u} {w}" for u in ("walking", "king", "a", "thing") for w in ("walking", "talking", "king", "a", "b", "cd", "thing")]
    asked += ["walking", "king", "a", "thing"]
    table = pa.table({
        "unit": pa.array([0] * (len(texts) + len(asked)), pa.int32()), "_text": texts + asked,
        "_held": [False] * len(texts) + [True] * len(asked),
    })
    rows = lm.stated(1)(table).to_pylist()
    share, found = lm.added_up(0, rows)
    below = share.below
    below.seen = lm.per_context(below, below.count).astype(float)
    below.totals = [np.bincount(below.at, minlength=len(below.context)).astype(float)]
    classes = lm.CONTEXTS + 1
    totals = lm.Totals(
        np.bincount(share.context, np.bincount(below.group, below.count), minlength=classes), len(share.word), (0.6, 0.4),
        [np.bincount(share.context, minlength=classes).astype(float)], [len(share.count)], [len(share.word)],
        [np.bincount(share.context, share.count, minlength=classes).astype(float)], 0.3,
    )
    for sweep in range(2):
        for tables, guests, roots in lm.seat(share, totals, sweep + 1, 1):
            pass
        assert ((below.tables >= 1) & (below.tables <= below.count)).all() and (share.count == np.bincount(below.group, below.tables)).all()
        below.totals.append(lm.per_context(below, below.tables).astype(float))
        totals.tables.append(np.bincount(share.context, tables, minlength=classes).astype(float))
        totals.customers.append(np.bincount(share.context, share.count, minlength=classes).astype(float))
        totals.guests.append(int(guests.sum()))
        totals.roots.append(int(roots.sum()))
    chance = lm.predicted(share, found, totals, 1, 1, 1)
    # All known words, one unknown, and the end of a text.
    words = lm.split_words(pa.array(["walking king a thing"]), lm.BLANK_LOWER)
    after = lm.context_of(lm.endings(words), words.hashes())
    for context in after:
        here = below.context[found.at] == context
        assert here.sum() == 8 and chance[here].sum() == pytest.approx(1)


def test_pairs_are_packed_and_read_back():
    rng = np.random.default_rng(2)
    for kind in (np.uint64, np.uint32):
        values = rng.integers(0, np.iinfo(kind).max, 1000, dtype=kind)
        values[:500].sort()
        assert (lm.unpacked_runs(lm.packed_runs(values), kind, 1000) == values).all()
        assert len(lm.unpacked_runs(lm.packed_runs(values[:0]), kind, 0)) == 0


def test_familiar_hashes_are_stated_by_their_places():
    rng = np.random.default_rng(5)
    ends = np.array([0, (1 << 64) - 1], np.uint64)
    values = np.unique(np.concatenate((rng.integers(0, 1 << 64, 5_000, dtype=np.uint64), ends)))
    for familiar in (values[:0], values[::3], values, np.unique(rng.integers(0, 1 << 64, 900, dtype=np.uint64)), values[-1:], values[:1]):
        for part in (values, values[::2], values[:0], values[-1:], values[:1]):
            data = lm.packed_listed(part, familiar)
            assert (lm.unpacked_listed(data, familiar, len(part)) == part).all()
    assert len(lm.packed_listed(values, values)) * 8 < len(lm.packed_listed(values, values[:0]))
    floats = -rng.random(1_000).astype(np.float32)
    assert (lm.unpacked_floats(lm.packed_floats(floats), np.float32, 1_000) == floats).all()


def zipf_texts(count):
    rng = np.random.default_rng(6)
    return [" ".join(f"{w:x}" for w in (10_000 * rng.random(400) ** 4).astype(int)) for _ in range(count)]


def stated_bytes(shares, familiar):
    rows = lm.stated(shares, familiar)(pa.table({"unit": pa.array([0] * 200, pa.int32()), "_text": zipf_texts(200), "_held": [False] * 200}))
    return sum(len(row[c]) for row in rows.to_pylist() for c in ("words", "contexts")), rows.to_pylist()


def test_what_a_unit_states_hardly_grows_with_the_shares():
    token, context, _ = lm.unit_tokens(pa.table({"_text": zipf_texts(300)[100:]}))
    familiar = lm.Familiar(lm.most_frequent(token), lm.most_frequent(context))
    few, one = stated_bytes(4, familiar)
    many, rows = stated_bytes(40, familiar)
    plain, same = stated_bytes(40, lm.STRANGERS)
    assert many < plain / 3
    for row, other in zip(rows, same, strict=True):
        share, asked = lm.added_up(row["share"], [row], familiar)
        left, right = lm.added_up(row["share"], [other])
        assert (share.word == left.word).all() and (share.below.context == left.below.context).all()
        assert (share.below.count == left.below.count).all() and (asked.pair == right.pair).all()


def test_texts_are_packed_and_read_back():
    texts = ["a b " * 40_000, None, "", "c " * 50_000, "d"] + ["words of a text " * 50] * 400
    table = pa.table({"_id": pa.array(range(len(texts)), pa.int64()), "_text": texts, "_held": [False] * len(texts)})
    bundles = pa.Table.from_batches(lm.bundled(table.to_batches()))
    assert lm.unbundled(bundles).to_pylist() == table.to_pylist()
    sizes = [pa.ipc.open_stream(b).read_all().column("_text") for b in bundles.column("texts").to_pylist()]
    assert all(len(s) == 1 or sum(len(t or "") for t in s.to_pylist()) <= lm.BUNDLE_BYTES for s in sizes)
    assert bundles.nbytes < table.nbytes / 10


def test_shuffled_rows_leave_the_disk_once_they_are_kept(spark):
    folder = os.environ.get("SPARK_LOCAL_DIRS") or spark.sparkContext.getConf().get("spark.local.dir", tempfile.gettempdir())

    def shuffled():
        return set(Path(folder).glob("blockmgr-*/*/shuffle_*"))

    before = shuffled()
    plain = spark.range(1_000).repartition(3, "id")
    storage.durable(plain)
    between = shuffled()
    assert between - before
    kept = storage.dealt_by(spark.range(1_000), 3, "id")
    until = time.time() + 20
    while shuffled() - between and time.time() < until:
        time.sleep(0.1)
    assert not shuffled() - between and kept.count() == 1_000


def test_scores_are_the_same_whatever_is_familiar(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(zipf_texts(60))), "doc_id int, text string")
    with_ = sorted(lm.score(docs, held(), unit_bytes=30_000).collect())
    monkeypatch.setattr(lm, "familiar_of", lambda dealt: lm.STRANGERS)
    assert sorted(lm.score(docs, held(), unit_bytes=30_000).collect()) == with_
