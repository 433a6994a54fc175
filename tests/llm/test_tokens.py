from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gleaner.llm import queries, tokens

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(queries.tokenizer_path())


def test_counts_agree_with_the_library(library):
    rng = random.Random(1)
    texts = ["", "a" * 1000, " " * 50, "x<|endoftext|> y<|endoftext|><|endoftext|>", "it's I'LL ''s", "日本語 👩‍👩‍👧 ½Ⅷ", "  \x85\x1c\x1f \x0b a"]
    texts += [f"a{chr(c)}b {chr(c)}{chr(c)}1" for c in range(0, 0x3000)]
    texts += ["".join(rng.choice("ab e1'\n\t .the<|>ción") for _ in range(rng.randint(0, 200))) for _ in range(500)]
    texts.append("".join(rng.choice("abcdefgh") for _ in range(20_000)))
    counter = tokens.Counter(tokens.load_vocabulary(queries.tokenizer_path()), remembered=2_000)
    got = [n for at in range(0, len(texts), 100) for n in counter.count(texts[at : at + 100])]
    assert got == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_rows(odd, odd_rows, library):
    df = odd.withColumns({"n_tokens": F.lit(-1), "_text": F.lit("x"), "over_limit": F.lit(None)})
    got = sorted((tuple(r) for r in tokens.count_tokens(df, queries.tokenizer_path(), limit=100).collect()), key=repr)
    counts = [len(e.ids) for e in library.encode_batch([r[1] or "" for r in odd_rows], add_special_tokens=False)]
    assert got == sorted(((r[0], len((r[1] or "").encode()), n, n > 100) for r, n in zip(odd_rows, counts)), key=repr)


def test_empty_table(none):
    assert tokens.count_tokens(none, queries.tokenizer_path()).collect() == []


def test_other_kinds_of_vocabulary_are_refused(tmp_path):
    import json

    spec = json.load(open(queries.tokenizer_path(), encoding="utf-8"))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "t.json"
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="plain byte-level"):
        tokens.load_vocabulary(str(path))


def test_long_pretokens_are_not_remembered(spark):
    vocabulary = tokens.load_vocabulary(queries.tokenizer_path())
    counter = tokens.Counter(vocabulary)
    texts = ["short words", "y" * 500 + " short", "short " + "y" * 500, "y" * 500]
    fresh = [tokens.Counter(vocabulary).count([t])[0] for t in texts]
    assert [counter.count([t])[0] for t in texts] == fresh == counter.count(texts)
    assert max(map(len, counter.known)) <= tokens.LONGEST
