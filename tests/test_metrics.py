from __future__ import annotations

import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleaner.functions import markup
from gleaner.operators import metrics, scorer, windows
from gleaner.operators.metrics import METRICS, with_scores


def plain_scores(parsed: str, gold: str) -> dict[str, float]:
    """The definitions stated in plain Python, for texts without markdown or numbers."""
    p, g = parsed.lower(), gold.lower()
    ps, gs = ({t for t in x.replace("\n", " ").split(" ") if t} for x in (p, g))
    precision = len(ps & gs) / len(ps) if ps else 0.0
    recall = len(ps & gs) / len(gs) if gs else 0.0
    f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
    pc, gc = Counter(p.split()), Counter(g.split())
    if not pc or not gc:
        return dict(precision=precision, recall=recall, f1=f1, cosine=0.0, jaccard=0.0, excess_ratio=0.0)
    dot = sum(n * gc[w] for w, n in pc.items())
    norm = math.sqrt(sum(n * n for n in pc.values())) * math.sqrt(sum(n * n for n in gc.values()))
    return dict(
        precision=precision,
        recall=recall,
        f1=f1,
        cosine=dot / norm,
        jaccard=len(set(pc) & set(gc)) / len(set(pc) | set(gc)),
        excess_ratio=1 - sum((pc & gc).values()) / sum(pc.values()),
    )


def random_pairs(count: int) -> list[tuple[str, str]]:
    rng = random.Random(7)
    vocabulary = ["alpha", "Beta", "gamma", "delta", "é", "ß", "x-y", " ", "zeta eta"]

    def text() -> str:
        return rng.choice([" ", "\n", "  "]).join(rng.choices(vocabulary, k=rng.randint(0, 30)))

    return [(text(), text()) for _ in range(count)]


def test_scores_agree_with_the_definitions(spark):
    pairs = random_pairs(200)
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, parsed_text string, gold_text string")
    rows = {r["i"]: r for r in with_scores(df).collect()}
    for i, (parsed, gold) in enumerate(pairs):
        expected = plain_scores(parsed.strip(), gold.strip())
        for name in METRICS:
            assert rows[i][name] == pytest.approx(expected[name], abs=1e-9), (i, name, parsed, gold)


def test_zero_guards_and_missing_gold(spark):
    df = spark.createDataFrame(
        [("", "x"), ("x", ""), ("", ""), (None, "x"), ("x", None)], "parsed_text string, gold_text string"
    )
    rows = with_scores(df).collect()
    for row in rows[:3]:
        assert [row[m] for m in METRICS] == [0.0] * 6
    # Nothing was measured without a gold text or without an extraction.
    for row in rows[3:]:
        assert [row[m] for m in METRICS] == [None] * 6


def test_properties(spark):
    pairs = random_pairs(100)
    there = spark.createDataFrame(pairs, "parsed_text string, gold_text string")
    back = spark.createDataFrame([(g, p) for p, g in pairs], "parsed_text string, gold_text string")
    for row in with_scores(there).collect():
        assert all(0 <= row[m] <= 1 + 1e-9 for m in METRICS)
        assert row["f1"] <= max(row["precision"], row["recall"]) + 1e-9
    swapped = {(r["gold_text"], r["parsed_text"]): (r["recall"], r["precision"]) for r in with_scores(back).collect()}
    for row in with_scores(there).collect():
        assert swapped[(row["parsed_text"], row["gold_text"])] == (row["precision"], row["recall"])


def test_numbers_and_quotes_compare_equal(value):
    got = value(metrics.token_level("p", "g"), p="It’s **1,400** – (12%)", g="it's 1.400 - 12")
    assert got["f1"] == 1.0 and got["extracted_count"] == 4


PAGE = "<p>The quick brown fox jumps over the lazy dog while seven wizards watch, amused.</p><script>secret text of scripts only</script>"


@pytest.mark.parametrize(
    ("markdown", "expected"),
    [
        ("short\nlines only", None),
        ("", None),
        ("**The quick brown fox** jumps over the lazy dog while seven wizards watch", 1.0),
        ("The quick brown fox jumps over the lazy cat while seven wizards watch amused by it", 1.0),
        ("Nothing in this sentence can be found anywhere on the page at all", 0.0),
        ("secret text of scripts only, padded with forty characters", 0.0),
        (
            "The quick brown fox jumps over the lazy dog\nan invented line that is long enough to count here",
            0.5,
        ),
        ("-" * 45, 1.0),
        ("quick-brown-fox-jumps-over ........................", 1.0),
    ],
)
def test_grounding(value, markdown, expected):
    assert value(metrics.grounded_fraction("m", "h"), m=markdown, h=PAGE) == expected


def test_grounding_agrees_with_the_definition(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = []
    for _ in range(60):
        page = " ".join(rng.choices(vocabulary, k=120)).split()
        lines = []
        for _ in range(6):
            at = rng.randint(0, 100)
            line = page[at : at + rng.randint(3, 18)]
            if rng.random() < 0.6:
                line = [w if rng.random() < 0.8 else "zzz" for w in line]
            lines.append(" ".join(line).ljust(41, "."))
        rows.append((" ".join(page), "\n".join(lines)))

    def anchored(line: str, page: str) -> bool:
        parts = line.replace(".", " ").split()
        if len(parts) < 8:
            return " ".join(parts) in page
        return any(" ".join(parts[i : i + 8]) in page for i in range(len(parts) - 7))

    df = spark.createDataFrame([(i, f"<p>{p}</p>", m) for i, (p, m) in enumerate(rows)], "i int, h string, m string")
    got = {r["i"]: r["g"] for r in df.select("i", metrics.grounded_fraction("m", "h").alias("g")).collect()}
    for i, (page, markdown) in enumerate(rows):
        lines = markdown.split("\n")
        assert got[i] == pytest.approx(sum(anchored(x, page) for x in lines) / len(lines))


def test_quote_verdicts(value):
    quotes = F.array(
        F.lit("  seven wizards watch, amused "),
        F.lit("the quick brown fox jumps over the lazy dog"),
        F.lit("a sentence the page never had in it"),
        F.lit("never said"),
        F.lit("   "),
    )
    checks = value(
        metrics.check_quotes(quotes, F.lit("the quick brown fox jumps over the lazy dog"), F.col("h")), h=PAGE
    )
    assert [(c["quote"], c["verdict"]) for c in checks] == [
        ("seven wizards watch, amused", "confermata"),
        ("the quick brown fox jumps over the lazy dog", "presente"),
        ("a sentence the page never had in it", "inventata"),
        ("never said", "troppo corta"),
    ]
    assert value(metrics.confirmed_omissions(metrics.check_quotes(quotes, F.lit("x"), F.col("h"))), h=PAGE) == 2
    assert value(metrics.is_complete(metrics.check_quotes(F.lit(None).cast("array<string>"), F.lit("x"), F.col("h"))), h=PAGE)


def test_judge_previews_are_cut_after_stripping(spark):
    df = spark.createDataFrame([("**" + "a" * 1500 + "**", "# short")], "parsed_text string, gold_text string")
    row = metrics.judge_previews(df).first()
    assert row["parsed_preview"] == "a" * 1000 and row["gold_preview"] == "short"


def plain_anchor(passage, text, size):
    words = passage.split(" ") if passage else []
    if len(words) < size:
        return passage in text
    return any(" ".join(words[i : i + size]) in text for i in range(len(words) - size + 1))


def test_windows_are_found_as_a_search_for_strings_finds_them(monkeypatch):
    rng = random.Random(3)
    words = ["a", "b", "ab", "ba", "aab", "c"]
    for scans in (0, 32):
        monkeypatch.setattr(windows, "SCANS", scans)
        for _ in range(600):
            text = " ".join(rng.choices(words, k=rng.randint(0, 60)))
            index = windows.WindowIndex(text)
            for _ in range(6):
                at = rng.randrange(len(text) + 1)
                passage = text[at : at + rng.randint(1, 30)].strip(" ") + rng.choice(["", " c", " ab ab"])
                for size in (1, 2, 3, 5, 8):
                    assert index.anchors(passage.strip(" "), size) == plain_anchor(passage.strip(" "), text, size)


def test_lookups_grow_with_the_page():
    """Foreign lines of a page of megabytes: four times the text takes about four times as long, not sixteen."""
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(20_000)]

    def seconds(scale):
        text = " ".join(rng.choices(vocabulary, k=60_000 * scale))
        lines = [" ".join(rng.choices(vocabulary, k=12)) for _ in range(1500 * scale)]
        started = time.perf_counter()
        assert not any(windows.anchored_in(lines, text, 8))
        return time.perf_counter() - started

    seconds(1)
    assert seconds(4) < 10 * max(seconds(1), 0.05)
    # A text of one sentence over and over has few distinct runs.
    started = time.perf_counter()
    windows.anchored_in([f"x the cat sat on the cat sat on y{i}" for i in range(1000)], "the cat sat on " * 100_000 + "end", 8)
    assert time.perf_counter() - started < 20


def test_both_scorers_against_plain_counts():
    rng = random.Random(8)
    for _ in range(300):
        parsed, gold = (" ".join(rng.choices(["a", "b", "c", "1,400", "1.400", "(12%)", "d\te"], k=rng.randint(0, 30))) for _ in range(2))
        one, other = Counter(parsed.split()), Counter(gold.split())
        got = dict(zip(scorer.SCORES.names, scorer.score_pair(parsed, gold)))
        sets = [{{"1,400": "1400", "1.400": "1400", "(12%)": "12"}.get(t, t) for t in re.split("[ \n]", x.replace("\t", " ")) if t} for x in (parsed, gold)]
        assert (got["extracted_count"], got["sample_count"], got["intersection_count"]) == (*map(len, sets), len(sets[0] & sets[1]))
        if one and other:
            dot = sum(one[w] * other[w] for w in one)
            assert got["cosine"] == pytest.approx(dot / (sum(n * n for n in one.values()) * sum(n * n for n in other.values())) ** 0.5)
            assert got["jaccard"] == pytest.approx(len(one.keys() & other.keys()) / len(one.keys() | other.keys()))
            assert got["excess_ratio"] == pytest.approx(1 - (one & other).total() / one.total())
        else:
            assert got["cosine"] == got["jaccard"] == got["excess_ratio"] == 0.0


def test_arguments_may_hold_nested_lambdas(spark):
    """Texts made by column functions with lambdas in lambdas reach the Python scorers."""
    df = spark.createDataFrame([("a *b* c &amp; d", "<p>a b c &amp; d and so on, a line of more than forty characters</p>")], "m string, h string")
    made = df.select(markup.strip_markdown("m").alias("parsed_text"), markup.unescape("h").alias("html_text"))
    row = made.select(metrics.all_scores("parsed_text", "parsed_text").f1.alias("f1")).first()
    assert row["f1"] == 1.0
    assert made.select(metrics.grounded_fraction("html_text", "html_text").alias("g")).first()["g"] == 1.0
    assert with_scores(made.select("parsed_text", F.col("html_text").alias("gold_text"))).first()["f1"] > 0
