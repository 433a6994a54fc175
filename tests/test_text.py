from __future__ import annotations

import html as html_lib
import random
import time
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from gleaner.functions import markup, plain, tokens, urls
from gleaner.functions.basic import signed_difference, strip, words


@pytest.mark.parametrize(
    ("markdown", "plain"),
    [
        ("# Title #", "Title"),
        ("###### deep\n\n\ntext", "deep\ntext"),
        ("#hashtag stays", "#hashtag stays"),
        ("Head\n====\ntext", "Head\ntext"),
        ("a **bold *and* nested** word", "a bold and nested word"),
        ("stars*** after words*** stay", "stars*** after words*** stay"),
        ("snake_case stays, _this_ does not", "snake_case stays, this does not"),
        ("__strong__ ~~gone~~ `code`", "strong gone code"),
        ("[text](http://a/b_(c) \"t\") and ![alt](x.png)end", "text and end"),
        ("> quoted\n> more", "quoted\nmore"),
        ("- one\n* two\n+ three\n1. four\n2) five", "one\ntwo\nthree\nfour\nfive"),
        ("a\n\n---\n\nb\n***\nc", "a\nb\nc"),
        ("```python\nx = 1\n```", "x = 1"),
        ("a <b>tag</b> and <script>var x</script>", "a tag and var x"),
        ("<http://x.org/>", "http://x.org/"),
        ("5 &lt; 6 &amp; 7 &copy; &#233; &#x20AC;", "5 < 6 & 7 © é €"),
        ("&amp;lt; is decoded once", "&lt; is decoded once"),
        ("curly ‘quotes’ and — dashes stay", "curly ‘quotes’ and — dashes stay"),
        ("tabs\tand   spaces", "tabs and spaces"),
        (r"\*not emphasis\#", "*not emphasis#"),
        ("a *b **c *d **e *f **g** f* e** d* c** b* a", "a b c d e f g f e d c b a"),
        ("_a __b _c_ b__ a_ and __x _y_ z__", "a b c b a and x y z"),
        ("```\n<b>code</b> **x** &amp;\n- not a list\n```\nafter **it**", "<b>code</b> **x** &amp;\n- not a list\nafter it"),
        ("~~~\n# no heading\n~~~", "# no heading"),
        ("a `**b** [c](d)` - e\n- f `<i>`", "a **b** [c](d) - e\nf <i>"),
        ("```\nnever closed **x**", "never closed **x**"),
        ("[t][r] and [short] and [t][] but [other][none]\n\n[r]: http://a\n[SHORT]: <b> 'c'\n[t]: x", "t and short and t but [other][none]"),
        ("a | b\n--|--\n1 | 2\n\nx | y", "a\nb\n1\n2\nx | y"),
        ("[a [b] c](http://x) ![i [j]](k)", "a [b] c"),
        ("", ""),
    ],
)
def test_strip_markdown(value, markdown, plain):
    assert value(markup.strip_markdown("t"), t=markdown) == plain


def test_strip_markdown_table_cells(value):
    table = "| a | b |\n|---|:-:|\n| 1 | 2 |\nafter | it"
    assert value(markup.strip_markdown("t"), t=table).split() == ["a", "b", "1", "2", "after", "|", "it"]


@pytest.mark.parametrize(
    "text",
    ["&eacute;&nbsp;&hellip;", "no reference", "&", "& &; &unknown; &amp;amp;", "x&lt;y&gt;z", "&#65;&#x1F600;", "and&amp", "&copy2 &notit; &AMP;x &lt<", "&#65 B&#x41;C &#", "&eacuteX &ampamp;", "don&apos;t it&#146;s &#0; &#x110000; &#xD800; &check; &#x0000041;b &#99999999999; &#xFDD0;x &#1; &#13; &#x80;", "&#x;&#;&#xg &nosuch; &notin; &notinx &CounterClockwiseContourIntegral;"],
)
def test_unescape_agrees_with_the_standard_library(value, text):
    assert value(markup.unescape("t"), t=text) == html_lib.unescape(text)


@pytest.mark.parametrize(
    ("token", "canonical"),
    [
        ("1,400", "1400"), ("1.400", "1400"), ("1400", "1400"), ("(12%)", "12"), ("€7.50", "750"),
        ("+5%", "+5"), ("-3", "-3"), ("v1.2", "v1.2"), ("1.", "1."), ("3,", "3,"), ("(a)", "(a)"), ("(1", "1"),
    ],
)
def test_canonical_number(value, token, canonical):
    assert value(tokens.canonical_number(F.col("t")), t=token) == canonical


def test_token_set_splits_on_spaces_only(value):
    got = value(tokens.token_set("t"), t="A a\tb c d\nA 1,000 1.000 “q”")
    assert sorted(got) == sorted({"a", "a\tb", "c d", "1000", '"q"'})


def test_token_bag_splits_on_any_white_space(value):
    assert value(tokens.token_bag("t"), t="A a\tb c d e\n1,000") == ["a", "a", "b", "c", "d", "e", "1,000"]


def test_python_white_space(value):
    text = "  x y \x1c"
    assert value(strip("t"), t=text) == text.strip()
    assert value(words("t"), t=text) == text.split()


def test_visible_text(value):
    page = (
        "<head><title>The title</title><style>p{}</style><script>var t = '</p>';</script></head>"
        "<template><p>later</p></template><!-- <p>hidden</p> --><p>vis_ible [12] Text&nbsp;&amp; more!</p><script>never closed <p>x"
    )
    assert value(markup.visible_text("t"), t=page) == "the title vis ible text more"


@pytest.mark.parametrize(
    ("page", "seen"),
    [
        ("<p>a</p><ruby>x<rt>kan</ruby> important text <ruby>y<rt>ji</rt></ruby> end", "a x important text y end"),
        ("<ruby>x<rp>(<rt>kan<rp>)</ruby>y", "x y"),
        ("<p>a<rt>b</p><p>kept</p>", "a kept"),
        ("<rt>to the end", "to the end"),
        ("<a title=\"x > y\">z</a> <b title='>'>c</b> <i title=it's>d</i>", "z c d"),
        ("a<template>b", "a"),
    ],
)
def test_what_is_seen(value, page, seen):
    assert value(markup.visible_text("t"), t=page) == seen


def test_names_agree_with_the_standard_library(spark):
    texts = [f"x&{name}y" for name in html5] + [f"&#{n};" for n in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["u"] for r in df.select("t", markup.unescape("t").alias("u")).collect()}
    assert [t for t in texts if got[t] != html_lib.unescape(t)] == []


@pytest.mark.parametrize(
    "piece", ["<rt>", "<template>", "<a =", "<a b='", "*_", "[", "`", "<!--", "&#x", "a | b\n", "**a ", "> "]
)
def test_long_texts_of_open_marks_end_soon(value, piece):
    import time

    text = piece * (300_000 // len(piece))
    started = time.monotonic()
    value(markup.visible_text("t"), t=text)
    value(markup.strip_markdown("t"), t=text)
    assert time.monotonic() - started < 30


def test_strip_code(value):
    page = "a<SCRIPT x>1</script>b<style>2</style>c<noscript>3</noscript>d<!--\n4-->e"
    assert value(markup.strip_code("t"), t=page) == "a b c d e"


@pytest.mark.parametrize(
    ("url", "domain"),
    [
        ("https://WWW.Example.com:8080/a?b#c", "WWW.Example.com:8080"),
        ("http://x.org", "x.org"),
        ("http://x.org?q=1", "x.org"),
        ("not a url", ""),
    ],
)
def test_domain_of(value, url, domain):
    assert value(urls.domain_of("t"), t=url) == domain


def test_titles(value):
    page = "<TITLE lang=it>\n A &amp; B </TITLE><h1 class=x>One <i>two</i></h1><h1>three</h1>"
    assert value(urls.title_of("t"), t=page) == "A &amp; B"
    assert value(urls.title_of("t", F.lit("given")), t=page) == "given"
    assert value(urls.title_of("t", F.lit("")), t=page) == "A &amp; B"
    assert value(urls.page_context("t"), t=page).asDict() == {"title": "A & B", "heading": "One two"}
    assert value(urls.title_of("t"), t="<p>none</p>") == ""


def test_signed_difference(spark):
    rows = spark.createDataFrame([(0.5, 0.5004), (0.5, 0.7), (None, 1.0)], "a double, b double")
    got = [r[0] for r in rows.select(signed_difference("a", "b")).collect()]
    assert got[0] == 0.0 and got[1] == pytest.approx(0.2) and got[2] is None


MARKS = [
    "a", "b c", "word", " ", "  ", "\n", "\n\n", "*", "**", "***", "_", "__", "___", "`", "``", "```\n", "~~~", "~~", "|", "|-|-|", "\n|-|-|\n",
    "---|---", "# ", "- ", "1. ", "> ", "[a]", "[a](b)", "![x](y)", "[a]: http://x\n", "[a][b]", "[b]: z\n", "\\*", "\\", "&amp;", "&lt", "&#65;",
    "<b>", "</b>", "<http://x.y>", "é", "\t", "===\n", "---\n", "\xa0", "’", "x_y", "\ue0000\ue001", "&#xE000;", "İ",
]
TAGS = [
    "<p>", "</p>", "<script>", "</script>", "<style>", "</style >", "a", "b c", " ", "\n", "<!--", "-->", "<br/>", "<a href='x>y'>", "<rt>", "</rt>",
    "</ruby>", '<div class="a>b">', "<", "</", "&amp;", "&#x41;", "[12]", "x_y", "é", "İ", "²", "<template>", "</template>", "1<2", "\u0301", "٣",
]


def test_python_reads_texts_as_the_column_functions_do(spark):
    rng = random.Random(12)
    texts = ["".join(rng.choices(MARKS, k=rng.randint(1, 25))) for _ in range(1500)]
    for mark in "*_":
        texts += ["".join(rng.choices([mark, "a", " ", "b", "\n", mark * 2, mark * 3], k=rng.randint(1, 30))) for _ in range(1000)]
    pages = ["".join(rng.choices(TAGS, k=rng.randint(1, 25))) for _ in range(1500)]
    df = spark.createDataFrame(list(zip(texts, pages)), "t string, h string")
    rows = df.select("*", markup.strip_markdown("t").alias("plain"), markup.visible_text("h").alias("visible"))
    for row in rows.select("*", tokens.normalise_for_compare("plain").alias("compared"), markup.normalise("t").alias("normal")).collect():
        assert plain.strip_markdown(row["t"]) == row["plain"]
        assert plain.normalise_for_compare(row["plain"]) == row["compared"]
        assert plain.normalise(row["t"]) == row["normal"]
        assert plain.visible_text(row["h"]) == row["visible"]


def test_emphasis_of_any_depth_takes_one_pass():
    started = time.perf_counter()
    for text in ("*" * 10_000 + "a" + "*" * 10_000, "_" * 10_000 + "a" + "_" * 10_000):
        assert plain.strip_markdown(text) == "a"
    nested = "*x " * 5_000 + "y" + " x*" * 5_000
    assert plain.strip_markdown(nested) == nested.replace("*", "")
    assert time.perf_counter() - started < 5


def test_windows_line_ends():
    assert plain.strip_markdown("# Title\r\n\r\n---\r\nText **bold**\r\n").split() == ["Title", "Text", "bold"]
