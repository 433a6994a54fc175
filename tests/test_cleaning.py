from __future__ import annotations

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from gleaner.operators import rules
from gleaner.operators.cleaning import Cleaners, apply_pack, heading_text, with_cleaned, without_trailing_blanks
from gleaner.operators.html_markdown import to_markdown, with_markdown
from gleaner.operators.rules import ENCYCLOPEDIA, FINANCE, NEWS, SPORTS


def cleaner(value, pack):
    def run(markdown, url="https://x/"):
        return value(apply_pack("m", F.lit(url), pack), m=markdown)

    return run


def test_encyclopedia(value):
    clean = cleaner(value, ENCYCLOPEDIA)
    text = (
        "[Vai al contenuto](#c)\n# Voce\nTesto[1] con [link](/a_(b) \"t\") , nota[N 2] e [1912] resta.\n"
        "![foto](x.png)\n[modifica]\n  ![altra](y.png)\n## Note storiche\nresta\n\n  \n## NOTE \nvia"
    )
    assert clean(text) == "# Voce\nTesto con link, nota e [1912] resta.\n## Note storiche\nresta"


def test_news(value):
    clean = cleaner(value, NEWS)
    text = (
        "# Head\n**Firm supplies** ** ** : parts\nRead more: x\n[Only](http://l)\n[Photo: y]\n"
        "Text with [a link](http://l) in it\nsee CNBC's new online course\n**WATCH:** z\n\n"
        "**Want to know more?**\nafter\n\n_Want to leave_\ntail"
    )
    assert clean(text) == (
        "# Head\nFirm supplies: parts\nText with [a link](http://l) in it\n\nWant to know more?\nafter"
    )
    assert clean("a\n## Related content today\nb") == "a"
    assert clean("Want to go?\nb") == ""


def test_sports(value):
    clean = cleaner(value, SPORTS)
    text = "intro\n## Stats\nrow\n*caption*\n**- [Promo](http://x)**\nkept *not caption* here\n\n- [Terms of Use](http://t)\nout"
    assert clean(text) == "intro\n## Stats\nrow\nkept *not caption* here"
    assert clean(text, "https://www.espn.com/nba/player/stats/_/id/1") == "Stats\nrow\nkept *not caption* here"
    assert clean("no heading\nhere", "https://www.espn.com/player/stats/x") == ""
    assert clean("Stats\nStats\nb", "https://www.espn.com/player/stats/x") == "Stats\nStats\nb"
    # The wait for the statistics also skips what would otherwise end the page.
    assert clean("Privacy Policy\nstats\na", "https://www.espn.com/player/stats/x") == "Stats\na"


def test_finance(value):
    clean = cleaner(value, FINANCE)
    text = (
        "![Xe](http://i/logo-xe.svg)**Rate** , now  \nEuroEUR![flag](f.png) rates[Send](http://s)\n| a | b |\n"
        "| --- | --- |\n| 1 |  | 2 |\n* * *\n___\nAdd currency\nWe use the mid-market rate here\n"
        "## Compare and Save\n[ Speak to an FX specialist](x)\nlast\n\nTrusted by\nout"
    )
    assert clean(text) == "**Rate**, now\nEuro EURflag rates\n[Send](http://s)\na\nb\n1\n2\nlast"


def test_dispatch(spark):
    df = spark.createDataFrame(
        [
            ("http://IT.wikipedia.org/x", "a[1]\n## Note\nb"),
            ("http://unknown.org/x", "a[1]\n## Note\nb"),
            ("http://mine.org/x", "a"),
            ("nonsense", "c[1]"),
        ],
        "url string, markdown string",
    )
    cleaners = Cleaners()
    cleaners.register("mine.org", lambda markdown, url: F.upper(markdown))
    got = [r[0] for r in df.select(cleaners.clean("markdown", "url")).collect()]
    assert got == ["a", "a[1]\n## Note\nb", "A", "c[1]"]


def test_line_helpers(value):
    assert value(heading_text(F.col("t")), t="##  Head  ") == "head"
    assert value(heading_text(F.col("t")), t=" # not at the start") is None
    assert value(without_trailing_blanks(F.split("t", "\n")), t="a\n\nb\n \n") == ["a", "", "b"]
    assert value(without_trailing_blanks(F.split("t", "\n")), t=" \n") == []


@pytest.mark.parametrize(
    ("html", "markdown"),
    [
        ("<h2>A <b>b</b></h2><p>x<p>y", "## A **b**\n\nx\n\ny"),
        ("<ul><li>a<li>b<ol><li>c</ol></ul>", "* a\n* b\n  1. c"),
        ("<table><tr><th>a<th>b<tr><td>1<td>2</table>", "| a | b |\n| --- | --- |\n| 1 | 2 |"),
        ("<p>t <a href='/u'>l</a> &amp; <img src=i.png alt=z>", "t [l](/u) & ![z](i.png)"),
        ("<title>t</title><script>var a='</p>'</script>text<style>s</style>", "text"),
        ("a<br>b<hr>c", "a\nb\n\n* * *\n\nc"),
        ("", ""),
        ("<div><p>open <b>never closed", "open **never closed**"),
    ],
)
def test_markdown(html, markdown):
    assert to_markdown("https://any.org/", html) == markdown


@pytest.mark.parametrize(
    ("url", "html", "markdown"),
    [
        ("https://it.wikipedia.org/w", "<nav>n</nav><div class='x infobox'>i<p>j</div><p>k", "k"),
        ("https://www.cnbc.com/a", "<div class='abc-JumpLink-x'>j</div><div id=GlobalFooter>f</div><nav>kept</nav>", "kept"),
        ("https://www.espn.com/a", "<aside class='inline x'>a</aside><aside>b</aside><img src=x>c<form>d</form>", "b\n\nc"),
        ("https://www.xe.com/a", "<div class='mb-24 from-blue-900'>a</div><div class='mb-24'>b</div><span id='c-aria-description'>d</span>", "b"),
        ("https://other.org/", "<nav>kept</nav><form>kept too</form>", "kept\n\nkept too"),
    ],
)
def test_exclusions(url, html, markdown):
    assert to_markdown(url, html) == markdown


def test_markdown_job(spark):
    df = spark.createDataFrame([("https://a.org", "<p>x", 1), ("https://a.org", None, 2)], "url string, html_text string, n int")
    rows = with_markdown(df).orderBy("n").collect()
    assert [(r["n"], r["markdown"]) for r in rows] == [(1, "x"), (2, None)]
    assert "html_text" not in rows[0].asDict()


@pytest.mark.parametrize(
    ("html", "markdown"),
    [
        ("<form><p>a</p><input name=x><p>b</p></form>", "a\n\nb"),
        (
            "<table><tr><td>one<td>two<table><tr><td>in1<td>in2</table><td>three</table>",
            "| one | two in1 in2 | three |\n| --- | --- | --- |",
        ),
        ("<table><tr>loose<td>a", "loose\n| a |\n| --- |"),
        ("<table><tr><td><p>a</p><p>b</p><td><ul><li>x<li>y</ul><h2>q</h2></table>", "| a b | x y q |\n| --- | --- |"),
        ("<ul><li><div>one</div><div>two</div><li>three<ul><li>n</ul></ul>", "* one two\n* three\n  * n"),
        ("<pre>  x\n   y <b>z</b> <a href=u>v</a>\n</pre>after", "```\n  x\n   y z v\n```\n\nafter"),
        ("<blockquote><p>q1</p><p>q2</p></blockquote>end", "> q1\n\n> q2\n\nend"),
        ("<table><tr><th>h<tr><td>d</table>tail", "| h |\n| --- |\n| d |\n\ntail"),
        ("<td>stray</td> cell", "| stray |\ncell"),
    ],
)
def test_nothing_shown_is_lost(html, markdown):
    assert to_markdown("https://unknown.example/", html) == markdown


def test_forms_go_where_the_filter_says_so():
    html = "<p>a</p><form><p>b</p></form>"
    assert to_markdown("https://www.xe.com/x", html) == "a"
    assert to_markdown("https://other.example/x", html) == "a\n\nb"


@pytest.mark.parametrize("pack", rules.RULE_PACKS, ids=lambda p: p.host)
def test_packs_by_host_clean_as_their_column_expressions(spark, pack):
    rng = random.Random(pack.host)
    words = [*pack.stop_headings, *pack.drop_headings, *pack.drop_lines, *pack.drop_prefixes, *pack.stop_lines]
    pieces = [
        "# ", "## ", "[vai al x]", "![i](u)", "[a](b (c) d)", "text , more ;", "| a | b |", "|c|", "  ", "\t", "Want to know", "[1]", "[N 2]",
        "# Stats", "é", "Copyright 2024", "camelCase", "£1.00", "\xa0", "* ", "-", "[Learn More](z)", "x", *words, *[w.title() for w in words],
    ]
    texts = ["\n".join("".join(rng.choices(pieces, k=rng.randint(0, 3))) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    rows = [(t, f"https://{pack.host.upper()}/{rng.choice(['a', 'player/stats/x'])}") for t in texts]
    df = spark.createDataFrame([*rows, (None, rows[0][1]), ("kept\n# Note", "https://else.where/"), ("kept", None)], "t string, u string")
    lowered = F.lower("u")
    for row in df.select("t", apply_pack("t", lowered, pack).alias("one"), Cleaners().clean("t", lowered).alias("all"), "u").collect():
        known = row["u"] is not None and "else" not in row["u"]
        # What could not be read stays so.
        assert row["all"] == (row["one"] if known and row["t"] is not None else row["t"])


def test_the_plan_does_not_grow_with_the_hosts(spark):
    df = spark.createDataFrame([("a\n## Note\nb", "http://h7.org/x")], "markdown string, url string")
    many = Cleaners(replace(rules.ENCYCLOPEDIA, host=f"h{i}.org") for i in range(1000))
    sizes = [len(with_cleaned(df, cleaners=c)._jdf.queryExecution().optimizedPlan().toString()) for c in (Cleaners(), many)]
    assert abs(sizes[0] - sizes[1]) < 200
    assert with_cleaned(df, cleaners=many).first()["parsed_text"] == "a"
    many.register("H7.org", replace(rules.ENCYCLOPEDIA, host="", stop_headings=("nothing",)))
    assert with_cleaned(df, cleaners=many).first()["parsed_text"] == "a\n## Note\nb"
