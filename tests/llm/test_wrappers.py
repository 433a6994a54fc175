from __future__ import annotations

import html
import json
import random
import re

import pytest
from llm_helpers import prose

from gleaner.llm import queries, wrappers

SCHEMA = "page_id bigint, url string, html string"


def sentence(rng, words=12):
    return " ".join(prose(rng, words).split())


def semantic(rng, n):
    """A site with an article element and all that does not belong to it."""
    blocks = [sentence(rng, 4)] + [sentence(rng, rng.randint(5, 40)) for _ in range(rng.randint(1, 6))]
    items = "".join(f"<li><a href='/{i}'>{sentence(rng, 1)}</a>" for i in range(rng.randint(2, 6)))
    rest = "".join(f"<p class='text'>{b[: len(b) // 2]}<b>{b[len(b) // 2 :]}</b>\n" for b in blocks[1:])
    comments = "".join(f"<article class='comment'><p>{sentence(rng, 30)}</p></article>" for _ in range(rng.randint(0, 5)))
    page = (
        f"<!doctype html><html><head><title>{blocks[0]}</title><style>p > a {{}}</style></head><body class='has-sidebar'><header><h1>The "
        f"Site</h1></header><nav><ul>{items}</ul></nav><div class=cookie-notice>We use cookies.</div><article class='post'><h1>{blocks[0]}</h1>"
        f"<div class=\"ad-slot\">{sentence(rng, 9)}</div>{rest}<script>if (a < b) document.write('<p>no</p>')</script>"
        f"<aside><p>{sentence(rng, 20)}</p></aside><form><input><p>{sentence(rng, 3)}</p></form></article>"
        f"<section id='comments'><h2>Comments</h2>{comments}</section><footer>&copy; site</footer>"
    )
    return page, blocks


def divs(rng, n):
    """A site without an article element: only what changes from page to page is text."""
    blocks = [sentence(rng, 5)] + [sentence(rng, rng.randint(8, 30)) for _ in range(rng.randint(2, 5))]
    menu = "".join(f"<li><a href='{w}'>{w}</a></li>" for w in ("home", "news", "about"))
    quote = f"<blockquote>{blocks[1]}</blockquote>" if n % 2 else f"<div>{blocks[1]}</div>"
    page = (
        f"<html><body><div class=top><ul>{menu}</ul></div><div class=box><h1>{blocks[0]}</h1>{quote}"
        + "".join(f"<dl><dt>{b[:6]}<dd>{b[6:]}</dl>" for b in blocks[2:])
        + "<div class=hint>Write to us at any time.</div></div><table><tr><td>All rights reserved</table></body></html>"
    )
    out = blocks[:2] + [part.strip() for b in blocks[2:] for part in (b[:6], b[6:])]
    return page, [b for b in out if b]


def broken(rng, n):
    """Open elements, references, comments and white space; the page may be cut after the article."""
    blocks = [sentence(rng, 4), sentence(rng, 10) + " & < \"é\"", sentence(rng, 10)]
    first, second, third = (html.escape(b).replace(" ", rng.choice([" ", "\n ", " <!-- <p> --> "])) for b in blocks)
    page = f"<BODY><MAIN><H1>{first}</h1><P>{second}<p><i>{third}<br><p></MAIN><FOOTER>{sentence(rng, 3)}"
    return page + ("</FOOTER></BODY>" if n % 2 else ""), blocks


SITES = {"a.example.com": semantic, "b.example.org": divs, "c.example.net": broken}


@pytest.fixture(scope="module")
def site_pages():
    rng = random.Random(4)
    rows, wanted = [], {}
    for host, make in SITES.items():
        for n in range(30):
            page, blocks = make(rng, n)
            key = len(rows)
            rows.append((key, f"https://{host}/{n}?q=1", page))
            wanted[key] = "\n".join(blocks)
        # Copies of a page are one page, however many they are.
        for _ in range(40):
            rows.append((len(rows), f"https://{host}/copy", page))
            wanted[len(rows) - 1] = "\n".join(blocks)
    rng.shuffle(rows)
    return rows, wanted


def test_main_text_of_sites_with_known_text(spark, site_pages):
    rows, wanted = site_pages
    pages = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = {r["page_id"]: r for r in wrappers.extract(pages).collect()}
    assert {k: r["text"] for k, r in found.items()} == wanted
    assert all(r["n_chars"] == len(r["text"]) for r in found.values())


def test_large_tables_of_wrappers_are_joined(spark, site_pages, monkeypatch):
    monkeypatch.setattr(wrappers, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(wrappers, "HOSTS_HELD", 1)
    rows, wanted = site_pages
    pages = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert {r["page_id"]: r["text"] for r in wrappers.extract(pages).collect()} == wanted


def test_whole_table_has_the_text_of_its_articles(spark, tiny):
    wanted = {}
    for row in spark.read.parquet(f"{tiny}/pages.parquet").collect():
        article = re.search("<article>(.*?)</article>", row["html"], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<br>|</?b>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article))
        wanted[row["page_id"]] = "\n".join(b for b in blocks if b)
    found = queries.op12_html_extraction(spark, tiny).collect()
    assert {r["page_id"]: r["text"] for r in found} == wanted
    assert len(found) == len(wanted) and list(found[0].asDict()) == ["page_id", "url", "text", "n_chars"]


def item(source: str) -> wrappers.Item:
    return wrappers.expression(wrappers.Page(source))


def test_alignment_infers_optional_and_repeated_parts():
    one = "<ul><li>a<li>b<li>c</ul><h2>x</h2><p>y</p><h2>x</h2><p>z</p>"
    two = "<ul><li>a</ul><div class='note'>n</div><h2>x</h2><p>y</p>"
    assert wrappers.written(item(one)) == "<ul>(<li>#</li>)+</ul>(<h2>#</h2><p>#</p>)+"
    for order in ((one, two), (two, one)):
        wrapper = wrappers.joined(item(order[0]), item(order[1]))
        assert wrappers.written(wrapper) == "<ul>(<li>#</li>)+</ul>(<div.note>#</div>)?(<h2>#</h2><p>#</p>)+".replace(
            "<div.note>#</div>", "<div.note>#</div>"
        )
    again = wrappers.Item.load(json.loads(json.dumps(wrapper.stored())))
    assert wrappers.written(again) == wrappers.written(wrapper)


def matches(page: list, expression: list) -> bool:
    """Whether the labels of a page's tree are in the language of the expression, by backtracking."""

    def rest(i, at):
        """All places that parts from ``i`` on can reach from place ``at``."""
        if i == len(expression):
            return {at}
        part = expression[i]
        reached = set(rest(i + 1, at)) if part.optional else set()
        ends, seen = once(part, at), set()
        while ends:
            seen |= ends
            for e in ends:
                reached |= rest(i + 1, e)
            ends = {f for e in ends for f in once(part, e)} - seen if part.repeated else set()
        return reached

    def once(part, at):
        if part.label.startswith("("):
            return {at + n for n in range(1, len(page) - at + 1) if matches(page[at : at + n], part.kids)}
        fits = at < len(page) and page[at].label == part.label and matches(page[at].kids, part.kids)
        return {at + 1} if fits else set()

    return len(page) in rest(0, 0)


def unfolded(page: wrappers.Page, element) -> list:
    out = []
    for part in element.parts:
        label = "#" if isinstance(part, int) else part.label
        out.append(wrappers.Item(label, [] if isinstance(part, int) else unfolded(page, part)))
    return out


def test_every_page_is_in_the_language_of_its_wrapper():
    rng = random.Random(9)

    def tree(depth):
        tags = rng.choices(["p", "div", "ul", "h2"], k=rng.randint(0, 4))
        return "".join(f"<{t}>{tree(depth - 1) if depth and t == 'div' else rng.choice(['', 'x'])}</{t}>" for t in tags)

    for _ in range(60):
        sources = [tree(2) for _ in range(5)]
        wrapper = None
        for source in sources:
            wrapper = wrappers.joined(wrapper, item(source))
        for source in sources:
            page = wrappers.Page(source)
            assert matches(unfolded(page, page.root), wrapper.kids), (sources, wrappers.written(wrapper))


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "core" + "</div>" * 3000
    texts = {
        None: "", "": "", " \n ": "", "plain &amp; simple": "plain & simple", "<p>a<p>b": "a\nb", "<p>one<br>two</p>": "one two",
        "<script>": "", "<script>x</scripty></script><p>y": "y", "<p title='>'>z": "z", "a < b": "a < b", deep: "core",
        "<title>t</title><textarea><p>u</textarea>v": "v", "<table><tr><td>1<td>2<tr><td>3</table>": "1\n2\n3", "<!-- open": "",
        "<p>" + "w " * 200_000: ("w " * 200_000).strip(), "</p></div>end": "end", "<svg><text>g</text></svg>h": "h",
    }
    rows = [(i, None if i % 2 else "no host", s) for i, s in enumerate(texts)]
    rows += [(100, "http://u:p@X.example/", "<p>q"), (100, "http://u:p@X.example/", "<p>q")]
    pages = spark.createDataFrame([(*r, 3, "x") for r in rows], SCHEMA + ", _html int, wrapper string")
    found = wrappers.extract(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted((r["page_id"], r["text"]) for r in found.collect())
    assert got == sorted([*enumerate(texts.values()), (100, "q"), (100, "q")])
    assert wrappers.extract(pages.limit(0)).collect() == []
    hosts = {r["host"]: r["expression"] for r in wrappers.expressions(wrappers.wrappers(pages.where("page_id = 100"))).collect()}
    assert hosts == {"x.example": "<p>#</p>"}


def test_sequences_without_an_order_stay_small():
    rng = random.Random(1)
    wrapper = None
    for _ in range(200):
        page = "".join(f"<div class='{''.join(rng.choices('abcdefgh', k=3))}'>x</div>" for _ in range(30))
        wrapper = wrappers.joined(wrapper, item(page))
    assert len(wrapper.kids) <= wrappers.SEQUENCE
