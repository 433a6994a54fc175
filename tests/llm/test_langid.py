from __future__ import annotations

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.llm import langid

SYLLABLES = {"aa": ["ka", "lo", "mi"], "bb": ["xu", "zi", "qe"], "cc": ["ör", "ßt", "än"]}


def words(rng, lang, count):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(count))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(5)
    docs = [(i, words(rng, lang, 60), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 40)]
    docs += [(500, "whatever", None), (501, None, "aa"), (502, "x", "no code"), (503, "", "bb")]
    return langid.fit_text_model(spark.createDataFrame(docs, "doc_id int, text string, lang string").repartition(3))


def page(rng, lang, declared, count=40):
    attr = f' lang="{declared}"' if declared else ""
    return f"<html{attr}><head><script>{words(rng, 'bb', 30)}</script></head><body><p class='kalo'>{words(rng, lang, count)}</p></body>"


@pytest.fixture(scope="module")
def crawl(spark):
    rng = random.Random(6)
    rows, truth = [], {}
    for i in range(90):
        lang = ["aa", "bb", "cc"][i % 3]
        rows.append((i, f"https://{lang}{i % 5}.site{i % 2}.example.{lang}/x{i}", page(rng, lang, lang if i % 7 else "bb")))
        truth[i] = lang
    rows += [(100, "https://aa1.site0.example.aa/empty", '<html lang="aa"><body></body>'), (101, "https://bb2.site1.example.bb/short", "<p>q</p>")]
    rows += [(102, None, page(rng, "cc", None)), (103, "not a url", None), (None, "https://aa0.site0.example.aa/y", page(rng, "aa", "zz"))]
    rows += [(104, "https://aa0.site0.example.aa/z", page(rng, "aa", "aa"))] * 2
    truth |= {100: "aa", 101: "bb", 102: "cc", 104: "aa"}
    return rows, truth, spark.createDataFrame(rows, "page_id int, url string, html string").repartition(3)


def test_known_languages_are_found(crawl, model):
    rows, truth, pages = crawl
    assert model.languages == ["aa", "bb", "cc"]
    got = langid.identify(pages.withColumns({"lang": F.lit(1), "_own": F.lit(2)}), model).collect()
    assert len(got) == len(rows)
    wrong = [r for r in got if r["page_id"] in truth and r["lang"] != truth[r["page_id"]]]
    assert wrong == []
    assert all(0 < r["confidence"] <= 1 for r in got)
    by_id = {r["page_id"]: r for r in got}
    assert by_id[100]["text_lang"] is None and by_id[103]["declared"] is None and by_id[None]["declared"] == "zz"


def test_agrees_with_bayes_rule_worked_by_hand(crawl, model):
    rows, _, pages = crawl
    texts = [langid.visible(h or "") for _, _, h in rows]
    logs = model.log_likelihoods(pa.array(texts, pa.string()))
    n = len(model.languages)

    def norm(x):
        top = max(x)
        e = [math.exp(v - top) for v in x]
        return [v / sum(e) for v in e]

    own = [norm(list(x)) for x in logs]

    def host(url):
        return url.split("/")[2] if url and "//" in url else None

    keys = [(h := host(u), ".".join(h.split(".")[-2:]) if h else None, h.split(".")[-1] if h else None) for _, u, _ in rows]
    said = [langid.declared(h or "") for _, _, h in rows]

    def total(level, key):
        return [sum(o[i] for o, k in zip(own, level) if k == key) for i in range(n)]

    overall = [sum(o[i] for o in own) for i in range(n)]
    got = {(r["page_id"], r["lang"]): r["confidence"] for r in langid.identify(pages, model).collect()}
    for at, (page_id, _, _) in enumerate(rows):
        prior = [(overall[i] + 1) / (sum(overall) + n) for i in range(n)]
        for level in (2, 1, 0):
            counts = total([k[level] for k in keys], keys[at][level])
            rest = [max(c - o, 0) + langid.PRIOR_PAGES * p for c, o, p in zip(counts, own[at], prior)]
            prior = [r / sum(rest) for r in rest]
        saying = total(said, said[at])
        trust = [
            math.log((saying[i] + langid.PRIOR_PAGES * sum(saying) / sum(overall)) / (overall[i] + langid.PRIOR_PAGES))
            for i in range(n)
        ]
        posterior = norm([a + b + math.log(c) for a, b, c in zip(logs[at], trust, prior)])
        best = max(range(n), key=lambda i: posterior[i])
        assert got[(page_id, model.languages[best])] == pytest.approx(posterior[best], rel=1e-9)


@pytest.mark.parametrize(
    ("html", "text", "said"),
    [
        ("<HTML class=x LANG='de-AT'>a<b>b</b>", "a b", "de"),
        ("<html xml:lang=fr>x<style>hidden</style>y<!-- c -->z", "x y z", "fr"),
        ('<meta http-equiv="content-language" content="es">q<script>never closed', "q", "es"),
        ("<html lang=''>a < b <i", "a < b <i", None),
        ("<" * 20_000, "<" * 20_000, None),
        ("<!--" * 5_000, "", None),
    ],
)
def test_reading_markup(html, text, said):
    assert langid.visible(html).split() == text.split()
    assert langid.declared(html) == said


def test_address_parts(value):
    host = langid.host_of(F.col("u"))
    assert value(host, u="HTTPS://user@www.A.b.co.uk:80/x?y") == "a.b.co.uk"
    assert value(host, u="no url") is None
    assert value(langid.parent_of(F.col("u")), u="a.b.co.uk") == "b.co.uk"
    assert value(langid.parent_of(F.col("u")), u="x.y.example.org") == "example.org"
    assert value(langid.suffix_of(F.col("u")), u="example.org") == "org"


def test_edges(spark, model):
    nothing = spark.createDataFrame([], "page_id int, url string, html string")
    assert langid.identify(nothing, model).collect() == []
    untrained = langid.fit_text_model(spark.createDataFrame([], "doc_id int, text string, lang string"))
    one = spark.createDataFrame([(1, "http://a.b/", "<p>x</p>")], "page_id int, url string, html string")
    assert [r["lang"] for r in langid.identify(one, untrained).collect()] == [None]
