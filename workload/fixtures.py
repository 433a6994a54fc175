"""Inputs derived from the given tables.

The given data has raw pages but no runs, verdicts or replies, so those are
derived from every page by expressions both Spark and the checking engine
read. Tables that must differ (stored and incoming, say) differ by what the
pages are, such as their scheme or whether their HTML is complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.urls import domain_of, title_of

COMPLETE = "contains(html_text, '</body>')"
SECURE = "url LIKE 'https%'"
DOT_COM = "url LIKE '%.com/%'"

RUNS = (
    # run_id, label, model_name, provider, condition_name, budget_tokens, eur_per_usd,
    # measured_cost_eur, created_seq
    (1, "rules", "crawl-rules", "locale", "rules", 0, None, None, 1),
    (2, "model-a", "m/a", "openrouter", "raw", 1500, 0.92, None, 2),
    (3, "model-b", "m/b", "OpenRouter ", "raw + chunking", 4000, 0.92, 1.25, 3),
    (4, "model-c", "m/c", "openrouter", "raw", 128000, 0.92, 0.5, 4),
)
RUN_COLUMNS = (
    "run_id BIGINT, label STRING, model_name STRING, provider STRING, condition_name STRING, "
    "budget_tokens INT, eur_per_usd DOUBLE, measured_cost_eur DOUBLE, created_at INT"
)
RUNS_WITH_PAGES = RUNS[:3]

STATUS = """CASE WHEN (page_id * 31 + run_id * 7) % 20 = 0 THEN 'error'
 WHEN (page_id * 31 + run_id * 7) % 20 = 1 THEN 'empty'
 WHEN budget_tokens > 0 AND input_tokens > budget_tokens THEN 'too_long'
 ELSE 'ok' END"""
HASH = "(page_id * 7919 + run_id * 104729) % 100003"

# Scalar columns of a page of a run, readable by both engines; NULL unless the page is ok.
OK_COLUMNS = {
    "seconds": "0.5 + CAST(h % 100 AS DOUBLE) / 7",
    "cpu_seconds": "CASE WHEN run_id = 1 THEN CAST(h % 50 AS DOUBLE) / 13 END",
    "fragments": "CASE WHEN h % 23 <> 0 THEN CAST(1 + h % 3 AS INT) END",
    "cost_eur": "CASE WHEN run_id = 2 THEN CAST(h % 50 AS DOUBLE) / 997 END",
    "precision_val": "0.5 + CAST(h % 4973 AS DOUBLE) / 9949",
    "recall_val": "0.5 + CAST(h % 4909 AS DOUBLE) / 9967",
    "f1": "0.5 + CAST(h % 4999 AS DOUBLE) / 10007",
    "cosine": "CAST(h % 4987 AS DOUBLE) / 4993",
    "jaccard": "CAST(h % 4931 AS DOUBLE) / 4999",
    "excess_ratio": "CAST(h % 997 AS DOUBLE) / 3001",
    "grounded": "CASE WHEN h % 9 <> 0 THEN CAST(h % 101 AS DOUBLE) / 103 END",
    "parsed_text": (
        "CASE WHEN h % 17 = 0 THEN NULL WHEN h % 19 = 0 THEN '' "
        "ELSE concat('text of ', url, ' by ', label) END"
    ),
    "checked": "run_id > 1 AND h % 4 <> 0",
}
CHECK_COLUMNS = {
    "check_complete": "CASE WHEN h % 13 <> 0 THEN h % 3 <> 0 END",
    "check_coherent": "h % 5 <> 0",
    "check_coherence": "CASE WHEN h % 11 <> 0 THEN CAST(h % 6 AS INT) END",
    "check_omissions": "CASE WHEN h % 7 <> 0 THEN CAST(h % 3 AS INT) END",
    "check_cost_eur": "CAST(h % 31 AS DOUBLE) / 977",
}
PROVIDER = "CASE WHEN (h + i) % 5 = 0 THEN '' WHEN (h + i) % 2 = 0 THEN 'north' ELSE 'south' END"
VERDICT = (
    "CASE (h + i) % 5 WHEN 0 THEN 'confermata' WHEN 1 THEN 'presente' WHEN 2 THEN 'inventata' "
    "WHEN 3 THEN 'troppo corta' ELSE '' END"
)

CHECK_REPLY = """CASE
 WHEN (page_id + n) % 11 = 0 THEN concat('no verdict for ', url)
 WHEN (page_id + n) % 11 = 1 THEN concat('{"coherent": true, "coherence": ', page_id % 6, ', "notes": ')
 WHEN (page_id + n) % 11 = 2 THEN concat('<think>{hm}</think>{"coherent": false, "coherence": 9, "coherence_evidence": "e', page_id, '", "missing": ["q', n, '"], "notes": "n"}')
 ELSE concat('{"coherent": ', CASE WHEN (page_id + n) % 4 = 0 THEN 'false' ELSE 'true' END,
  ', "coherence": ', (page_id + n) % 6, ', "coherence_evidence": "', CASE WHEN page_id % 3 = 0 THEN '' ELSE concat('proof ', n) END,
  '", "missing": [', CASE WHEN page_id % 2 = 0 THEN concat('"first ', n, '", "second ', n, '"') ELSE '' END,
  '], "notes": " note ', n, ' "}') END"""
JUDGE_REPLY = """CASE
 WHEN (page_id + n) % 7 = 0 THEN concat('no verdict here for ', url)
 WHEN (page_id + n) % 7 = 1 THEN concat('<think>x</think>{"feedback": "f', page_id, '", "score": 9}')
 WHEN (page_id + n) % 7 = 2 THEN concat('{"feedback": "g', page_id, '"}')
 ELSE concat('```json', chr(10), '{"feedback": "f', page_id, '", "score": ', (page_id + n) % 6, '}', chr(10), '```') END"""


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A given table, split as Spark splits its files."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def raw_pages(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "pages").select(
        "page_id", "url", domain_of("url").alias("domain"), F.col("html").alias("html_text")
    )


def pages(spark: SparkSession, base: str) -> DataFrame:
    return raw_pages(spark, base).select(
        "page_id", "url", "domain", title_of("html_text").alias("title"), "html_text"
    )


def _plain(html):
    spaced = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(spaced, r"[ \t\n]+", " "))


def article_text(html: str = "html_text"):
    return _plain(F.regexp_extract(html, r"(?s)<article>(.*?)</article>", 1))


def body_text(html: str = "html_text"):
    body = F.regexp_extract(html, r"(?s)<body>(.*)</body>", 1)
    for pattern in (
        r"(?s)<script\b.*?</script>", r"(?s)<style\b.*?</style>", r"(?s)<nav\b.*?</nav>", r"(?s)<!--.*?-->",
    ):
        body = F.regexp_replace(body, pattern, "")
    return _plain(body)


def pairs(spark: SparkSession, base: str) -> DataFrame:
    """Per page an extraction with markdown marks and a gold text; incomplete pages extract nothing."""
    thousand = F.concat(F.lit("1,"), F.lpad((F.col("page_id") % 1000).cast("string"), 3, "0"))
    source = pages(spark, base).select(
        "page_id", "url", "domain", "title", body_text().alias("body"), article_text().alias("article")
    )
    parsed = F.concat(
        F.lit("# "), "title", F.lit("\n\n"), "body", F.lit("\n\n* ["), "domain", F.lit("]("), "url",
        F.lit(") **"), "page_id", F.lit("** `"), thousand, F.lit("`"),
    )
    gold = F.concat(
        "article", F.lit("\n"), "domain", F.lit(" ("), F.translate(thousand, ",", "."), F.lit("%) "), "page_id"
    )
    return source.select(
        "page_id",
        "url",
        "domain",
        F.when(F.col("body") == "", "").otherwise(parsed).alias("parsed_text"),
        gold.alias("gold_text"),
    )


def gold(spark: SparkSession, base: str) -> DataFrame:
    """Complete pages have a gold text."""
    return raw_pages(spark, base).where(COMPLETE).select("url", article_text().alias("gold_text"))


def evaluations(spark: SparkSession, base: str) -> DataFrame:
    """Secure pages carry metrics, .com pages a judge score; some carry both, some neither."""
    metrics = {
        "precision_val": "CAST(page_id % 991 AS DOUBLE) / 997",
        "recall_val": "CAST(page_id % 983 AS DOUBLE) / 991",
        "f1": "CAST(page_id % 977 AS DOUBLE) / 983",
        "cosine": "CAST(page_id % 971 AS DOUBLE) / 977",
        "jaccard": "CAST(page_id % 967 AS DOUBLE) / 971",
        "excess_ratio": "CAST(page_id % 953 AS DOUBLE) / 967",
    }
    return raw_pages(spark, base).where(f"{SECURE} OR {DOT_COM}").select(
        "url",
        *[F.expr(f"CASE WHEN {SECURE} THEN {e} END").alias(n) for n, e in metrics.items()],
        F.expr(f"CASE WHEN {DOT_COM} THEN CAST(1 + page_id % 5 AS INT) END").alias("judge_score"),
    )


def runs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RUNS), RUN_COLUMNS)


def page_results(spark: SparkSession, base: str) -> DataFrame:
    """Every page under three runs; the first run never saw the URLs with a query string."""
    per_run = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(r[0]).cast("long").alias("run_id"), F.lit(r[1]).alias("label"), F.lit(r[5]).alias("budget_tokens")
                )
                for r in RUNS_WITH_PAGES
            ]
        )
    ).alias("r")
    base_rows = (
        raw_pages(spark, base)
        .select(
            "page_id", "url", "domain",
            F.floor(F.length("html_text") / F.lit(3.0)).cast("long").alias("input_tokens"),
            per_run,
        )
        .select("page_id", "url", "domain", "input_tokens", "r.*")
        .where("NOT (run_id = 1 AND url LIKE '%?%')")
        .withColumns({"status": F.expr(STATUS), "h": F.expr(HASH)})
    )
    ok = base_rows.withColumns(
        {n: F.expr(f"CASE WHEN status = 'ok' THEN {e} END") for n, e in OK_COLUMNS.items()}
    )
    checked = ok.withColumns(
        {n: F.expr(f"CASE WHEN checked THEN {e} END") for n, e in CHECK_COLUMNS.items()}
    )
    return checked.withColumns(
        {
            "providers": F.expr(
                f"CASE WHEN status = 'ok' THEN transform(sequence(1, coalesce(fragments, 1)), i -> {PROVIDER}) END"
            ),
            "check_quote_verdicts": F.expr(
                "CASE WHEN checked THEN transform(sequence(1, CAST(1 + h % 3 AS INT)), "
                f"i -> named_struct('quote', concat('q', i), 'verdict', {VERDICT})) END"
            ),
        }
    ).drop("checked", "label", "budget_tokens")


def three_per_page(df: DataFrame) -> DataFrame:
    return df.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))


def judge_replies(spark: SparkSession, base: str) -> DataFrame:
    return three_per_page(raw_pages(spark, base).select("page_id", "url", "domain")).withColumn(
        "raw", F.expr(JUDGE_REPLY)
    )


def check_replies(spark: SparkSession, base: str) -> DataFrame:
    rows = three_per_page(raw_pages(spark, base).select("page_id", "url"))
    return rows.withColumns(
        {
            "raw": F.expr(CHECK_REPLY),
            "finish_reason": F.expr("CASE WHEN (page_id + n) % 2 = 0 THEN 'length' ELSE 'stop' END"),
        }
    )


LINES_MARKDOWN = r"""concat(
 '# ', title, chr(10), chr(10),
 '[Vai al contenuto](/x "y")', chr(10),
 'prologue', chr(10),
 CASE WHEN page_id % 4 = 0 THEN 'Stats' WHEN page_id % 4 = 1 THEN '## STATS ' ELSE 'No stats' END, chr(10),
 replace(article, '. ', concat('.[12] ', chr(10))), chr(10),
 'See [Foo](/wiki/Foo_(bar) "Foo (bar)") , then [N 3] and ** ** bold [', page_id, ']', chr(10),
 '![img](a.png) tail', chr(10),
 'WATCH: clip', chr(10), '- [Only link](http://a)', chr(10), '[Alone](http://b)', chr(10),
 '*caption*', chr(10), 'Read more: other', chr(10),
 'EuroEUR rates[Send](http://s) ** , more ![Xe](http://i/logo-xe.svg) x', chr(10),
 '| a | b |', chr(10), '|---|---|', chr(10), '| 1 |  | 2 |', chr(10), '* * *', chr(10), '----', chr(10),
 'Add currency', chr(10), 'We use the mid-market rate for this', chr(10), '## Compare and Save', chr(10),
 'kept ', url, chr(10), chr(10),
 '**Want to know?**', chr(10), 'after it', chr(10),
 CASE page_id % 6 WHEN 0 THEN '## Note' WHEN 1 THEN '## Related content for you' WHEN 2 THEN 'Privacy Policy'
  WHEN 3 THEN '### Sign up' WHEN 4 THEN 'Trusted by' ELSE 'plain' END, chr(10),
 'epilogue', chr(10), '  ', chr(10))"""


def line_pages(spark: SparkSession, base: str) -> DataFrame:
    """Pages as markdown with lines every rule pack has something to say about."""
    source = pages(spark, base).select("page_id", "url", "domain", "title", article_text().alias("article"))
    return source.select("page_id", "url", "domain", F.expr(LINES_MARKDOWN).alias("markdown"))


WORDS_PER_LINE = 12
LINES_PER_PIECE = 3


def numbered_lines(spark: SparkSession, base: str) -> DataFrame:
    """Per page its article as numbered lines of twelve words."""
    words = F.split(article_text(), " ")
    source = raw_pages(spark, base).select("page_id", "url", words.alias("w"))
    starts = F.sequence(F.lit(0), F.floor((F.size("w") - 1) / WORDS_PER_LINE).cast("int"))
    lines = F.transform(
        starts,
        lambda i: F.concat(
            F.lit("l"), i.cast("string"), F.lit(" "),
            F.array_join(F.slice("w", i * WORDS_PER_LINE + 1, WORDS_PER_LINE), " "),
        ),
    )
    return source.select("page_id", "url", lines.alias("lines"))


def fragment_replies(spark: SparkSession, base: str) -> DataFrame:
    """Replies of consecutive pieces that repeat up to three lines of the one before; every page has
    one piece that says it holds nothing, and the first reply of every ninth page was cut off."""
    lined = numbered_lines(spark, base)
    last = F.floor((F.size("lines") - 1) / LINES_PER_PIECE).cast("int")

    def piece(k):
        repeated = F.when(k == 0, 0).otherwise((F.col("page_id") + k) % 4).cast("int")
        text = F.array_join(
            F.slice("lines", k * LINES_PER_PIECE + 1 - repeated, LINES_PER_PIECE + repeated), "\n"
        )
        return F.struct((2 * k).alias("n"), text.alias("raw"))

    pieces = F.transform(F.sequence(F.lit(0), last), piece)
    nothing = F.array(F.struct(F.lit(1).alias("n"), F.lit("Nothing_Here.").alias("raw")))
    return lined.select("page_id", "url", F.explode(F.concat(pieces, nothing)).alias("r")).select(
        "page_id", "url", (F.col("r.n") + 1).alias("n"), "r.raw",
        F.when((F.col("page_id") % 9 == 0) & (F.col("r.n") == 0), "length").otherwise("stop").alias("finish_reason"),
        F.lit("").alias("page_title"), F.lit("").alias("page_heading"),
    )


def document_pairs(spark: SparkSession, base: str) -> DataFrame:
    """Each document as the extraction of a page made of its own and its source's label."""
    return table(spark, base, "documents").select(
        "doc_id",
        F.concat("text", F.lit("\nthis closing line was certainly never part of the document")).alias("parsed_text"),
        F.concat(
            F.lit("<html><head><title>"), "source", F.lit("</title><script>var a = '"), "lang",
            F.lit("';</script></head><body><p>"), "text", F.lit("</p></body></html>"),
        ).alias("html_text"),
        "text",
    )
