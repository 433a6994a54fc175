"""Scores of an extraction against a gold text, and against the page itself.

All of it is row-local: a pair of texts is scored where it lies, without a
shuffle, so a page of any size and a domain of any size cost the same per row.
Words are counted and passages are looked up batch by batch, in time that grows
with the texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import (
    QUOTE_CONFIRMED,
    QUOTE_INVENTED,
    QUOTE_PRESENT,
    QUOTE_TOO_SHORT,
    THRESHOLDS,
    Thresholds,
)
from ..functions.basic import Columnish, as_column, let, strip
from ..functions.markup import strip_markdown
from ..functions.tokens import token_bag
from .scorer import BAG_FIELDS, TOKEN_FIELDS, scores
from .windows import grounded, look_up

METRICS = ("precision", "recall", "f1", "cosine", "jaccard", "excess_ratio")


def _plain(parsed: Columnish, gold: Columnish) -> Column:
    """Both texts without their markdown; one expression serves both sides."""
    texts = F.array(*[F.coalesce(as_column(t), F.lit("")) for t in (parsed, gold)])
    return F.transform(texts, strip_markdown)


def all_scores(parsed: Columnish, gold: Columnish) -> Column:
    """struct of both families; each text is read once."""
    return scores(as_column(parsed), as_column(gold))


def _fields(parsed: Columnish, gold: Columnish, names: tuple[str, ...]) -> Column:
    return let(all_scores(parsed, gold), lambda s: F.struct(*[s[n].alias(n) for n in names]))


def token_level(parsed: Columnish, gold: Columnish) -> Column:
    """struct of precision, recall, f1 and the three set sizes."""
    return _fields(parsed, gold, TOKEN_FIELDS)


def similarity(parsed: Columnish, gold: Columnish) -> Column:
    """struct of cosine, Jaccard and excess ratio over word counts."""
    return _fields(parsed, gold, BAG_FIELDS)


def with_scores(df: DataFrame, parsed: str = "parsed_text", gold: str = "gold_text") -> DataFrame:
    """Add the six metrics and the token counts for each row's pair of texts.

    A row without a gold text or without an extraction gets NULLs: nothing was
    measured, which is not a score of zero. An empty extraction is one.
    """
    both = F.col(gold).isNotNull() & F.col(parsed).isNotNull()
    scored = df.withColumn("_scores", F.when(both, all_scores(parsed, gold)))
    return scored.select(
        *df.columns,
        *[F.col(f"_scores.{n}").alias(n) for n in (*TOKEN_FIELDS, *BAG_FIELDS)],
    )


def word_counts(
    df: DataFrame, keys: list[str], parsed: str = "parsed_text", gold: str = "gold_text"
) -> DataFrame:
    """Both bags as rows: per key and word, how often each text has it.

    Every word that either text has is listed, as a full join of the two bags
    would, but out of one pass; the counts are partial before the shuffle.
    """
    bags = F.transform(_plain(parsed, gold), token_bag)

    def tag(side: int) -> Callable[[Column], Column]:
        return lambda bag: F.transform(bag, lambda w: F.struct(w.alias("word"), F.lit(side).alias("side")))

    both = let(bags, lambda b: F.concat(tag(0)(b[0]), tag(1)(b[1])))
    rows = df.select(*keys, F.explode_outer(both).alias("w")).where(F.col("w").isNotNull())
    return rows.groupBy(*keys, F.col("w.word").alias("word")).agg(
        F.count_if(F.col("w.side") == 0).alias("parsed_count"),
        F.count_if(F.col("w.side") == 1).alias("gold_count"),
    )


def judge_previews(
    df: DataFrame, parsed: str = "parsed_text", gold: str = "gold_text", chars: int = THRESHOLDS.preview_chars
) -> DataFrame:
    """The opening of both texts as a judge is shown them."""
    def preview(name: str) -> Column:
        return F.substring(strip_markdown(F.col(name)), 1, chars)

    return df.withColumn("parsed_preview", preview(parsed)).withColumn("gold_preview", preview(gold))


# --- reference-free checks ---------------------------------------------------


def grounded_fraction(markdown: Columnish, html: Columnish, limits: Thresholds = THRESHOLDS) -> Column:
    """Share of an extraction's long lines found on the page; NULL without long lines."""
    return grounded(as_column(markdown), as_column(html), limits.line_chars, limits.anchor_words)


def check_quotes(
    quotes: Columnish, markdown: Columnish, html: Columnish, limits: Thresholds = THRESHOLDS
) -> Column:
    """array<struct<quote, verdict, in_page, in_extraction>>, blank quotes left out."""
    wanted = F.filter(
        F.transform(F.coalesce(as_column(quotes), F.array().cast("array<string>")), strip),
        lambda q: F.coalesce(q != "", F.lit(False)),
    )

    def judged(quote: Column, found: Column) -> Column:
        verdict = (
            F.when(F.length(quote) < limits.quote_chars, QUOTE_TOO_SHORT)
            .when(~found.in_page, QUOTE_INVENTED)
            .when(found.in_extraction, QUOTE_PRESENT)
            .otherwise(QUOTE_CONFIRMED)
        )
        return F.struct(
            quote.alias("quote"), verdict.alias("verdict"), found.in_page.alias("in_page"),
            found.in_extraction.alias("in_extraction"),
        )

    found = look_up(wanted, as_column(markdown), as_column(html), limits.anchor_words)
    return F.zip_with(wanted, found, judged)


def confirmed_omissions(quote_checks: Columnish) -> Column:
    return F.size(F.filter(as_column(quote_checks), lambda c: c.verdict == QUOTE_CONFIRMED))


def is_complete(quote_checks: Columnish) -> Column:
    return confirmed_omissions(quote_checks) == 0
