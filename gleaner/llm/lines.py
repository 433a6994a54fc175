"""Line dedup by how often a line occurs on its site.

For every host and line: the share of the host's pages that hold the line. Lines
above a ratio are boilerplate of that host and go. All of it is DataFrame
expressions. Texts stay where they are while all hosts together have at most
``BROADCAST_LINES`` boilerplate lines; beyond that they are joined by host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.basic import let
from gleaner.llm.storage import free_prefix, lookup

RATIO = 0.1
LEAST_PAGES = 5
# Hosts and lines whose keys, 8 bytes each beside the host, are broadcast.
BROADCAST_LINES = 500_000
BLANKS = " \t\r\x0b\x0c"


def line_key(line: Column) -> Column:
    """Lines are the same if they agree without blanks at their ends; 64 bits stand for one."""
    return F.xxhash64(F.btrim(line, F.lit(BLANKS)))


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def _has_words(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS)) != ""


def boilerplate(
    docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES
) -> DataFrame:
    """``_host`` and ``_lines``: the keys of each host's boilerplate lines.

    A page is a distinct text of a host, so copies of one page are one page. A
    line is boilerplate if more than ``ratio`` of the host's pages hold it, and
    at least ``least_pages`` do: on a host of a few pages every line has a high
    share. A host's list has at most its pages' mean number of lines divided by
    ``ratio`` entries, whatever the number of pages.
    """
    pages = docs.select(
        F.col(host).alias("_host"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_page"),
        _lines(text).alias("_all"),
    )
    held = (
        pages.select(
            "_host", "_page",
            F.explode(F.array_distinct(F.transform(F.filter("_all", _has_words), line_key))).alias("_line"),
        )
        .distinct()
        .groupBy("_host", "_line").agg(F.count("*").alias("_pages"))
        .where(F.col("_pages") >= least_pages)
    )
    totals = pages.select("_host", "_page").distinct().groupBy("_host").agg(F.count("*").alias("_total"))
    return (
        held.withColumnRenamed("_host", "_of").join(totals, F.col("_of").eqNullSafe(F.col("_host")))
        .where(F.col("_pages") > ratio * F.col("_total"))
        .groupBy("_host").agg(F.collect_list("_line").alias("_lines"))
    )


def drop_boilerplate(
    docs: DataFrame,
    host: str = "source",
    text: str = "text",
    ratio: float = RATIO,
    least_pages: int = LEAST_PAGES,
    counts: bool = False,
) -> DataFrame:
    """``docs`` with the boilerplate lines of each row's host taken out of its text.

    Lines without a word are never boilerplate, and a text without boilerplate
    stays as it is, byte by byte. Pages without a host are a host of their own. A
    null text stays null, a text of nothing but boilerplate becomes empty; no row
    is dropped. With ``counts`` there are ``n_lines`` and ``n_dropped`` as well,
    replacing columns of these names. Other columns may have any names.
    """
    site, gone, cut = (free_prefix(docs.columns) + name for name in ("site", "gone", "cut"))
    found = boilerplate(docs, host, text, ratio, least_pages)
    known = lookup(found, "1 + size(_lines)", BROADCAST_LINES).select(
        F.col("_host").alias(site), F.col("_lines").alias(gone)
    )
    joined = docs.join(known, F.col(host).eqNullSafe(F.col(site)), "left")

    def split(lines: Column) -> Column:
        kept = F.filter(lines, lambda line: ~(_has_words(line) & F.array_contains(gone, line_key(line))))
        return let(kept, lambda k: F.struct(
            F.size(lines).cast("bigint").alias("n_lines"),
            (F.size(lines) - F.size(k)).cast("bigint").alias("n_dropped"),
            F.array_join(k, "\n").alias("text"),
        ))

    changed = joined.withColumn(cut, F.when(F.col(gone).isNotNull() & F.col(text).isNotNull(), let(_lines(text), split)))
    cleaned = F.when(F.col(f"{cut}.n_dropped") > 0, F.col(f"{cut}.text")).otherwise(F.col(text)).alias(text)
    columns = [cleaned if c == text else F.col(c) for c in docs.columns if not (counts and c in ("n_lines", "n_dropped"))]
    if counts:
        lines = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(_lines(text)))
        columns += [
            F.coalesce(f"{cut}.n_lines", lines).cast("bigint").alias("n_lines"),
            F.coalesce(f"{cut}.n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"),
        ]
    return changed.select(*columns)
