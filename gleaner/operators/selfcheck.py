"""Self-check replies merged per page and verified against the page."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import THRESHOLDS, Thresholds
from ..functions.basic import strip
from ..functions.replies import parse_check
from .metrics import check_quotes, confirmed_omissions, grounded_fraction


def with_verdicts(
    replies: DataFrame, raw: str = "raw", finish_reason: str = "finish_reason", limits: Thresholds = THRESHOLDS
) -> DataFrame:
    """Add the parsed verdict of every reply as the struct ``verdict``, with all the quotes it claims.

    What is kept of them is decided when a page's verdicts are merged, so their number is known there.
    """
    return replies.withColumn("verdict", parse_check(raw, finish_reason, replace(limits, max_quotes=None)))


def merge_verdicts(verdicts: DataFrame, keys: list[str], limits: Thresholds = THRESHOLDS) -> DataFrame:
    """One verdict per page: incoherent if any piece is, with the lowest score any piece gave.

    Expects ``n`` and ``verdict``. A page has as many verdicts as fragments.
    The notes are those of the pieces that objected; a page checked in one
    piece keeps its own words. ``claimed_total`` counts the quotes of all
    pieces, of which the first ``limits.max_quotes`` are kept, or all; these are
    the same whether or not each piece was cut to as many before.
    """
    gathered = verdicts.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("n", "verdict"))).alias("_pieces"),
        F.bool_and("verdict.coherent").alias("coherent"),
        F.min("verdict.coherence").alias("coherence"),
        F.count("*").cast("int").alias("check_fragments"),
    )
    pieces = F.col("_pieces.verdict")
    total = F.col("check_fragments").cast("string")

    def complaint(piece: Column, i: Column) -> Column:
        objects = (
            ~piece.coherent | (piece.coherence < limits.coherence_max) | (F.size(piece.missing) > 0)
        )
        place = F.concat(F.lit("[pezzo "), (i + 1).cast("string"), F.lit("/"), total, F.lit("] "))
        return F.when(objects, F.concat(place, strip(piece.notes)))

    complaints = F.filter(F.transform(pieces, complaint), lambda c: c.isNotNull())
    worst = F.filter(
        pieces,
        lambda p: (p.coherence == F.col("coherence")) & (strip(p.coherence_evidence) != ""),
    )
    single = F.col("check_fragments") == 1
    merged_notes = F.when(F.size(complaints) > 0, F.array_join(complaints, " ")).otherwise(
        F.concat(F.lit("Nessun problema trovato in "), total, F.lit(" pezzi."))
    )
    quotes = F.flatten(F.transform(pieces, lambda p: p.missing))
    return gathered.select(
        *keys,
        "coherent",
        "coherence",
        F.when(single, pieces[0].coherence_evidence)
        .otherwise(F.coalesce(F.get(worst, F.lit(0)).coherence_evidence, F.lit("")))
        .alias("coherence_evidence"),
        (quotes if limits.max_quotes is None else F.slice(quotes, 1, limits.max_quotes)).alias("claimed_missing"),
        F.size(quotes).alias("claimed_total"),
        F.when(single, pieces[0].notes).otherwise(merged_notes).alias("notes"),
        "check_fragments",
    )


def check_records(
    merged: DataFrame, texts: DataFrame, keys: list[str], limits: Thresholds = THRESHOLDS
) -> DataFrame:
    """Verdicts with their quotes looked up in the whole page and the whole extraction.

    ``texts`` holds ``html_text`` and ``parsed_text`` per key. Completeness is
    what the lookup says, not what the model felt.
    """
    checked = merged.join(texts.select(*keys, "html_text", "parsed_text"), keys).withColumns(
        {
            "quote_checks": check_quotes("claimed_missing", "parsed_text", "html_text", limits),
            "grounded": grounded_fraction("parsed_text", "html_text", limits),
        }
    )
    return checked.drop("html_text", "parsed_text").withColumns(
        {
            "omissions": confirmed_omissions("quote_checks"),
            "complete": confirmed_omissions("quote_checks") == 0,
            "coherent_by_score": F.col("coherence") >= limits.coherent_from,
        }
    )
