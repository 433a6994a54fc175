"""Mixing sources to target weights.

Each document gets a random place on its source's line by a hash of its id.
Sources are taken along that line: whole rounds first, then up to the word at
which the source's budget is used up. To find that word, the line is cut into
ranges of about ``RANGE_ROWS`` documents; the words of every range are summed
where they lie, the sums are added up along the line, and only the one range
that holds the cut is sorted. No source, however large, passes through one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.storage import durable, free_prefix, lookup

WEIGHTS = (5.0, 2.0, 1.0)
MOST_ROUNDS = 3
RANGE_ROWS = 1_000
# Sources whose budgets are broadcast; a source is one short row.
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("bigint")


def place_of(doc_id: str, seed: str) -> Column:
    """32 hex digits that order a source's documents at random, always in the same way."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))


def text_of(text: str) -> Column:
    """Tells rows of one id and size apart: a hash of the text; a null text is the empty one."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def range_of(place: Column, ranges: Column) -> Column:
    """Which of ``ranges`` equal ranges a place lies in."""
    fraction = F.conv(F.substring(place, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    return F.floor(fraction * ranges)


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``_rank``, its position by code point from 0, null last.

    Sources are sorted in ranges; a range's first rank is the number of sources before it.
    """
    spread = sources.repartitionByRange(F.col("_source").asc_nulls_last()).withColumn("_part", F.spark_partition_id())
    stable = durable(spread)
    parts = stable.groupBy("_part").agg(F.count("*").alias("_n"))
    before = parts.select(
        F.col("_part").alias("_p"),
        (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"),
    )
    own = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("_source").asc_nulls_last()))
    return stable.withColumn("_own", own).join(before, F.col("_part") == F.col("_p")).select(
        *sources.columns, (F.col("_before") + F.col("_own") - 1).alias("_rank")
    )


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """``sources`` (``_source``, ``_docs``, ``_size``) with ``_target``.

    All words are shared by weight; a source gets ``most_rounds`` times its own
    words at most, and what it cannot take is shared by weight among the others,
    until none is above. One row comes to the driver in each step.
    """
    place = F.pmod(F.col("_rank"), F.lit(len(weights))).cast("int")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1)
    weighed = durable(ranked(sources).withColumn("_weight", weight).withColumn("_most", F.col("_size") * float(most_rounds)))
    total = weighed.agg(F.sum("_size"), F.sum("_weight")).first()
    if not total[1]:
        return weighed.withColumn("_target", F.lit(0.0))
    words, level, capped = float(total[0] or 0), float(total[0] or 0) / total[1], -1
    while True:
        above = F.col("_most") < level * F.col("_weight")
        found = weighed.agg(
            F.count(F.when(above, 1)), F.sum(F.when(above, F.col("_most")).otherwise(0.0)),
            F.sum(F.when(above, 0.0).otherwise(F.col("_weight"))),
        ).first()
        if found[0] == capped or not found[2]:
            break
        capped, level = found[0], (words - found[1]) / found[2]
    return weighed.withColumn("_target", F.least("_most", level * F.col("_weight")))


def narrowed(rows: DataFrame, level: Column) -> DataFrame:
    """Of every source (``_s``) the rows of that value of ``level`` in which its budget ``_rest`` ends.

    Values come in order; ``_rest`` becomes what is left of the budget for these rows.
    Sums per value are made before anything is ordered.
    """
    valued = rows.withColumn("_level", level)
    line = Window.partitionBy("_s").orderBy("_level").rowsBetween(Window.unboundedPreceding, 0)
    ends = (
        valued.groupBy("_s", "_rest", "_level").agg(F.sum("_words").alias("_sum"))
        .withColumn("_until", F.sum("_sum").over(line))
        .where((F.col("_until") >= F.col("_rest")) & (F.col("_until") - F.col("_sum") < F.col("_rest")))
        .select(F.col("_s").alias("_of"), F.col("_level").alias("_in"), (F.col("_rest") - F.col("_until") + F.col("_sum")).alias("_now"))
    )
    here = F.col("_s").eqNullSafe(F.col("_of")) & (F.col("_level") == F.col("_in"))
    return valued.join(ends, here).withColumn("_rest", F.col("_now")).drop("_of", "_in", "_now", "_level")


# The order of a source's documents: by place, then size, then text.
ORDER = ("_place", "_words", "_text")


def plan(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    most_rounds: int = MOST_ROUNDS,
    seed: str = "mix",
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """One row per source: its words, target, whole rounds, and the document at which its budget ends.

    ``_cut`` is that document's place, words and text (a hash), ``_left`` how many words of it still
    belong to the mix and ``_same`` how many rows are just like it; they are null where the budget is
    whole rounds exactly. The document is found by ranges of places, then by places, sizes and texts,
    so rows that share an id, or have none, are not gathered to be ordered.
    """
    rows = durable(
        docs.select(
            F.col(source).alias("_source"), place_of(doc_id, seed).alias("_place"), word_count(text).alias("_words"),
            text_of(text).alias("_text"),
        )
    )
    sources = rows.groupBy("_source").agg(F.count("*").alias("_docs"), F.sum("_words").alias("_size"))
    budget = F.round("_target").cast("bigint")
    size = F.greatest("_size", F.lit(1))
    shares = durable(
        targets(sources, weights, most_rounds)
        .withColumn("_rounds", F.when(F.col("_size") > 0, F.floor(budget / size)).otherwise(F.lit(0)))
        .withColumn("_rest", F.when(F.col("_size") > 0, budget - F.col("_rounds") * size).otherwise(F.lit(0)))
        .select("_source", "_size", "_target", "_rounds", "_rest", F.ceil(F.col("_docs") / range_rows).alias("_ranges"))
    )
    of = shares.select(F.col("_source").alias("_s"), "_ranges", "_rest").where("_rest > 0")
    placed = rows.join(of, F.col("_source").eqNullSafe(F.col("_s")))
    inside = durable(narrowed(placed, range_of(F.col("_place"), F.col("_ranges"))))
    inside = durable(narrowed(inside, F.col("_place")))
    # Texts of one size are dealt to ranges of their hash first.
    for level in (F.col("_words"), F.shiftright("_text", 48), F.col("_text")):
        inside = narrowed(inside, level)
    cuts = inside.groupBy(F.col("_s").alias("_cut_of"), F.col("_rest").alias("_left")).agg(
        F.first(F.struct(*ORDER)).alias("_cut"), F.count("*").alias("_same")
    )
    return shares.join(cuts, F.col("_source").eqNullSafe(F.col("_cut_of")), "left").select(
        "_source", "_size", "_target", "_rounds", "_cut", "_left", "_same"
    )


def numbered(rows: DataFrame, keys: list[str], number: str, part: str) -> DataFrame:
    """``rows`` with a number from 0 within their keys, for rows that nothing else tells apart.

    Rows are counted where they lie: a partition's first number is the rows of the partitions before it.
    """
    stable = durable(rows.withColumn(part, F.spark_partition_id()))
    counts = stable.groupBy(*keys, part).agg(F.count("*").alias(f"{part}_n"))
    line = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, 0)
    before = counts.select(
        *[F.col(k).alias(f"{k}_of") for k in keys], F.col(part).alias(f"{part}_of"),
        (F.sum(f"{part}_n").over(line) - F.col(f"{part}_n")).alias(f"{part}_before"),
    )
    same = F.col(part) == F.col(f"{part}_of")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"{key}_of"))
    own = F.row_number().over(Window.partitionBy(*keys, part).orderBy(F.lit(1)))
    found = stable.withColumn(f"{part}_own", own).join(before, same)
    return found.select(*rows.columns, (F.col(f"{part}_before") + F.col(f"{part}_own") - 1).alias(number))


OUTPUT = ("size", "source_size", "target", "taken")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    most_rounds: int = MOST_ROUNDS,
    seed: str = "mix",
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """``docs`` with ``size`` (words), its source's ``source_size`` and ``target``, and ``taken``.

    ``taken`` is how many words of the document the mix holds, repeats counted:
    its size for every whole round, once more if it lies before the cut, a part
    of it at the cut. Documents of a source are ordered by a hash of the id, then
    by size and text, so the cut falls into one row, whatever ids are repeated or
    missing; of rows that are alike in all three the first in the table's order
    are taken. Columns named like the results are replaced, others may have any
    names. A null text has no words, rows without a source are the last source. A
    source without words has target 0.
    """
    budgets = plan(docs, weights, most_rounds, seed, doc_id, source, text, range_rows)
    mark = free_prefix(docs.columns)
    known = lookup(budgets, "1", BROADCAST_SOURCES)
    known = known.select(*[F.col(c).alias(mark + c) for c in known.columns])

    def own(name: str) -> Column:
        return F.col(mark + name)

    placed = docs.withColumns(
        {mark + "_place": place_of(doc_id, seed), mark + "_words": word_count(text), mark + "_text": text_of(text)}
    )
    joined = placed.join(known, F.col(source).eqNullSafe(own("_source")))
    document = F.struct(*[own(c).alias(c) for c in ORDER])
    words = own("_words")
    more = F.when(own("_cut").isNull() | (document > own("_cut")), F.lit(0)).when(document < own("_cut"), words)

    def result(rows: DataFrame, taken: Column) -> DataFrame:
        return rows.select(
            *[c for c in docs.columns if c not in OUTPUT], words.alias("size"), own("_size").alias("source_size"),
            own("_target").cast("double").alias("target"), (own("_rounds") * words + taken).cast("bigint").alias("taken"),
        )

    if known.where(own("_same") > 1).isEmpty():
        return result(joined, more.otherwise(own("_left")))
    alike = F.coalesce((document == own("_cut")) & (own("_same") > 1), F.lit(False))
    number = mark + "_number"
    one_by_one = numbered(joined.where(alike), [mark + "_source"], number, mark + "_part")
    share = F.greatest(F.lit(0), F.least(words, own("_left") - F.col(number) * words))
    return result(joined.where(~alike), more.otherwise(own("_left"))).unionByName(result(one_by_one, share))
