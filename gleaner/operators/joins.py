"""Joins of large tables with key-value tables whose keys are uneven."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_TASK = 2_000_000
# Rows of a lookup that are broadcast, whatever the share of its keys; a lookup has one short row per key.
FEW_KEYS = 50_000


def salts_for(facts: DataFrame, keys: list[str], rows_per_task: int = ROWS_PER_TASK) -> int:
    """How many parts the most frequent key must be cut into to leave ``rows_per_task`` rows in each."""
    largest = facts.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    return max(1, -(-largest // rows_per_task))


def spread_join(
    facts: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    spread_on: list[str],
    how: str = "inner",
    salts: int | None = None,
) -> DataFrame:
    """Join a large table with one row per key of ``lookup``, whatever the key's share.

    A run or a domain may own a third of all pages. A lookup of up to ``FEW_KEYS``
    rows, which are counted, is broadcast and the rows stay where they are. For a
    larger one the rows per key are counted; while none has more than a task
    should hold, this is a plain join. Else the rows are spread over as many join
    keys as the count asks for, by a hash of ``spread_on`` (stable, so a retried
    task agrees with itself), and ``lookup`` is repeated once per salt.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a spread join keeps the side of the facts: {how}")
    if salts is None and lookup.limit(FEW_KEYS + 1).count() <= FEW_KEYS:
        return facts.join(F.broadcast(lookup), keys, how)
    parts = salts_for(facts, keys) if salts is None else salts
    if parts == 1:
        return facts.join(lookup, keys, how)
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(*spread_on), F.lit(parts)).cast("int"))
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")
