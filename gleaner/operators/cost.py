"""What calls and local work cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EUR_PER_USD, LOCAL_MACHINE, OK, REMOTE_PROVIDERS, LocalMachine
from ..functions.basic import Columnish, as_column, strip


def is_remote(provider: Columnish) -> Column:
    return F.coalesce(F.lower(strip(provider)).isin(*REMOTE_PROVIDERS), F.lit(False))


def local_cost(
    seconds: Columnish, provider: Columnish, machine: LocalMachine = LOCAL_MACHINE
) -> dict[str, Column]:
    """Electricity, hardware and total in euros; NULL for remote work or no recorded time."""
    spent = F.when(~is_remote(provider) & (as_column(seconds) > 0), as_column(seconds))
    electricity = spent * machine.electricity_per_second
    hardware = spent * machine.hardware_per_second
    return {
        "local_cost_eur": electricity + hardware,
        "local_cost_electricity_eur": electricity,
        "local_cost_hardware_eur": hardware,
    }


def with_local_cost(
    df: DataFrame, seconds: str = "wall_seconds", provider: str = "provider",
    machine: LocalMachine = LOCAL_MACHINE,
) -> DataFrame:
    return df.withColumns(local_cost(seconds, provider, machine))


def call_rollup(calls: DataFrame, keys: list[str], eur_per_usd: float = EUR_PER_USD) -> DataFrame:
    """One row per page out of one row per call.

    Expects ``n, cost_usd, prompt_tokens, completion_tokens, provider,
    generation_id``. The ordered lists are as long as a page has pieces, which
    the size of one page's text bounds.
    """
    ordered = F.array_sort(F.collect_list(F.struct("n", "cost_usd", "provider", "generation_id")))
    named = F.when(F.coalesce(F.col("provider"), F.lit("")) != "", F.col("provider"))
    rolled = calls.groupBy(*keys).agg(
        F.count("*").alias("calls"),
        F.sum("cost_usd").alias("cost_usd"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        ordered.alias("_ordered"),
        F.array_sort(F.collect_set(named)).alias("providers_used"),
    )
    return rolled.select(
        *keys,
        "calls",
        "cost_usd",
        (F.col("cost_usd") * eur_per_usd).alias("cost_eur"),
        "prompt_tokens",
        "completion_tokens",
        F.col("_ordered.cost_usd").alias("call_costs_usd"),
        F.col("_ordered.provider").alias("providers"),
        F.col("_ordered.generation_id").alias("generation_ids"),
        "providers_used",
    )


def run_cost(page_results: DataFrame, keys: list[str]) -> DataFrame:
    """Spent, calls of parsed pages and the price of one call; no row where nothing was spent."""
    pieces = F.when(
        F.col("status") == OK, F.coalesce(F.nullif(F.col("fragments"), F.lit(0)), F.lit(1))
    )
    totals = page_results.groupBy(*keys).agg(
        F.coalesce(F.sum("cost_eur"), F.lit(0.0)).alias("spent_eur"),
        F.coalesce(F.sum(pieces), F.lit(0)).alias("calls"),
    )
    return totals.where(F.col("spent_eur") != 0).withColumn(
        "eur_per_call", F.try_divide(F.col("spent_eur"), F.col("calls"))
    )
