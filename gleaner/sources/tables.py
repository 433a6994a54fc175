"""The stored tables: Parquet, laid out for the joins and filters the jobs make."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The tables keyed by a page's URL are joined with one another on it.
KEYED_BY_URL = ("web_resources", "gold_standard", "evaluations")


def save_keyed(df: DataFrame, name: str, buckets: int, key: str = "url") -> None:
    """Store a table bucketed and sorted by its key.

    Tables with equal buckets join on the key without moving a row, which is
    what keeps the raw HTML off the network. Choose ``buckets`` so that one
    holds a few hundred megabytes.
    """
    (
        df.repartition(buckets, key)
        .write.mode("overwrite")
        .bucketBy(buckets, key)
        .sortBy(key)
        .format("parquet")
        .saveAsTable(name)
    )


def save_page_results(df: DataFrame, path: str) -> None:
    """Store page results one folder per run, so reading a run reads only its files.

    Spark balances the rows by run before they are written: small runs share a
    task, a large one is cut into as many as its bytes ask for
    (``spark.sql.adaptive.advisoryPartitionSizeInBytes``).
    """
    spread = df.hint("rebalance", F.col("run_id"))
    spread.write.mode("overwrite").partitionBy("run_id").parquet(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def page(pages: DataFrame, url: str) -> DataFrame:
    """One page by its URL; the predicate reaches the Parquet scan."""
    return pages.where(F.col("url") == url)
