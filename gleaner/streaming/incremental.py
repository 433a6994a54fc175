"""Scoring of gold pages as they arrive.

The only state is the stored evaluations table, so a batch that is retried
scores nothing twice: pages already measured are left out again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.metrics import METRICS
from ..operators.tables import one_per_key
from ..plans.evaluate import STORED_NAMES, evaluate_pages
from ..plans.reports import missing_metrics
from ..schema import GOLD_ENTRY
from ..session import durable
from ..sources.buckets import BucketTable, save_metrics


def score_arrivals(
    spark: SparkSession,
    entries_path: str,
    checkpoint: str,
    stored: Callable[[], DataFrame],
    save: Callable[[DataFrame, int], None],
) -> StreamingQuery:
    """Score every new gold entry under ``entries_path`` once.

    ``stored`` reads the evaluations as they are, ``save`` appends a batch of
    scores. The stream ends when the files present at its start are done.
    """
    arrivals = spark.readStream.schema(GOLD_ENTRY).option("multiLine", True).json(entries_path)

    def score_batch(batch: DataFrame, batch_id: int) -> None:
        new = batch.dropDuplicates(["url"])
        todo = missing_metrics(new.select("url", "gold_text"), stored())
        save(evaluate_pages(todo, new.select("url", "domain", "html_text")), batch_id)

    return (
        arrivals.writeStream.foreachBatch(score_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def score_into(spark: SparkSession, entries_path: str, checkpoint: str, evaluations: BucketTable) -> StreamingQuery:
    """Score every new gold entry under ``entries_path`` once, into a stored table dealt by the URL.

    A batch reads and rewrites the buckets of its own pages only, so its time does
    not grow with what is stored. A batch that is run again finds its pages measured.
    """
    arrivals = spark.readStream.schema(GOLD_ENTRY).option("multiLine", True).json(entries_path)

    def score_batch(batch: DataFrame, _: int) -> None:
        new = one_per_key(batch, ["url"])
        todo = missing_metrics(new.select("url", "gold_text"), evaluations.beside(new))
        scores = evaluate_pages(todo, new.select("url", "domain", "html_text"))
        save_metrics(evaluations, durable(scores.select("url", *[F.col(m).alias(STORED_NAMES.get(m, m)) for m in METRICS])))

    return (
        arrivals.writeStream.foreachBatch(score_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
