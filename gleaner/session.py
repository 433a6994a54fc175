"""Session settings and the durable cut of a lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Page texts run to megabytes, so input splits stay small and AQE merges what
# turns out to be little after a shuffle. Skewed join partitions are split.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.files.maxPartitionBytes": "64m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Arrow batches of rows that may hold megabytes of HTML each.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
}


def build_session(app_name: str = "gleaner", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the library's defaults; ``extra`` wins over them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(session: SparkSession) -> str:
    """A folder that all executors share: ``spark.checkpoint.dir``, else one below the warehouse."""
    warehouse = session.conf.get("spark.sql.warehouse.dir").rstrip("/")
    return session.conf.get("spark.checkpoint.dir", None) or f"{warehouse}/_checkpoints"


def durable(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the cluster's shared folder, so a lost executor costs no recomputation."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
