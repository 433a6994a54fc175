"""Where the operators of this package cut their lineage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_BYTES = 4 << 20


def in_small_batches(df: DataFrame, most: int = BATCH_BYTES) -> DataFrame:
    """``df``, to be handed to Python about ``most`` bytes at a time.

    Rows of texts differ in size, so a number of rows bounds no memory. The
    setting is the session's, which lowers it for its other Arrow functions as
    well; a smaller one is left.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    session = df.sparkSession
    now = session._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(session.conf.get(key))
    if now > most:
        session.conf.set(key, str(most))
    return df


def free_prefix(columns: Iterable[str]) -> str:
    """A prefix that none of the columns has, for columns of one's own beside them."""
    taken, prefix = [c.lower() for c in columns], "_x_"
    while any(c.startswith(prefix) for c in taken):
        prefix = "_x" + prefix
    return prefix


def shared_folder(session: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset, as in tests, one below the
    warehouse, which executors share as well."""
    named = session.conf.get("spark.checkpoint.dir", None)
    return (named or session.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints").rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder, so that a lost executor costs no recomputation."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


@contextmanager
def setting(session: SparkSession, key: str, value: str) -> Iterator[None]:
    """``key`` is ``value`` inside, and afterwards what it was."""
    before = session.conf.get(key, None)
    session.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            session.conf.unset(key)
        else:
            session.conf.set(key, before)


def without_shuffles(df: DataFrame) -> DataFrame:
    """As ``durable``; what its plan shuffled leaves the disk as soon as the result is written.

    Otherwise both are kept until the driver's garbage collector finds the plan.
    """
    with setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        return durable(df.select("*"))


def dealt_by(df: DataFrame, tasks: int, key: str) -> DataFrame:
    """As ``without_shuffles``, in ``tasks`` partitions by ``key``, which later groupings by it need not shuffle again.

    Adaptive plans do not say how their result is partitioned, so this one is not adaptive.
    """
    with setting(df.sparkSession, "spark.sql.adaptive.enabled", "false"):
        return without_shuffles(df.repartition(tasks, key))


def lookup(table: DataFrame, weight: str, most: int) -> DataFrame:
    """``table``, checkpointed, and marked for broadcast if its ``weight`` adds up to ``most`` at most.

    The sum is taken before anything is broadcast. Above it the join is left to
    Spark, which moves both sides and splits keys that are too frequent.
    """
    kept = durable(table)
    total = kept.agg(F.sum(F.expr(weight).cast("bigint"))).first()[0] or 0
    return F.broadcast(kept) if total <= most else kept


def in_stages(first: DataFrame, steps: Iterable[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Apply ``steps`` one after the other, each result written as Parquet and read again.

    A step's input is deleted once its result is written; the last result stays
    in the shared folder, as the returned table reads it.
    """
    session = first.sparkSession
    folder = f"{shared_folder(session)}/stages-{uuid.uuid4()}"
    now, before = first, None
    for number, step in enumerate(steps):
        path = f"{folder}/{number}"
        step(now).write.parquet(path)
        now = session.read.parquet(path)
        if before:
            old = session._jvm.org.apache.hadoop.fs.Path(before)
            old.getFileSystem(session._jsc.hadoopConfiguration()).delete(old, True)
        before = path
    return now
