"""Stored tables of which a write rewrites only the parts it touches.

Rows are dealt to buckets by a hash of some of their key columns. A bucket's rows
lie in a folder of its own; which folder that is, a snapshot says: a few rows, one
per bucket, stored as Parquet under the snapshot's number. A write reads the
buckets of its new rows, lets an ordinary table step change them, stores the
result in new folders and then publishes a snapshot that names these and, for all
other buckets, the folders they had. Until then readers see the table as it was,
so a job that is lost on the way leaves nothing but folders nobody names.

Two writers cannot publish the same snapshot: the second one fails and may try
again. ``buckets`` should make a bucket some hundred megabytes large.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import tables

# A table step on some rows: what is stored and what is new, to what is to be stored.
Step = Callable[[DataFrame, DataFrame], DataFrame]

BUCKET = "_bucket"
SNAPSHOT = T.StructType([T.StructField(BUCKET, T.IntegerType()), T.StructField("folder", T.StringType())])


class Conflict(RuntimeError):
    """Another writer published first."""


@dataclass(frozen=True)
class BucketTable:
    """A table under ``path`` whose rows are dealt to ``buckets`` by the columns ``on``."""

    spark: SparkSession
    path: str
    schema: T.StructType
    on: tuple[str, ...]
    buckets: int

    # -- reading ----------------------------------------------------------------

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.on), F.lit(self.buckets)).cast("int")

    def newest(self) -> int:
        """The number of the newest snapshot, -1 if nothing was published yet."""
        found = self._published()
        return -1 if found is None else found.agg(F.max("snapshot")).first()[0]

    def _published(self) -> DataFrame | None:
        kept = T.StructType([*SNAPSHOT.fields, T.StructField("snapshot", T.LongType())])
        try:
            found = self.spark.read.schema(kept).parquet(f"{self.path}/snapshots")
        except AnalysisException:
            return None
        return None if found.isEmpty() else found

    def folders(self, snapshot: int | None = None) -> dict[int, str]:
        """The folder of every bucket that has rows; at most ``buckets`` of them."""
        number = self.newest() if snapshot is None else snapshot
        if number < 0:
            return {}
        rows = self._published().where(F.col("snapshot") == number).where(F.col(BUCKET) >= 0).collect()
        return {r[BUCKET]: r["folder"] for r in rows}

    def read(self, snapshot: int | None = None, only: set[int] | None = None) -> DataFrame:
        """The table, as it is or as it was; with ``only`` the rows of these buckets."""
        wanted = [f"{self.path}/{f}" for b, f in sorted(self.folders(snapshot).items()) if only is None or b in only]
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*wanted)

    def touched(self, rows: DataFrame) -> set[int]:
        """The buckets that rows with the columns ``on`` lie in; at most ``buckets`` numbers."""
        return {r[0] for r in rows.select(self.bucket()).distinct().collect()}

    def beside(self, rows: DataFrame) -> DataFrame:
        """The stored rows of the buckets that ``rows`` lie in, all that a join with them can meet."""
        return self.read(only=self.touched(rows))

    # -- writing ----------------------------------------------------------------

    def replace(self, rows: DataFrame) -> int:
        """Store ``rows`` in place of all there is; the number of the new snapshot."""
        return self._publish(self.newest(), self._write(rows), dict.fromkeys(range(self.buckets)))

    def merge(self, new: DataFrame, step: Step) -> int:
        """Change the buckets of ``new`` by ``step``; the number of the new snapshot.

        ``step`` gets the stored rows of these buckets and ``new``, and gives what they
        are to hold; its rows stay in the buckets of ``new``. Without new rows nothing is written.
        """
        base, only = self.newest(), self.touched(new)
        if not only:
            return base
        changed = step(self.read(base, only), new).select(*self.schema.names)
        return self._publish(base, self._write(changed), dict.fromkeys(only))

    def _write(self, rows: DataFrame) -> str:
        folder = f"data/{uuid.uuid4()}"
        dealt = rows.withColumn(BUCKET, self.bucket())
        dealt.hint("rebalance", F.col(BUCKET)).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        return folder

    def _publish(self, base: int, folder: str, rewritten: dict[int, None]) -> int:
        """Name the folders of the next snapshot: the rewritten buckets that have rows, and all others as they were."""
        written = self.spark.read.parquet(f"{self.path}/{folder}") if self._any(folder) else None
        filled = set() if written is None else {r[0] for r in written.select(BUCKET).distinct().collect()}
        strays = filled - rewritten.keys()
        if strays:
            raise ValueError(f"the step moved rows to buckets it did not read: {sorted(strays)}")
        now = {b: f for b, f in self.folders(base).items() if b not in rewritten}
        now |= {b: f"{folder}/{BUCKET}={b}" for b in filled}
        # A snapshot of an empty table has a row as well, so that it counts.
        rows = self.spark.createDataFrame([*now.items(), (-1, "")], SNAPSHOT)
        target = f"{self.path}/snapshots/snapshot={base + 1}"
        try:
            rows.coalesce(1).write.mode("errorifexists").parquet(target)
        except AnalysisException:
            if self.newest() > base:
                raise Conflict(f"snapshot {base + 1} of {self.path} was published by another writer") from None
            # What a lost job left of its publishing.
            rows.coalesce(1).write.mode("overwrite").parquet(target)
        return base + 1

    def _any(self, folder: str) -> bool:
        try:
            return not self.spark.read.parquet(f"{self.path}/{folder}").isEmpty()
        except AnalysisException:
            return False


# -- the table steps on stored tables --------------------------------------------------------------


def upsert(table: BucketTable, new: DataFrame, keys: list[str], order: str | None = None) -> int:
    return table.merge(new, lambda stored, rows: tables.upsert(stored, rows, keys, order))


def upsert_pages(pages: BucketTable, fetched: DataFrame, order: str | None = None) -> int:
    """Store fetched pages (``url, html_text``); domain and title are read off them."""
    return pages.merge(fetched, lambda stored, rows: tables.upsert_pages(stored, rows, order))


def upsert_gold(gold: BucketTable, pages: BucketTable, new: DataFrame, order: str | None = None) -> DataFrame:
    """Store gold texts of known pages; the others are handed back. Both tables are dealt by the URL."""
    written = tables.upsert_gold(gold.beside(new), pages.beside(new), new, order)
    known = new.join(written.rejected.select("url").distinct(), "url", "left_anti")
    gold.merge(known, lambda stored, rows: tables.upsert(stored, rows, ["url"], order))
    return written.rejected


def save_pages_with_gold(pages: BucketTable, gold: BucketTable, entries: DataFrame, order: str | None = None) -> None:
    """Pages first, then their gold texts, of several entries for a URL the last by ``order`` both."""
    upsert_pages(pages, entries.select("url", "html_text", *([order] if order else [])), order)
    gold.merge(entries, lambda stored, rows: tables.save_pages_with_gold(pages.read(only=set()), stored, rows, order)[1].table)


def save_metrics(evaluations: BucketTable, scores: DataFrame, order: str | None = None) -> int:
    """Write the metrics of some pages and leave what else is stored of them."""
    return evaluations.merge(scores, lambda stored, rows: tables.save_metrics(stored, rows, order))


def delete(table: BucketTable, urls: DataFrame) -> int:
    """Remove the rows of some pages."""
    return table.merge(urls, lambda stored, gone: tables.delete_gold(gone, stored))


def replace_runs(
    runs: DataFrame, results: BucketTable, new_runs: DataFrame, new_results: DataFrame
) -> DataFrame:
    """The runs with the new ones by label; results of replaced runs go and new ones come.

    ``results`` is dealt by run (or by run and page: then a replaced run touches all
    buckets its pages are in). Only rows of the runs concerned are rewritten with
    those that share a bucket.
    """
    old = runs.join(new_runs.select("label"), "label", "left_semi").select("run_id")
    gone = results.beside(old) if results.on == ("run_id",) else results.read()
    concerned = (
        gone.join(old, "run_id", "left_semi").select(*results.on)
        .unionByName(new_results.select(*results.on)).distinct()
    )

    def step(stored: DataFrame, _: DataFrame) -> DataFrame:
        return tables.replace_runs(runs, stored, new_runs, new_results)[1]

    kept = runs.join(new_runs.select("label"), "label", "left_anti").select(*runs.columns)
    results.merge(concerned, step)
    return kept.unionByName(new_runs, allowMissingColumns=True)
