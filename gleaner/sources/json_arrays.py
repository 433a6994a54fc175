"""Large JSON documents read by many tasks: a list of objects, cut at its elements.

The list is the document itself, or the one list of objects under a key of it. Files
are read in ranges of bytes. Whether a range begins inside of a string, and how deep,
depends on all that comes before it; so every range first says what it does to
either state, prefix sums over the ranges of a file give each its beginning, and
then each range finds the elements that begin in it and reads on to the end of the
last. The elements are parsed by Spark. What stands between elements is checked,
and a document that is broken, or of another form, fails the job by its name.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The reader travels with the job, so executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__.partition(".")[0]])

RANGE_BYTES = 4 << 20
# What is read on at a time to the end of an element.
AHEAD = 1 << 18
MOST_TASKS = 20_000
QUOTE, BACKSLASH = ord('"'), ord("\\")
_STEP = np.zeros(256, np.int8)
_STEP[[ord("{"), ord("[")]] = 1
_STEP[[ord("}"), ord("]")]] = -1
_BETWEEN = np.zeros(256, bool)
_BETWEEN[[ord(c) for c in "[], \t\r\n"]] = True


def opened(path: str) -> pa.NativeFile:
    """A stored file by the URI that Spark names it by."""
    system, inside = pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    return system.open_input_file(inside)


def quotes_of(data: np.ndarray, slashes: int) -> np.ndarray:
    """Which bytes are quotes that no backslash escapes; ``slashes`` stand before the first byte."""
    at = np.arange(len(data))
    last = np.maximum.accumulate(np.where(data != BACKSLASH, at, -1))
    before = np.concatenate(([-1], last[:-1])) if len(data) else last
    run = at - 1 - before + np.where(before < 0, slashes, 0)
    return (data == QUOTE) & (run % 2 == 0)


def slashes_before(file: pa.NativeFile, start: int) -> int:
    """How many backslashes in a row end before a place of the file."""
    count = 0
    while start - count > 0:
        size = min(64, start - count)
        block = file.read_at(size, start - count - size)
        run = len(block) - len(block.rstrip(b"\\"))
        count += run
        if run < size:
            break
    return count


@dataclass
class Walk:
    """Bytes read so far with their depth after each, outside of strings; ``depth`` and ``inside`` at the end."""

    depth: int
    inside: bool
    slashes: int

    def read(self, block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = np.frombuffer(block, np.uint8)
        strings = (np.cumsum(quotes_of(data, self.slashes)) + self.inside) % 2 == 1
        depth = self.depth + np.cumsum(np.where(strings, 0, _STEP[data]), dtype=np.int64)
        if len(data):
            tail = len(block) - len(block.rstrip(b"\\"))
            self.slashes = tail + (self.slashes if tail == len(block) else 0)
            self.depth, self.inside = int(depth[-1]), bool(strings[-1])
        return data, strings, depth


def _effects(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range: whether it changes from outside to inside of a string, and its depth from either beginning."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            with opened(row["path"]) as file:
                slashes = slashes_before(file, row["start"])
                block = file.read_at(row["end"] - row["start"], row["start"])
            out, within = Walk(0, False, slashes), Walk(0, True, slashes)
            out.read(block)
            within.read(block)
            rows.append((row["path"], row["start"], row["end"], int(out.inside), out.depth, within.depth))
        yield pa.RecordBatch.from_pylist([dict(zip(EFFECTS, r)) for r in rows], pa.schema(EFFECTS))


EFFECTS = {
    "path": pa.string(), "start": pa.int64(), "end": pa.int64(), "flips": pa.int64(), "out": pa.int64(), "within": pa.int64(),
}
FOUND = {"path": pa.string(), "first": pa.int64(), "last": pa.int64(), "element": pa.string()}


def _elements(level: int):
    """Elements of the list at depth ``level`` that begin in each range, with where they begin and end."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with opened(row["path"]) as file:
                    yield from _of_range(file, row, level)

    return run


def _of_range(file: pa.NativeFile, row: dict, level: int) -> Iterator[pa.RecordBatch]:
    start, end = row["start"], row["end"]
    walk = Walk(row["depth"], bool(row["inside"]), slashes_before(file, start))
    block = file.read_at(end - start, start)
    data, strings, depth = walk.read(block)
    begins = np.flatnonzero(~strings & (data == ord("{")) & (depth == level + 1))
    ends = np.flatnonzero(~strings & (data == ord("}")) & (depth == level)) + 1
    ends = ends[np.searchsorted(ends, begins[0], "right") :] if len(begins) else ends[:0]
    if level == 1:
        stray = ~strings & (depth <= 1) & ~_BETWEEN[data] & (data != ord("}"))
        if stray.any() or (strings & (depth <= 1)).any():
            raise ValueError(f"not a list of objects: {row['path']}, near byte {start + int(np.argmax(stray | (strings & (depth <= 1))))}")
    parts = [block]
    while len(ends) < len(begins):
        at = end + sum(map(len, parts[1:]))
        more = file.read_at(AHEAD, at)
        if not more:
            raise ValueError(f"an element does not end: {row['path']}, from byte {start + int(begins[-1])}")
        data, strings, depth = walk.read(more)
        closing = np.flatnonzero(~strings & (data == ord("}")) & (depth == level))
        if len(closing):
            ends = np.append(ends, at - start + closing[0] + 1)
        parts.append(more)
    whole = b"".join(parts)
    texts = [whole[a:b].decode() for a, b in zip(begins.tolist(), ends.tolist())]
    columns = [[row["path"]] * len(texts), (begins + start).tolist(), (ends[: len(begins)] + start).tolist(), texts]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, FOUND.values())], list(FOUND))


def _ddl(columns: dict) -> str:
    return ", ".join(f"`{n}` {'string' if t == pa.string() else 'bigint'}" for n, t in columns.items())


def list_elements(spark: SparkSession, path: str, level: int = 1, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``path``, ``first``, ``last`` (bytes) and the text of every element of the lists under ``path``."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(range_bytes).cast("bigint"))
    ranges = files.select("path", "length", F.explode(starts).alias("start")).select(
        "path", "start", F.least(F.col("start") + range_bytes, F.col("length")).alias("end")
    )
    # Ranges are short rows that stand for megabytes, so their number and not their size says how many tasks there are.
    tasks = max(1, min(MOST_TASKS, ranges.count()))
    effects = ranges.repartition(tasks, "path", "start").mapInArrow(_effects, _ddl(EFFECTS))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    strings = effects.withColumn("inside", F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2)
    placed = strings.withColumn("by", F.when(F.col("inside") == 1, F.col("within")).otherwise(F.col("out")))
    placed = placed.withColumn("depth", F.coalesce(F.sum("by").over(before), F.lit(0)))
    whole = Window.partitionBy("path")
    open_ = (F.sum("by").over(whole) != 0) | (F.sum("flips").over(whole) % 2 != 0)
    broken = F.raise_error(F.concat(F.lit("a document does not end: "), F.col("path"))).cast("boolean")
    placed = placed.withColumn("open", open_).where(F.when(F.col("open"), broken).otherwise(F.lit(True)))
    rows = placed.select("path", "start", "end", "inside", "depth").repartition(tasks, "path", "start")
    return rows.mapInArrow(_elements(level), _ddl(FOUND))


def _file_name(path: str):
    return F.regexp_extract(path, r"([^/]*)$", 1).alias("file")


def read_array(spark: SparkSession, path: str, schema: T.StructType, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The objects of JSON arrays by ``schema``, and ``file``, the name of theirs. Empty files have none."""
    found = list_elements(spark, path, 1, range_bytes)
    parsed = F.from_json("element", schema, {"mode": "FAILFAST"})
    return found.select(_file_name("path"), parsed.alias("_e")).select("_e.*", "file")


def read_listed(
    spark: SparkSession, path: str, key: str, schema: T.StructType, range_bytes: int = RANGE_BYTES
) -> tuple[DataFrame, DataFrame]:
    """Documents with one list of objects under ``key``: the documents without it, and the objects.

    ``schema`` is a document's. Both have ``file``, which joins them. A document whose list is empty
    has no objects. The list must be the only one of objects directly in the document; another
    would leave more than the document's own fields between its brackets and fails the job.
    """
    element = schema[key].dataType.elementType
    found = list_elements(spark, path, 2, range_bytes)
    objects = found.select(_file_name("path"), F.from_json("element", element, {"mode": "FAILFAST"}).alias("_e")).select("_e.*", "file")
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    edges = found.groupBy(F.col("path").alias("_of")).agg(F.min("first").alias("first"), F.max("last").alias("last"))
    around = files.join(edges, F.col("path") == F.col("_of"), "left").select("path", "length", "first", "last")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                with opened(row["path"]) as file:
                    if row["first"] is None:
                        text = file.read_at(row["length"], 0)
                    else:
                        text = file.read_at(row["first"], 0) + file.read_at(row["length"] - row["last"], row["last"])
                rows.append({"path": row["path"], "text": text.decode()})
            yield pa.RecordBatch.from_pylist(rows, pa.schema({"path": pa.string(), "text": pa.string()}))

    rest = T.StructType([f for f in schema.fields if f.name != key])
    heads = around.mapInArrow(read, "path string, text string")
    documents = heads.select(_file_name("path"), F.from_json("text", rest, {"mode": "FAILFAST"}).alias("_d")).select("_d.*", "file")
    return documents, objects
