"""SimHash near-duplicates: fingerprints, links by BK-trees, and the groups they form.

Two fingerprints that differ in at most three of 64 bits agree on at least one
of any four disjoint parts of them. Every distinct fingerprint therefore goes
to four shards, one for each 16-bit part and its value; a BK-tree per shard
finds the links inside it. A shard that holds too many fingerprints is cut
again, by parts of the bits that its members need not share yet, so that no
shard ever exceeds ``SHARD_LIMIT``: after five cuts fewer than 16 bits are left.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm import near
from gleaner.llm.groups import connected
from gleaner.llm.storage import durable, free_prefix, in_small_batches, lookup
from gleaner.llm.texts import shingle_hashes, slices, texts_of
from gleaner.llm.trees import Forest, merge_labels

SHINGLE_WORDS = 3
RADIUS = 3
# Fingerprints of one shard. Above 2**15, so that the last cut always suffices.
SHARD_LIMIT = 40_000
# Trees are built and searched over so many fingerprints at once, whole shards each.
FOREST_ROWS = 100_000
# Ids of dropped documents that are broadcast; beyond it documents are joined by id.
BROADCAST_IDS = 1_000_000


# -- fingerprints ---------------------------------------------------------------------------------


def fingerprints_of(texts: list[str], size: int = SHINGLE_WORDS) -> np.ndarray:
    """A 64-bit fingerprint per text: a bit is set if it is in over half of the shingle hashes."""
    per_text = [shingle_hashes(t, size) for t in texts]
    counts = np.array([len(h) for h in per_text], np.int64)
    out = np.zeros(len(texts), np.uint64)
    filled = np.flatnonzero(counts)
    if not len(filled):
        return out
    hashes = np.array([h for one in per_text for h in one], np.uint64)
    begins = np.concatenate(([0], np.cumsum(counts[filled])[:-1]))
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = np.add.reduceat(bits, begins, axis=0, dtype=np.int64)
    packed = np.packbits(2 * ones > counts[filled][:, None], axis=1)
    out[filled] = packed.view(">u8").ravel().astype(np.uint64)
    return out


def with_fingerprints(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS, keyed: bool = False
) -> DataFrame:
    """``_id`` and ``_fp`` (the fingerprint as a signed long) of every row; a null text has no words.

    With ``keyed`` there is ``_row`` as well, which tells texts under one id apart.
    """
    beside = ["_id", "_row"] if keyed else ["_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            prints = fingerprints_of(texts_of(batch, "_text"), shingle_words)
            yield pa.RecordBatch.from_arrays([*map(batch.column, beside), pa.array(prints.view(np.int64))], [*beside, "_fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("_id"), near.row_key(text).alias("_row"), F.col(text).alias("_text"))
    return in_small_batches(rows.select(*beside, "_text")).mapInArrow(
        run, f"_id {kind}, {'_row bigint, ' if keyed else ''}_fp bigint"
    )


# -- links in shards -------------------------------------------------------------------------------


def shard_links(prints: np.ndarray, tree: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Per print that reaches an earlier one of its shard, itself and the first it reaches."""
    label = np.arange(len(prints))
    if len(prints) > 1:
        for a, b in Forest(prints, tree).links(radius):
            merge_labels(label, a, b)
    joined = np.flatnonzero(label != np.arange(len(prints)))
    return prints[joined], prints[label[joined]]


def linked_in_shards(shards: DataFrame, radius: int) -> DataFrame:
    """Links (``a``, ``b``) that connect, shard by shard, all fingerprints within ``radius``.

    ``shards`` has one row per shard (``key``) and distinct fingerprint. A task
    sees its rows in order of the key and holds whole shards, some at a time.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held = [], []
        count = 0

        def found(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
            tree = np.cumsum(np.concatenate(([0], keys[1:] != keys[:-1])))
            a, b = shard_links(prints, tree, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held_keys.append(batch.column("key").to_numpy(zero_copy_only=False))
            held.append(batch.column("_fp").to_numpy(zero_copy_only=False).view(np.uint64))
            count += batch.num_rows
            if count < FOREST_ROWS:
                continue
            keys, prints = np.concatenate(held_keys), np.concatenate(held)
            whole = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
            if whole:
                yield found(keys[:whole], prints[:whole])
            held_keys, held, count = [keys[whole:]], [prints[whole:]], len(keys) - whole
        if count:
            yield found(np.concatenate(held_keys), np.concatenate(held))

    rows = shards.select("key", "_fp").repartition("key").sortWithinPartitions("key", "_fp")
    return rows.mapInArrow(run, "a bigint, b bigint")


# -- shards ----------------------------------------------------------------------------------------


def parts(bits: list[int], count: int) -> list[list[int]]:
    """``bits`` cut into ``count`` parts of about equal size."""
    return [list(map(int, p)) for p in np.array_split(np.array(bits, int), count) if len(p)]


def value_of(fingerprint: F.Column, bits: list[int]) -> F.Column:
    """The bits at the given places as one number; places are ascending and mostly adjacent."""
    runs, at = [], 0
    while at < len(bits):
        end = at
        while end + 1 < len(bits) and bits[end + 1] == bits[end] + 1:
            end += 1
        runs.append((bits[at], end - at + 1, at))
        at = end + 1
    pieces = [
        F.shiftleft(F.shiftrightunsigned(fingerprint, low).bitwiseAND(F.lit((1 << width) - 1).cast("bigint")), place)
        for low, width, place in runs
    ]
    total = pieces[0]
    for piece in pieces[1:]:
        total = total.bitwiseOR(piece)
    return total


def links(prints: DataFrame, radius: int = RADIUS, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """Links that connect all distinct fingerprints (``_fp``) with others within ``radius`` bits.

    Only as many links as it takes: every fingerprint is joined to the first one
    it reaches inside a shard, so a shard of near copies gives a star and not all
    its pairs. No star has more ends than a shard has members, which is bounded.
    """
    out = None
    # A cell is a way of cutting: the bits its shards agree on so far. At the start, none.
    cells = {0: list(range(64))}
    rows = prints.select("_fp", F.lit(0).alias("cell"), F.lit(0).cast("bigint").alias("key"))
    while True:
        cut, next_cells, choices = [], {}, []
        for cell, free in cells.items():
            for place, part in enumerate(parts(free, radius + 1)):
                name = cell * (radius + 1) + place + 1
                next_cells[name] = [b for b in free if b not in set(part)]
                choices.append((cell, name, part))
        for cell, name, part in choices:
            cut.append(
                F.when(
                    F.col("cell") == cell,
                    F.struct(
                        F.lit(name).alias("cell"),
                        F.xxhash64(F.col("key"), F.lit(name), value_of(F.col("_fp"), part)).alias("key"),
                    ),
                )
            )
        pieces = rows.select("_fp", F.explode(F.filter(F.array(*cut), lambda c: c.isNotNull())).alias("at")).select(
            "_fp", "at.cell", "at.key"
        )
        crowded = pieces.groupBy("cell", "key").count().where(F.col("count") > shard_limit).select("cell", "key")
        last = all(len(free) < 16 for free in next_cells.values())
        crowded = durable(crowded) if not last else None
        # Ways of cutting that left a shard crowded; there are few ways, whatever the data.
        open_cells = [] if crowded is None else [r["cell"] for r in crowded.select("cell").distinct().collect()]
        here = pieces.join(crowded, ["cell", "key"], "left_anti") if open_cells else pieces
        found = linked_in_shards(here, radius)
        out = found if out is None else out.unionByName(found)
        if not open_cells:
            return out
        rows = pieces.join(crowded, ["cell", "key"], "left_semi")
        cells = {cell: next_cells[cell] for cell in open_cells}


# -- groups ----------------------------------------------------------------------------------------


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    radius: int = RADIUS,
    shard_limit: int = SHARD_LIMIT,
) -> DataFrame:
    """One row per row of ``docs``: its id, fingerprint (hex) and the smallest id of its group.

    A group is what links of at most ``radius`` differing bits reach. Texts
    without words, null among them, have the fingerprint zero and are linked like
    any other. Repeated ids are rows of their own; a null id is never the smallest
    while its group has another. Extra columns of ``docs`` are not read. An empty
    table gives an empty result.
    """
    rows = durable(with_fingerprints(docs, doc_id, text, shingle_words))
    prints = durable(rows.groupBy("_fp").agg(F.min("_id").alias("_least")))
    roots = connected(links(prints.select("_fp"), radius, shard_limit))
    grouped = prints.join(roots.select(F.col("node").alias("_fp"), "root"), "_fp", "left").select(
        "_fp", "_least", F.coalesce("root", "_fp").alias("_root")
    )
    least = grouped.groupBy("_root").agg(F.min("_least").alias("component_id"))
    classes = durable(grouped.join(least, "_root").select("_fp", "component_id"))
    return rows.join(classes, "_fp").select(
        F.col("_id").alias(doc_id),
        F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def keep_one(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    similarity: float | None = None,
    shingle_words: int | None = None,
    radius: int = RADIUS,
    shard_limit: int = SHARD_LIMIT,
) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest id.

    Groups are those of ``near_duplicates``; with ``similarity`` they are what
    links of at least that Jaccard similarity of shingles reach
    (``near.similar_texts``), and texts without words are one group.

    Rows are told apart by id and text, so texts under one id that are not linked
    all stay. Of several texts under a group's smallest id one stays, and one row
    of those that repeat it. A row without an id stays if no other of its group
    has one. Other columns may have any names.
    """
    mark = free_prefix(docs.columns)
    if similarity is None:
        rows = durable(with_fingerprints(docs, doc_id, text, shingle_words or SHINGLE_WORDS, keyed=True)).withColumnRenamed("_fp", "_key")
        roots = connected(links(rows.select(F.col("_key").alias("_fp")).distinct(), radius, shard_limit))
    else:
        rows, roots = near.similar_texts(docs, doc_id, text, shingle_words or near.SHINGLE_WORDS, similarity)
    marks = durable(
        rows.join(roots.withColumnRenamed("node", "_key"), "_key", "left")
        .groupBy("_id", "_row").agg(F.first(F.coalesce("root", "_key")).alias("_root"), F.count("*").alias("rows"))
    )
    first = F.min(F.struct(F.col("_id").isNull().alias("_none"), "_id", "_row")).alias("_first")
    kept = durable(marks.groupBy("_root").agg(first).select("_first._id", "_first._row"))

    def matches(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        """Rows of ``left``, which may be ``docs``, that are or are not among ``right``."""
        own, key = (F.col(doc_id), near.row_key(text)) if left is docs else (left["_id"], left["_row"])
        right = right.select(F.col("_id").alias(f"{mark}id"), F.col("_row").alias(f"{mark}row"))
        return left.join(right, own.eqNullSafe(F.col(f"{mark}id")) & (key == F.col(f"{mark}row")), how)

    lost = matches(marks, kept, "left_anti").select("_id", "_row")
    repeats = durable(matches(marks.where("rows > 1"), kept, "left_semi").select("_id", "_row"))
    gone = lookup(lost.unionByName(repeats), "1", BROADCAST_IDS)
    plain = matches(docs, gone, "left_anti")
    if repeats.isEmpty():
        return plain
    repeated = matches(docs, repeats, "left_semi")
    first = Window.partitionBy(doc_id, near.row_key(text)).orderBy(*[c for c in docs.columns if c not in (doc_id, text)], text)
    place = f"{mark}place"
    once = repeated.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).drop(place)
    return plain.unionByName(once)
