"""Near copies by the similarity of their shingles: BK-trees propose, exact similarity decides.

At a similarity of 0.8 two 64-bit SimHash fingerprints differ in ten bits or so.
One tree over all of them would not prune at that distance, so texts are first
dealt to shards, 20 each: those that agree on all minima of a band of MinHash
values. Two texts of similarity s share one of ``BANDS`` bands of ``ROWS`` minima
with probability 1 - (1 - s ** ROWS) ** BANDS, which is 0.9997 at 0.8. A BK-tree
per shard gives the pairs whose fingerprints differ in up to ``RADIUS`` bits (five
deviations above the mean at 0.8), and a link is taken only if the exact Jaccard
similarity of the two sets of shingles reaches the bar.

Texts with the same words are one text from the start; 64 bits stand for them. In
a crowded shard, of more than ``SMALL`` texts, every text is compared with the
shard's first, and the shard is settled if that joins all. Crowded shards that are
not settled by then, and share texts, are one crowd. It is compared in blocks: the
texts outside of its largest joined group with all others, a tree and exact
similarities per pair of blocks. No comparison is left out for the size of a shard.
A crowd of m texts, r of them outside of its largest group, costs r times m.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.groups import connected
from gleaner.llm.storage import durable, in_small_batches, lookup
from gleaner.llm.texts import SHINGLE_SEED, mixed, ragged, shingle_hashes, slices, texts_of
from gleaner.llm.trees import Forest

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS = 20
ROWS = 5
# Bits in which the fingerprints of near copies may differ.
RADIUS = 24
# Texts of a shard whose pairs are written out; of a larger one, pairs are compared where they lie.
SMALL = 32
# Texts of a block of a crowd.
BLOCK = 1024
# Fingerprints whose trees are searched at once, whole shards each.
FOREST_ROWS = 50_000
# Rows of lookups that are broadcast.
BROADCAST_ROWS = 500_000
# Odd factors, one for every minimum.
FACTORS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def shingles_of(text: str, size: int) -> np.ndarray:
    """The distinct hashes of all runs of ``size`` words, ascending; of all words when there are fewer."""
    return np.unique(np.array(shingle_hashes(text, size), np.uint64))


def bands_of(sets: list[np.ndarray]) -> np.ndarray:
    """A row per set, which must not be empty, and a column per band: the hash of the band's minima."""
    begins = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1])).astype(np.int64)
    hashes = np.concatenate(sets)
    out = np.empty((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        code = np.full(len(sets), band + 1, np.uint64)
        for factor in FACTORS[band * ROWS : (band + 1) * ROWS]:
            least = np.minimum.reduceat((hashes ^ (hashes >> np.uint64(32))) * factor, begins)
            code = mixed(code * np.uint64(0x9E3779B97F4A7C15) + least)
        out[:, band] = code
    return out


def fingerprint(hashes: list[int]) -> int:
    """A bit is set if it is in over half of the hashes, repeats included."""
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)).tobytes(), "big", signed=True)


def _sketches(size: int):
    """Per row its text's key (the hash of its words), bands and fingerprint; a text without words has no bands."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            texts = texts_of(batch, "_text")
            keys = [xxhash.xxh64_intdigest(b" ".join(t.encode().lower().split()), SHINGLE_SEED) for t in texts]
            hashes = [shingle_hashes(t, size) for t in texts]
            prints = [fingerprint(h) if h else 0 for h in hashes]
            filled = [np.unique(np.array(h, np.uint64)) for h in hashes if h]
            rows = iter(bands_of(filled).view(np.int64)) if filled else iter(())
            bands = pa.array([next(rows) if h else [] for h in hashes], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"), batch.column("_row"), pa.array(np.array(keys, np.uint64).view(np.int64)), bands,
                    pa.array(prints, pa.int64()),
                ],
                ["_id", "_row", "_key", "_bands", "_fp"],
            )

    return run


def _sets(size: int):
    """Per row the shingles of its text, 8 bytes each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            sets = [shingles_of(t, size).tobytes() for t in texts_of(batch, "_text")]
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(sets, pa.binary())], ["_key", "_set"])

    return run


def _confirm(bar: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.zeros(batch.num_rows, bool)
            for place, (a, b) in enumerate(zip(batch.column("_set"), batch.column("_other"))):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                low, high = sorted((len(a), len(b)))
                if low < bar * high:
                    continue
                both = len(np.intersect1d(a, b, assume_unique=True))
                near[place] = both >= bar * (low + high - both)
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return run


def row_key(text: str):
    """Tells rows of one id apart: a hash of the text as it is; a null text is the empty one."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def confirmed(edges: DataFrame, sets: DataFrame, bar: float) -> DataFrame:
    """The edges (``a``, ``b``) whose texts are that similar; the adaptive join splits a crowded end."""
    paired = edges.join(sets.select(F.col("_key").alias("b"), F.col("_set").alias("_other")), "b").join(
        sets.withColumnRenamed("_key", "a"), "a"
    )
    return in_small_batches(paired.select("a", "b", "_set", "_other")).mapInArrow(_confirm(bar), "a bigint, b bigint")


# -- shards ----------------------------------------------------------------------------------------


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[dict[str, np.ndarray]]:
    """Rows that come in order of the keys, some whole groups at a time; column ``group`` numbers them."""
    held: list[pa.RecordBatch] = []
    count = 0

    def columns(table: pa.Table) -> dict[str, np.ndarray]:
        out = {name: table[name].to_numpy() for name in table.column_names}
        fresh = np.zeros(table.num_rows, bool)
        for key in keys:
            fresh[1:] |= out[key][1:] != out[key][:-1]
        return out | {"group": np.cumsum(fresh)}

    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held)
        found = columns(table)
        whole = int(np.searchsorted(found["group"], found["group"][-1]))
        if whole:
            yield {name: values[:whole] for name, values in found.items()}
        held, count = table.slice(whole).to_batches(), count - whole
    if count:
        yield columns(pa.Table.from_batches(held))


def _in_trees(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of texts of one shard, not yet joined, whose fingerprints are within ``RADIUS``, by a BK-tree per shard."""
    for rows in whole_groups(batches, ["bucket"], FOREST_ROWS):
        # Texts of one fingerprint are a node of the tree; all of them are near each other.
        order = np.lexsort((rows["_fp"], rows["group"]))
        keys, prints, roots, group = (rows[name][order] for name in ("_key", "_fp", "root", "group"))
        fresh = np.concatenate(([True], (group[1:] != group[:-1]) | (prints[1:] != prints[:-1])))
        first = np.flatnonzero(fresh)
        size = np.diff(np.append(first, len(keys)))
        found = [(np.arange(len(first)), np.arange(len(first)))]
        if len(first) > 1:
            found += list(Forest(prints[first].view(np.uint64), group[first]).links(RADIUS))
        for x, y in found:
            # All texts of node x with all of node y; of one node every pair once.
            left = ragged(first[x], size[x])
            many = np.repeat(size[y], size[x])
            right = ragged(np.repeat(first[y], size[x]), many)
            left = np.repeat(left, many)
            apart = left < right if (x is y or (x == y).all()) else np.ones(len(left), bool)
            apart &= roots[left] != roots[right]
            a, b = keys[left[apart]], keys[right[apart]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def near_pairs(shards: DataFrame) -> DataFrame:
    """Edges (``a``, ``b``) to compare among shards (``bucket``, ``_key``, ``_fp``, ``root``) of a few texts each."""
    rows = shards.select("bucket", "_key", "_fp", "root").repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(_in_trees, "a bigint, b bigint").distinct()


def shared(sets: list[np.ndarray], asked: int, codes: np.ndarray, owners: np.ndarray, of: list[np.ndarray]) -> np.ndarray:
    """How many shingles the text ``asked`` has in common with every text; ``codes`` are ascending."""
    low, high = np.searchsorted(codes, of[asked]), np.searchsorted(codes, of[asked], "right")
    return np.bincount(owners[ragged(low, high - low)], minlength=len(sets))


def _in_blocks(bar: float):
    """Links between the texts of two blocks: a tree proposes, exact similarity decides, joined texts are not compared."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["bucket", "left", "right"], BLOCK):
            bounds = np.searchsorted(rows["group"], np.arange(rows["group"][-1] + 2))
            for low, high in zip(bounds, bounds[1:]):
                # A text of both blocks counts as one of the left block.
                order = np.lexsort((rows["side"][low:high], rows["_key"][low:high]))
                keys, first = np.unique(rows["_key"][low:high][order], return_index=True)
                at = low + order[first]
                sets = [np.frombuffer(s, np.uint64) for s in rows["_set"][at]]
                size = np.array([len(s) for s in sets], np.int64)
                label = np.unique(rows["root"][at], return_inverse=True)[1]
                prints, node = np.unique(rows["_fp"][at], return_inverse=True)
                if len(prints) > 1:
                    found = list(Forest(prints.view(np.uint64), np.zeros(len(prints), np.int64)).links(RADIUS))
                else:
                    found = []
                near = np.eye(len(prints), dtype=bool)
                for x, y in found:
                    near[x, y] = near[y, x] = True
                kinds, codes = np.unique(np.concatenate(sets), return_inverse=True)
                of = np.split(codes, np.cumsum(size)[:-1])
                owners = np.repeat(np.arange(len(sets)), size)
                order = np.argsort(codes, kind="stable")
                codes, owners = codes[order], owners[order]
                links = []
                for text in np.flatnonzero(rows["side"][at] == 0):
                    open_ = near[node[text]][node] & (label != label[text])
                    if not open_.any():
                        continue
                    both = shared(sets, text, codes, owners, of)
                    linked = np.flatnonzero(open_ & (both >= bar * (size + size[text] - both)))
                    if len(linked):
                        links.append((np.full(len(linked), text), linked))
                        for other in np.unique(label[linked]):
                            label[label == other] = label[text]
                if links:
                    a, b = (keys[np.concatenate(side)] for side in zip(*links))
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def crowd_links(crowd: DataFrame, sets: DataFrame, bar: float) -> DataFrame:
    """Links between texts of different roots in crowds (``bucket``, ``_key``, ``_fp``, ``root``).

    A crowd's largest group of joined texts is not compared with itself: the texts
    outside of it are dealt to blocks, and every block of these meets every block
    of the crowd on its own.
    """
    roots = crowd.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    totals = roots.groupBy("bucket").agg(F.sum("n").alias("_all"), F.max(F.struct("n", "root")).alias("_main"))
    blocks = F.ceil(F.col("_all") / BLOCK).cast("int")
    outside = F.greatest(F.lit(1), F.ceil((F.col("_all") - F.col("_main.n")) / BLOCK)).cast("int")
    sized = crowd.join(
        totals.select("bucket", F.col("_main.root").alias("_main"), blocks.alias("_blocks"), outside.alias("_outside")), "bucket"
    )
    own = F.xxhash64("_key", F.lit(7))
    lefts = F.sequence(F.lit(0), F.col("_outside") - 1)
    rights = F.sequence(F.lit(0), F.col("_blocks") - 1)
    kept = ["bucket", "_key", "_fp", "root"]
    as_right = sized.select(*kept, F.lit(1).alias("side"), F.explode(lefts).alias("left"), F.pmod(own, F.col("_blocks")).cast("int").alias("right"))
    as_left = sized.where(F.col("root") != F.col("_main")).select(
        *kept, F.lit(0).alias("side"), F.pmod(own, F.col("_outside")).cast("int").alias("left"), F.explode(rights).alias("right")
    )
    rows = as_right.unionByName(as_left).join(sets, "_key").repartition("bucket", "left", "right")
    rows = rows.sortWithinPartitions("bucket", "left", "right").select("bucket", "left", "right", "side", "_key", "_fp", "root", "_set")
    return in_small_batches(rows).mapInArrow(_in_blocks(bar), "a bigint, b bigint").distinct()


def similar_texts(
    docs: DataFrame, doc_id: str, text: str, shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY
) -> tuple[DataFrame, DataFrame]:
    """``_id``, ``_row`` and ``_key`` of every row of ``docs``, and ``node`` and ``root`` of every key that is linked.

    Rows with the same ``_key`` have the same words; keys with the same root are
    joined by links of at least that similarity. A null text has no words, and
    texts without words share a key and are linked to none. Repeated rows have
    the same key and row; other columns are not read.
    """
    source = docs.select(F.col(doc_id).alias("_id"), row_key(text).alias("_row"), F.col(text).alias("_text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = durable(in_small_batches(source).mapInArrow(
        _sketches(shingle_words), f"_id {kind}, _row bigint, _key bigint, _bands array<bigint>, _fp bigint"
    ))
    texts = durable(
        rows.groupBy("_key").agg(F.first("_bands").alias("_bands"), F.first("_fp").alias("_fp"), F.min("_row").alias("_row"))
    )

    pieces = texts.select("_key", "_fp", F.col("_key").alias("root"), F.posexplode("_bands").alias("place", "bucket"))
    sizes = durable(
        pieces.groupBy("bucket").agg(F.count("*").alias("_size"), F.min("_key").alias("_leader")).where(F.col("_size") > 1)
    )
    large = lookup(sizes.where(F.col("_size") > SMALL).select("bucket", "_leader"), "1", BROADCAST_ROWS)
    crowd = durable(pieces.join(large, "bucket"))
    few = pieces.join(sizes.where(F.col("_size") <= SMALL).select("bucket"), "bucket", "left_semi")
    stars = crowd.where("_leader <> _key").select(F.least("_leader", "_key").alias("a"), F.greatest("_leader", "_key").alias("b"))
    edges = durable(near_pairs(few).unionByName(stars).distinct())
    # All texts of crowded shards are ends of these edges.
    ends = edges.select(F.explode(F.array("a", "b")).alias("_key")).distinct()
    wanted = lookup(texts.join(ends, "_key", "left_semi").select("_key", "_row"), "1", BROADCAST_ROWS)
    some = in_small_batches(source.join(wanted, "_row").select("_key", "_text"))
    sets = durable(some.mapInArrow(_sets(shingle_words), "_key bigint, _set binary").dropDuplicates(["_key"]))
    links = durable(confirmed(edges, sets, similarity))
    roots = connected(links)
    if not crowd.isEmpty():
        joined = durable(
            crowd.drop("root").join(roots.withColumnRenamed("node", "_key"), "_key", "left").withColumn("root", F.coalesce("root", "_key"))
        )
        unsettled = lookup(
            joined.groupBy("bucket").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low <> _high").select("bucket"),
            "1", BROADCAST_ROWS,
        )
        open_ = durable(joined.join(unsettled, "bucket", "left_semi"))
        # Shards of one crowd hold the same texts over and over; the crowd is compared once.
        of = connected(open_.select(F.col("_leader").alias("a"), F.col("_key").alias("b")))
        members = open_.select("_key", "_fp", "root").distinct().join(of.select(F.col("node").alias("_key"), F.col("root").alias("bucket")), "_key")
        last = durable(crowd_links(durable(members), sets, similarity))
        if not last.isEmpty():
            roots = connected(links.unionByName(last))
    return rows.select("_id", "_row", "_key"), roots
