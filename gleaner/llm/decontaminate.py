"""Benchmark decontamination: find test passages in training texts and take them out.

The benchmark's windows of ten words are hashed; the set of hashes is broadcast,
every window of every training text is looked up in it, and a hit counts only if
the words themselves agree. The benchmark has no proven size, so its windows go
out in blocks of at most ``BLOCK_WINDOWS``; each block is one narrow pass over
the rows, and a row carries what the passes before found.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.storage import durable, in_small_batches
from gleaner.llm.texts import SIGN_LOWER, Words, slices, split_words, window_hashes

WINDOW_WORDS = 10
BLOCK_WINDOWS = 200_000
FOUND = "struct<n_words:bigint,spans:array<struct<first:bigint,last:bigint>>,items:array<string>>"


def window_starts(words: Words, size: int) -> np.ndarray:
    """Positions of the words that begin a run of ``size`` words within one text."""
    last = np.repeat(words.first[1:], words.per_text)
    return np.flatnonzero(np.arange(len(words.start)) + size <= last)


def spelled(words: Words, at: int, size: int) -> bytes:
    """A window's words, joined by spaces."""
    return b" ".join(words.data[words.start[i] : words.end[i]].tobytes() for i in range(at, at + size))


def benchmark_windows(benchmark: DataFrame, item_id: str, text: str, size: int) -> DataFrame:
    """``item`` (as text), ``size``, ``hash`` and ``words`` of every window of every item.

    An item of fewer words than a window is one window of all its words; an item
    without words, null among them, has none.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            words = split_words(batch.column("_text"), SIGN_LOWER)
            hashes = words.hashes()
            ids = batch.column("item").to_pylist()
            rows = []
            for text_at, count in enumerate(words.per_text):
                width = min(size, int(count))
                begin = int(words.first[text_at])
                own = window_hashes(hashes[begin : begin + count], width) if width else []
                rows += [(ids[text_at], width, int(h.view(np.int64)), spelled(words, begin + i, width)) for i, h in enumerate(own)]
            columns = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.binary()))],
                ["item", "size", "hash", "words"],
            )

    rows = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("_text"))
    return in_small_batches(rows).mapInArrow(run, "item string, size int, hash bigint, words binary").distinct()


class WindowSet:
    """A block of benchmark windows, to be broadcast: hashes by window size, and the words to verify."""

    def __init__(self, rows):
        self.items: dict[bytes, list[str]] = defaultdict(list)
        by_size: dict[int, list[int]] = defaultdict(list)
        for item, size, value, words in rows:
            known = self.items[bytes(words)]
            if item is not None:
                known.append(item)
            by_size[size].append(value)
        self.items = dict(self.items)
        self.hashes = {k: np.unique(np.array(v, np.int64).view(np.uint64)) for k, v in sorted(by_size.items())}

    def hits(self, words: Words) -> Iterator[tuple[int, int, list[str]]]:
        """Position, size and items of every verified window."""
        hashes = words.hashes()
        for size, wanted in self.hashes.items():
            starts = window_starts(words, size)
            if not len(starts):
                continue
            asked = window_hashes(hashes, size)[starts]
            at = np.minimum(np.searchsorted(wanted, asked), len(wanted) - 1)
            for place in starts[wanted[at] == asked]:
                items = self.items.get(spelled(words, int(place), size))
                if items is not None:
                    yield int(place), size, items


def joined_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans (first word, one past the last) in order, those that overlap or touch made one."""
    out: list[list[int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


def without(text: str | None, words: Words, at: int, spans: list[tuple[int, int]]) -> str | None:
    """``text`` without the characters from the first to the last word of each span."""
    if not spans or text is None:
        return text
    raw = text.encode()
    begin = words.first[at]
    # Positions in the slice's bytes; the text's own bytes end with its last word at most.
    kept, done, offset = [], 0, words.offsets[at]
    for first, last in spans:
        kept.append(raw[done : words.start[begin + first] - offset])
        done = words.end[begin + last - 1] - offset
    kept.append(raw[done:])
    return b"".join(kept).decode()


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window_words: int = WINDOW_WORDS,
    output: str = "contamination",
    cut: bool = False,
    drop_text: bool = False,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """``docs`` with a column ``output`` that says what of the benchmark each text holds.

    ``n_words`` counts the text's words; ``spans`` are the runs of words inside
    any occurrence of a window, from ``first`` up to but not including ``last``;
    ``items`` are the ids, as text, of items with an occurring window, sorted. A
    null or empty text has no words. An item without id marks words and is not
    listed. With ``cut`` the spans are taken out of the text, with ``drop_text``
    the text is left out of the result. All other columns stay; one named like
    ``output`` is replaced. An empty benchmark marks nothing.
    """
    windows = durable(
        benchmark_windows(benchmark, item_id, item_text, window_words)
        .withColumn("_order", F.xxhash64("words"))
    )
    blocks = max(1, -(-windows.count() // block_windows))
    kept = [c for c in docs.columns if c != output]
    schema = T.StructType([f for f in docs.schema.fields if f.name != output]).add(output, T._parse_datatype_string(FOUND))
    rows = docs.select(*kept, F.lit(None).cast(FOUND).alias(output))
    for block in range(blocks):
        mine = windows.where(F.pmod(F.col("_order"), F.lit(blocks)) == block) if blocks > 1 else windows
        held = docs.sparkSession.sparkContext.broadcast(
            WindowSet(mine.select("item", "size", "hash", "words").collect())
        )
        last = block == blocks - 1
        rows = in_small_batches(rows).mapInArrow(_pass(held, text, output, cut and last), schema)
    return rows.drop(text) if drop_text else rows


def _pass(held, text: str, output: str, cut: bool):
    kind = pa.struct([
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
        ("items", pa.list_(pa.string())),
    ])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = held.value
        for batch in slices(batches, text):
            words = split_words(batch.column(text), SIGN_LOWER)
            counts = words.per_text.tolist()
            spans: dict[int, list] = defaultdict(list)
            items: dict[int, set] = defaultdict(set)
            for at, before in enumerate(batch.column(output).to_pylist()):
                if before and before["spans"]:
                    spans[at] += [(s["first"], s["last"]) for s in before["spans"]]
                    items[at].update(before["items"])
            for place, size, found in wanted.hits(words):
                at = int(np.searchsorted(words.first, place, "right")) - 1
                first = place - int(words.first[at])
                spans[at].append((first, first + size))
                items[at].update(found)
            joined = {at: joined_spans(s) for at, s in spans.items()}
            result = [
                {
                    "n_words": count,
                    "spans": [{"first": a, "last": b} for a, b in joined.get(at, ())],
                    "items": sorted(items.get(at, ())),
                }
                for at, count in enumerate(counts)
            ]
            columns = list(batch.columns)
            names = batch.schema.names
            columns[names.index(output)] = pa.array(result, kind)
            if cut and joined:
                place = names.index(text)
                texts = batch.column(text).to_pylist()
                for at, own in joined.items():
                    texts[at] = without(texts[at], words, at, own)
                columns[place] = pa.array(texts, batch.schema.types[place])
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def n_hit(contamination: str = "contamination"):
    """How many words of the text lie in a span."""
    return F.aggregate(
        F.col(contamination)["spans"], F.lit(0).cast("bigint"), lambda total, s: total + s["last"] - s["first"]
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, remove: str = "documents", output: str = "contamination", **options
) -> DataFrame:
    """``docs`` in their own columns, without what the benchmark holds.

    ``remove="documents"`` drops every text with a hit, ``remove="spans"`` keeps
    all rows and takes the hit passages out of their texts.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove documents or spans: {remove}")
    name = output
    while name in docs.columns:
        name += "_"
    found = scan(docs, benchmark, output=name, cut=remove == "spans", **options)
    if remove == "documents":
        found = found.where(F.size(F.col(name)["spans"]) == 0)
    return found.select(*docs.columns)
