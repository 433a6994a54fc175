"""Reading texts batch by batch inside a task.

Arrow hands a task thousands of rows at once and a text may have megabytes, so
every function here works on slices of about ``CHUNK_BYTES`` of text; a single
longer text is a slice of its own. Texts are never cut.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK_BYTES = 1 << 19
SHINGLE_SEED = 42

# Odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, about ``limit`` bytes of text at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        filled = np.cumsum(sizes.astype(np.int64))
        at = 0
        while at < len(filled):
            before = filled[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(filled, before + limit, "right")))
            yield batch.slice(at, end - at)
            at = end


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    """The texts of a batch; null is the empty text."""
    return [t or "" for t in batch.column(text).to_pylist()]


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts back to back, and where each text begins (one more than texts)."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_table(separators: Iterable[int], lower: bool) -> np.ndarray:
    """Maps each byte to itself, or A-Z to a-z if ``lower``; separators become 0x20."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[0x41:0x5B] += 0x20
    for byte in separators:
        table[byte] = 0x20
    return table


# The bytes that part words: space and the controls from tab to carriage return.
BLANKS = (0x20, *range(0x09, 0x0E))
BLANK_LOWER = byte_table(BLANKS, lower=True)
BLANK_PLAIN = byte_table(BLANKS, lower=False)
# Everything in ASCII but digits and letters.
SIGNS = (*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80))
SIGN_LOWER = byte_table(SIGNS, lower=True)


@dataclass
class Words:
    """The words of several texts: ``first[d]:first[d + 1]`` are those of text ``d``,
    whose bytes begin at ``offsets[d]`` of ``data``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    offsets: np.ndarray

    @property
    def per_text(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.per_text)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)


def split_words(column: pa.Array, table: np.ndarray) -> Words:
    """Words of the texts, with bytes mapped by ``table`` and 0x20 between words."""
    data, offsets = buffer_of(column)
    data = table[data]
    inside = data != 0x20
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    previous = np.concatenate(([False], inside[:-1])) if len(inside) else inside
    following = np.concatenate((inside[1:], [False])) if len(inside) else inside
    start = np.flatnonzero(inside & (~previous | begins[:-1]))
    end = np.flatnonzero(inside & (~following | begins[1:])) + 1
    return Words(data, start, end, np.searchsorted(start, offsets), offsets)


def ragged(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions ``begins[i] .. begins[i] + sizes[i]`` of all ``i``, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - begins, sizes)


def powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    if count:
        out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread every bit of ``values`` over all 64 bits."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ``data[start:end]`` for every span, the same wherever the span lies.

    A polynomial in ``BASE`` modulo 2**64, taken from prefix sums and moved back
    to position zero, then mixed with the length.
    """
    if not len(start):
        return np.empty(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=sums[1:])
    back = powers(INVERSE, len(data))[start]
    return mixed((sums[end] - sums[start]) * back + (end - start).astype(np.uint64) * np.uint64(BASE))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` word hashes; the caller leaves out runs across texts."""
    count = len(words) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for place, power in enumerate(powers(BASE, size)):
        total += words[place : place + count] * power
    return mixed(total)


def shingle_hashes(text: str, size: int) -> list[int]:
    """XXH64 of every run of ``size`` words, repeats included; of all words when there are fewer."""
    words = text.encode().lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(joined, SHINGLE_SEED)]
    at, starts = 0, []
    for word in words:
        starts.append(at)
        at += len(word) + 1
    starts.append(at)
    return [digest(joined[a : b - 1], SHINGLE_SEED) for a, b in zip(starts, starts[size:])]
