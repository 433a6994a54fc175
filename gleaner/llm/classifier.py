"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL-proximal.

A text becomes a sparse vector of ``DIMENSIONS`` hashed features: its words and
pairs of words, the shapes of one to three adjacent words (script, capitals,
digits, the signs they carry), and the word runs it repeats. Training goes
through a bounded sample of the labelled rows in a fixed number of shards, each
by its own pass of follow-the-regularised-leader updates; the shards' weights
are averaged. The model is one vector of fixed size, broadcast for scoring,
where a score is the sparse dot product with it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.storage import in_small_batches
from gleaner.llm.texts import BASE, BLANK_LOWER, BLANK_PLAIN, mixed, slices, span_hashes, split_words, window_hashes

DIMENSIONS = 1 << 18
# About so many labelled rows train the model, chosen by a hash of their ids; all of them when there are fewer.
SAMPLE_ROWS = 20_000
SHARDS = 8
EPOCHS = 3
REPEATED_RUN = 4


@dataclass(frozen=True)
class Ftrl:
    """Step size, its smoothing, and the two penalties of the updates."""

    alpha: float = 0.6
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.5


# -- features --------------------------------------------------------------------------------------

# What a byte says about a word's shape; signs keep their own value.
_SHAPE = np.zeros(256, np.uint64)
_SHAPE[0x80:] = 1
_SHAPE[0x61:0x7B] = 1
_SHAPE[0x41:0x5B] = 2
_SHAPE[0x30:0x3A] = 3
for _byte in (*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)):
    _SHAPE[_byte] = _byte


def shape_hashes(words) -> np.ndarray:
    """A hash of each word's shape: its runs of like characters, whatever their length."""
    shape = _SHAPE[words.data]
    first = np.ones(len(shape), bool)
    first[1:] = shape[1:] != shape[:-1]
    first[words.start] = True
    inside = np.zeros(len(shape) + 1, np.int64)
    np.add.at(inside, words.start, 1)
    np.add.at(inside, words.end, -1)
    kept = np.flatnonzero(first & (np.cumsum(inside[:-1]) > 0))
    squeezed = shape[kept].astype(np.uint8)
    begin = np.searchsorted(kept, words.start)
    return span_hashes(squeezed, begin, np.searchsorted(kept, words.end))


def features(column: pa.Array, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse unit vectors of the texts: where each begins, the features and their values."""
    plain = split_words(column, BLANK_PLAIN)
    lowered = split_words(column, BLANK_LOWER)
    word, shape = lowered.hashes(), shape_hashes(plain)
    owner = plain.text
    texts = len(plain.first) - 1
    parts = []

    def runs(hashes: np.ndarray, size: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
        own = window_hashes(hashes, size)
        if not len(own):
            return np.empty(0, np.int64), own
        whole = owner[: len(own)] == owner[size - 1 :]
        return owner[: len(own)][whole], mixed(own[whole] + np.uint64(kind * BASE % (1 << 64)))

    # Every group of features has length one on its own, so that many words don't drown few shapes.
    words_at = [runs(word, 1, 1), runs(word, 2, 2)]
    shapes_at = [runs(shape, 1, 3), runs(shape, 2, 4), runs(shape, 3, 5)]
    for group in (words_at, shapes_at):
        who = np.concatenate([p[0] for p in group])
        cell = who * dimensions + (np.concatenate([p[1] for p in group]) % np.uint64(dimensions)).astype(np.int64)
        cells, counts = np.unique(cell, return_counts=True)
        norms = np.sqrt(np.bincount(cells // dimensions, counts, minlength=texts))
        parts.append((cells, np.sqrt(counts) / np.maximum(norms, 1e-12)[cells // dimensions]))
    # How much of a text are runs of words it has had before, in eighths, every eighth reached being a feature.
    at, own = runs(word, REPEATED_RUN, 6)
    if len(own):
        order = np.lexsort((own, at))
        again = np.concatenate(([False], (own[order][1:] == own[order][:-1]) & (at[order][1:] == at[order][:-1])))
        share = np.bincount(at[order][again], minlength=texts) / np.maximum(np.bincount(at, minlength=texts), 1)
        for eighth in range(1, 8):
            marked = np.flatnonzero(share * 8 >= eighth)
            feature = int(mixed(np.array([eighth], np.uint64))[0] % np.uint64(dimensions))
            parts.append((marked * dimensions + feature, np.ones(len(marked))))
    cells, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    values = np.bincount(which, np.concatenate([p[1] for p in parts]), minlength=len(cells))
    begins = np.searchsorted(cells, np.arange(texts + 1) * dimensions)
    return begins, cells % dimensions, values


# -- training --------------------------------------------------------------------------------------


def train(vectors: list[tuple[np.ndarray, np.ndarray, int]], dimensions: int, epochs: int, ftrl: Ftrl) -> np.ndarray:
    """Weights (the last one is the bias) after ``epochs`` passes over the rows in their order."""
    z, n = np.zeros(dimensions + 1), np.zeros(dimensions + 1)

    def weights(at):
        own = z[at]
        return np.where(
            np.abs(own) <= ftrl.l1, 0.0,
            -(own - np.sign(own) * ftrl.l1) / ((ftrl.beta + np.sqrt(n[at])) / ftrl.alpha + ftrl.l2),
        )

    for _ in range(epochs):
        for cells, values, label in vectors:
            at, x = np.append(cells, dimensions), np.append(values, 1.0)
            w = weights(at)
            gradient = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            sigma = (np.sqrt(n[at] + gradient**2) - np.sqrt(n[at])) / ftrl.alpha
            z[at] += gradient - sigma * w
            n[at] += gradient**2
    return weights(np.arange(dimensions + 1))


def fit(
    labelled: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "label",
    dimensions: int = DIMENSIONS,
    shards: int = SHARDS,
    epochs: int = EPOCHS,
    ftrl: Ftrl = Ftrl(),
) -> np.ndarray:
    """The averaged weights of models trained on ``shards`` parts of ``labelled``.

    ``labelled`` must be bounded, see ``training_rows``. Rows without a label are
    left out; a null text is empty. No row at all gives weights of zero, which
    score everything 0.5.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = []
        for batch in slices(batches, "_text"):
            begins, cells, values = features(batch.column("_text"), dimensions)
            for at, own in enumerate(batch.column("_label").to_pylist()):
                vectors.append((cells[begins[at] : begins[at + 1]], values[begins[at] : begins[at + 1]], own))
        if vectors:
            model = train(vectors, dimensions, epochs, ftrl).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([model.tobytes()]), pa.array([len(vectors)])], ["model", "rows"])

    rows = (
        labelled.where(F.col(label).isNotNull())
        .select(F.xxhash64(F.col(doc_id)).alias("_order"), F.col(text).alias("_text"), F.col(label).cast("int").alias("_label"))
        .repartition(shards, F.pmod("_order", F.lit(shards)))
        .sortWithinPartitions("_order", "_label", "_text")
    )
    # One vector of fixed size per shard.
    found = in_small_batches(rows).mapInArrow(run, "model binary, rows bigint").collect()
    total = np.zeros(dimensions + 1)
    for row in sorted(found, key=lambda r: (r["rows"], bytes(r["model"]))):
        total += np.frombuffer(row["model"], np.float32).astype(float) * row["rows"]
    return total / max(1, sum(r["rows"] for r in found))


def training_rows(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    usable: Column | None = None,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """``doc_id``, ``text`` and ``label`` of about ``sample_rows`` labelled documents.

    Labels count once per id and value. Ids are taken by their hash, so a rerun
    takes the same. The chosen ids are few by that bound and are broadcast: no
    text is shuffled to find them.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    if usable is not None:
        known = known.where(usable)
    known = known.select(F.col(doc_id).alias("_known"), F.col(label).cast("int").alias("label")).distinct()
    share = min(1.0, sample_rows / max(1, known.count()))
    place = F.shiftrightunsigned(F.xxhash64("_known", F.lit(5)), 11) / F.lit(float(1 << 53))
    chosen = known.where(place < share)
    return docs.select(doc_id, text).join(F.broadcast(chosen), F.col(doc_id) == F.col("_known")).drop("_known")


# -- scoring ---------------------------------------------------------------------------------------


def score(
    docs: DataFrame, model: np.ndarray, text: str = "text", output: str = "score", drop_text: bool = False
) -> DataFrame:
    """``docs`` with the probability of label 1 in ``output``; a column of that name is replaced.

    Only the text is read. A null or empty text has no features and scores by
    the model's bias.
    """
    held = docs.sparkSession.sparkContext.broadcast(np.asarray(model))
    rest = [f for f in docs.schema.fields if f.name != output and not (drop_text and f.name == text)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = held.value
        for batch in slices(batches, text):
            begins, cells, values = features(batch.column(text), len(weights) - 1)
            sums = np.concatenate(([0.0], np.cumsum(weights[cells] * values)))
            total = sums[begins[1:]] - sums[begins[:-1]] + weights[-1]
            scores = 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in rest] + [pa.array(scores)], [f.name for f in rest] + [output]
            )

    schema = type(docs.schema)([*rest]).add(output, "double")
    return in_small_batches(docs).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    """Whether a row's id falls into the fold that training leaves out; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds == fold


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` whose score is at least ``least``, in their own columns."""
    model = fit(training_rows(docs, labels, doc_id, text, usable=~held_out(doc_id)), doc_id, text)
    name = "score"
    while name in docs.columns:
        name += "_"
    return score(docs, model, text, name).where(F.col(name) >= least).select(*docs.columns)
