"""Scoring texts by a hierarchical Pitman-Yor language model of the corpus itself.

The model has three levels of restaurants. Tokens that follow a word are
customers of that word's own restaurant, its context. Every table there sends one
customer to the restaurant of the context's ending: the words that end alike (by
their last three bytes, hashed into ``CONTEXTS`` classes) share it as a parent.
Its tables send customers to the root restaurant, which all share, and whose own
base is uniform over the known tokens and one unknown. How many tables serve a
word is sampled by Gibbs: given the totals of the sweep before, the number for
each word is independent of the others, so words are dealt over the cluster. A
sweep ends with the totals of each ending and of the root, a small sum, and with
those of each context, which grow with the corpus: they are added up in a table
dealt by context, and each share of the words gets those of its own contexts
back. After ``BURN_IN`` sweeps the predictive probabilities of ``SAMPLES`` sweeps
are averaged.

Texts and counts meet without a row per token. Texts are dealt into units of
about ``UNIT_BYTES``. A unit states each pair of context and word it holds once,
with the count in training texts; the pairs are dealt by word, added up over the
units and seated, and each unit gets back one probability for each pair it
stated, in the same order. The texts themselves are packed and dealt once. The
words and contexts of one unit are told to all tasks, so that units state those
by their places, and by their hashes only what that unit has not. Sweeps keep no state but the totals: with those and
fixed seeds, every task seats its words again from the start, so a lost
executor costs its own tasks only.

Words, and words only, are stood for by 64-bit hashes; a word as a context by its
ending and the first 53 bits.
"""

from __future__ import annotations

import math
import struct
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.storage import dealt_by, in_small_batches, without_shuffles
from gleaner.llm.texts import BLANK_LOWER, mixed, slices, split_words

CONTEXTS = 1024
START = CONTEXTS
BURN_IN = 1
SAMPLES = 3
STRENGTH = 1.0
UNIT_BYTES = 16 << 20
# Texts are packed, and dealt into units, about so many bytes at a time.
BUNDLE_BYTES = 1 << 16
# So many words, and contexts, at most are told to all tasks.
FAMILIAR = 1 << 19
# Up to so many customers of a word, the number of their tables is drawn from its exact distribution.
EXACT = 64
# Beyond that, customers are seated in batches of a sixteenth of those seated.
BATCH = 16
END = np.uint64(0x5851F42D4C957F2D)
# A context's ending is in its first bits, so contexts in order are in order of their endings.
ENDING = np.uint64(11)
REST = np.uint64(53)


# -- texts of a unit -------------------------------------------------------------------------------


BUNDLED = "texts binary"


def bundled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, packed ``BUNDLE_BYTES`` of text at a time; a longer text on its own."""
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
    for part in slices(batches, "_text", BUNDLE_BYTES):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema, options=options) as out:
            out.write_batch(part)
        yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["texts"])


def unbundled(bundles: pa.Table) -> pa.Table:
    """The rows of a unit."""
    return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in bundles.column("texts").to_pylist()])


# -- tokens of a unit ------------------------------------------------------------------------------


def endings(words) -> np.ndarray:
    """How each word ends: the class of the context that it is to the next."""
    size = words.end - words.start
    code = np.minimum(size, 4).astype(np.uint64)
    for back in (1, 2, 3):
        byte = np.where(size >= back, words.data[np.maximum(words.end - back, 0)], 0)
        code = code * np.uint64(256) + byte.astype(np.uint64)
    return (mixed(code) % np.uint64(CONTEXTS)).astype(np.uint16)


def context_of(ending, word: np.ndarray) -> np.ndarray:
    return (np.asarray(ending).astype(np.uint64) << REST) | (word >> ENDING)


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and context of every token, text after text, and where each text begins."""
    words = split_words(column, BLANK_LOWER)
    texts = len(words.first) - 1
    begin = words.first + np.arange(texts + 1)
    token = np.full(begin[-1], END, np.uint64)
    context = np.full(begin[-1], context_of(START, END), np.uint64)
    place = np.arange(len(words.start)) + words.text
    token[place] = words.hashes()
    context[place + 1] = context_of(endings(words), token[place])
    return token, context, begin


@dataclass
class Pairs:
    """The distinct pairs of a unit in ascending order of word, then context."""

    word: np.ndarray
    context: np.ndarray
    count: np.ndarray
    of_token: np.ndarray

    @property
    def words(self) -> np.ndarray:
        """Where each distinct word's pairs begin."""
        return np.flatnonzero(np.concatenate(([True], self.word[1:] != self.word[:-1]))) if len(self.word) else np.empty(0, int)


def pairs_of(token: np.ndarray, context: np.ndarray, train: np.ndarray) -> Pairs:
    """The tokens are those of whole texts, so the one before, or the end of the last, tells a token's context."""
    words, word = np.unique(token, return_inverse=True)
    before = np.roll(word, 1)
    of_word = np.empty(len(words), np.uint64)
    of_word[before] = context
    contexts, at = np.unique(of_word, return_inverse=True)
    keys, of_token = np.unique(word * len(contexts) + at[before], return_inverse=True)
    count = np.bincount(of_token, train, minlength=len(keys)).astype(np.int64)
    return Pairs(words[keys // max(len(contexts), 1)], contexts[keys % max(len(contexts), 1)], count, of_token)


def unit_tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``tokens_of``, for all texts of a unit."""
    tokens, contexts, begins, at = [], [], [np.zeros(1, np.int64)], 0
    for batch in slices(table.to_batches(), "_text"):
        token, context, begin = tokens_of(batch.column("_text"))
        tokens.append(token)
        contexts.append(context)
        begins.append(begin[1:] + at)
        at += len(token)
    if not tokens:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), begins[0]
    return np.concatenate(tokens), np.concatenate(contexts), np.concatenate(begins)


def share_of(word: np.ndarray, shares: int) -> np.ndarray:
    """Which of ``shares`` equal ranges of hashes a word lies in."""
    return ((word >> np.uint64(32)) * np.uint64(shares) >> np.uint64(32)).astype(np.int64)


def home_of(context: np.ndarray, shares: int) -> np.ndarray:
    """Which share adds up a context's totals."""
    return share_of(context << ENDING, shares)


def packed(values: np.ndarray) -> bytes:
    return pa.Codec("zstd", 1).compress(np.ascontiguousarray(values).tobytes(), asbytes=True)


def unpacked(data: bytes, kind, count: int) -> np.ndarray:
    size = count * np.dtype(kind).itemsize
    return np.frombuffer(pa.Codec("zstd").decompress(data, size, asbytes=True) if size else b"", kind)


def packed_runs(values: np.ndarray) -> bytes:
    """Numbers in ascending runs: the bytes of their differences, first of all the lowest, then the next."""
    steps = np.diff(values, prepend=np.zeros(1, values.dtype))
    return packed(steps.view(np.uint8).reshape(-1, values.itemsize).T)


def unpacked_runs(data: bytes, kind, count: int) -> np.ndarray:
    steps = np.ascontiguousarray(unpacked(data, kind, count).view(np.uint8).reshape(np.dtype(kind).itemsize, -1).T)
    return np.cumsum(steps.reshape(-1).view(kind), dtype=kind)


def packed_floats(values: np.ndarray) -> bytes:
    """The first bytes of all numbers, which are much alike, then the next."""
    return packed(values.view(np.uint8).reshape(-1, values.itemsize).T)


def unpacked_floats(data: bytes, kind, count: int) -> np.ndarray:
    parts = unpacked(data, kind, count).view(np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(parts.T).reshape(-1).view(kind)


@dataclass
class Familiar:
    """Words and contexts that all tasks know, in ascending order; any will do, frequent ones save most."""

    words: np.ndarray
    contexts: np.ndarray


STRANGERS = Familiar(np.empty(0, np.uint64), np.empty(0, np.uint64))


def packed_listed(values: np.ndarray, familiar: np.ndarray) -> bytes:
    """Distinct hashes in ascending order: the places of the familiar ones, then the others."""
    at = np.searchsorted(familiar, values)
    met = (at < len(familiar)) & (np.append(familiar, np.uint64(0))[at] == values)
    places = packed_runs(at[met].astype(np.uint32))
    return struct.pack("<II", int(met.sum()), len(places)) + places + packed_runs(values[~met])


def unpacked_listed(data: bytes, familiar: np.ndarray, count: int) -> np.ndarray:
    met, size = struct.unpack_from("<II", data)
    places = unpacked_runs(data[8 : 8 + size], np.uint32, met)
    return np.sort(np.concatenate((familiar[places], unpacked_runs(data[8 + size :], np.uint64, count - met))))


def most_frequent(hashes: np.ndarray) -> np.ndarray:
    kinds, times = np.unique(hashes, return_counts=True)
    return np.sort(kinds[np.argsort(-times, kind="stable")[:FAMILIAR]])


FREQUENT = "n_words int, n_contexts int, words binary, contexts binary"


def frequent(bundles: pa.Table) -> pa.Table:
    """What a unit's texts hold most often."""
    token, context, _ = unit_tokens(unbundled(bundles))
    words, contexts = most_frequent(token), most_frequent(context)
    return pa.table({
        "n_words": pa.array([len(words)], pa.int32()), "n_contexts": pa.array([len(contexts)], pa.int32()),
        "words": pa.array([packed_runs(words)], pa.binary()), "contexts": pa.array([packed_runs(contexts)], pa.binary()),
    })


def familiar_of(dealt: DataFrame) -> Familiar:
    """Those of the first unit; of any other, or of none, the results would be the same."""
    rows = dealt.where(F.col("unit") == 0).groupBy("unit").applyInArrow(frequent, FREQUENT).collect()
    if not rows:
        return STRANGERS
    row = rows[0]
    return Familiar(
        unpacked_runs(bytes(row["words"]), np.uint64, row["n_words"]),
        unpacked_runs(bytes(row["contexts"]), np.uint64, row["n_contexts"]),
    )


# Of a pair, the place of its context among those of the row.
STATED = (
    "unit int, share int, n_words int, n_pairs int, n_contexts int, "
    "words binary, widths binary, contexts binary, places binary, counts binary"
)


def stated(shares: int, familiar: Familiar = STRANGERS):
    """Per unit: what it holds, one row for each share of the words."""
    kinds = (pa.int32(),) * 5 + (pa.binary(),) * 5
    names = [c.split()[0] for c in STATED.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        token, context, begin = unit_tokens(table)
        train = np.repeat(~table.column("_held").to_numpy().astype(bool), np.diff(begin))
        pairs = pairs_of(token, context, train)
        heads = pairs.words
        widths = np.diff(np.append(heads, len(pairs.word)))
        unit = table.column("unit")[0].as_py()
        share = share_of(pairs.word[heads], shares)
        edges = np.searchsorted(share, np.arange(shares + 1))
        bounds = np.append(heads, len(pairs.word))[edges]
        rows = []
        for number in range(shares):
            a, b, first, last = edges[number], edges[number + 1], bounds[number], bounds[number + 1]
            if b > a:
                contexts, places = np.unique(pairs.context[first:last], return_inverse=True)
                rows.append((
                    unit, number, int(b - a), int(last - first), len(contexts), packed_listed(pairs.word[heads[a:b]], familiar.words),
                    packed(widths[a:b].astype(np.uint32)), packed_listed(contexts, familiar.contexts), packed_runs(places.astype(np.uint32)),
                    packed(pairs.count[first:last].astype(np.uint32)),
                ))
        columns = list(zip(*rows)) or [[]] * len(names)
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


def stated_of_bundles(shares: int, familiar: Familiar):
    of_unit = stated(shares, familiar)

    def run(bundles: pa.Table) -> pa.Table:
        texts = unbundled(bundles)
        return of_unit(texts.append_column("unit", pa.array([bundles.column("unit")[0].as_py()] * len(texts), pa.int32())))

    return run


# -- seating ---------------------------------------------------------------------------------------


def log_stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """``[c, t]``: log of the weight of all ways to seat c customers at t tables."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    for c in range(1, most):
        t = np.arange(1, c + 2)
        stay = np.where(t <= c, np.log(np.maximum(c - discount * t, 1e-300)) + out[c, 1 : c + 2], -np.inf)
        out[c + 1, 1 : c + 2] = np.logaddexp(out[c, 0 : c + 1], stay)
    return out


def draw_tables(customers: np.ndarray, opening: np.ndarray, discount: float, stirling: np.ndarray, random) -> np.ndarray:
    """How many tables the customers of each word sit at; ``opening`` is the weight of a new table.

    The probability of t tables for c customers is proportional to the Stirling
    weight of (c, t) times ``opening ** t``.
    """
    tables = np.ones(len(customers), np.int64)
    lead = np.minimum(customers, EXACT)
    order = np.argsort(lead, kind="stable")
    edges = np.searchsorted(lead[order], np.arange(2, EXACT + 2))
    for c, first, last in zip(range(2, EXACT + 1), edges[:-1], edges[1:]):
        step = max(1, 2_000_000 // c)
        for at in range(first, last, step):
            rows = order[at : min(at + step, last)]
            weight = stirling[c, 1 : c + 1] + np.log(opening[rows])[:, None] * np.arange(1, c + 1)
            weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            tables[rows] = 1 + (weight < (random.random(len(rows)) * weight[:, -1])[:, None]).sum(axis=1)
    rows = np.flatnonzero(customers > EXACT)
    seated = EXACT
    while len(rows):
        batch = np.minimum(max(1, seated // BATCH), customers[rows] - seated)
        chance = opening[rows] / (seated + batch / 2 - discount * tables[rows] + opening[rows])
        tables[rows] += random.binomial(batch, np.clip(chance, 0.0, 1.0))
        seated += max(1, seated // BATCH)
        rows = rows[customers[rows] > seated]
    return np.minimum(tables, customers)


@dataclass
class Totals:
    """What all tasks share: the corpus' counts, and the totals before every sweep.

    ``seen`` has the training tokens of each ending. ``tables[s]`` has the tables of
    each ending before sweep s, ``customers[s]`` its customers (without contexts
    below, as many as tokens), ``guests[s]`` and ``roots[s]`` the customers and
    tables of the root restaurant. ``discounts`` are those of endings and of the
    root, ``below`` that of contexts.
    """

    seen: np.ndarray
    known: int
    discounts: tuple[float, float]
    tables: list[np.ndarray] = field(default_factory=list)
    guests: list[int] = field(default_factory=list)
    roots: list[int] = field(default_factory=list)
    customers: list[np.ndarray] = field(default_factory=list)
    below: float = 0.5

    def visits(self, sweep: int) -> np.ndarray:
        return self.customers[sweep] if self.customers else self.seen

    def backoff(self, sweep: int) -> np.ndarray:
        """Per ending, the probability that the next token comes from the root."""
        return (STRENGTH + self.discounts[0] * self.tables[sweep]) / (STRENGTH + self.visits(sweep))

    def ending(self, sweep: int, context: np.ndarray, customers: np.ndarray, tables: np.ndarray, root: np.ndarray) -> np.ndarray:
        """The probability, in an ending, of words with so many customers and tables there, and ``root`` at the root."""
        own = (customers - self.discounts[0] * tables) / (STRENGTH + self.visits(sweep)[context])
        return own + self.backoff(sweep)[context] * root

    def root(self, sweep: int, guests: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """The root's probability of words with so many customers and tables there."""
        rest = (STRENGTH + self.discounts[1] * self.roots[sweep]) / (self.known + 1)
        return (guests - self.discounts[1] * tables + rest) / (STRENGTH + self.guests[sweep])


@dataclass
class Below:
    """The pairs of words and contexts of one share, with the totals of its contexts.

    ``context`` are the share's contexts in ascending order; a pair names its own
    by ``at``, and by ``group`` the pair of its word and ending. ``seen`` are
    the training tokens of each context, ``totals[s]`` its tables before sweep s,
    ``tables`` those of every pair in the sweep just done.
    """

    context: np.ndarray
    group: np.ndarray
    at: np.ndarray
    count: np.ndarray
    seen: np.ndarray | None = None
    totals: list[np.ndarray] = field(default_factory=list)
    tables: np.ndarray | None = None


@dataclass
class Share:
    """The pairs of one share of the words and endings, added up over the units; only pairs of training texts.

    ``count`` are the customers of each pair; with contexts below, at first one for each of them.
    """

    number: int
    word: np.ndarray
    of: np.ndarray
    context: np.ndarray
    count: np.ndarray
    below: Below | None = None


@dataclass
class Asked:
    """The distinct pairs of words and contexts that units stated, in training texts or not.

    ``pair`` has one for every stated pair, unit after unit. Those not in training texts have -1 for their
    word, for the pair of word and ending, and for the pair itself, where the share does not know it.
    """

    pair: np.ndarray
    at: np.ndarray
    word: np.ndarray
    group: np.ndarray
    own: np.ndarray


def added_up(number: int, rows: list[dict], familiar: Familiar = STRANGERS) -> tuple[Share, Asked]:
    own = [unpacked_listed(row["words"], familiar.words, row["n_words"]) for row in rows]
    widths = np.concatenate([unpacked(row["widths"], np.uint32, row["n_words"]) for row in rows])
    words, word = np.unique(np.concatenate(own), return_inverse=True)
    listed = [unpacked_listed(row["contexts"], familiar.contexts, row["n_contexts"]) for row in rows]
    contexts, at = np.unique(np.concatenate(listed), return_inverse=True)
    begins = np.cumsum([len(c) for c in listed]) - [len(c) for c in listed]
    at = at[np.concatenate([unpacked_runs(row["places"], np.uint32, row["n_pairs"]) + begin for row, begin in zip(rows, begins)])]
    counts = np.concatenate([unpacked(row["counts"], np.uint32, row["n_pairs"]) for row in rows])
    keys, pair = np.unique(np.repeat(word, widths) * len(contexts) + at, return_inverse=True)
    count = np.bincount(pair, counts, minlength=len(keys)).astype(np.int64)
    word, at = keys // len(contexts), keys % len(contexts)
    met = count > 0
    known = np.zeros(len(words), bool)
    known[word[met]] = True
    of_word = np.where(known, np.cumsum(known) - 1, -1)[word]
    ending = (contexts >> REST).astype(np.int64)[at]
    # Pairs are in order of word, then of ending.
    groups = of_word * (CONTEXTS + 1) + ending
    heads = np.flatnonzero(np.diff(groups[met], prepend=-1))
    kept = groups[met][heads]
    place = np.minimum(np.searchsorted(kept, groups), max(len(kept) - 1, 0))
    group = np.where((of_word >= 0) & (kept[place] == groups), place, -1) if len(kept) else np.full(len(keys), -1)
    below = Below(contexts, group[met], at[met], count[met])
    spread = np.bincount(below.group, minlength=len(kept))
    share = Share(number, words[known], kept // (CONTEXTS + 1), kept % (CONTEXTS + 1), spread, below)
    return share, Asked(pair, at, of_word, group, np.where(met, np.cumsum(met) - 1, -1))


def seat(share: Share, totals: Totals, sweeps: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """After each sweep: the tables of every pair, and every word's customers and tables at the root.

    At first every pair and every word has one table, as in ``Totals`` before sweep 0. Contexts below
    are seated first, with the pairs above as the sweep before left them; ``share.count`` and
    ``share.below.tables`` are then those of this sweep.
    """
    low, high = (log_stirling(d) for d in totals.discounts)
    words, below = len(share.word), share.below
    tables = np.ones(len(share.count), np.int64)
    guests = np.bincount(share.of, minlength=words)
    roots = np.ones(words, np.int64)
    if below:
        lowest = log_stirling(totals.below)
        below.tables = np.ones(len(below.count), np.int64)
        share.count = np.bincount(below.group, minlength=len(tables))
    for sweep in range(sweeps):
        random = np.random.default_rng([seed, share.number, sweep])
        # A pair is seated as if its own customers were not there yet, here and at the levels above.
        if below:
            several = np.flatnonzero(below.count > 1)
            group, own = below.group[several], below.tables[several]
            left = share.count[group] - own
            kept = np.minimum(tables[group], left)
            of = share.of[group]
            others = guests[of] - tables[group] + kept
            root = totals.root(sweep, others, np.minimum(roots[of], others))
            parent = totals.ending(sweep, share.context[group], left, kept, root)
            opening = (STRENGTH + totals.below * (below.totals[sweep][below.at[several]] - own)) * parent
            below.tables[several] = draw_tables(below.count[several], opening, totals.below, lowest, random)
            share.count = np.bincount(below.group, below.tables, minlength=len(tables)).astype(np.int64)
        others = guests[share.of] - tables
        context = STRENGTH + totals.discounts[0] * (totals.tables[sweep][share.context] - tables)
        opening = context * totals.root(sweep, others, np.minimum(roots[share.of], others))
        tables = draw_tables(share.count, opening, totals.discounts[0], low, random)
        guests = np.bincount(share.of, tables, minlength=words).astype(np.int64)
        fresh = (STRENGTH + totals.discounts[1] * totals.roots[sweep]) / (totals.known + 1)
        roots = draw_tables(guests, np.full(words, fresh), totals.discounts[1], high, random)
        yield tables, guests, roots


def shares_in(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each share in this partition; a share lies in one partition as a whole."""
    rows: dict[int, list[dict]] = defaultdict(list)
    for batch in batches:
        for row in batch.to_pylist():
            rows[row["share"]].append(row)
    for number in sorted(rows):
        yield number, sorted(rows.pop(number), key=lambda r: r["unit"])


SUMS = "name string, place int, value bigint"


def sums_of(found: dict[str, np.ndarray]) -> pa.Table:
    """One long per name and place."""
    names = [n for n, v in found.items() for _ in v]
    places = [i for v in found.values() for i in range(len(v))]
    values = np.concatenate([*found.values()]).astype(np.int64)
    return pa.table({"name": pa.array(names, pa.string()), "place": pa.array(places, pa.int32()), "value": values})


def added(sums: DataFrame) -> dict[tuple[str, int], int]:
    """The sums of all shares; as many rows as places reach the driver."""
    summed = sums.groupBy("name", "place").agg(F.sum("value").alias("value"))
    return {(r["name"], r["place"]): r["value"] for r in summed.collect()}


def _vector(found: dict, name: str, size: int) -> np.ndarray:
    return np.array([found.get((name, i), 0) for i in range(size)], np.float64)


def _by_ending(share: Share, weights: np.ndarray) -> np.ndarray:
    return np.bincount(share.context, weights, minlength=CONTEXTS + 1)


def corpus_totals(sums: DataFrame) -> Totals:
    """The counts of the corpus, and the totals with one table for every pair and word."""
    found = added(sums)
    known, kinds, *few = _vector(found, "one", 8)

    def discount(first: float, second: float) -> float:
        """The usual estimate from how many are met once and twice, kept inside the open interval."""
        return min(0.95, max(0.05, first / (first + 2 * second) if first else 0.5))

    return Totals(
        _vector(found, "seen", CONTEXTS + 1), int(known), (discount(*few[2:4]), discount(*few[4:])),
        [_vector(found, "tables", CONTEXTS + 1)], [int(kinds)], [int(known)],
        [_vector(found, "customers", CONTEXTS + 1)], discount(*few[:2]),
    )


# -- totals of contexts ----------------------------------------------------------------------------

HELD = f"home int, share int, n int, contexts binary, seen binary, tables binary, {SUMS}"
SWEPT = f"home int, share int, tables binary, {SUMS}"
TOLD = "share int, home int, sweep int, n int, seen binary, tables binary"


def per_home(contexts: np.ndarray, shares: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each home that has some of a share's contexts, their places in ascending order."""
    home = home_of(contexts, shares)
    order = np.argsort(home, kind="stable")
    edges = np.flatnonzero(np.diff(home[order], prepend=-1))
    for places in np.split(order, edges[1:]) if len(order) else ():
        yield int(home[places[0]]), places


def per_context(below: Below, weights: np.ndarray) -> np.ndarray:
    return np.bincount(below.at, weights, minlength=len(below.context)).astype(np.int64)


def held(shares: int, familiar: Familiar = STRANGERS):
    """Per share and home: the contexts that the share states, with their tokens and pairs in it; and the corpus' counts in it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in shares_in(batches):
            share, _ = added_up(number, rows, familiar)
            below, spread = share.below, np.bincount(share.of, minlength=len(share.word))
            seen, tables = per_context(below, below.count), per_context(below, np.ones(len(below.at)))
            kinds = [(c == n).sum() for c in (below.count, share.count, spread) for n in (1, 2)]
            sums = sums_of({
                "seen": _by_ending(share, np.bincount(below.group, below.count, minlength=len(share.count))),
                "customers": _by_ending(share, share.count),
                "tables": _by_ending(share, np.ones(len(share.count))),
                "one": np.array([len(share.word), len(share.count), *kinds]),
            })
            out = [
                (home, len(at), packed_listed(below.context[at], familiar.contexts), packed(seen[at]), packed(tables[at]))
                for home, at in per_home(below.context, shares)
            ]
            columns = dict(zip(("home", "n", "contexts", "seen", "tables"), zip(*out)))
            yield from of_share(number, HELD, columns, sums)

    return run


def of_share(number: int, schema: str, columns: dict[str, tuple], sums: pa.Table) -> list[pa.RecordBatch]:
    """What a share tells homes, and its sums, which have a name and no home."""
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    target = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in schema.split(", "))])
    up = pa.table({n: pa.array(v, target.field(n).type) for n, v in columns.items()})
    up = up.append_column("share", pa.array([number] * len(up), pa.int32()))
    sums = sums.append_column("share", pa.array([number] * len(sums), pa.int32()))
    both = pa.concat_tables([up, sums], promote_options="default")
    return both.select(target.names).combine_chunks().to_batches()


def told(sweep: int, familiar: Familiar = STRANGERS):
    """At each home: the totals of its contexts, told to every share in the order of its own list."""

    def run(lists: pa.Table, sums: pa.Table) -> pa.Table:
        rows = lists.to_pylist()
        sums = {r["share"]: r["tables"] for r in sums.to_pylist()}
        listed = [unpacked_listed(r["contexts"], familiar.contexts, r["n"]) for r in rows]
        known, at = np.unique(np.concatenate(listed), return_inverse=True)

        def total(parts: list[np.ndarray]) -> list[bytes]:
            whole = np.bincount(at, np.concatenate(parts), minlength=len(known)).astype(np.int64)[at]
            return [packed(v) for v in np.split(whole, np.cumsum([r["n"] for r in rows])[:-1])]

        tables = total([unpacked(sums[r["share"]], np.int64, r["n"]) for r in rows])
        seen = [None] * len(rows) if sweep else total([unpacked(r["seen"], np.int64, r["n"]) for r in rows])
        return pa.table({
            "share": pa.array([r["share"] for r in rows], pa.int32()), "home": pa.array([r["home"] for r in rows], pa.int32()),
            "sweep": pa.array([sweep] * len(rows), pa.int32()), "n": pa.array([r["n"] for r in rows], pa.int32()),
            "seen": pa.array(seen, pa.binary()), "tables": pa.array(tables, pa.binary()),
        })

    def first(lists: pa.Table) -> pa.Table:
        return run(lists, lists)

    return run if sweep else first


def listen(below: Below, rows: list[dict], shares: int) -> None:
    """Give the contexts of a share the totals that it was told."""
    places = dict(per_home(below.context, shares))
    below.seen = np.zeros(len(below.context))
    below.totals = [np.zeros(len(below.context)) for _ in range(1 + max((r["sweep"] for r in rows), default=-1))]
    for row in rows:
        at = places[row["home"]]
        below.totals[row["sweep"]][at] = unpacked(row["tables"], np.int64, row["n"])
        if row["seen"] is not None:
            below.seen[at] = unpacked(row["seen"], np.int64, row["n"])


def swept(totals: Totals, sweeps: int, seed: int, shares: int, familiar: Familiar = STRANGERS):
    """Per share, after so many sweeps: the tables of its contexts, for their homes, and its part of the other totals."""

    def run(stated: pa.Table, heard: pa.Table) -> pa.Table:
        rows = sorted(stated.to_pylist(), key=lambda r: r["unit"])
        share, _ = added_up(rows[0]["share"], rows, familiar)
        listen(share.below, heard.to_pylist(), shares)
        for tables, guests, roots in seat(share, totals, sweeps, seed):
            pass
        own = per_context(share.below, share.below.tables)
        homes = [(home, packed(own[at])) for home, at in per_home(share.below.context, shares)]
        sums = sums_of({
            "customers": _by_ending(share, share.count), "tables": _by_ending(share, tables),
            "one": np.array([guests.sum(), roots.sum()]),
        })
        return pa.Table.from_batches(of_share(share.number, SWEPT, dict(zip(("home", "tables"), zip(*homes))), sums))

    return run


def all_totals(pairs: DataFrame, sweeps: int, seed: int, shares: int, familiar: Familiar = STRANGERS) -> tuple[Totals, DataFrame]:
    """The totals before and after each sweep, and those of all contexts, as told to the shares.

    A sweep is one pass over the pairs.
    """
    both = dealt_by(pairs.mapInArrow(held(shares, familiar), HELD), shares, "home")
    totals, lists = corpus_totals(both.where("name IS NOT NULL")), both.where("name IS NULL").drop("name", "place", "value")
    heard = without_shuffles(lists.groupBy("home").applyInArrow(told(0, familiar), TOLD))
    for sweep in range(1, sweeps + 1):
        done = without_shuffles(
            pairs.groupBy("share").cogroup(heard.groupBy("share")).applyInArrow(swept(totals, sweep, seed, shares, familiar), SWEPT)
        )
        found = added(done.where("name IS NOT NULL"))
        guests, roots = _vector(found, "one", 2)
        totals.tables.append(_vector(found, "tables", CONTEXTS + 1))
        totals.customers.append(_vector(found, "customers", CONTEXTS + 1))
        totals.guests.append(int(guests))
        totals.roots.append(int(roots))
        sums = done.where("name IS NULL").select("home", "share", "tables")
        now = lists.groupBy("home").cogroup(sums.groupBy("home")).applyInArrow(told(sweep, familiar), TOLD)
        heard = heard.unionByName(without_shuffles(now))
    return totals, heard


# -- probabilities ---------------------------------------------------------------------------------


ANSWERED = "unit int, share int, n_words int, n_pairs int, logs binary, counts binary"


def predicted(share: Share, asked: Asked, totals: Totals, burn_in: int, samples: int, seed: int) -> np.ndarray:
    """The probability of every distinct pair that units stated."""

    def of(values: np.ndarray, place: np.ndarray) -> np.ndarray:
        return np.append(values, 0)[place]

    below = share.below
    ending = (below.context >> REST).astype(np.int64)[asked.at]
    whole = np.zeros(len(asked.at))
    for sweep, (tables, guests, roots) in enumerate(seat(share, totals, burn_in + samples, seed), 1):
        if sweep > burn_in:
            root = totals.root(sweep, of(guests, asked.word), of(roots, asked.word))
            parent = totals.ending(sweep, ending, of(share.count, asked.group), of(tables, asked.group), root)
            own = of(below.count - totals.below * below.tables, asked.own)
            rest = (STRENGTH + totals.below * below.totals[sweep])[asked.at] * parent
            whole += (own + rest) / (STRENGTH + below.seen[asked.at]) / samples
    return whole


def answered(totals: Totals, burn_in: int, samples: int, seed: int, shares: int, familiar: Familiar = STRANGERS):
    """For every row that a unit stated: log10 of each pair's probability, and each word's count."""

    def run(stated: pa.Table, heard: pa.Table) -> pa.Table:
        rows = sorted(stated.to_pylist(), key=lambda r: r["unit"])
        share, asked = added_up(rows[0]["share"], rows, familiar)
        below = share.below
        listen(below, heard.to_pylist(), shares)
        logs = np.log10(predicted(share, asked, totals, burn_in, samples, seed)).astype(np.float32)[asked.pair]
        counts = np.bincount(share.of[below.group], below.count, minlength=len(share.word)).astype(np.int64)
        counts = np.append(counts, 0)[asked.word][asked.pair]
        out, at = [], 0
        for row in rows:
            widths = unpacked(row["widths"], np.uint32, row["n_words"]).astype(np.int64)
            heads = at + np.cumsum(widths) - widths
            own = packed_floats(logs[at : at + row["n_pairs"]])
            out.append((row["unit"], share.number, row["n_words"], row["n_pairs"], own, packed(counts[heads])))
            at += row["n_pairs"]
        kinds = (pa.int32(),) * 4 + (pa.binary(),) * 2
        names = [c.split()[0] for c in ANSWERED.split(", ")]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return run


def scored(totals: Totals):
    """Joins a unit's texts with its answers."""
    train_tokens = int(totals.seen.sum())
    base_below = math.log10(train_tokens + totals.known + 1)

    def run(answers: pa.Table, bundles: pa.Table) -> pa.Table:
        texts = unbundled(bundles).combine_chunks()
        token, context, begin = unit_tokens(texts)
        pairs = pairs_of(token, context, np.zeros(len(token)))
        rows = sorted(answers.to_pylist(), key=lambda r: r["share"])
        logs = np.concatenate([unpacked_floats(r["logs"], np.float32, r["n_pairs"]) for r in rows] or [np.empty(0)])
        counts = np.concatenate([unpacked(r["counts"], np.int64, r["n_words"]) for r in rows] or [np.empty(0, np.int64)])
        if len(logs) != len(pairs.word):
            raise RuntimeError("a unit's texts differ from those it stated")
        widths = np.diff(np.append(pairs.words, len(pairs.word)))
        count = np.repeat(counts, widths)[pairs.of_token]
        whose = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        texts_n = len(begin) - 1
        base = np.bincount(whose, np.log10(count + 1) - base_below, minlength=texts_n)
        score = np.bincount(whose, logs[pairs.of_token], minlength=texts_n)
        known = np.bincount(whose[count > 0], minlength=texts_n)
        return pa.Table.from_arrays(
            [
                texts.column("_id").combine_chunks(), texts.column("_held").combine_chunks(), pa.array(np.diff(begin), pa.int64()),
                pa.array(known, pa.int64()), pa.array(base), pa.array(score),
            ],
            ["_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
        )

    return run


def score(
    docs: DataFrame,
    held_out: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    burn_in: int = BURN_IN,
    samples: int = SAMPLES,
    seed: int = 1,
    unit_bytes: int = UNIT_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: how likely its text is to a model of the rows not ``held_out``.

    ``n_tokens`` counts the words and one end, ``n_known`` those of them that
    training texts hold, ``train_tokens`` all of training. ``base_score`` is the
    log10 probability under the words' own frequencies, one added to each;
    ``score`` that under the model. Perplexity is ``10 ** (-score / n_tokens)``.
    A null text is empty and still has its end. Other columns of ``docs`` are not
    read, repeated ids are rows of their own. Without training texts every token
    is unknown and has probability 1.
    """
    kind = docs.schema[doc_id].dataType
    rows = docs.select(
        F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.coalesce(held_out, F.lit(False)).alias("_held")
    )
    size = rows.agg(F.sum(F.octet_length("_text").cast("bigint") + 1)).first()[0] or 1
    units = max(1, -(-size // unit_bytes))
    bundles = in_small_batches(rows).mapInArrow(bundled, BUNDLED)
    dealt = dealt_by(bundles.withColumn("unit", F.pmod(F.xxhash64("texts"), F.lit(units)).cast("int")), units, "unit")
    familiar = familiar_of(dealt)
    pairs = dealt_by(dealt.groupBy("unit").applyInArrow(stated_of_bundles(units, familiar), STATED), units, "share")
    totals, heard = all_totals(pairs, burn_in + samples, seed, units, familiar)
    answers = pairs.groupBy("share").cogroup(heard.groupBy("share")).applyInArrow(
        answered(totals, burn_in, samples, seed, units, familiar), ANSWERED
    )
    result = answers.groupBy("unit").cogroup(dealt.groupBy("unit")).applyInArrow(
        scored(totals),
        f"_id {kind.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double",
    )
    return result.select(
        F.col("_id").alias(doc_id), "held_out", "n_tokens", "n_known",
        F.lit(int(totals.seen.sum())).cast("bigint").alias("train_tokens"), "base_score", "score",
    )
