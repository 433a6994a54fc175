"""Alignment of two tokenizers: which tokens of one stand for which tokens of the other.

Both tokenizers read a text with a space in front. Wherever a token of each ends
at the same byte the text is cut, and the tokens between two cuts are a group;
every token of A in a group is linked to every token of B in it.

The cuts are found in lockstep. One NumPy vector holds, for every text of a
batch, which token of A and which of B it has reached. Each step compares the
ends of the two tokens, emits a cut where they agree and advances the token that
ends first, or both; texts that are through leave the vector. A long text is
laid into several lanes that begin at shared ends, so the steps of a batch do
not grow with its longest text.

How often a pair of ids is linked in the corpus is counted by Spark over the
stored pairs of each text. Texts are tokenized once.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.storage import durable, in_small_batches, in_stages
from gleaner.llm.texts import ragged, slices, texts_of
from gleaner.llm.tokens import PATTERN, byte_letters, plain_byte_level

# Bytes of text whose lanes advance together.
BATCH_BYTES = 1 << 20
# Tokens of A after which a long text goes on in another lane.
LANE = 2048
# Links that are written out at once; the links of a larger group are counted by its distinct ids.
LINKS_AT_ONCE = 1 << 20
WIDE_GROUP = 1 << 12
# Pairs whose counts are broadcast, 16 bytes each; beyond it pairs are joined.
BROADCAST_PAIRS = 4_000_000
# Pieces of text whose tokens are remembered, and the longest of them.
REMEMBERED = 300_000
LONGEST = 64
UNITS_AT_ONCE = 5_000

# The characters of Unicode's White_Space, and the sign that stands for a space in pieces.
SPACES = "\t-\r \x85\xa0  -     　"
BAR = "▁"
# A text falls into units in front of every space that follows a character which is none. Neither
# vocabulary has a token across such a place, so units are tokenized on their own, once each.
NO_BLANKS = SPACES.replace(" ", "", 1)
UNITS = re.compile(f"[{SPACES}]*(?:[^{SPACES}]+(?:[{NO_BLANKS}][{SPACES}]*)?)+|[{SPACES}]+").findall


@dataclass
class Tokenizer:
    """``encode`` gives the ids of each unit; ``data[first[i]:first[i + 1]]`` are the bytes of token ``i``."""

    encode: Callable[[list[str]], list[list[int]]]
    data: np.ndarray
    first: np.ndarray

    @property
    def size(self) -> int:
        return len(self.first) - 1


def _tokenizer(encode: Callable[[list[str]], list[list[int]]], tokens: list[bytes]) -> Tokenizer:
    first = np.concatenate(([0], np.cumsum([len(t) for t in tokens]))).astype(np.int64)
    return Tokenizer(encode, np.frombuffer(b"".join(tokens), np.uint8), first)


def byte_level(spec: bytes) -> Tokenizer:
    """A byte-level BPE from the content of a ``tokenizers`` file; special strings in texts are plain text.

    Where ids rise in the order of the merges, an id is a token's rank, which is all that a
    byte pair encoding asks for; a file that asks for more is refused.
    """
    import tiktoken

    model = json.loads(spec)["model"]
    ids = model["vocab"]
    merged = [ids["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in model["merges"]]
    if any(a >= b for a, b in zip(merged, merged[1:])) or not plain_byte_level(json.loads(spec)):
        raise ValueError("not a plain byte-level BPE in the order of its merges")
    byte_of = {letter: byte for byte, letter in enumerate(byte_letters())}
    tokens, ranks = [b""] * (max(ids.values()) + 1), {}
    for token, number in ids.items():
        known = all(c in byte_of for c in token)
        tokens[number] = bytes(byte_of[c] for c in token) if known else token.encode()
        if known and (len(token) == 1 or number >= merged[0]) and number <= merged[-1]:
            ranks[tokens[number]] = number
    library = tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(units: list[str]) -> list[list[int]]:
        return list(map(library.encode_ordinary, units))

    return _tokenizer(encode, tokens)


def pieces(spec: bytes) -> Tokenizer:
    """A ``sentencepiece`` model that adds a space in front, from the content of its file."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=spec)
    names = [library.id_to_piece(i) for i in range(library.vocab_size())]
    if any(re.search(f"[^{SPACES}{BAR}]{BAR}", name) for name in names):
        raise ValueError("pieces that go on over a space cannot be tokenized by units")
    tokens = [
        bytes([int(name[3:5], 16)]) if library.is_byte(i) else name.replace(BAR, " ").encode() for i, name in enumerate(names)
    ]

    alone = [library.piece_to_id(BAR)]

    def encode(units: list[str]) -> list[list[int]]:
        # Every unit begins with the space that the model adds, except to nothing.
        found = library.encode([u[1:] for u in units], num_threads=1)
        return [alone if u == " " else ids for u, ids in zip(units, found)]

    return _tokenizer(encode, tokens)


class Encoder:
    """Tokens of texts by both tokenizers, remembering units; only what is remembered is bounded."""

    def __init__(self, one: Tokenizer, other: Tokenizer, remembered: int = REMEMBERED):
        self.tokenizers = (one, other)
        self.remembered = remembered
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = [np.empty(0, np.int64) for _ in self.tokenizers]
        self.first = [np.zeros(1, np.int64) for _ in self.tokenizers]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per tokenizer the ids of all texts, each with a space in front, and where each text begins."""
        units = [UNITS(" " + text) for text in texts]
        per_text = np.concatenate(([0], np.cumsum([len(one) for one in units]))).astype(np.int64)
        if len(self.place) > self.remembered:
            self.forget()
        every = list(chain.from_iterable(units))
        places = np.fromiter(map(self.place.get, every, repeat(-1)), np.int64, len(every))
        missing = np.flatnonzero(places < 0).tolist()
        asked = [every[i] for i in missing]
        # Longer units come last, so that they can be forgotten after this batch.
        fresh = sorted(dict.fromkeys(asked), key=lambda u: len(u) > LONGEST)
        begin = len(self.place)
        self.place.update(zip(fresh, range(begin, begin + len(fresh))))
        places[missing] = [self.place[u] for u in asked]
        out = []
        for side, tokenizer in enumerate(self.tokenizers):
            self._learn(side, tokenizer, fresh)
            first = self.first[side]
            begins, sizes = first[places], first[places + 1] - first[places]
            ends = np.concatenate(([0], np.cumsum(sizes)))
            out.append((self.ids[side][ragged(begins, sizes)], ends[per_text]))
        long = [u for u in reversed(fresh) if len(u) > LONGEST]
        for unit in long:
            del self.place[unit]
        for side in range(2) if long else ():
            self.first[side] = self.first[side][: len(self.place) + 1]
            self.ids[side] = self.ids[side][: self.first[side][-1]]
        return out

    def _learn(self, side: int, tokenizer: Tokenizer, fresh: list[str]) -> None:
        ids, sizes = [self.ids[side]], []
        for at in range(0, len(fresh), UNITS_AT_ONCE):
            found = tokenizer.encode(fresh[at : at + UNITS_AT_ONCE])
            sizes.extend(map(len, found))
            ids.append(np.fromiter(chain.from_iterable(found), np.int64))
        self.ids[side] = np.concatenate(ids)
        self.first[side] = np.concatenate((self.first[side], self.first[side][-1] + np.cumsum(sizes, dtype=np.int64)))


# -- cuts ------------------------------------------------------------------------------------------


def lanes(end_a: np.ndarray, first_a: np.ndarray, end_b: np.ndarray, first_b: np.ndarray, size: int = LANE):
    """Where each lane begins in A and B, and ends in A: texts, and parts of long texts from a shared end on."""
    starts_a, starts_b, stops = [], [], []
    for text in np.flatnonzero(np.diff(first_a)):
        at, stop, at_b, stop_b = first_a[text], first_a[text + 1], first_b[text], first_b[text + 1]
        begins = [(at, at_b)]
        ends = end_b[at_b:stop_b]
        look = at + size
        while look < stop - 1:
            some = end_a[look : min(look + 64, stop - 1)]
            place = np.searchsorted(ends, some)
            shared = np.flatnonzero(ends[place] == some)
            if len(shared):
                begins.append((look + shared[0] + 1, at_b + place[shared[0]] + 1))
                look = begins[-1][0] + size
            else:
                look += len(some)
        starts_a += [a for a, _ in begins]
        starts_b += [b for _, b in begins]
        stops += [a for a, _ in begins[1:]] + [stop]
    return np.array(starts_a, np.int64), np.array(starts_b, np.int64), np.array(stops, np.int64)


def lockstep(end_a: np.ndarray, first_a: np.ndarray, end_b: np.ndarray, first_b: np.ndarray, lane: int = LANE):
    """Where the groups of all texts end in A and in B, in order.

    ``end_a`` and ``end_b`` are the offsets at which tokens end within their text,
    ``first_a`` and ``first_b`` where each text begins. Both tokenizations of a
    text end at the same offset.
    """
    i, j, stop = lanes(end_a, first_a, end_b, first_b, lane)
    cut_a, cut_b = np.zeros(len(end_a) + 1, bool), np.zeros(len(end_b) + 1, bool)
    while len(i):
        reach_a, reach_b = end_a[i], end_b[j]
        i = i + (reach_a <= reach_b)
        j = j + (reach_b <= reach_a)
        cut = reach_a == reach_b
        cut_a[i[cut]] = True
        cut_b[j[cut]] = True
        open_ = i < stop
        if not open_.all():
            i, j, stop = i[open_], j[open_], stop[open_]
    return np.flatnonzero(cut_a), np.flatnonzero(cut_b)


# -- links -----------------------------------------------------------------------------------------


def counted(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of their times."""
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    fresh = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[fresh], np.add.reduceat(times, fresh) if len(fresh) else times


def linked_pairs(
    text: np.ndarray, a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray, size_a: int, size_b: int
) -> tuple[np.ndarray, np.ndarray]:
    """``(text * size_a + id of A) * size_b + id of B`` of every pair linked in a text, ascending, and how often it is."""
    starts_a, starts_b = np.concatenate(([0], ends_a[:-1])), np.concatenate(([0], ends_b[:-1]))
    m, n = ends_a - starts_a, ends_b - starts_b
    wide = m * n > WIDE_GROUP
    keys, times = [], []
    for group in np.flatnonzero(wide):
        one, of_one = np.unique(a[starts_a[group] : ends_a[group]], return_counts=True)
        two, of_two = np.unique(b[starts_b[group] : ends_b[group]], return_counts=True)
        keys.append((((text[group] * size_a + one) * size_b)[:, None] + two).ravel())
        times.append((of_one[:, None] * of_two).ravel())
    narrow = np.flatnonzero(~wide)
    total = np.cumsum((m * n)[narrow])
    at = 0
    while at < len(narrow):
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + LINKS_AT_ONCE, "right")))
        some = narrow[at:end]
        links = (m * n)[some]
        group = np.repeat(some, links)
        place = ragged(np.zeros(len(some), np.int64), links)
        one = a[starts_a[group] + place // n[group]]
        two = b[starts_b[group] + place % n[group]]
        key, often = counted((text[group] * size_a + one) * size_b + two, np.ones(len(group), np.int64))
        keys.append(key)
        times.append(often)
        at = end
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return counted(np.concatenate(keys), np.concatenate(times)) if len(keys) > 1 else (keys[0], times[0])


def group_texts(a: np.ndarray, first_a: np.ndarray, ends_a, b: np.ndarray, first_b: np.ndarray, ends_b, signs) -> list[str]:
    """Per text its groups, as ``a1,a2|b1;a3|b2,b3``."""
    comma, bar, semicolon = signs
    last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    last_a[ends_a - 1] = True
    last_b[ends_b - 1] = True
    # A token of A follows all tokens of B of earlier groups, a token of B all of A up to its own.
    sizes_a, sizes_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
    row = np.empty(len(a) + len(b), object)
    row[np.arange(len(a)) + np.repeat(ends_b - sizes_b, sizes_a)] = np.where(last_a, bar[a], comma[a])
    row[np.arange(len(b)) + np.repeat(ends_a, sizes_b)] = np.where(last_b, semicolon[b], comma[b])
    bounds = (first_a + first_b).tolist()
    return ["".join(row[low:high].tolist())[:-1] for low, high in zip(bounds, bounds[1:])]


def same_bytes(tokenizer: Tokenizer, ids: np.ndarray, first: np.ndarray, wanted: list[bytes]) -> np.ndarray:
    """Which texts' tokens, joined, give the wanted bytes."""
    data = tokenizer.data[ragged(tokenizer.first[ids], tokenizer.first[ids + 1] - tokenizer.first[ids])].tobytes()
    ends = np.concatenate(([0], np.cumsum(tokenizer.first[ids + 1] - tokenizer.first[ids])))[first].tolist()
    return np.array([data[low:high] == w for low, high, w in zip(ends, ends[1:], wanted)], bool)


class Aligner:
    """Aligns batches of texts."""

    def __init__(self, one: Tokenizer, other: Tokenizer, lane: int = LANE):
        self.one, self.other, self.lane = one, other, lane
        self.encoder = Encoder(one, other)
        most = max(one.size, other.size)
        self.signs = [np.array([f"{i}{sign}" for i in range(most)], object) for sign in ",|;"]

    def align(self, texts: list[str]) -> dict[str, list]:
        """Columns with one value per text; a text that a tokenizer does not give back has no tokens."""
        # The sign for a space in pieces comes back as a space.
        asked = ["" if BAR in t else t for t in texts]
        (a, first_a), (b, first_b) = self.encoder.encode(asked)
        wanted = [(" " + t).encode() for t in asked]
        good = same_bytes(self.one, a, first_a, wanted) & same_bytes(self.other, b, first_b, wanted)
        good &= np.array([bool(t) for t in asked], bool)
        a, first_a = chosen(a, first_a, good)
        b, first_b = chosen(b, first_b, good)
        end_a, end_b = self.ends(self.one, a, first_a), self.ends(self.other, b, first_b)
        ends_a, ends_b = lockstep(end_a, first_a, end_b, first_b, self.lane)
        text = np.searchsorted(first_a, ends_a, "left") - 1
        links = np.diff(ends_a, prepend=0) * np.diff(ends_b, prepend=0)
        keys, times = linked_pairs(text, a, ends_a, b, ends_b, self.one.size, self.other.size)
        span = self.one.size * self.other.size
        bounds = np.searchsorted(keys // span, np.arange(len(texts) + 1))
        return {
            "n_a": np.diff(first_a),
            "n_b": np.diff(first_b),
            "n_groups": np.bincount(text, minlength=len(texts)),
            "n_links": np.bincount(text, weights=links, minlength=len(texts)).astype(np.int64),
            "groups": group_texts(a, first_a, ends_a, b, first_b, ends_b, self.signs),
            "pairs": (bounds, keys % span),
            "times": (bounds, times),
        }

    @staticmethod
    def ends(tokenizer: Tokenizer, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where each token ends within its text."""
        ends = np.cumsum(tokenizer.first[ids + 1] - tokenizer.first[ids])
        before = np.concatenate(([0], ends))[first[:-1]]
        return ends - np.repeat(before, np.diff(first))


def chosen(ids: np.ndarray, first: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the good texts; the others have none."""
    sizes = np.diff(first)
    return ids[np.repeat(good, sizes)], np.concatenate(([0], np.cumsum(np.where(good, sizes, 0)))).astype(np.int64)


# -- the operator ----------------------------------------------------------------------------------


def content(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


class Aligners:
    """The content of both files; the aligner is made once per Python worker and stays there."""

    def __init__(self, byte_level_path: str, pieces_path: str):
        self.specs = content(byte_level_path), content(pieces_path)
        self.made: Aligner | None = None

    def __getstate__(self) -> dict:
        return {"specs": self.specs, "made": None}

    def get(self) -> Aligner:
        if self.made is None:
            self.made = Aligner(byte_level(self.specs[0]), pieces(self.specs[1]))
        return self.made


def alignments(
    docs: DataFrame, byte_level_path: str, pieces_path: str, doc_id: str = "doc_id", text: str = "text", digest: bool = False
) -> DataFrame:
    """One row per row of ``docs``: ``_id``, counts of tokens, groups and links, ``groups``
    (``a1,a2|b1;a3|b2,b3``, or with ``digest`` its SHA-256), and the distinct linked ``pairs``
    (id of A times the size of B, plus id of B) with their ``times``.

    Null and empty texts, and those that a tokenizer does not give back byte for byte,
    have no tokens: zeros, an empty string, empty arrays. Repeated rows are rows of
    their own; other columns are not read. The vocabularies are read on the driver
    and broadcast; their size is fixed.
    """
    held = docs.sparkSession.sparkContext.broadcast(Aligners(byte_level_path, pieces_path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = held.value.get()
        for batch in slices(batches, "_text", BATCH_BYTES):
            found = aligner.align(texts_of(batch, "_text"))
            groups = found["groups"]
            if digest:
                groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
            lists = [
                pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int64()))
                for bounds, values in (found["pairs"], found["times"])
            ]
            numbers = [pa.array(found[name], pa.int64()) for name in NUMBERS]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), *numbers, pa.array(groups, pa.string()), *lists], ["_id", *NUMBERS, "groups", "pairs", "times"]
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    columns = ", ".join(f"{name} bigint" for name in NUMBERS)
    return in_small_batches(rows).mapInArrow(
        run, f"_id {kind}, {columns}, groups string, pairs array<bigint>, times array<bigint>"
    )


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair`` and ``n``, the number of rows that hold it linked; summed before the shuffle."""
    return aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


def size_of_pieces(pieces_path: str) -> int:
    return pieces(content(pieces_path)).size


def best_partners(counts: DataFrame, size_b: int) -> DataFrame:
    """For every id of A the id of B that it is linked to in most texts, the lower of ties, and that number."""
    most = F.max(F.struct("n", (-F.col("pair") % size_b).alias("_b")))
    return counts.groupBy(F.floor(F.col("pair") / size_b).alias("a")).agg(most.alias("_most")).select(
        "a", (-F.col("_most._b")).alias("b"), F.col("_most.n").alias("n")
    )


def _by_broadcast(aligned: DataFrame, counts: DataFrame, best: DataFrame, size_b: int) -> DataFrame:
    """Look the pairs up in arrays; a pair that is not in them is in one text only."""
    session: SparkSession = aligned.sparkSession
    table = counts.where("n > 1").toArrow()
    keys, n = table["pair"].to_numpy(), table["n"].to_numpy()
    order = np.argsort(keys)
    tops = best.select("a", "n").toArrow()
    top = np.zeros(int(max(tops["a"].to_numpy(), default=0)) + 1, np.int64)
    top[tops["a"].to_numpy()] = tops["n"].to_numpy()
    sent = session.sparkContext.broadcast((keys[order], n[order], top))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, top = sent.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times")
            bounds = np.concatenate(([0], np.cumsum(pairs.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
            pair, often = pairs.flatten().to_numpy(zero_copy_only=False), times.flatten().to_numpy(zero_copy_only=False)
            count = np.ones(len(pair), np.int64)
            if len(keys):
                place = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
                count = np.where(keys[place] == pair, n[place], 1)
            is_best = np.concatenate(([0], np.cumsum(np.where(count == top[pair // size_b], often, 0))))
            total = np.concatenate(([0], np.cumsum(count * often)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("_id", *NUMBERS, "groups")]
                + [pa.array(np.diff(is_best[bounds]), pa.int64()), pa.array(np.diff(total[bounds]), pa.int64())],
                ["_id", *NUMBERS, "groups", "n_best", "count_sum"],
            )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in aligned.schema if f.name not in ("pairs", "times"))
    return in_small_batches(aligned).mapInArrow(run, f"{kinds}, n_best bigint, count_sum bigint")


def _by_join(aligned: DataFrame, counts: DataFrame, best: DataFrame, size_b: int) -> DataFrame:
    """Join the pairs of all texts with their counts; for more pairs than a task can hold."""
    beside = ["_id", *NUMBERS, "groups"]
    # Texts of the same groups are alike in all that follows.
    rows = aligned.withColumn("_row", F.sha2("groups", 256))
    flat = rows.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("_at")).select(
        "_row", F.col("_at.pairs").alias("pair"), "_at.times"
    )
    judged = counts.join(
        best.select("a", F.col("n").alias("_top")), F.floor(F.col("pair") / size_b) == F.col("a")
    ).select("pair", "n", (F.col("n") == F.col("_top")).alias("_best"))
    sums = flat.distinct().join(judged, "pair").groupBy("_row").agg(
        F.sum(F.when(F.col("_best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum")
    )
    return rows.select(*beside, "_row").join(sums, "_row", "left").select(
        *beside, F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum")
    )


def align(
    docs: DataFrame,
    byte_level_path: str,
    pieces_path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    digest: bool = False,
    broadcast_pairs: int = BROADCAST_PAIRS,
) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups``,
    ``n_best`` (links whose pair is in as many texts as any pair of its id of A) and ``count_sum``
    (over the links, the number of texts that hold the pair linked).

    Cases are those of ``alignments``; an empty table gives an empty result. Counts of
    up to ``broadcast_pairs`` pairs that are in several texts are broadcast, more are joined.
    """
    size_b = size_of_pieces(pieces_path)
    aligned = in_stages(docs, [lambda rows: alignments(rows, byte_level_path, pieces_path, doc_id, text, digest)])
    counts = durable(pair_counts(aligned))
    best = best_partners(counts, size_b)
    few = counts.where("n > 1").count() <= broadcast_pairs
    found = (_by_broadcast if few else _by_join)(aligned, counts, best, size_b)
    return found.withColumnRenamed("_id", doc_id)
