"""Counting the tokens of a byte-level BPE vocabulary by merging ragged arrays in step of rank.

A text is split into pre-tokens by the vocabulary's pattern. All pre-tokens not
seen before are laid end to end as one array of symbols. Each step looks up the
rank of every adjacent pair, takes the lowest rank of each pre-token and applies
that merge wherever it occurs in it, in all pre-tokens at once; what is left when
no pair has a rank are its tokens. A pre-token that no longer merges leaves the
array. Counts are remembered by pre-token, so a frequent word is merged once per
task; only the memory of counts is bounded, by number and length, never the work.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.storage import in_small_batches
from gleaner.llm.texts import slices, texts_of

# Fixed value: the pre-token pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
REMEMBERED = 300_000
# Longer pre-tokens are merged whenever they come up.
LONGEST = 64
# Bytes of pre-tokens merged together; a longer pre-token is merged on its own.
MERGED_BYTES = 4 << 20
NO_RANK = np.iinfo(np.int64).max


@dataclass
class Vocabulary:
    """``symbol[byte]`` is a byte's symbol; ``pairs`` (left * size + right) is sorted, with rank and result."""

    symbol: np.ndarray
    pairs: np.ndarray
    rank: np.ndarray
    result: np.ndarray
    size: int
    specials: tuple[str, ...]


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: its own if it is
    printable and no space in Latin-1, else the next one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, following = [], 0x100
    for byte in range(256):
        letters.append(chr(byte if byte in shown else following))
        following += byte not in shown
    return letters


def plain_byte_level(spec: dict) -> bool:
    """Whether a ``tokenizers`` file is a byte-level BPE and nothing else."""
    model, split = spec["model"], spec["pre_tokenizer"]
    return (
        model["type"] == "BPE" and split["type"] == "ByteLevel" and split.get("use_regex", True)
        and not split["add_prefix_space"] and spec["normalizer"] is None and spec["post_processor"] is None
        and not model.get("ignore_merges") and not model.get("dropout")
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
    )


def load_vocabulary(path: str) -> Vocabulary:
    """Read a ``tokenizers`` file with a byte-level BPE; a file that asks for more is refused."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    if not plain_byte_level(spec):
        raise ValueError(f"not a plain byte-level BPE: {path}")
    model = spec["model"]
    ids = model["vocab"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    size = max(ids.values()) + 1
    left = np.array([ids[a] for a, _ in merges], np.int64)
    right = np.array([ids[b] for _, b in merges], np.int64)
    pairs = left * size + right
    order = np.argsort(pairs)
    result = np.array([ids[a + b] for a, b in merges], np.int64)
    return Vocabulary(
        np.array([ids[c] for c in byte_letters()], np.int64),
        pairs[order],
        order.astype(np.int64),
        result[order],
        size,
        tuple(t["content"] for t in spec["added_tokens"]),
    )


def merge_ragged(words: list[bytes], vocabulary: Vocabulary) -> np.ndarray:
    """How many symbols are left of each word once no pair of it has a rank."""
    lengths = np.array([len(w) for w in words], np.int64)
    left = lengths.copy()
    symbols = vocabulary.symbol[np.frombuffer(b"".join(words), np.uint8)]
    owner = np.repeat(np.arange(len(words)), lengths)
    while len(symbols) > 1:
        inside = owner[:-1] == owner[1:]
        pair = symbols[:-1] * vocabulary.size + symbols[1:]
        at = np.minimum(np.searchsorted(vocabulary.pairs, pair), len(vocabulary.pairs) - 1)
        known = inside & (vocabulary.pairs[at] == pair)
        rank = np.append(np.where(known, vocabulary.rank[at], NO_RANK), NO_RANK)
        begins = np.flatnonzero(np.concatenate(([True], ~inside)))
        lowest = np.minimum.reduceat(rank, begins)
        counts = np.diff(np.append(begins, len(symbols)))
        chosen = (rank == np.repeat(lowest, counts)) & (rank != NO_RANK)
        # Of pairs that overlap, as in a run of one symbol, every second one merges.
        place = np.flatnonzero(chosen)
        if not len(place):
            left[owner[begins]] = counts
            return left
        fresh = np.concatenate(([True], place[1:] != place[:-1] + 1))
        run = np.maximum.accumulate(np.where(fresh, place, 0))
        place = place[(place - run) % 2 == 0]
        symbols[place] = vocabulary.result[at[place]]
        stays = np.ones(len(symbols), bool)
        stays[place + 1] = False
        # Words without a ranked pair are done.
        done = lowest == NO_RANK
        left[owner[begins[done]]] = counts[done]
        stays &= ~np.repeat(done, counts)
        symbols, owner = symbols[stays], owner[stays]
    if len(symbols):
        left[owner] = 1
    return left


class Counter:
    """Counts the tokens of texts, remembering the pre-tokens it has merged."""

    def __init__(self, vocabulary: Vocabulary, remembered: int = REMEMBERED):
        self.vocabulary = vocabulary
        self.remembered = remembered
        self.known: dict[str, int] = {}
        self.split = regex.compile(PATTERN).findall
        specials = sorted(vocabulary.specials, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None

    def learn(self, pretokens: set[str]) -> None:
        self.long = [t for t in pretokens if len(t) > LONGEST]
        unknown = [t for t in pretokens if t not in self.known]
        if len(self.known) + len(unknown) > self.remembered:
            self.known.clear()
            unknown = list(pretokens)
        words = [t.encode() for t in unknown]
        at = 0
        while at < len(words):
            end, size = at, 0
            while end < len(words) and (end == at or size + len(words[end]) <= MERGED_BYTES):
                size += len(words[end])
                end += 1
            self.known.update(zip(unknown[at:end], merge_ragged(words[at:end], self.vocabulary).tolist()))
            at = end

    def count(self, texts: list[str]) -> list[int]:
        """Tokens per text; the vocabulary's special strings are one token each."""
        pieces, specials = [], []
        for text in texts:
            parts = [text]
            if self.special is not None and any(s in text for s in self.vocabulary.specials):
                parts = self.special.split(text)
            specials.append(len(parts) - 1)
            pieces.append([t for part in parts for t in self.split(part)] if len(parts) > 1 else self.split(text))
        self.learn(set().union(*pieces))
        of = self.known.__getitem__
        counts = [sum(map(of, p)) + s for p, s in zip(pieces, specials)]
        for pretoken in self.long:
            del self.known[pretoken]
        return counts


def count_tokens(
    docs: DataFrame, tokenizer_path: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes`` (UTF-8), ``n_tokens`` and whether they exceed ``limit``.

    A null text is empty and has no tokens. Repeated ids are rows of their own,
    other columns are not read. The vocabulary is read on the driver and
    broadcast; its size is fixed.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(load_vocabulary(tokenizer_path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary.value)
        for batch in slices(batches, "_text"):
            counts = counter.count(texts_of(batch, "_text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_bytes"), pa.array(counts, pa.int64())],
                ["_id", "n_bytes", "n_tokens"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("_id"), F.octet_length(body).cast("bigint").alias("_bytes"), body.alias("_text"))
    counted = in_small_batches(rows).mapInArrow(run, f"_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.select(
        F.col("_id").alias(doc_id), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
