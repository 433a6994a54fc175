"""Looking passages up in a text by an index of its word windows.

A passage is anchored if a run of ``size`` of its words occurs in the text, or
all of it if it is shorter. It occurs where the text has it as a string, so its
first word may be the end of a word of the text and its last one the beginning
of one. The words between are whole words: hashes of all runs of that many words
of the text are sorted once, a window of a passage is looked up among them, and
what is found is compared by its words. Time grows with the words of the text and
of the passages; passages of one or two words are searched for as strings.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.basic import held
from ..functions.plain import normalise, visible_text

# The index travels with the job, so executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__.partition(".")[0]])


# Odd, so that no word is lost from a product modulo 2**64.
FACTOR = np.uint64(0x9E3779B97F4A7C15)

# Passages that are searched for as a whole, until so many were not found; the index is built by then.
SCANS = 32


def run_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` numbers."""
    count = len(ids) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for place in range(size):
        total = total * FACTOR + ids[place : place + count]
    return total


class WindowIndex:
    """The runs of words of a normalised text: words parted by single spaces."""

    def __init__(self, text: str):
        self.text = text
        self.words: list[str] | None = None
        self.runs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.short: dict[str, bool] = {}
        self.scans = SCANS

    def _read(self) -> None:
        self.words = self.text.split(" ") if self.text else []
        self.number: dict[str, int] = {}
        self.ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in self.words], np.uint64)

    def _inner(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of ``size`` words that have a word on both sides, ascending, and where they
        begin. Runs that repeat with the same words around them are held once."""
        if size not in self.runs:
            whole = run_hashes(self.ids, size + 2)
            places = np.argsort(whole, kind="stable")
            again = whole[places[1:]] == whole[places[:-1]]
            for step in range(size + 2):
                again &= self.ids[places[1:] + step] == self.ids[places[:-1] + step]
            places = places[np.concatenate(([True], ~again))] if len(places) else places
            hashes = run_hashes(self.ids[1:-1], size)[places]
            order = np.argsort(hashes, kind="stable")
            self.runs[size] = hashes[order], places[order] + 1
        return self.runs[size]

    def has_any(self, words: list[str], size: int) -> bool:
        """Whether the text has ``size`` of these words in a row, the outer two cut or not."""
        if self.words is None:
            self._read()
        if size < 3:
            return any(self._has_string(" ".join(words[at : at + size])) for at in range(len(words) - size + 1))
        asked = np.array([self.number.get(w, 0) for w in words], np.uint64)
        hashes, places = self._inner(size - 2)
        wanted = run_hashes(asked[1:-1], size - 2)
        low, high = np.searchsorted(hashes, wanted), np.searchsorted(hashes, wanted, "right")
        return any(
            self._fits(places[low[at] : high[at]], asked[at + 1 : at + size - 1], words[at], words[at + size - 1])
            for at in np.flatnonzero(low < high)
        )

    def _fits(self, places: np.ndarray, inner: np.ndarray, first: str, last: str) -> bool:
        """Whether at one of the places these inner words stand between such outer ones."""
        # Equal hashes of other words are told apart here.
        equal = np.ones(len(places), bool)
        for step, word in enumerate(inner):
            equal &= self.ids[places + step] == word
        return any(
            self.words[p - 1].endswith(first) and self.words[p + len(inner)].startswith(last) for p in places[equal].tolist()
        )

    def _has_string(self, passage: str) -> bool:
        if passage not in self.short:
            self.short[passage] = passage in self.text
        return self.short[passage]

    def anchors(self, passage: str, size: int) -> bool:
        """Whether a run of ``size`` words of the passage occurs; a passage without words does."""
        if self.scans and passage not in self.short:
            if passage in self.text:
                return True
            self.scans -= 1
        words = passage.split(" ") if passage else []
        return not words or self.has_any(words, min(size, len(words)))


def anchored_in(passages: Sequence[str], text: str | None, size: int) -> list[bool | None]:
    """For every normalised passage whether it is anchored; unknown without a text."""
    if text is None or not len(passages):
        return [None] * len(passages)
    index = WindowIndex(text)
    return [index.anchors(p, size) for p in passages]


def grounded_share(markdown: str | None, source: str | None, line_chars: int, size: int) -> float | None:
    """Share of the long lines of a markdown that are anchored on the page; None without long lines."""
    long = [line for line in (markdown or "").split("\n") if len(line.strip()) >= line_chars]
    if not long:
        return None
    found = anchored_in([normalise(line) for line in long], None if source is None else visible_text(source), size)
    return sum(map(bool, found)) / len(found)


def grounded(markdown: Column, source: Column, line_chars: int, size: int) -> Column:
    """``grounded_share`` of every row."""
    @pandas_udf(T.DoubleType())
    def share(texts: pd.Series, pages: pd.Series) -> pd.Series:
        return pd.Series([grounded_share(t, p, line_chars, size) for t, p in zip(texts, pages)], dtype=float)

    return share(held(markdown), held(source))


LOOKUPS = T.ArrayType(T.StructType([T.StructField("in_page", T.BooleanType()), T.StructField("in_extraction", T.BooleanType())]))


def look_up(passages: Column, markdown: Column, source: Column, size: int) -> Column:
    """For an array of passages whether each is anchored on the page, and in the extraction."""
    @pandas_udf(LOOKUPS)
    def both(lists: pd.Series, texts: pd.Series, pages: pd.Series) -> pd.Series:
        out = []
        for some, text, page in zip(lists, texts, pages):
            wanted = [] if some is None else [normalise(p) for p in some]
            shown = visible_text(page) if wanted and page is not None else None
            said = normalise(text) if wanted and text is not None else None
            sides = zip(anchored_in(wanted, shown, size), anchored_in(wanted, said, size))
            out.append([{"in_page": a, "in_extraction": b} for a, b in sides])
        return pd.Series(out, dtype=object)

    return both(held(passages), held(markdown), held(source))
