"""Words that are spelling variants of one another, found through a reduced alphabet.

Every letter is hashed to one of a few symbols. Two words that differ by one
inserted, deleted or replaced letter give reduced words that are equal or differ
by one symbol. The whole one-edit neighbourhood of every reduced word is joined
with the reduced vocabulary, and what meets is verified on the words as they are.

A pair is generated from one of its sides only: a replaced symbol by the word
whose symbol is the lower one, a deleted one by the longer word (which is an
insertion into the shorter), equal reduced words by the word with the lower
number. So verified pairs are found once, and nothing is emitted that does not
share a reduced word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.storage import durable
from gleaner.llm.texts import BASE, INVERSE, mixed, powers, ragged

# Symbols of the reduced alphabet: few enough for small neighbourhoods, many enough that a
# reduced word stands for few words however large the vocabulary.
SYMBOLS = 8
LEAST_LENGTH = 7
LEAST_COUNT = 2
# A word is a variant of a near word that is so many times as frequent.
FACTOR = 10
# One run in so many loses a letter, chosen by its hash.
DAMAGE = 31
# Fixed value: the runs that words are made of.
RUN = r"[a-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Words whose neighbourhoods are made at once.
WORDS_AT_ONCE = 20_000


def word_counts(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    damage: int | None = DAMAGE,
) -> DataFrame:
    """``word`` and ``n`` of all words of the texts that are long and frequent enough.

    With ``damage`` a run whose CRC-32 with its id (a null id is empty) is divisible by it loses
    the letter at that hash modulo its length. Counts are summed before the shuffle.
    """
    runs = F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(f"({RUN}{{{least_length},}})"), F.lit(1))
    word = F.col("_run")
    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("_id"), F.explode(runs).alias("_run"))
    if damage:
        code = F.crc32(F.concat("_id", F.lit(":"), "_run"))
        place = (F.col("_code") % F.length("_run")).cast("int")
        cut = F.concat(F.substring(word, F.lit(1), place), F.substr(word, place + 2))
        rows = rows.select("_run", code.alias("_code")).select(
            F.when(F.col("_code") % damage == 0, cut).otherwise(word).alias("_run")
        ).where(F.length("_run") >= least_length)
    return rows.groupBy(F.col("_run").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


# -- reduced words ---------------------------------------------------------------------------------


class Reduced:
    """Reduced words as polynomials of their symbols, so that the hash of each neighbour takes constant time."""

    def __init__(self, words: list[str], symbols: int = SYMBOLS):
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        self.symbols = symbols
        self.symbol = (mixed(letters + np.uint64(1)) % np.uint64(symbols)).astype(np.int64)
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self.word = np.repeat(np.arange(len(words)), self.length)
        self.begin = np.cumsum(self.length) - self.length
        place = ragged(np.zeros(len(words), np.int64), self.length)
        self.power = powers(BASE, int(self.length.max(initial=0)) + 1)[place]
        sums = np.zeros(len(letters) + 1, np.uint64)
        np.cumsum((self.symbol + 1).astype(np.uint64) * self.power, out=sums[1:])
        self.before = sums[:-1] - sums[self.begin][self.word]
        self.total = sums[self.begin + self.length] - sums[self.begin]

    @staticmethod
    def _key(total: np.ndarray, length: np.ndarray) -> np.ndarray:
        return mixed(total + mixed(length.astype(np.uint64)))

    def keys(self) -> np.ndarray:
        return self._key(self.total, self.length)

    def neighbours(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions of words and the key of one neighbour each: symbols replaced by higher ones, symbols deleted."""
        for step in range(1, self.symbols):
            at = np.flatnonzero(self.symbol + step < self.symbols)
            word = self.word[at]
            yield word, self._key(self.total[word] + np.uint64(step) * self.power[at], self.length[word])
        # Deleting any symbol of a run of equal ones gives the same word.
        first = np.ones(len(self.symbol), bool)
        first[1:] = (self.symbol[1:] != self.symbol[:-1]) | (self.word[1:] != self.word[:-1])
        at = np.flatnonzero(first)
        word = self.word[at]
        through = self.before[at] + (self.symbol[at] + 1).astype(np.uint64) * self.power[at]
        yield word, self._key(self.before[at] + (self.total[word] - through) * np.uint64(INVERSE), self.length[word] - 1)


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Reduced]]:
    for batch in batches:
        for at in range(0, batch.num_rows, WORDS_AT_ONCE):
            some = batch.slice(at, WORDS_AT_ONCE)
            yield some, Reduced(some.column("word").to_pylist())


def _own(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, reduced in _slices(batches):
        keys = pa.array(reduced.keys().view(np.int64))
        yield pa.RecordBatch.from_arrays([*batch.columns, keys], [*batch.schema.names, "key"])


def _neighbours(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, reduced in _slices(batches):
        ids = batch.column("id").to_numpy()
        for word, keys in reduced.neighbours():
            yield pa.RecordBatch.from_arrays([pa.array(ids[word]), pa.array(keys.view(np.int64))], ["id", "key"])


def near_pairs(words: DataFrame) -> DataFrame:
    """Every pair of words that differ by exactly one letter, once: ``id``, ``word``, ``n`` of the one
    and ``other_id``, ``other``, ``other_n``.

    ``words`` has a unique ``id``, distinct words and ``n``, and must not change between reads.
    """
    kind = "id bigint, word string, n bigint"
    rows = words.select("id", "word", "n")
    keyed = rows.mapInArrow(_own, f"{kind}, key bigint")
    other = keyed.select("key", F.col("id").alias("other_id"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    equal = keyed.select("id", "key").join(other, "key").where("id < other_id").drop("key")
    apart = rows.select("id", "word").mapInArrow(_neighbours, "id bigint, key bigint").join(other, "key").drop("key")
    met = equal.unionByName(apart).join(rows, "id")
    return met.where(F.levenshtein("word", "other", 1) == 1).select("id", "word", "n", "other_id", "other", "other_n").distinct()


# -- forms -----------------------------------------------------------------------------------------


def last_forms(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` for every row of ``forms`` (``word``, ``form``), which has no circles.

    Paths are doubled every round, so the rounds are the logarithm of the longest one.
    """
    state = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        above = state.select(F.col("word").alias("root"), F.col("root").alias("higher"))
        moved = durable(state.join(above, "root", "left").select("word", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")))
        if moved.where("moved").isEmpty():
            return state
        state = moved.drop("moved")


def variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """One row per row of ``words`` (distinct ``word``, ``n``): ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    ``form`` is the near word with the largest ``n``, the first in the order of code points
    among ties, if that is at least ``factor`` times the word's; else null. ``root`` is where
    forms end, the word itself if it has none. An empty vocabulary gives an empty result.
    """
    words = durable(words.select(F.monotonically_increasing_id().alias("id"), "word", "n"))
    pairs = durable(near_pairs(words))
    sides = pairs.select("id", "other", "other_n").unionByName(
        pairs.select(F.col("other_id").alias("id"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    )
    top = F.min(F.struct((-F.col("other_n")).alias("low"), F.col("other").alias("form"))).alias("_top")
    near = sides.groupBy("id").agg(F.count("*").alias("n_near"), top)
    much = -F.col("_top.low") >= factor * F.col("n")
    judged = durable(
        words.join(near, "id", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(much, F.col("_top.form")).alias("form"), F.when(much, -F.col("_top.low")).alias("form_n"),
        )
    )
    roots = last_forms(judged.where("form is not null"))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    factor: int = FACTOR,
    damage: int | None = DAMAGE,
) -> DataFrame:
    """The words of ``docs`` (``word_counts``) with their forms (``variants``).

    Null and empty texts have no words; repeated rows count again; other columns
    are not read. An empty table gives an empty result.
    """
    return variants(word_counts(docs, doc_id, text, least_length, least_count, damage), factor)
