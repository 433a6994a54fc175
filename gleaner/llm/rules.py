"""Quality rules, judged by document and by host.

Every text is measured and held against rules. A host's share of failing
documents says something about its other documents as well, but a host with two
documents knows little, so its share is shrunk towards that of all hosts by a
beta prior fitted to the hosts' shares. The verdict on a host is joined back to
its documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.storage import durable, free_prefix, in_small_batches
from gleaner.llm.texts import BLANK_PLAIN, buffer_of, slices, span_hashes, split_words, window_hashes

SYMBOLS = b"#*$%&|<>"
RUN = 3
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


@dataclass(frozen=True)
class Limits:
    """The rules. The first two are the base; ``host_rate`` is the failing share at which a host is refused."""

    least_words: int = 50
    repeat_percent: int = 50
    symbol_percent: int = 10
    dup_line_percent: int = 30
    least_dup_lines: int = 3
    host_rate: float = 0.5


def measures(column: pa.Array) -> dict[str, np.ndarray]:
    """``MEASURES`` of every text. Words, lines and runs of words are compared by 64-bit hashes."""
    raw, offsets = buffer_of(column)
    texts = len(offsets) - 1
    words = split_words(column, BLANK_PLAIN)
    inside = BLANK_PLAIN[raw] != 0x20

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])

    # Lines: from a text's start or behind a line feed, up to the next.
    feeds = np.flatnonzero(raw == 0x0A)
    begin = np.sort(np.concatenate((offsets[:-1], feeds + 1)))
    owner = np.concatenate((np.arange(texts), np.searchsorted(offsets, feeds, "right") - 1))
    order = np.lexsort((np.concatenate((np.zeros(texts, int), np.ones(len(feeds), int))), np.concatenate((offsets[:-1], feeds + 1)), owner))
    begin, owner = np.concatenate((offsets[:-1], feeds + 1))[order], owner[order]
    end = np.append(begin[1:] - 1, len(raw))
    last = np.append(owner[1:] != owner[:-1], True)
    end[last] = offsets[1:][owner[last]]
    filled = np.concatenate(([0], np.cumsum(inside)))
    worded = filled[end] > filled[begin]
    hashes = span_hashes(raw, begin[worded], end[worded])
    kinds = np.unique(np.stack((owner[worded].astype(np.uint64), hashes)), axis=1)[0].astype(int) if len(hashes) else np.empty(0, int)

    # Runs of words found twice or more; a word counts once however many such runs it lies in.
    word = words.hashes()
    runs = window_hashes(word, RUN)
    whose = words.text
    repeated = np.zeros(len(word) + 1, np.int64)
    if len(runs):
        at = np.flatnonzero(whose[: len(runs)] == whose[RUN - 1 :])
        order = np.lexsort((runs[at], whose[at]))
        at = at[order]
        same = (runs[at][1:] == runs[at][:-1]) & (whose[at][1:] == whose[at][:-1])
        twice = at[np.concatenate((same, [False])) | np.concatenate(([False], same))] if len(at) else at
        np.add.at(repeated, twice, 1)
        np.add.at(repeated, twice + RUN, -1)
    covered = np.cumsum(repeated[:-1]) > 0
    return {
        "n_words": words.per_text,
        "word_chars": per_text(inside & ((raw & 0xC0) != 0x80)),
        "n_symbols": per_text(_SYMBOL[raw]),
        "n_lines": np.bincount(owner[worded], minlength=texts),
        "n_dup_lines": np.bincount(owner[worded], minlength=texts) - np.bincount(kinds, minlength=texts),
        "n_repeat_words": np.bincount(whose[covered], minlength=texts),
    }


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text and with ``MEASURES``, which replace columns of these names.

    A null text has no words; empty texts have zeros throughout.
    """
    rest = [f for f in docs.schema.fields if f.name != text and f.name not in MEASURES]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = measures(batch.column(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in rest] + [pa.array(found[m].astype(np.int64)) for m in MEASURES],
                [f.name for f in rest] + list(MEASURES),
            )

    schema = type(docs.schema)([*rest])
    for name in MEASURES:
        schema = schema.add(name, "long")
    return in_small_batches(docs).mapInArrow(run, schema)


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """The two parameters of the beta distribution of the hosts' failing shares, by their moments.

    One row comes to the driver. Where hosts differ no more than chance makes
    them, the prior is as strong as all documents together.
    """
    share = F.col("failed") / F.col("docs")
    one = hosts.agg(
        F.count("*").alias("hosts"), F.sum("docs").alias("n"), F.sum("failed").alias("f"),
        F.sum(F.col("docs").cast("double") * F.col("docs")).alias("squares"),
        F.sum(F.col("docs") * share * share).alias("spread"),
    ).first()
    n = float(one["n"] or 0)
    if not n:
        return 1.0, 1.0
    mean = one["f"] / n
    chance = mean * (1 - mean)
    between = one["spread"] / n - mean * mean - chance * (one["hosts"] - 1) / n
    room = chance * (1 - one["squares"] / n**2 - (one["hosts"] - 1) / n)
    alike = min(1.0, max(between / room if room > 0 else 0.0, 1.0 / (n + 1)))
    strength = max(1.0, 1.0 / alike - 1)
    return max(mean * strength, 1e-9), max((1 - mean) * strength, 1e-9)


def judge(docs: DataFrame, host: str = "source", text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """``docs`` without the text, with ``MEASURES``, the rules they fail, their host's rate and ``kept``.

    ``base_failed``: fewer words than ``least_words``, or more than
    ``repeat_percent`` of the words lie in repeated runs of three. ``failed``:
    that, or too many symbols per word, or ``least_dup_lines`` and more than
    ``dup_line_percent`` of the lines repeat an earlier one. ``host_rate`` is the host's share of failed documents after shrinking.
    ``kept``: not failed, and the host is not refused. Documents without a host
    are a host of their own; an empty table gives an empty result. Columns named
    like the results are replaced, unless it is the host or the text.
    """
    docs = docs.drop(*({"base_failed", "failed", "host_rate", "kept"} - {host, text}))
    own = free_prefix(docs.columns) + "host"
    n = F.col("n_words")
    base = (n < limits.least_words) | (100 * F.col("n_repeat_words") > limits.repeat_percent * n)
    failed = (
        base | (100 * F.col("n_symbols") > limits.symbol_percent * n)
        | (
            (F.col("n_dup_lines") >= limits.least_dup_lines)
            & (100 * F.col("n_dup_lines") > limits.dup_line_percent * F.col("n_lines"))
        )
    )
    rows = durable(measured(docs, text).withColumn("base_failed", base).withColumn("failed", failed))
    hosts = durable(
        rows.groupBy(F.col(host).alias(own)).agg(
            F.count("*").alias("docs"), F.sum(F.col("failed").cast("bigint")).alias("failed")
        )
    )
    alpha, beta = beta_prior(hosts)
    rates = hosts.select(own, ((F.col("failed") + alpha) / (F.col("docs") + alpha + beta)).alias("host_rate"))
    joined = rows.join(rates, F.col(host).eqNullSafe(F.col(own))).drop(own)
    return joined.withColumn("kept", ~F.col("failed") & (F.col("host_rate") <= limits.host_rate))
