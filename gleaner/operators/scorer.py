"""Counts of the words two texts share, for both families of metrics, in one reading of each text.

Pairs come a batch at a time. Each text is made plain and split once; its words
are counted once, and both the sets and the bags are compared by looking words
up, so time grows with the words of a pair and equal words are compared as words.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from math import sqrt

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.basic import held
from ..functions.plain import normalise_for_compare, strip_markdown
from ..functions.tokens import NUMBER_WRAPPERS

# The scorer travels with the job, so executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__.partition(".")[0]])

TOKEN_FIELDS = ("precision", "recall", "f1", "extracted_count", "sample_count", "intersection_count")
BAG_FIELDS = ("cosine", "jaccard", "excess_ratio")
SCORES = T.StructType(
    [T.StructField(n, T.IntegerType() if n.endswith("_count") else T.DoubleType()) for n in (*TOKEN_FIELDS, *BAG_FIELDS)]
)
# Fixed value: what counts as a number once its wrappers are off.
NUMBER = re.compile(r"[+\-]?\d[\d.,]*\d%?|[+\-]?\d%?")
WITHOUT_POINTS = str.maketrans("", "", ".,")


def canonical(token: str) -> str:
    """1,400, 1.400 and (1400%) are one token; anything else stays as it is."""
    core = token.strip(NUMBER_WRAPPERS)
    return core.rstrip("%").translate(WITHOUT_POINTS) if NUMBER.fullmatch(core) else token


def token_set(text: str) -> set[str]:
    """Distinct canonical tokens. Only newline and space separate tokens here."""
    raw = set(text.replace("\n", " ").split(" "))
    raw.discard("")
    # No number begins with a Latin letter.
    return {t if "a" <= t[0] <= "z" else canonical(t) for t in raw}


def token_level(parsed: str, gold: str) -> tuple[float, float, float, int, int, int]:
    one, other = token_set(parsed), token_set(gold)
    shared = len(one & other)
    precision = shared / len(one) if one else 0.0
    recall = shared / len(other) if other else 0.0
    f1 = 2 * precision * recall / (precision + recall) if shared else 0.0
    return precision, recall, f1, len(one), len(other), shared


def bag_similarity(parsed: str, gold: str) -> tuple[float, float, float]:
    one, other = Counter(parsed.split()), Counter(gold.split())
    if not one or not other:
        return 0.0, 0.0, 0.0
    dot = overlap = shared = 0
    for word in one.keys() & other.keys():
        n, m = one[word], other[word]
        dot += n * m
        overlap += min(n, m)
        shared += 1
    squares = sqrt(sum(n * n for n in one.values())) * sqrt(sum(n * n for n in other.values()))
    return dot / squares, shared / (len(one) + len(other) - shared), 1.0 - overlap / one.total()


def score_pair(parsed: str | None, gold: str | None) -> tuple:
    """All scores of two texts with their markdown; a missing text is an empty one."""
    pair = [normalise_for_compare(strip_markdown(t or "")) for t in (parsed, gold)]
    return *token_level(*pair), *bag_similarity(*pair)


def scores(parsed: Column, gold: Column) -> Column:
    """The struct ``SCORES`` of the parsed and the gold text of every row."""
    @pandas_udf(SCORES)
    def score(ones: pd.Series, others: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(list(map(score_pair, ones, others)), columns=SCORES.names)

    return score(held(parsed), held(gold))
