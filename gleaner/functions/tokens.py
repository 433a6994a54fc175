"""The two tokenizers. They differ on purpose and never share a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .basic import Columnish, as_column, let, split_on_blanks, swap, words

# Typographic marks and their plain forms, compared as equal.
TYPOGRAPHIC = (("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "-"))
TYPOGRAPHIC_RANGE = "[\u2013-\u201d]"
# What may wrap a number, and what counts as one.
NUMBER_WRAPPERS = "()€£"
NUMBER = r"^(?:[+\-]?\p{Nd}[\p{Nd}.,]*\p{Nd}%?|[+\-]?\p{Nd}%?)$"


def normalise_for_compare(text: Columnish) -> Column:
    """Typographic marks made plain, then lower case."""
    def plain(t: Column) -> Column:
        return F.when(F.rlike(t, F.lit(TYPOGRAPHIC_RANGE)), swap(t, TYPOGRAPHIC)).otherwise(t)

    return F.lower(let(as_column(text), plain))


def canonical_number(token: Column) -> Column:
    """1,400, 1.400 and (1400%) are one token; anything else stays as it is."""
    core = F.btrim(token, F.lit(NUMBER_WRAPPERS))
    number = F.translate(F.rtrim(core, F.lit("%")), ".,", "")
    # No number begins with a Latin letter, which two comparisons tell without a regex.
    return (
        F.when((token >= "a") & (token < "{"), token)
        .when(F.rlike(core, F.lit(NUMBER)), number)
        .otherwise(token)
    )


def token_set(text: Columnish) -> Column:
    """Distinct canonical tokens. Only newline and space separate tokens here."""
    raw = split_on_blanks(swap(normalise_for_compare(text), [("\n", " ")]))
    return F.array_distinct(F.transform(F.array_distinct(raw), canonical_number))


def token_bag(text: Columnish) -> Column:
    """All words with their repetitions, split on any white space."""
    return words(normalise_for_compare(text))


def estimate_tokens(text: Columnish, chars_per_token: float = 3.0) -> Column:
    return F.floor(F.length(as_column(text)) / F.lit(float(chars_per_token))).cast("long")
