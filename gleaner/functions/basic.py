"""Small building blocks the other column functions share."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python and Unicode count as white space: once as a string for
# native trimming, once as the inside of a Java regex class.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Ranges that hold every white space but line feed and space. One quick test
# tells the texts that need no regex to be split.
UNUSUAL = r"[\x00-\x09\x0b-\x1f\x7f-\xa0\u1680-\u3000]"

Columnish = Column | str


def as_column(value: Columnish) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    A column used inside a lambda is evaluated per element unless it is bound
    by an enclosing lambda first; the optimizer is free to inline projections,
    so a named intermediate column does not guarantee it.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def held(value: Columnish) -> Column:
    """``value`` as the argument of a Python function.

    Spark cannot hand nested lambdas to Python. A column that is named twice is
    computed by the projection below, however it is made, and handed over as it is.
    """
    column = as_column(value)
    return F.when(column.isNotNull(), column)


def strip(text: Columnish) -> Column:
    """Trim Unicode white space at both ends."""
    return F.btrim(as_column(text), F.lit(SPACE_CHARS))


def collapse(text: Columnish) -> Column:
    """Every run of white space becomes one space, none at the ends."""
    return F.trim(F.regexp_replace(as_column(text), f"[{SPACE_CLASS}]+", " "))


def swap(text: Columnish, pairs: Iterable[tuple[str, str]]) -> Column:
    """Replace fixed strings. A byte search each, far cheaper than one regex or ``translate``."""
    column = as_column(text)
    for old, new in pairs:
        column = F.replace(column, F.lit(old), F.lit(new))
    return column


def split_on_blanks(text: Column) -> Column:
    """Split on single spaces, no empty words; one plain character needs no regex."""
    return F.array_remove(F.split(text, " "), "")


def words(text: Columnish) -> Column:
    """Split on runs of Unicode white space, no empty words."""
    def split(t: Column) -> Column:
        by_class = F.array_remove(F.split(t, f"[{SPACE_CLASS}]+"), "")
        return F.when(F.rlike(t, F.lit(UNUSUAL)), by_class).otherwise(
            split_on_blanks(swap(t, [("\n", " ")]))
        )

    return let(as_column(text), split)


def lines(text: Columnish) -> Column:
    return F.split(as_column(text), "\n")


def is_blank(text: Columnish) -> Column:
    return strip(text) == ""


def replace_all(text: Columnish, rules: Iterable[tuple[str, str]]) -> Column:
    """Apply regex replacements one after the other."""
    column = as_column(text)
    for pattern, replacement in rules:
        column = F.regexp_replace(column, pattern, replacement)
    return column


def when_present(
    text: Column, triggers: str | tuple[str, ...], change: Callable[[Column], Column]
) -> Column:
    """``change`` the texts that hold one of the triggers and leave the others untouched.

    No trigger at all means always.
    """
    if not triggers:
        return change(text)
    wanted = (triggers,) if isinstance(triggers, str) else triggers

    def guarded(t: Column) -> Column:
        found = F.contains(t, F.lit(wanted[0]))
        for trigger in wanted[1:]:
            found = found | F.contains(t, F.lit(trigger))
        return F.when(found, change(t)).otherwise(t)

    return let(text, guarded)


def any_of(patterns: Iterable[str]) -> str:
    """One alternation of several patterns."""
    return "|".join(f"(?:{p})" for p in patterns)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, 0.0 on a zero denominator."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator), F.lit(0.0))


def pearson(x: Columnish, y: Columnish) -> Column:
    """Pearson's r over the rows where both sides are known.

    NULL with fewer than two rows or when a side does not vary; the built-in
    ``corr`` raises on a constant side under ANSI.
    """
    xs, ys = as_column(x).cast("double"), as_column(y).cast("double")
    both = xs.isNotNull() & ys.isNotNull()
    xs, ys = F.when(both, xs), F.when(both, ys)
    return F.try_divide(F.covar_pop(xs, ys), F.stddev_pop(xs) * F.stddev_pop(ys))


def signed_difference(before: Columnish, after: Columnish, tolerance: float = 0.001) -> Column:
    """after - before; 0 below the tolerance, NULL when a side is missing."""
    gap = as_column(after) - as_column(before)
    return F.when(F.abs(gap) < tolerance, F.lit(0.0)).otherwise(gap)
