"""Rule packs applied to markdown lines: one pack as a column expression, all packs by host."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basic import (
    SPACE_CHARS,
    SPACE_CLASS,
    Columnish,
    any_of,
    as_column,
    is_blank,
    let,
    lines,
    replace_all,
    strip,
)
from ..functions.urls import host_of
from .packs import cleaned
from .rules import RULE_PACKS, RulePack

Cleaner = Callable[[Column, Column], Column]
NO_LINES = "array<string>"


def _spaced(pattern: str) -> str:
    """White space in a rule means Unicode white space."""
    return pattern.replace(r"[\s*]", f"[{SPACE_CLASS}*]").replace(r"\s", f"[{SPACE_CLASS}]")


def _matches(line: Column, patterns: Iterable[str]) -> Column:
    return F.rlike(line, F.lit(_spaced(any_of(patterns))))


def heading_text(line: Column) -> Column:
    """The lower-cased text of a heading, NULL for any other line."""
    text = F.lower(strip(F.ltrim(line, F.lit("#"))))
    return F.when(F.startswith(line, F.lit("#")), text)


def without_trailing_blanks(page_lines: Column) -> Column:
    last = F.array_max(F.transform(page_lines, lambda line, i: F.when(~is_blank(line), i + 1)))
    return F.slice(page_lines, F.lit(1), F.coalesce(last, F.lit(0)))


def _any(conditions: list[Column]) -> Column:
    result = F.lit(False)
    for condition in conditions:
        result = result | F.coalesce(condition, F.lit(False))
    return result


def _before_first(page_lines: Column, is_stop: Callable[[Column], Column]) -> Column:
    stop = F.array_position(F.transform(page_lines, is_stop), True)
    return F.when(stop > 0, F.slice(page_lines, F.lit(1), stop.cast("int") - 1)).otherwise(page_lines)


def _is_stop(pack: RulePack) -> Callable[[Column], Column]:
    def test(line: Column) -> Column:
        conditions = []
        if pack.stop_patterns:
            conditions.append(_matches(line, pack.stop_patterns))
        if pack.stop_headings and pack.stop_headings_by_prefix:
            heading = heading_text(line)
            conditions += [F.startswith(heading, F.lit(h)) for h in pack.stop_headings]
        elif pack.stop_headings:
            conditions.append(heading_text(line).isin(*pack.stop_headings))
        if pack.stop_lines:
            conditions.append(F.lower(strip(line)).isin(*pack.stop_lines))
        return _any(conditions)

    return test


def _is_dropped(pack: RulePack) -> Callable[[Column], Column] | None:
    def test(line: Column) -> Column:
        conditions = []
        if pack.drop_headings:
            conditions.append(heading_text(line).isin(*pack.drop_headings))
        lowered = F.lower(strip(line))
        if pack.drop_lines:
            conditions.append(lowered.isin(*pack.drop_lines))
        conditions += [F.startswith(lowered, F.lit(p)) for p in pack.drop_prefixes]
        if pack.drop_stripped:
            conditions.append(_matches(strip(line), pack.drop_stripped))
        return _any(conditions)

    has_rules = pack.drop_headings or pack.drop_lines or pack.drop_prefixes or pack.drop_stripped
    return test if has_rules else None


def _cells(line: Column) -> Column:
    """The line itself, or the filled cells of a piped row."""
    def of_row(text: Column) -> Column:
        cells = F.transform(F.split(F.btrim(text, F.lit("|")), r"\|"), strip)
        is_row = F.startswith(text, F.lit("|")) & F.contains(F.substring(text, F.lit(2), F.length(text)), F.lit("|"))
        return F.when(is_row, F.filter(cells, lambda c: c != "")).otherwise(F.array(line))

    return let(strip(line), of_row)


def apply_pack(markdown: Columnish, url: Columnish, pack: RulePack) -> Column:
    """The markdown of one page cleaned by one pack."""
    steps: list[Callable[[Column], Column]] = []

    if pack.trim_line_ends:
        steps.append(lambda ls: F.transform(ls, lambda x: F.rtrim(x, F.lit(SPACE_CHARS))))
    if pack.start_in_url:
        def after_start(ls: Column) -> Column:
            at = F.array_position(F.transform(ls, lambda x: _matches(x, [pack.start_pattern])), True).cast("int")
            return let(
                at,
                lambda p: F.when(~F.contains(as_column(url), F.lit(pack.start_in_url)), ls)
                .when(p > 0, F.slice(ls, p + 1, F.size(ls)))
                .otherwise(F.array().cast(NO_LINES)),
            )

        steps.append(after_start)
    steps.append(lambda ls: _before_first(ls, _is_stop(pack)))
    if pack.drop_first:
        steps.append(lambda ls: F.filter(ls, lambda x: ~_matches(x, pack.drop_first)))
    dropped = _is_dropped(pack)
    if dropped is not None:
        steps.append(lambda ls: F.filter(ls, lambda x: ~dropped(x)))
    if pack.line_rewrites:
        rewrites = [(_spaced(p), r) for p, r in pack.line_rewrites]
        steps.append(lambda ls: F.transform(ls, lambda x: replace_all(x, rewrites)))
    if pack.drop_last:
        steps.append(lambda ls: F.filter(ls, lambda x: ~_matches(x, pack.drop_last)))
    if pack.one_cell_per_line:
        steps.append(lambda ls: F.flatten(F.transform(ls, _cells)))
    if pack.start_in_url:
        # The start line is given back as plain text, ahead of what follows it.
        def with_start_line(ls: Column) -> Column:
            found = F.contains(as_column(url), F.lit(pack.start_in_url)) & F.exists(
                lines(as_column(markdown)), lambda x: _matches(x, [pack.start_pattern])
            )
            return F.when(found, F.concat(F.array(F.lit(pack.start_emits)), ls)).otherwise(ls)

        steps.append(with_start_line)
    steps.append(without_trailing_blanks)
    if pack.cut_from_last:
        def cut(ls: Column) -> Column:
            at = F.array_max(F.transform(ls, lambda x, i: F.when(_matches(x, [pack.cut_from_last]), i)))
            return let(
                at,
                lambda p: F.when(p.isNull(), ls).otherwise(
                    without_trailing_blanks(F.slice(ls, F.lit(1), p))
                ),
            )

        steps.append(cut)

    text = replace_all(as_column(markdown), [(_spaced(p).replace(r"\S", f"[^{SPACE_CLASS}]"), r) for p, r in pack.rewrites])

    def run(index: int, page_lines: Column) -> Column:
        if index == len(steps):
            return F.array_join(page_lines, "\n")
        return let(steps[index](page_lines), lambda nxt: run(index + 1, nxt))

    return let(lines(text), lambda ls: run(0, ls))


class Cleaners:
    """Cleaners by host: rule packs, which are looked up like rows, and functions of (markdown, url) columns."""

    def __init__(self, packs: Iterable[RulePack] = RULE_PACKS):
        self._packs = {pack.host.lower(): pack for pack in packs}
        self._by_host: dict[str, Cleaner] = {}

    def register(self, host: str, cleaner: Cleaner | RulePack) -> None:
        """Give a host its cleaner, in place of the one it had. A function adds a branch to the plan, a pack does not."""
        name = host.lower()
        self._packs.pop(name, None)
        self._by_host.pop(name, None)
        if isinstance(cleaner, RulePack):
            self._packs[name] = cleaner
        else:
            self._by_host[name] = cleaner

    def clean(self, markdown: Columnish, url: Columnish) -> Column:
        """Dispatch on the lower-cased host; an unknown host passes through unchanged."""
        md, link = as_column(markdown), as_column(url)
        by_pack = cleaned(self._packs, md, link) if self._packs else md
        if not self._by_host:
            return by_pack
        chosen = F.when(F.lit(False), md)
        for name, cleaner in self._by_host.items():
            chosen = chosen.when(host_of(link) == name, cleaner(md, link))
        return chosen.otherwise(by_pack)


def with_cleaned(
    pages: DataFrame, markdown: str = "markdown", url: str = "url", cleaners: Cleaners | None = None
) -> DataFrame:
    return pages.withColumn("parsed_text", (cleaners or Cleaners()).clean(markdown, url))
