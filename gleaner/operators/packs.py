"""Rule packs applied to markdown in batches: packs are rows looked up by host.

What a pack does and in which order is as in ``cleaning.apply_pack``; here one pack
is made ready once per task and the page's host says which one applies, so a plan is
the same for four hosts and for a thousand.
"""

from __future__ import annotations

import re
import sys
from functools import partial
from urllib.parse import urlsplit

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.basic import SPACE_CLASS, held
from .rules import RulePack

# The engine travels with the job, so executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__.partition(".")[0]])

Lines = list[str]
LEADING_FLAGS = re.compile(r"\A\(\?([a-z]+)\)(.*)\Z", re.S)


def spaced(pattern: str) -> re.Pattern:
    """White space in a rule means Unicode white space; letters and digits are those of ASCII."""
    # What is no white space either, where a rule asks for it.
    pattern = pattern.replace(r"[\s*]", f"[{SPACE_CLASS}*]").replace(r"\s", f"[{SPACE_CLASS}]").replace(r"\S", f"[^{SPACE_CLASS}]")
    # Flags lead a rule; Python takes them for the whole pattern or for a group.
    return re.compile(LEADING_FLAGS.sub(r"(?\1:\2)", pattern), re.A)


def one_of(patterns: tuple[str, ...]) -> re.Pattern | None:
    """One pattern for several; none for none."""
    return re.compile("|".join(f"(?:{spaced(p).pattern})" for p in patterns), re.A) if patterns else None


def put(replacement: str) -> str:
    """A replacement with ``$1`` for its groups."""
    return re.sub(r"\$(\d)", r"\\g<\1>", replacement.replace("\\", "\\\\"))


def heading_text(line: str) -> str | None:
    return line.lstrip("#").strip().lower() if line.startswith("#") else None


def without_trailing_blanks(lines: Lines) -> Lines:
    last = len(lines)
    while last and not lines[last - 1].strip():
        last -= 1
    return lines[:last]


def cells(line: str) -> Lines:
    """The line itself, or the filled cells of a piped row."""
    text = line.strip()
    if not (text.startswith("|") and "|" in text[1:]):
        return [line]
    return [c for c in (part.strip() for part in text.strip("|").split("|")) if c]


class Ready:
    """A pack with its patterns compiled and its words in sets."""

    def __init__(self, pack: RulePack):
        self.pack = pack
        self.start = one_of((pack.start_pattern,) if pack.start_in_url else ())
        self.stop, self.first, self.last = one_of(pack.stop_patterns), one_of(pack.drop_first), one_of(pack.drop_last)
        self.stripped = one_of(pack.drop_stripped)
        self.cut = one_of((pack.cut_from_last,) if pack.cut_from_last else ())
        self.rewrites = [(spaced(p), put(r)) for p, r in pack.rewrites]
        self.line_rewrites = [(spaced(p), put(r)) for p, r in pack.line_rewrites]
        self.stop_headings, self.stop_lines = frozenset(pack.stop_headings), frozenset(pack.stop_lines)
        self.drop_headings, self.drop_lines = frozenset(pack.drop_headings), frozenset(pack.drop_lines)

    def stops(self, line: str) -> bool:
        if self.stop and self.stop.search(line):
            return True
        heading = heading_text(line) if self.stop_headings else None
        if heading is not None:
            if heading.startswith(self.pack.stop_headings) if self.pack.stop_headings_by_prefix else heading in self.stop_headings:
                return True
        return bool(self.stop_lines) and line.strip().lower() in self.stop_lines

    def drops(self, line: str) -> bool:
        if self.drop_headings and heading_text(line) in self.drop_headings:
            return True
        lowered = line.strip().lower()
        if lowered in self.drop_lines or (self.pack.drop_prefixes and lowered.startswith(self.pack.drop_prefixes)):
            return True
        return bool(self.stripped and self.stripped.search(line.strip()))

    def rewritten(self, line: str) -> str:
        for pattern, replacement in self.line_rewrites:
            line = pattern.sub(replacement, line)
        return line

    def clean(self, markdown: str, url: str) -> str:
        pack, text = self.pack, markdown
        for pattern, replacement in self.rewrites:
            text = pattern.sub(replacement, text)
        lines = text.split("\n")
        if pack.trim_line_ends:
            lines = [line.rstrip() for line in lines]
        starts = bool(self.start) and pack.start_in_url in url
        if starts:
            at = next((n for n, line in enumerate(lines) if self.start.search(line)), len(lines))
            lines = lines[at + 1 :]
        lines = lines[: next((n for n, line in enumerate(lines) if self.stops(line)), len(lines))]
        if self.first:
            lines = [line for line in lines if not self.first.search(line)]
        lines = [line for line in lines if not self.drops(line)]
        if self.line_rewrites:
            lines = [self.rewritten(line) for line in lines]
        if self.last:
            lines = [line for line in lines if not self.last.search(line)]
        if pack.one_cell_per_line:
            lines = [cell for line in lines for cell in cells(line)]
        if starts and any(map(self.start.search, markdown.split("\n"))):
            lines = [pack.start_emits, *lines]
        lines = without_trailing_blanks(lines)
        if self.cut:
            at = max((n for n, line in enumerate(lines) if self.cut.search(line)), default=None)
            lines = lines if at is None else without_trailing_blanks(lines[:at])
        return "\n".join(lines)


def host_of(url: str | None) -> str:
    try:
        return urlsplit(url or "").netloc.lower()
    except ValueError:
        return ""


def cleaned(packs: dict[str, RulePack], markdown: Column, url: Column) -> Column:
    """Every markdown cleaned by the pack of its URL's host; of an unknown host it stays."""
    def run(texts: pd.Series, links: pd.Series, packs: dict[str, RulePack]) -> pd.Series:
        ready: dict[str, Ready] = {}

        def one(text: str | None, link: str | None) -> str | None:
            host = host_of(link)
            if text is None or host not in packs:
                return text
            if host not in ready:
                ready[host] = Ready(packs[host])
            return ready[host].clean(text, link or "")

        return pd.Series([one(t, u) for t, u in zip(texts, links)], dtype=object)

    bound = partial(run, packs=packs)

    @pandas_udf(T.StringType())
    def clean(texts: pd.Series, links: pd.Series) -> pd.Series:
        return bound(texts, links)

    return clean(held(markdown), held(url))
