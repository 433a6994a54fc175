"""Stored HTML to markdown lines, element exclusions applied on the way.

The one place that needs nested elements and so leaves the JVM: a pass of the
standard library's HTML parser per page inside ``mapInPandas``. Rows stay where
they are, nothing is shuffled.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .rules import HTML_FILTERS, Exclusion, HtmlFilter

# The converter travels inside the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__.partition(".")[0]])

VOID = frozenset(
    ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
)
BLOCK = frozenset(
    ["address", "article", "aside", "blockquote", "dd", "details", "div", "dl", "dt", "fieldset",
     "figcaption", "figure", "footer", "form", "header", "main", "nav", "ol", "p", "pre", "section",
     "summary", "table", "tbody", "thead", "tfoot", "ul", "body", "html", "head"]
)
NEVER_SHOWN = frozenset(["script", "style", "title", "template"])
# An open element of the left kind ends when one of the right kind begins.
CLOSED_BY = {
    "p": BLOCK | {"h1", "h2", "h3", "h4", "h5", "h6", "li", "hr", "p"},
    "li": frozenset(["li"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "tr": frozenset(["tr"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "option": frozenset(["option"]),
}
MARK = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`", "del": "~~", "s": "~~"}
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
CELLS = frozenset(["td", "th"])
SPACES = re.compile(r"\s+")


def _excluded(tag: str, attrs: dict[str, str], exclusions: Iterable[Exclusion]) -> bool:
    def holds(name: str, test: str, value: str) -> bool:
        actual = attrs.get(name)
        if actual is None:
            return False
        if test == "=":
            return actual == value
        if test == "word":
            return value in actual.split()
        if test == "end":
            return actual.endswith(value)
        return value in actual

    return any(
        (not e.tag or e.tag == tag) and all(holds(*c) for c in e.conditions) for e in exclusions
    )


class _Markdown(HTMLParser):
    """Writes markdown lines while skipping excluded elements."""

    def __init__(self, rules: HtmlFilter):
        super().__init__(convert_charrefs=True)
        self.rules = rules
        self.dropped = set(rules.tags) | NEVER_SHOWN | ({"form"} if rules.remove_forms else set())
        self.open: list[str] = []
        self.skip_from: int | None = None
        self.out: list[str] = []
        self.line: list[str] = []
        self.prefix = ""
        self.links: list[str] = []
        self.lists: list[list] = []
        # The cells of the open row; a table inside a cell is text of that cell.
        self.cells: list[str] | None = None
        self.cell_depth = 0
        self.header_rule = False
        self.quotes = 0
        self.pre_from: int | None = None

    # -- writing
    def flush(self, blank: bool = False) -> None:
        text = SPACES.sub(" ", "".join(self.line)).strip()
        self.line = []
        if text.strip("*`~ "):
            self.out.append("> " * self.quotes + self.prefix + text)
            self.prefix = ""
        if blank and self.out and self.out[-1] != "":
            self.out.append("")

    def markdown(self) -> str:
        self.close()
        while self.open:
            self.handle_endtag(self.open[-1])
        self.flush()
        while self.out and self.out[-1] == "":
            self.out.pop()
        return "\n".join(self.out)

    # -- structure
    def handle_starttag(self, tag: str, attrs: list) -> None:
        while self.open and tag in CLOSED_BY.get(self.open[-1], ()):
            self.handle_endtag(self.open[-1])
        values = {k: v or "" for k, v in attrs}
        if tag not in VOID:
            self.open.append(tag)
        if self.skip_from is not None:
            return
        if tag in self.dropped or _excluded(tag, values, self.rules.exclusions):
            if tag not in VOID:
                self.skip_from = len(self.open)
            return
        self.begin(tag, values)

    def begin(self, tag: str, values: dict[str, str]) -> None:
        if self.pre_from is not None:
            if tag == "br":
                self.line.append("\n")
        elif tag == "img":
            if values.get("src"):
                self.line.append(f"![{values.get('alt', '')}]({values['src']})")
        elif tag == "a":
            self.links.append(values.get("href", ""))
            if values.get("href"):
                self.line.append("[")
        elif tag in MARK:
            self.line.append(MARK[tag])
        elif self.cell_depth:
            self.line.append(" ")
            self.cell_depth += tag in CELLS
        elif tag in HEADINGS:
            self.flush(blank=True)
            self.prefix = "#" * int(tag[1]) + " "
        elif tag in ("ul", "ol"):
            self.flush(blank=not self.lists)
            self.lists.append([tag, 0])
        elif tag == "li":
            self.flush()
            depth = max(len(self.lists) - 1, 0)
            marker = "* "
            if self.lists:
                self.lists[-1][1] += 1
                if self.lists[-1][0] == "ol":
                    marker = f"{self.lists[-1][1]}. "
            self.prefix = "  " * depth + marker
        elif tag == "table":
            self.flush(blank=True)
            self.header_rule = True
        elif tag == "tr":
            self.flush()
            self.cells = []
        elif tag in CELLS:
            # Text between a row and its cells is no cell's; it stands before the row.
            self.flush()
            if self.cells is None:
                self.cells = []
            self.cell_depth = 1
        elif tag == "br":
            self.flush()
        elif tag == "hr":
            self.flush(blank=True)
            self.out += ["* * *", ""]
        elif tag == "pre":
            self.flush(blank=True)
            self.pre_from = len(self.open)
        elif tag == "blockquote":
            self.flush(blank=True)
            self.quotes += 1
        elif tag in BLOCK:
            self.part()

    def part(self) -> None:
        """A block begins or ends: a new paragraph, or just a space within a list item."""
        if "li" in self.open:
            self.line.append(" ")
        else:
            self.flush(blank=True)

    def row(self) -> None:
        self.flush()
        if self.cells:
            self.out.append("| " + " | ".join(self.cells) + " |")
            if self.header_rule:
                self.out.append("| " + " | ".join("---" for _ in self.cells) + " |")
                self.header_rule = False
        self.cells = None

    def code(self) -> None:
        text = "".join(self.line).strip("\n")
        self.line, self.pre_from = [], None
        if text.strip():
            self.out += ["> " * self.quotes + line for line in ("```", *text.split("\n"), "```")]
            self.out.append("")

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.open:
            return
        while True:
            last = self.open.pop()
            if self.skip_from is None:
                self.end(last)
            elif len(self.open) < self.skip_from:
                self.skip_from = None
            if last == tag:
                return

    def end(self, tag: str) -> None:
        if self.pre_from is not None:
            if tag == "pre" and len(self.open) < self.pre_from:
                self.code()
        elif tag == "a":
            target = self.links.pop() if self.links else ""
            if target:
                self.line.append(f"]({target})")
        elif tag in MARK:
            self.line.append(MARK[tag])
        elif self.cell_depth:
            self.cell_depth -= tag in CELLS
            if self.cell_depth:
                self.line.append(" ")
            elif tag in CELLS:
                self.cells.append(SPACES.sub(" ", "".join(self.line)).strip())
                self.line = []
                if "tr" not in self.open:
                    self.row()
        elif tag in HEADINGS:
            self.flush(blank=True)
            self.prefix = ""
        elif tag in ("ul", "ol"):
            self.flush(blank=len(self.lists) == 1)
            if self.lists:
                self.lists.pop()
        elif tag == "li":
            self.flush()
            self.prefix = ""
        elif tag == "tr":
            self.row()
        elif tag == "table":
            if self.cells:
                self.row()
            self.flush(blank=True)
        elif tag == "blockquote":
            self.flush(blank=True)
            self.quotes -= 1
        elif tag in BLOCK:
            self.part()

    def handle_data(self, data: str) -> None:
        if self.skip_from is None:
            self.line.append(data)


# Without a filter of their own, hosts keep everything that is shown, forms included.
_NO_RULES = HtmlFilter(host="", tags=(), remove_forms=False)
_FILTER_BY_HOST = {f.host: f for f in HTML_FILTERS}


def to_markdown(url: str, html: str) -> str:
    """One page's markdown, its host's exclusions applied."""
    try:
        host = urlsplit(url).netloc.lower()
    except ValueError:
        host = ""
    writer = _Markdown(_FILTER_BY_HOST.get(host, _NO_RULES))
    writer.feed(html)
    return writer.markdown()


def with_markdown(pages: DataFrame, html: str = "html_text", url: str = "url", keep_html: bool = False) -> DataFrame:
    """Add ``markdown``; the HTML is dropped unless asked for, to keep later stages narrow.

    A page the parser cannot read gets NULL and is left to the caller to skip.
    """
    kept = [f for f in pages.schema.fields if keep_html or f.name != html]
    schema = T.StructType([*kept, T.StructField("markdown", T.StringType())])

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(link: str | None, text: str | None) -> str | None:
            try:
                return None if text is None else to_markdown(link or "", text)
            except (AssertionError, ValueError, RecursionError):
                return None

        for batch in batches:
            markdown = [one(u, h) for u, h in zip(batch[url], batch[html], strict=True)]
            out = batch[[f.name for f in kept]].copy()
            out["markdown"] = markdown
            yield out

    return pages.mapInPandas(convert, schema)
