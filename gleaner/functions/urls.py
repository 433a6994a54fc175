"""Columns read off a URL or a page's head."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .basic import Columnish, as_column, collapse, strip
from .markup import without_tags

# The authority part as written: case and port are kept. ``parse_url`` raises
# on a malformed URL under ANSI and drops the port.
NETLOC = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
HEADING = r"(?is)<h1\b[^>]*>(.*?)</h1>"


def domain_of(url: Columnish) -> Column:
    return F.regexp_extract(as_column(url), NETLOC, 1)


def host_of(url: Columnish) -> Column:
    """The key rule packs are looked up by."""
    return F.lower(domain_of(url))


def title_of(html: Columnish, metadata_title: Columnish | None = None) -> Column:
    """The first <title>, trimmed; a non-empty metadata title wins."""
    found = strip(F.regexp_extract(as_column(html), TITLE, 1))
    if metadata_title is None:
        return found
    return F.coalesce(F.nullif(as_column(metadata_title), F.lit("")), found)


def page_context(html: Columnish) -> Column:
    """Struct of title and first h1, each as one line of text."""
    def one_line(pattern: str) -> Column:
        return collapse(without_tags(F.regexp_extract(as_column(html), pattern, 1)))

    return F.struct(one_line(TITLE).alias("title"), one_line(HEADING).alias("heading"))
