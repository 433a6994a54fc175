"""Main text of pages by wrappers: one union-free regular expression per host.

A page is read as a stream of balanced tokens: tags of blocks, and text. Inside a
page the stream is folded: neighbours with the same tag, and neighbouring runs of
tags, become one repeated group. The streams of a host are then aligned one after
the other with what has been inferred so far. Where both have the same tag it is
kept and its content aligned; a tag that only one of them has becomes optional;
text becomes a slot, which remembers whether it ever changed. The expression has
sequences, optional parts and repeated groups, and no alternatives.

What is boilerplate is read from the wrapper, not from the page: the slots below
the article or main element (all of the body where a host has neither) are the
text, without those below elements that are marked as menus, notices, forms,
comments and the like, without what stays the same on every page of the host, and
without lists of nothing but links. A page is aligned with its host's wrapper in
the same way, which gives every text of it its slot.

Wrappers are merged by task, then by parts of a host, then by host, so that a host
with very many pages is never gathered; a wrapper has the size of a page's outline.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.storage import in_small_batches, lookup
from gleaner.llm.texts import slices

# Pages that must differ before what they share is taken for boilerplate.
DISTINCT_PAGES = 5
# Share of links above which a list is a menu.
LINK_SHARE = 0.9
# Items of a sequence, beyond which items of one tag are one repeated group.
SEQUENCE = 64
# Length of runs of tags that are looked for as repeated groups.
RUN = 6
# Parts of a host that are merged on their own first; hosts held by a task at once.
PARTS = 64
HOSTS_HELD = 2_000
# Bytes of wrappers that are broadcast; beyond it pages are joined by host.
BROADCAST_BYTES = 64 << 20
# Elements nested deeper belong to the last one.
DEEPEST = 100

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
GONE = frozenset(
    "script style template noscript title textarea iframe svg math object canvas audio video select option button datalist "
    "noembed noframes xmp dialog".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var".split()
)
LISTS = frozenset("ul ol dl table".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# What an opening tag ends: the nearest of these, unless one of the others comes before it.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
    "body": (("head",), ()),
}
# Elements and words of class, id and role that mark what is not the article.
MARKED_TAGS = frozenset("nav footer aside form menu".split())
MARKED_WORDS = frozenset(
    "nav navbar navigation menu topbar toolbar breadcrumb breadcrumbs masthead banner footer sidebar aside ad ads advert adverts "
    "advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "comment comments commentlist respond reply replies disqus discussion form login signup newsletter subscribe subscription share "
    "sharing social related recommended recommendations pagination pager skip widget copyright contentinfo complementary search "
    "searchform header".split()
)
REGIONS = frozenset("article main".split())
PLAIN_MARKS = frozenset("html body article main".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>", re.S
)
RAW_ENDS = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.I) for tag in RAW}
MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


# -- pages -----------------------------------------------------------------------------------------


class Element:
    """A block of a page: its label (tag and marks), and in order elements and places of texts."""

    __slots__ = ("tag", "label", "gone", "parts")

    def __init__(self, tag: str, label: str, gone: bool):
        self.tag, self.label, self.gone = tag, label, gone
        self.parts: list = []


class Page:
    """The elements of a page and its texts: white space made one, with the characters in links."""

    def __init__(self, source: str):
        self.texts: list[str] = []
        self.linked: list[int] = []
        self.root = Element("#page", "#page", False)
        self._open = [self.root]
        self._run: list[str] = []
        self._links = 0
        self._in_link = 0
        self._read(source)

    def _text(self, raw: str) -> None:
        if raw and not self._open[-1].gone:
            text = html.unescape(raw) if "&" in raw else raw
            self._run.append(text)
            if self._in_link:
                self._links += len(text)

    def _end_text(self) -> None:
        """What was read since the last block tag is one text of the open block."""
        if self._run:
            text = " ".join("".join(self._run).split())
            if text:
                self._open[-1].parts.append(len(self.texts))
                self.texts.append(text)
                self.linked.append(min(self._links, len(text)))
            self._run, self._links = [], 0

    def _close(self, depth: int) -> None:
        self._end_text()
        del self._open[depth:]
        self._in_link = 0

    def _nearest(self, tags: tuple[str, ...], until: tuple[str, ...]) -> int:
        for depth in range(len(self._open) - 1, 0, -1):
            if self._open[depth].tag in tags:
                return depth
            if self._open[depth].tag in until:
                return 0
        return 0

    def _start(self, tag: str, marks: str) -> None:
        if tag in INLINE:
            self._in_link += tag == "a"
            return
        if tag in VOID:
            if tag == "hr":
                self._end_text()
            elif tag == "br":
                self._text(" ")
            return
        if tag not in GONE and (depth := self._nearest(("p",), ("td", "th", "li", "table", "button"))):
            self._close(depth)
        if tag in ENDS and (depth := self._nearest(*ENDS[tag])):
            self._close(depth)
        if tag in HEADINGS and self._open[-1].tag in HEADINGS:
            self._close(len(self._open) - 1)
        self._end_text()
        parent = self._open[-1]
        if len(self._open) > DEEPEST and tag not in GONE or len(self._open) > 2 * DEEPEST:
            return
        element = Element(tag, tag + marks, parent.gone or tag in GONE)
        if not element.gone:
            parent.parts.append(element)
        self._open.append(element)
        self._in_link = 0

    def _end(self, tag: str) -> None:
        if tag in INLINE:
            self._in_link = max(0, self._in_link - (tag == "a"))
        elif tag not in VOID and (depth := self._nearest((tag,), ())):
            self._close(depth)

    def _read(self, source: str) -> None:
        at = 0
        while found := TOKEN.search(source, at):
            self._text(source[at : found.start()])
            at = found.end()
            end, tag, rest = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
            if not tag:
                continue
            tag = tag.lower()
            if end:
                self._end(tag)
                continue
            self._start(tag, marks_of(rest) if "=" in rest else "")
            if tag in RAW:
                # Raw text reaches to its own end tag, whatever it looks like.
                close = RAW_ENDS[tag].search(source, at)
                at = close.start() if close else len(source)
        self._text(source[at:])
        self._close(1)


def marks_of(attributes: str) -> str:
    """The words of class, id and role, each once in alphabetical order: ``.body.post``."""
    words = {w.lower() for found in MARKS.finditer(attributes) for w in WORDS.findall(found[1] or found[2] or found[3] or "")}
    return "".join("." + w for w in sorted(words))


# -- expressions -----------------------------------------------------------------------------------


class Item:
    """A part of an expression: a tag with its content, a group of items ("()") or a text slot ("#").

    ``digest`` stands for all text below it on a page; it is None once two pages differed. Until
    then ``seen`` are the lowest of the names of the pages that have it, up to ``DISTINCT_PAGES``.
    ``texts`` are, on a page, the places of its texts.
    """

    __slots__ = ("label", "optional", "repeated", "kids", "digest", "seen", "size", "links", "texts", "keep")

    def __init__(self, label, kids=(), digest=0, size=0, links=0, texts=(), optional=False, repeated=False, seen=()):
        self.label, self.kids, self.digest, self.size, self.links = label, list(kids), digest, size, links
        self.texts, self.optional, self.repeated, self.seen = list(texts), optional, repeated, list(seen)
        self.keep = None

    def stored(self) -> list:
        flags = int(self.optional) + 2 * int(self.repeated)
        return [self.label, flags, self.digest, self.seen, self.size, self.links, [k.stored() for k in self.kids]]

    @staticmethod
    def load(row: list) -> Item:
        label, flags, digest, seen, size, links, kids = row
        return Item(label, map(Item.load, kids), digest, size, links, (), bool(flags & 1), bool(flags & 2), seen)


def mix(a: int, b: int) -> int:
    return (a * 0x9E3779B97F4A7C15 + b + 1) & 0x7FFFFFFFFFFFFFFF


def align(left: list[Item], right: list[Item], same_page: bool) -> list[Item]:
    """One sequence that stands for both: items with equal labels in order, the others optional."""
    if [i.label for i in left] == [i.label for i in right]:
        return [merge(a, b, same_page) for a, b in zip(left, right)]
    left, right = regrouped(left, right), regrouped(right, left)
    # The longest common sequence of labels.
    rows, columns = len(left), len(right)
    best = [[0] * (columns + 1) for _ in range(rows + 1)]
    for i in range(rows - 1, -1, -1):
        here, below, label = best[i], best[i + 1], left[i].label
        for j in range(columns - 1, -1, -1):
            here[j] = below[j + 1] + 1 if label == right[j].label else max(below[j], here[j + 1])
    out, i, j = [], 0, 0
    while i < rows or j < columns:
        if i < rows and j < columns and left[i].label == right[j].label:
            out.append(merge(left[i], right[j], same_page))
            i, j = i + 1, j + 1
            continue
        if j == columns or (i < rows and best[i + 1][j] >= best[i][j + 1]):
            item, i = left[i], i + 1
        else:
            item, j = right[j], j + 1
        item.optional = True
        out.append(item)
    return folded(out, same_page)


def names(a: Item, b: Item) -> list[int]:
    return a.seen if a.seen == b.seen else sorted({*a.seen, *b.seen})[:DISTINCT_PAGES]


def merge(a: Item, b: Item, same_page: bool) -> Item:
    """Two occurrences of one item, of one page or of two."""
    if same_page:
        a.digest = mix(a.digest or 0, b.digest or 0)
        a.texts += b.texts
    else:
        a.digest = a.digest if a.digest == b.digest else None
        a.seen = [] if a.digest is None else names(a, b)
    a.repeated |= b.repeated
    a.optional |= b.optional
    a.size += b.size
    a.links += b.links
    if a.kids or b.kids:
        a.kids = align(a.kids, b.kids, same_page)
    return a


def folded(items: list[Item], same_page: bool) -> list[Item]:
    """Neighbours with equal labels become one repeated item, equal neighbouring runs a repeated group."""
    out: list[Item] = []
    for item in items:
        if out and out[-1].label == item.label:
            optional = out[-1].optional and item.optional
            out[-1] = merge_inside(out[-1], item, same_page)
            out[-1].optional = optional
        else:
            out.append(item)
    for run in range(2, min(RUN, len(out) // 2) + 1):
        out = _runs(out, run, same_page)
    if len(out) > SEQUENCE:
        out = by_label(out, same_page, lambda label: label)
        if len(out) > SEQUENCE:
            out = by_label(out, same_page, lambda label: label.split(".")[0])
    return out


def merge_inside(a: Item, b: Item, same_page: bool) -> Item:
    """Two items of one sequence as one repeated item."""
    both = merge(a, b, same_page)
    both.repeated = True
    return both


def _runs(items: list[Item], run: int, same_page: bool) -> list[Item]:
    out, at = [], 0
    labels = [i.label for i in items]
    while at < len(items):
        times = 1
        while labels[at : at + run] == labels[at + times * run : at + (times + 1) * run] and len(labels) >= at + (times + 1) * run:
            times += 1
        if times == 1:
            out.append(items[at])
            at += 1
            continue
        group = grouped(items[at : at + run])
        for turn in range(1, times):
            group = merge_inside(group, grouped(items[at + turn * run : at + (turn + 1) * run]), same_page)
        out.append(group)
        at += times * run
    return out


def grouped(items: list[Item]) -> Item:
    """A group of items, which stands where they stood."""
    digest = 0
    for item in items:
        digest = None if digest is None or item.digest is None else mix(digest, item.digest)
    return Item(
        "(" + " ".join(i.label for i in items) + ")", items, digest, sum(i.size for i in items), sum(i.links for i in items),
        [t for i in items for t in i.texts], seen=[] if digest is None else items[0].seen,
    )


def regrouped(items: list[Item], others: list[Item]) -> list[Item]:
    """Runs of ``items`` that the other sequence has as a group become that group."""
    for other in others:
        if not other.label.startswith("("):
            continue
        wanted, out, at = [k.label for k in other.kids], [], 0
        while at < len(items):
            if wanted and [i.label for i in items[at : at + len(wanted)]] == wanted:
                out.append(grouped(items[at : at + len(wanted)]))
                at += len(wanted)
            else:
                out.append(items[at])
                at += 1
        items = out
    return items


def by_label(items: list[Item], same_page: bool, name) -> list[Item]:
    """One repeated item per label, in order of first occurrence; for sequences without an order."""
    kept: dict[str, Item] = {}
    for item in items:
        item.label = name(item.label)
        if item.label in kept:
            kept[item.label] = merge_inside(kept[item.label], item, same_page)
        else:
            item.optional = True
            kept[item.label] = item
    return list(kept.values())


def expression(page: Page) -> Item:
    """A page as an expression of its own."""

    def of(element: Element) -> Item:
        items = []
        for part in element.parts:
            if isinstance(part, int):
                text = page.texts[part]
                items.append(Item("#", (), xxhash.xxh64_intdigest(text) >> 1, len(text), page.linked[part], [part]))
            else:
                items.append(of(part))
        items = folded(items, True)
        digest = 0
        for item in items:
            digest = mix(digest, item.digest or 0)
        return Item(element.label, items, digest, sum(i.size for i in items), sum(i.links for i in items))

    root = of(page.root)
    # A page is named by its first heading, so that copies and near copies of it are one page.
    first = next((h for h in headings(root)), root)
    name = mix(first.digest, len(first.label))

    def call(item: Item) -> None:
        item.seen = [name]
        for kid in item.kids:
            call(kid)

    call(root)
    return root


def headings(item: Item) -> Iterator[Item]:
    if item.label.split(".")[0] == "h1" and item.size:
        yield item
    for kid in item.kids:
        yield from headings(kid)


def written(item: Item) -> str:
    """The expression as text: ``(x)?`` is optional, ``(x)+`` repeated, ``(x)*`` both, ``#`` a text slot."""
    inside = "".join(map(written, item.kids))
    text = "#" if item.label == "#" else inside if item.label[0] in "(#" else f"<{item.label}>{inside}</{item.label.split('.')[0]}>"
    sign = "*" if item.optional and item.repeated else "?" if item.optional else "+" if item.repeated else ""
    return f"({text}){sign}" if sign else text


# -- what is text ----------------------------------------------------------------------------------


def judge(root: Item) -> Item:
    """Mark every slot of the wrapper: kept, or not part of the main text."""
    whole = max(1, root.size)

    def holds_page(item: Item) -> bool:
        tag = item.label.split(".")[0]
        return tag in ("h1", "main") or any(map(holds_page, item.kids))

    def marked(item: Item) -> bool:
        tag, *words = item.label.split(".")
        if tag in PLAIN_MARKS:
            return tag == "article" and not {"comment", "comments"}.isdisjoint(words)
        if tag == "form":
            return 2 * item.size <= whole and not holds_page(item)
        return tag in MARKED_TAGS or (not MARKED_WORDS.isdisjoint(words) and not holds_page(item))

    def constant(item: Item, tag: str) -> bool:
        return item.digest is not None and len(item.seen) >= DISTINCT_PAGES and tag != "h1"

    def good(item: Item, below: bool, inside: bool) -> int:
        """Mark the slots below ``item`` and add up the size of those that are kept."""
        tag = item.label.split(".")[0]
        inside = inside or tag in REGIONS
        if tag == "header" and not (inside and any(headings(item))):
            below = True
        elif marked(item) or constant(item, tag):
            below = True
        elif tag in LISTS and item.size and item.links >= LINK_SHARE * item.size:
            below = True
        if item.label == "#":
            item.keep = not below
            return 0 if below else item.size
        return sum([good(kid, below, inside) for kid in item.kids])

    total = good(root, False, False)
    regions = outermost(root)
    inner = [found for region in regions for kid in region.kids for found in outermost(kid)]
    if inner and 2 * kept_size(inner) >= kept_size(regions):
        regions = inner
    if regions and 10 * kept_size(regions) >= 3 * total:
        inside = {id(slot) for region in regions for slot in slots(region)}
        for slot in slots(root):
            slot.keep = slot.keep and id(slot) in inside
    return root


def slots(item: Item) -> Iterator[Item]:
    if item.label == "#":
        yield item
    for kid in item.kids:
        yield from slots(kid)


def kept_size(items: list[Item]) -> int:
    return sum(slot.size for item in items for slot in slots(item) if slot.keep)


def outermost(item: Item) -> list[Item]:
    """The article and main elements with kept text that are not inside of others."""
    tag, *words = item.label.split(".")
    if tag in REGIONS or tag in ("div", "section") and "main" in words:
        return [item] if kept_size([item]) else []
    return [found for kid in item.kids for found in outermost(kid)]


def verdicts(page: list[Item], wrapper: list[Item], out: dict[int, bool]) -> bool:
    """Align the items of a page with those of its wrapper and note for every text whether its slot is kept.

    Whether each item has its place in the wrapper.
    """
    page, wrapper = regrouped(page, wrapper), regrouped(wrapper, page)
    labels = [i.label for i in wrapper]
    at, whole = 0, True
    for item in page:
        place = labels.index(item.label, at) if item.label in labels[at:] else labels.index(item.label) if item.label in labels else -1
        if place < 0:
            whole = False
            continue
        at = place
        slot = wrapper[place]
        if item.label == "#":
            out.update(dict.fromkeys(item.texts, bool(slot.keep)))
        else:
            whole &= verdicts(item.kids, slot.kids, out)
    return whole


def main_text(source: str, wrapper: Item | None) -> str:
    """The kept texts of a page in order, one a line; ``wrapper`` has been judged.

    A page, or a part of it, that does not fit its wrapper is judged by itself.
    """
    page = Page(source)
    own = expression(page)
    found: dict[int, bool] = {}
    fits = wrapper is not None and verdicts(own.kids, wrapper.kids, found)
    if not fits:
        judge(own)
        alone = {text: bool(slot.keep) for slot in slots(own) for text in slot.texts}
        found = alone | found if any(found.values()) else alone
    return "\n".join(text for place, text in enumerate(page.texts) if found.get(place))


# -- the operator ----------------------------------------------------------------------------------


def host_of(url: str):
    """The host of a URL in lower case; an empty one where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _rows(held: dict[str, Item]) -> pa.RecordBatch:
    texts = [json.dumps(item.stored(), separators=(",", ":")) for item in held.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(texts, pa.string())], ["host", "wrapper"])


def joined(held: Item | None, item: Item) -> Item:
    return item if held is None else merge(held, item, False)


def _infer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Item] = {}
    for batch in slices(batches, "_html"):
        for host, source in zip(batch.column("_host").to_pylist(), batch.column("_html").to_pylist()):
            item = expression(Page(source or ""))
            held[host] = joined(held.get(host), item)
        if len(held) > HOSTS_HELD:
            yield _rows(held)
            held = {}
    if held:
        yield _rows(held)


def _combine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the wrappers of each key; rows come in order of the key."""
    key = item = None
    for batch in batches:
        done: dict[str, Item] = {}
        for host, wrapper in zip(batch.column("host").to_pylist(), batch.column("wrapper").to_pylist()):
            if host != key:
                if item is not None:
                    done[key] = item
                key, item = host, None
            item = joined(item, Item.load(json.loads(wrapper)))
        if done:
            yield _rows(done)
    if item is not None:
        yield _rows({key: item})


def wrappers(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """``host`` and ``wrapper`` (as JSON) of every host of ``pages``; null sources are empty pages."""
    rows = in_small_batches(pages.select(host_of(url).alias("_host"), F.col(source).alias("_html")))
    kind = "host string, wrapper string"
    found = rows.mapInArrow(_infer, kind)
    part = F.pmod(F.xxhash64("wrapper"), F.lit(PARTS))
    some = found.repartition("host", part).sortWithinPartitions("host", "wrapper").mapInArrow(_combine, kind)
    return some.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(_combine, kind)


def expressions(found: DataFrame) -> DataFrame:
    """``host`` and ``expression`` of stored wrappers, for reading."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [written(Item.load(json.loads(w))) for w in batch.column("wrapper").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(texts, pa.string())], ["host", "expression"])

    return found.mapInArrow(run, "host string, expression string")


def extract(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html", found: DataFrame | None = None
) -> DataFrame:
    """One row per row of ``pages``: its id, url, the main ``text`` and its ``n_chars`` (code points).

    ``found`` are stored wrappers, inferred from ``pages`` where none are given. A null or
    empty source has an empty text. Pages without a host share one wrapper; repeated rows are
    rows of their own; other columns are not read. An empty table gives an empty result.
    """
    known = lookup(wrappers(pages, url, source) if found is None else found, "length(wrapper)", BROADCAST_BYTES)
    kinds = {name: pages.schema[name].dataType.simpleString() for name in (page_id, url)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged: dict[str, Item] = {}
        for batch in slices(batches, "_html"):
            texts = []
            for wrapper, body in zip(batch.column("wrapper").to_pylist(), batch.column("_html").to_pylist()):
                if wrapper is not None and wrapper not in judged:
                    if len(judged) > HOSTS_HELD:
                        judged.clear()
                    judged[wrapper] = judge(Item.load(json.loads(wrapper)))
                texts.append(main_text(body or "", judged.get(wrapper)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["_id", "_url", "text", "n_chars"],
            )

    rows = pages.select(F.col(page_id).alias("_id"), F.col(url).alias("_url"), host_of(url).alias("_host"), F.col(source).alias("_html"))
    beside = rows.join(known, F.col("_host") == F.col("host"), "left").select("_id", "_url", "_html", "wrapper")
    texts = in_small_batches(beside).mapInArrow(run, f"_id {kinds[page_id]}, _url {kinds[url]}, text string, n_chars bigint")
    return texts.select(F.col("_id").alias(page_id), F.col("_url").alias(url), "text", "n_chars")
