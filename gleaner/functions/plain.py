"""The markdown reading and comparison forms of ``markup`` and ``tokens``, for one text in Python.

For batches that are in Python anyway. Rules and their order are those of
``markup.strip_markdown``, which reads the same text the same way; emphasis is
taken off in one pass over its marks instead of one pass of the text per level.
"""

from __future__ import annotations

import html
import re

from .markup import CLOSES, INVISIBLE, MARKDOWN_RULES, OPENS
from .tokens import TYPOGRAPHIC, TYPOGRAPHIC_RANGE

# What the column functions call white space inside patterns.
_BLANK = r" \t\n\x0b\f\r"
_BLANKS = frozenset(" \t\n\x0b\f\r")
_END = r"(?=\r?(?:\n|\Z))"
_WORD = r"[^_\s](?:[^_\n]*[^_\s])?".replace(r"\s", _BLANK)

_CODE = re.compile(
    r"^ {0,3}(`{3,})[^`\n]*$(.*?)(?:^ {0,3}\1`*[ \t]*$|\Z)"
    r"|^ {0,3}(~{3,})[^\n]*$(.*?)(?:^ {0,3}\3~*[ \t]*$|\Z)"
    r"|(?<!`)(`{1,2})(?!`)([^`\n]+)\5(?!`)",
    re.M | re.S,
)
_OPEN_TABLE = re.compile(
    rf"^ {{0,3}}[^{_BLANK}|][^\n]*\|[^\n]*\n {{0,3}}:?-[-:]* *\|[-| :]*{_END}\r?(?:\n[^\n|]*+\|[^\n]*+)*+", re.M
)
_OPEN_TABLE_RULE = re.compile(rf"^ {{0,3}}:?-[-:]* *\|[-| :]*{_END}\r?\n?", re.M)
_BAR = re.compile(r"[ \t]*\|[ \t]*")
_TABLE_RULE = re.compile(rf"^[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)+\|?[ \t]*{_END}", re.M)
_TABLE_ROW = re.compile(r"^[ \t]*\|([^\n]*)", re.M)
_REFERENCE = re.compile(rf"^ {{0,3}}\[([^\[\]\n]+)\]:[ \t]*[^{_BLANK}][^\n]*$", re.M)
_REFERRING = re.compile(r"\[([^\[\]\n]*)\](?:\[([^\[\]\n]*)\])?(?![(:])")
_UNDERSCORES = re.compile(rf"(?<!\w)_({_WORD})_(?!\w)|(?<!\w)__({_WORD})__(?!\w)|(?<=_)_({_WORD})_(?=_)")
# The only two runs of a line lose all their levels but the last ones at once.
_DEEP_UNDERSCORES = re.compile(rf"^([^_\n]*)(_{{3,}})({_WORD})(_{{3,}})(?=[^_\n]*$)", re.M)
_STRUCK = re.compile(rf"~~([^{_BLANK}~](?:[^~\n]*[^{_BLANK}~])?)~~")
_ESCAPED = re.compile(r"\\([!-/:-@\[-`{-~])")
_MARKS = str.maketrans("", "", OPENS + CLOSES)
_NUMBER = re.compile(r"\s*[+-]?\d+\s*")
_TYPOGRAPHIC = re.compile(TYPOGRAPHIC_RANGE)
_INVISIBLE = re.compile(INVISIBLE.replace(r"\z", r"\Z").replace(r"\s", f"[{_BLANK}]"), re.A)
_NOTE = re.compile(r"\[\d+\]")
_NO_WORD = re.compile(r"[\W_]+")


def _python(pattern: str) -> re.Pattern:
    """A rule's pattern for Python, whose lines end at line feeds only and whose classes know more blanks."""
    flags = re.M if pattern.startswith("(?m)") else 0
    pattern = pattern.removeprefix("(?m)")
    if flags and pattern.endswith("$"):
        pattern = pattern[:-1] + _END
    return re.compile(pattern, flags | re.A)


_RULES = [
    ((triggers,) if isinstance(triggers, str) else triggers, [(_python(p), put.replace("$1", r"\1")) for p, put in rules])
    for triggers, rules in MARKDOWN_RULES
]


def _read_tables(text: str) -> str:
    text = _OPEN_TABLE.sub(lambda m: _BAR.sub("\n", _OPEN_TABLE_RULE.sub("", m[0])), text)
    if not _TABLE_RULE.search(text):
        return text
    return _TABLE_ROW.sub(lambda m: "\n" + m[1].replace("|", "\n"), _TABLE_RULE.sub("", text))


def _read_references(text: str) -> str:
    labels = {m[1].lower() for m in _REFERENCE.finditer(text)}
    if not labels:
        return text
    return _REFERRING.sub(lambda m: m[1] if (m[2] or m[1]).lower() in labels else m[0], _REFERENCE.sub("", text))


def without_emphasis(text: str) -> str:
    """Pairs of asterisks around a word or more go, innermost first and from the left.

    Whether two asterisks with none left between them are a pair depends on the
    text between them only, so after the first round just those are looked at
    that have become neighbours. Time grows with the text, however deep they nest.
    """
    marks = [i for i, c in enumerate(text) if c == "*"]
    count = len(marks)
    # For every mark the next other character, the one before it, and the line it is on.
    after, before, line = [0] * count, [0] * count, [0] * count
    for n in range(count - 1, -1, -1):
        after[n] = after[n + 1] if n + 1 < count and marks[n + 1] == marks[n] + 1 else marks[n] + 1
    for n, at in enumerate(marks):
        before[n] = before[n - 1] if n and marks[n - 1] == at - 1 else at - 1
        line[n] = (line[n - 1] + text.count("\n", marks[n - 1], at)) if n else 0
    following, previous = list(range(1, count + 1)), list(range(-1, count - 1))

    def pair(a: int, b: int) -> bool:
        return (
            line[a] == line[b] and after[a] < marks[b]
            and text[after[a]] not in _BLANKS and text[before[b]] not in _BLANKS
        )

    gone = bytearray(count)
    candidates = range(count - 1)
    while candidates:
        found = []
        for a in candidates:
            b = following[a]
            if not gone[a] and b < count and not gone[b] and pair(a, b):
                gone[a] = gone[b] = 1
                found.append((a, b))
        for a, b in found:
            left, right = previous[a], following[b]
            if left >= 0:
                following[left] = right
            if right < count:
                previous[right] = left
        # Neighbours of what went; a mark may have lost several neighbours at once.
        candidates = sorted({previous[a] for a, _ in found if previous[a] >= 0 and not gone[previous[a]]})
    out, start = [], 0
    for n, at in enumerate(marks):
        if gone[n]:
            out.append(text[start:at])
            start = at + 1
    out.append(text[start:])
    return "".join(out)


def _without_underscores(text: str) -> str:
    def shorter(m: re.Match) -> str:
        levels = min(len(m[2]), len(m[4])) - 2
        return m[1] + m[2][levels:] + m[3] + m[4][levels:]

    text = _DEEP_UNDERSCORES.sub(shorter, text)
    while (plain := _UNDERSCORES.sub(lambda m: m[1] or m[2] or m[3], text)) != text:
        text = plain
    return text


def _may_list(text: str) -> bool:
    """Whether a line begins like an item of a list, which the last rule is for."""
    return any((mark := line.lstrip(" \t")[:1]) in "-*+0123456789" and mark for line in text.split("\n"))


def _without_marks(text: str) -> str:
    if "|" in text:
        text = _read_tables(text)
    if "]:" in text:
        text = _read_references(text)
    for triggers, rules in _RULES:
        if any(t in text for t in triggers) if triggers[0] else _may_list(text):
            for pattern, put in rules:
                text = pattern.sub(put, text)
    if "*" in text:
        text = without_emphasis(text)
    if "_" in text:
        text = _without_underscores(text)
    if "~~" in text:
        text = _STRUCK.sub(r"\1", text)
    if "\\" in text:
        text = _ESCAPED.sub(r"\1", text)
    return html.unescape(text) if "&" in text else text


def strip_markdown(text: str) -> str:
    """The text a reader sees once the markdown is rendered and the tags are gone."""
    codes: list[str] = []
    if "`" in text or "~~~" in text:

        def put(m: re.Match) -> str:
            codes.append((m[2] or "") + (m[4] or "") + (m[6] or ""))
            return f"{OPENS}{len(codes) - 1}{CLOSES}"

        text = _CODE.sub(put, text.translate(_MARKS))
    text = _without_marks(text)
    if codes:
        pieces = text.split(OPENS)
        for n, piece in enumerate(pieces[1:], 1):
            number, _, rest = piece.partition(CLOSES)
            if _NUMBER.fullmatch(number):
                code = int(number)
                pieces[n] = codes[code] + rest if 0 <= code < len(codes) else ""
        text = "".join(pieces)
    if "\t" in text:
        text = text.replace("\t", " ")
    if "  " in text:
        text = re.sub(" {2,}", " ", text)
    if "\n\n" in text:
        text = re.sub("\n{2,}", "\n", text)
    return text.strip()


def normalise_for_compare(text: str) -> str:
    """Typographic marks made plain, then lower case."""
    if _TYPOGRAPHIC.search(text):
        for old, new in TYPOGRAPHIC:
            text = text.replace(old, new)
    return text.lower()


def normalise(text: str) -> str:
    """Lower-cased words only: the form in which passages are looked up."""
    return _NO_WORD.sub(" ", _NOTE.sub(" ", text) if "[" in text else text).lower().strip(" ")


def visible_text(source: str) -> str:
    """What a reader sees of a page, normalised for lookups."""
    shown = _INVISIBLE.sub(" ", source)
    return normalise(html.unescape(shown) if "&" in shown else shown)
