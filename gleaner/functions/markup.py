"""Plain text out of HTML and markdown, by native expressions only.

These are documented subsets: there is no DOM. ``visible_text`` does not repair
markup. ``strip_markdown`` covers fences and code spans (kept as written), ATX
and setext headings, rules, block quotes, list markers, tables with and without
outer pipes, inline and reference links, images, emphasis of any depth,
strikethrough, raw tags and entities; code that is only indented is read as text.

Patterns never repeat a group unless the repetition is possessive, which the
regular expression engine runs as a loop, and none scans to the end of a text
more than once, so time grows with the text.
"""

from __future__ import annotations

import html as html_reference
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .basic import Columnish, as_column, let, replace_all, strip, when_present

# A quoted attribute value may hold ">"; quotes elsewhere in a tag mean nothing.
_TAG = r"""<[!?/A-Za-z][^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+')?+[^>=]*+)*+>?"""
# Script, style and template run to their end tag or, unclosed, to the end of the
# page. Ruby annotations need no end tag: the next one, the end of the ruby or of
# a block ends them as well.
# One alternation, so whichever construct opens first wins: a comment marker in
# a script is script text, a script in a comment is comment text.
INVISIBLE = (
    r"(?is)<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
    r"|<template\b.*?(?:</template\s*>|\z)"
    r"|<r[tp]\b.*?(?:</r[tp]\s*>|(?=<r[tp]\b|</ruby\b|</?(?:p|div|li|t[drh]|table|section|article|body|h[1-6]|[uo]l)\b))"
    r"|<!--.*?(?:-->|\z)|" + _TAG
)
TAG = r"(?s)<!--.*?(?:-->|\z)|" + _TAG
CODE_BLOCK = r"(?is)<(script|style|noscript)\b.*?</\1>"
COMMENT = r"(?s)<!--.*?-->"

_LINK_TEXT = r"\[((?:[^\[\]]|\[[^\[\]]*+\])*+)\]"
_LINK_TARGET = r"\([^()]*(?:\([^()]*\)[^()]*)*+\)"
_EMPHASIS = (r"\*([^\s*](?:[^*\n]*[^\s*])?)\*", "$1")
# Underscores only count at word boundaries.
_UNDERSCORES = (
    r"(?<![\p{L}\p{N}_])_([^\s_](?:[^_\n]*[^\s_])?)_(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])__([^\s_](?:[^_\n]*[^\s_])?)__(?![\p{L}\p{N}_])"
    r"|(?<=_)_([^\s_](?:[^_\n]*[^\s_])?)_(?=_)",
    "$1$2$3",
)
TABLE_RULE = r"(?m)^[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)+\|?[ \t]*$"
TABLE_CELL = r"(?m)(?:^[ \t]*|\G(?!^))\|([^|\n]*)"
# A head line, a rule and body lines that all hold a pipe and open with something else.
OPEN_TABLE = (
    r"(?m)^ {0,3}[^\s|][^\n]*\|[^\n]*\n {0,3}:?-[-:]* *\|[-| :]*$(?:\n[^\n|]*+\|[^\n]*+)*+"
)
OPEN_TABLE_RULE = r"(?m)^ {0,3}:?-[-:]* *\|[-| :]*$\n?"
# The text between fences of the same kind (groups 2 and 4) or the marks of a code span (group 6).
CODE = (
    r"(?ms)^ {0,3}(`{3,})[^`\n]*$(.*?)(?:^ {0,3}\1`*[ \t]*$|\z)"
    r"|^ {0,3}(~{3,})[^\n]*$(.*?)(?:^ {0,3}\3~*[ \t]*$|\z)"
    r"|(?<!`)(`{1,2})(?!`)([^`\n]+)\5(?!`)"
)
REFERENCE = r"(?m)^ {0,3}\[([^\[\]\n]+)\]:[ \t]*\S[^\n]*$"
REFERRING = r"\[([^\[\]\n]*)\](?:\[([^\[\]\n]*)\])?(?![(:])"
# Private characters that hold the place of code while the rest is read.
OPENS, CLOSES = "\ue000", "\ue001"

# (triggers, rules): the rules of a group only run on texts holding a trigger,
# which spares plain prose nearly all of the passes; '' always runs.
MARKDOWN_RULES = (
    ("<", ((r"<(https?://[^<>\s]+)>", "$1"), (r"</?[A-Za-z][^<>]*>", ""))),
    (
        "](",
        (
            (r"!" + _LINK_TEXT + _LINK_TARGET, ""),
            (_LINK_TEXT + _LINK_TARGET, "$1"),
        ),
    ),
    ("#", ((r"(?m)^ {0,3}#{1,6}(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$", "$1"),)),
    (
        ("--", "**", "__", "- ", "* ", "_ ", "-\t", "*\t", "_\t"),
        (
            (r"(?m)^ {0,3}(?:-[ \t]*-[ \t]*-[- \t]*|\*[ \t]*\*[ \t]*\*[* \t]*|_[ \t]*_[ \t]*_[_ \t]*)$", ""),
        ),
    ),
    ("=", ((r"(?m)^ {0,3}=+[ \t]*$", ""),)),
    (">", ((r"(?m)^ {0,3}>(?: ?>)*+ ?", ""),)),
    ("", ((r"(?m)^[ \t]*(?:[-*+]|\d{1,9}[.)])[ \t]+", ""),)),
)
# Each pass takes the innermost marks off, until a pass finds none.
NESTED_RULES = (("*", _EMPHASIS), ("_", _UNDERSCORES))
LAST_RULES = (
    ("~~", ((r"~~([^\s~](?:[^~\n]*[^\s~])?)~~", "$1"),)),
    ("\\", ((r"\\([!-/:-@\[-`{-~])", "$1"),)),
)
SPACES = (
    ("\t", ((r"\t", " "),)),
    ("  ", ((r" {2,}", " "),)),
    ("\n\n", ((r"\n{2,}", "\n"),)),
)


# Names that also count without their semicolon, longest first.
LEGACY_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)


def _table(entries: dict[str, str]) -> Column:
    """One literal that the optimizer folds into a map."""
    listed = "\x01".join(f"{name}\x02{text}" for name, text in entries.items())
    return F.str_to_map(F.lit(listed), F.lit("\x01"), F.lit("\x02"))


# Nearly all references are one of these; the full table is searched entry by entry.
USUAL_NAMES = ("amp;", "lt;", "gt;", "quot;", "nbsp;", "apos;", "copy;", "mdash;", "ndash;", "hellip;", "rsquo;", "lsquo;")
# What numbers below 160 stand for, as the standard has it: mostly characters of windows-1252 or nothing.
LOW_NUMBERS = [html_reference.unescape(f"&#{n};") for n in range(160)]


def unescape(text: Columnish) -> Column:
    """Decode named and numeric character references, each once, by the rules of HTML.

    The old names count without a semicolon too. Numbers that are no character
    become U+FFFD or nothing, as the standard says.
    """
    usual = _table({n: html5[n] for n in USUAL_NAMES})
    names = _table(html5)

    def after(piece: Column, taken: Column) -> Column:
        return F.substring(piece, F.length(taken) + 1, F.length(piece))

    def character(point: Column) -> Column:
        low = F.element_at(F.array(*[F.lit(c) for c in LOW_NUMBERS]), (point + 1).cast("int"))
        none = point.between(0xFDD0, 0xFDEF) | (point.bitwiseAND(F.lit(0xFFFE).cast("long")) == 0xFFFE)
        wrong = (point > 0x10FFFF) | point.between(0xD800, 0xDFFF)
        return (
            F.when(point < 160, low).when(wrong, "\ufffd").when(none, "")
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))
        )

    def numeric(piece: Column) -> Column:
        def read(written: Column) -> Column:
            is_hex = F.lower(F.substring(written, 2, 1)) == "x"
            digits = F.ltrim(F.btrim(written, F.lit("#xX;")), F.lit("0"))
            number = F.when(F.length(digits) > 7, F.lit(0x110000)).otherwise(
                F.when(is_hex, F.conv(digits, 16, 10)).otherwise(digits).try_cast("long")
            )
            point = F.when(digits == "", F.lit(0)).otherwise(number).cast("long")
            return F.when(written != "", F.concat(let(point, character), after(piece, written)))

        return let(F.regexp_extract(piece, r"^#(?:[xX][0-9A-Fa-f]+|[0-9]+);?", 0), read)

    def named(piece: Column) -> Column:
        def read(written: Column) -> Column:
            found = F.coalesce(F.try_element_at(usual, written), F.try_element_at(names, written))
            return F.concat(found, after(piece, written))

        return let(F.regexp_extract(piece, r"^[A-Za-z][A-Za-z0-9]*;", 0), read)

    def legacy(piece: Column) -> Column:
        written = F.regexp_extract(piece, "^(?:" + "|".join(LEGACY_NAMES) + ")", 0)
        return F.concat(F.try_element_at(names, written), after(piece, written))

    def decode(piece: Column) -> Column:
        return F.coalesce(
            F.when(F.startswith(piece, F.lit("#")), numeric(piece)).otherwise(
                F.coalesce(named(piece), legacy(piece))
            ),
            F.concat(F.lit("&"), piece),
        )

    def decode_all(pieces: Column) -> Column:
        tail = F.slice(pieces, F.lit(2), F.size(pieces))
        return F.array_join(F.concat(F.slice(pieces, 1, 1), F.transform(tail, decode)), "")

    return when_present(as_column(text), "&", lambda t: let(F.split(t, "&"), decode_all))


def replace_until_none(text: Column, pattern: str, replacement: str, mark: str) -> Column:
    """Replace again and again until nothing changes; every change takes marks away, so their number ends it."""
    state = F.struct(text.alias("text"), F.lit(True).alias("more"))

    def again(acc: Column, _: Column) -> Column:
        changed = let(
            F.regexp_replace(acc.text, pattern, replacement),
            lambda t: F.struct(t.alias("text"), (t != acc.text).alias("more")),
        )
        return F.when(acc.more, changed).otherwise(acc)

    # Rounds of turns, so that a text that is done passes over whole rounds.
    marks = F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))
    turns = F.sequence(F.lit(1), F.ceil(F.sqrt(F.greatest(marks, F.lit(1)))).cast("int"))

    def round_of_turns(acc: Column, _: Column) -> Column:
        return F.when(acc.more, F.aggregate(turns, acc, again)).otherwise(acc)

    return F.aggregate(turns, state, round_of_turns, lambda acc: acc.text)


def between_matches(text: Column, pattern: str, put, group: int = 0) -> Column:
    """``text`` with ``put(match, number)`` in place of every match of ``pattern``, numbered from 0."""
    def join(found: Column) -> Column:
        pieces = F.split(text, pattern)
        return F.array_join(
            F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(put(F.get(found, i), i), F.lit("")))), ""
        )

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda f: F.when(F.size(f) == 0, text).otherwise(join(f)))


def _read_references(text: Column) -> Column:
    """Links whose target stands on a line of its own become their text; those lines go."""
    def read(labels: Column) -> Column:
        def plain(match: Column, _: Column) -> Column:
            shown = F.regexp_extract(match, REFERRING, 1)
            label = F.regexp_extract(match, REFERRING, 2)
            return F.when(
                F.array_contains(labels, F.lower(F.coalesce(F.nullif(label, F.lit("")), shown))), shown
            ).otherwise(match)

        return F.when(F.size(labels) == 0, text).otherwise(
            let(F.regexp_replace(text, REFERENCE, ""), lambda t: between_matches(t, REFERRING, plain))
        )

    return let(F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1)), F.lower), read)


def _read_tables(text: Column) -> Column:
    """Cells of tables stand on lines of their own."""
    def open_cells(match: Column, _: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(match, OPEN_TABLE_RULE, ""), r"[ \t]*\|[ \t]*", "\n")

    def piped(t: Column) -> Column:
        return F.when(
            F.rlike(t, F.lit(TABLE_RULE)), replace_all(t, ((TABLE_RULE, ""), (TABLE_CELL, "\n$1")))
        ).otherwise(t)

    return let(between_matches(text, OPEN_TABLE, open_cells), piped)


def _without_marks(text: Column) -> Column:
    column = when_present(text, "|", _read_tables)
    column = when_present(column, "]:", _read_references)
    for triggers, rules in MARKDOWN_RULES:
        column = when_present(column, triggers, lambda t, rules=rules: replace_all(t, rules))
    for mark, (pattern, put) in NESTED_RULES:
        column = when_present(column, mark, lambda t, p=pattern, r=put, m=mark: replace_until_none(t, p, r, m))
    for triggers, rules in LAST_RULES:
        column = when_present(column, triggers, lambda t, rules=rules: replace_all(t, rules))
    return unescape(column)


def _code_of(match: Column) -> Column:
    return F.concat(*[F.coalesce(F.regexp_extract(match, CODE, g), F.lit("")) for g in (2, 4, 6)])


def strip_markdown(text: Columnish) -> Column:
    """The text a reader sees once the markdown is rendered and the tags are gone.

    Code is set aside as written while the marks around it are taken off.
    """
    def set_aside(t: Column) -> Column:
        fenced = F.contains(t, F.lit("`")) | F.contains(t, F.lit("~~~"))
        cleared = F.translate(t, OPENS + CLOSES, "")
        held = between_matches(
            cleared, CODE, lambda m, i: F.when(m.isNotNull(), F.concat(F.lit(OPENS), i.cast("string"), F.lit(CLOSES)))
        )
        codes = F.transform(F.regexp_extract_all(cleared, F.lit(CODE), F.lit(0)), _code_of)
        return F.when(fenced, F.struct(held.alias("text"), codes.alias("codes"))).otherwise(
            F.struct(t.alias("text"), F.array().cast("array<string>").alias("codes"))
        )

    def read(apart: Column) -> Column:
        def put_back(piece: Column, i: Column) -> Column:
            number = F.substring_index(piece, CLOSES, 1).try_cast("int")
            rest = F.substr(piece, F.locate(CLOSES, piece) + 1)
            return F.when((i == 0) | number.isNull(), piece).otherwise(F.concat(F.get(apart.codes, number), rest))

        return let(
            _without_marks(apart.text),
            lambda plain: F.when(F.size(apart.codes) == 0, plain).otherwise(
                F.array_join(F.transform(F.split(plain, OPENS), put_back), "")
            ),
        )

    column = let(let(as_column(text), set_aside), read)
    for triggers, rules in SPACES:
        column = when_present(column, triggers, lambda t, rules=rules: replace_all(t, rules))
    return strip(F.when(as_column(text).isNotNull(), column))


def without_tags(html: Columnish) -> Column:
    """Tags and comments become spaces, character references are decoded."""
    return unescape(F.regexp_replace(as_column(html), TAG, " "))


def normalise(text: Columnish) -> Column:
    """Lower-cased words only: the form in which passages are looked up.

    Footnote marks go as a whole; any other run of non-word characters, the
    underscore included, becomes one space.
    """
    without_notes = F.regexp_replace(as_column(text), r"\[\p{Nd}+\]", " ")
    return F.trim(F.lower(F.regexp_replace(without_notes, r"[^\p{L}\p{N}]+", " ")))


def visible_text(html: Columnish) -> Column:
    """What a reader sees of a page, normalised for lookups."""
    return normalise(unescape(F.regexp_replace(as_column(html), INVISIBLE, " ")))


def strip_code(html: Columnish) -> Column:
    """Script, style, noscript and comments become spaces; nothing visible is touched."""
    return replace_all(html, ((CODE_BLOCK, " "), (COMMENT, " ")))
