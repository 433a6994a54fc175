"""Personal data in texts: patterns propose, checksums confirm, nearby words weigh.

Everything is a column expression. A pattern's matches and where they lie come
from splitting the text at the pattern and extracting it: the pieces between the
matches say how far each match is from the one before. Patterns are written
without repeated groups and without a start inside a run they would have to
read again, so time grows with the text and no text is too deep for the regular
expression engine; where a pattern asks for "a sign, but only between two
digits", signs elsewhere are masked first by a character that cannot match, which
moves nothing.

Kinds with ``base=True`` are always reported; the others only if their score,
the kind's own plus what words nearby add or take, reaches ``LEAST_SCORE`` and
they lie outside the base spans.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.basic import let

LEAST_SCORE = 0.5
BEFORE, AFTER = 40, 20
SPAN = "struct<start:int,rank:int,end:int,kind:string,score:double,base:boolean>"

# How long an IBAN is, by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20,
    "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24,
    "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]+", "")


def passes_luhn(digits: Column) -> Column:
    """Whether digits pass the Luhn check: from the right, every second one doubled, the sum ends in 0."""
    def weigh(c: Column, i: Column) -> Column:
        digit = c.cast("int")
        twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return F.when(i % 2 == 1, twice).otherwise(digit)

    each = F.transform(F.reverse(F.split(digits, "")), weigh)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def passes_mod97(iban: Column) -> Column:
    """Whether an IBAN without blanks leaves 1 when divided by 97, its first four characters moved to the end."""
    turned = F.split(F.concat(F.substr(iban, F.lit(5)), F.left(iban, F.lit(4))), "")

    def step(left: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (left * 10 + code - 48) % 97).otherwise((left * 100 + code - 55) % 97)

    return F.aggregate(turned, F.lit(0), step) == 1


@dataclass(frozen=True)
class Kind:
    """One pattern. ``mask`` changes the text before matching, character by character; ``needs`` is a
    cheap pattern without which there is no match; ``valid`` confirms a matched string."""

    name: str
    pattern: str
    needs: str
    valid: Callable[[Column], Column]
    score: float
    supports: str
    opposes: str = ""
    mask: tuple[str, str] | None = None
    base: bool = False


def _digit_count(least: int, most: int) -> Callable[[Column], Column]:
    return lambda m: F.length(digits_of(m)).between(least, most)


def _card(match: Column) -> Column:
    return let(digits_of(match), lambda d: F.length(d).between(12, 19) & passes_luhn(d))


def _parts_in_range(match: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.ltrim(part, F.lit("0"))
        return (bare == "") | ((F.length(bare) <= 3) & (bare.try_cast("int") <= 255))

    return F.forall(F.split(match, r"\."), small)


def _iban(match: Column) -> Column:
    def check(compact: Column) -> Column:
        lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
        return (F.element_at(lengths, F.left(compact, F.lit(2))) == F.length(compact)) & passes_mod97(compact)

    return let(F.replace(match, F.lit(" "), F.lit("")), check)


def _ssn(match: Column) -> Column:
    return ~F.rlike(match, F.lit("^(?:000|666|9)|-00-|-0000$"))


# A kind's place here is its rank among spans that start together.
KINDS = (
    # A dot that no domain character follows cannot be part of a domain; as % it can still be part of a name.
    Kind(
        "email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++", "@",
        lambda m: F.lit(True), 0.9, r"\b(?:e-?mail|mail|contact|write|kontakt|correo|courriel)\b",
        mask=(r"\.(?![A-Za-z0-9-])", "%"), base=True,
    ),
    Kind(
        "ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", _parts_in_range, 0.7,
        r"\b(?:ip|host|server|address|login)\b", r"\b(?:version|release|chapter|section)\b", base=True,
    ),
    # A blank or hyphen that is not between two digits ends a number.
    Kind(
        "card", r"[0-9][0-9\x20-]+", r"[0-9][0-9\x20-]{10,}[0-9]", _card, 0.8,
        r"\b(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta)\b", r"\b(?:isbn|order|tracking|serial)\b",
        mask=(r"[\x20-](?![0-9])|(?<![0-9])[\x20-]", "x"), base=True,
    ),
    Kind(
        "phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", _digit_count(9, 15), 0.8,
        r"\b(?:phone|tel|telephone|call|mobile|fax|telefon|móvil)\b", base=True,
    ),
    Kind(
        "card", r"(?<![0-9])[0-9]{13,19}(?![0-9])", r"[0-9]{13}", _card, 0.6,
        r"\b(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta)\b", r"\b(?:isbn|order|tracking|serial)\b",
    ),
    Kind(
        "phone", r"(?<![0-9+(])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])", "[0-9]{3}[)\x20.-]",
        lambda m: F.lit(True), 0.3, r"\b(?:phone|tel|telephone|call|mobile|fax|telefon|móvil)\b",
    ),
    Kind(
        "iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,27}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
        r"[A-Z]{2}[0-9]{2}", _iban, 0.9, r"\b(?:iban|account|konto|compte|cuenta|bank)\b",
    ),
    Kind(
        "ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]{2}-[0-9]", _ssn, 0.3,
        r"\b(?:ssn|social security|taxpayer)\b",
    ),
)


def matches(text: Column, pattern: str) -> Column:
    """``start``, ``end`` (code points, end exclusive) and ``value`` of every match, leftmost first."""
    def place(between: Column, found: Column) -> Column:
        both = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("gap"), found.alias("value"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

        def step(state: Column, one: Column) -> Column:
            begin = state["at"] + F.length(one["gap"])
            end = begin + F.length(one["value"])
            return F.struct(
                end.alias("at"),
                F.concat(
                    state["out"],
                    F.array(F.struct(begin.alias("start"), end.alias("end"), one["value"].alias("value"))),
                ).alias("out"),
            )

        return F.aggregate(both, start, step)["out"]

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(found, lambda f: F.when(F.size(f) > 0, place(F.split(text, pattern), f)).otherwise(
        F.array().cast("array<struct<start:int,end:int,value:string>>")
    ))


def spans_of_kind(text: Column, kind: Kind, rank: int) -> Column:
    """The confirmed spans of one kind, with their scores."""
    def from_masked(masked: Column) -> Column:
        confirmed = F.filter(matches(masked, kind.pattern), lambda m: kind.valid(m["value"]))
        return F.transform(confirmed, score)

    def score(m: Column) -> Column:
        first = F.greatest(m["start"] - BEFORE, F.lit(0))
        near = F.lower(F.concat(
            F.substr(text, first + 1, m["start"] - first), F.lit("\n"), F.substr(text, m["end"] + 1, F.lit(AFTER))
        ))
        value = F.lit(kind.score) + F.when(F.rlike(near, F.lit(kind.supports)), 0.3).otherwise(0.0)
        if kind.opposes:
            value = value - F.when(F.rlike(near, F.lit(kind.opposes)), 0.3).otherwise(0.0)
        return F.struct(
            m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind.name).alias("kind"),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)).alias("score"), F.lit(kind.base).alias("base"),
        )

    masked = F.regexp_replace(text, *kind.mask) if kind.mask else text
    return F.when(F.rlike(text, F.lit(kind.needs)), let(masked, from_masked)).otherwise(F.array().cast(f"array<{SPAN}>"))


def spans(text: Column, kinds: tuple[Kind, ...] = KINDS, least_score: float = LEAST_SCORE) -> Column:
    """All spans of a text by start, then rank; an empty array for a null or empty text."""
    base = [(i, k) for i, k in enumerate(kinds) if k.base]
    more = [(i, k) for i, k in enumerate(kinds) if not k.base]

    def collect(t: Column) -> Column:
        def add(sure: Column) -> Column:
            added = F.concat(*[spans_of_kind(t, k, i) for i, k in more])
            fresh = F.filter(
                added,
                lambda s: (s["score"] >= least_score)
                & ~F.exists(sure, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
            )
            return F.array_sort(F.concat(sure, fresh))

        return let(F.concat(*[spans_of_kind(t, k, i) for i, k in base]), add)

    return let(F.coalesce(text, F.lit("")), collect)


def listed(found: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def find(docs: DataFrame, text: str = "text", output: str = "pii") -> DataFrame:
    """``docs`` with the array of spans in ``output``, which replaces a column of that name.

    A span has ``start``, ``end``, ``kind``, ``score`` and whether it is a base
    span. Texts are read whole. Null and empty texts have no spans; rows keep
    their number and other columns.
    """
    return docs.withColumn(output, spans(F.col(text)))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span's characters replaced by its kind in brackets; of spans that overlap the first.

    A null text stays null.
    """
    def rewrite(found: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

        def step(state: Column, s: Column) -> Column:
            ahead = F.concat(
                state["out"], F.substr(F.col(text), state["at"] + 1, s["start"] - state["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]")
            )
            late = s["start"] < state["at"]
            return F.struct(
                F.when(late, F.greatest(state["at"], s["end"])).otherwise(s["end"]).alias("at"),
                F.when(late, state["out"]).otherwise(ahead).alias("out"),
            )

        return F.aggregate(found, start, step, lambda s: F.concat(s["out"], F.substr(F.col(text), s["at"] + 1)))

    found = spans(F.col(text))
    return docs.withColumn(text, F.when(F.col(text).isNotNull(), let(found, rewrite)))
