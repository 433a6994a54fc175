"""Columns that read model replies: cleaning, verdicts, tolerant JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import (
    BUDGETS,
    CHECK_BAD_JSON,
    CHECK_CUT,
    CHECK_WITHOUT_JSON,
    FINISH_TRUNCATED,
    JUDGE_BAD_JSON,
    JUDGE_WITHOUT_JSON,
    NOTHING_HERE,
    THRESHOLDS,
    Thresholds,
)
from .basic import SPACE_CLASS, Columnish, as_column, let, strip

# What wraps a reply.
THINK = r"(?is)<think>.*?</think>"
FENCE = rf"(?s)\A[{SPACE_CLASS}]*```[a-zA-Z]*[{SPACE_CLASS}]*\n(.*)\n[{SPACE_CLASS}]*```[{SPACE_CLASS}]*\z"
JSON_OBJECT = r"(?s)\{.*\}"

STRICT_JSON = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}
CHECK_TYPE = (
    "struct<coherent:boolean,coherence:int,coherence_evidence:string,"
    "missing:array<string>,notes:string>"
)


def clean_reply(raw: Columnish) -> Column:
    """Drop reasoning blocks and one fence around the whole answer, nothing else."""
    def unfence(text: Column) -> Column:
        return F.when(F.rlike(text, F.lit(FENCE)), strip(F.regexp_extract(text, FENCE, 1))).otherwise(text)

    return let(strip(F.regexp_replace(as_column(raw), THINK, "")), unfence)


def _is_nothing_word(text: Column) -> Column:
    return F.lower(F.btrim(strip(text), F.lit("."))) == NOTHING_HERE.lower()


def clean_fragment_reply(raw: Columnish) -> Column:
    """A cleaned reply; the agreed word for "no content here" becomes ''."""
    return let(clean_reply(raw), lambda t: F.when(_is_nothing_word(t), F.lit("")).otherwise(t))


def says_nothing(text: Columnish) -> Column:
    column = as_column(text)
    return (strip(column) == "") | _is_nothing_word(column)


def _json_object(raw: Column) -> Column:
    """The widest {...} outside reasoning blocks, or NULL."""
    return F.nullif(F.regexp_extract(F.regexp_replace(raw, THINK, ""), JSON_OBJECT, 0), F.lit(""))


def _fields(json: Column) -> Column:
    """Top-level fields as text, NULL unless the whole string is one JSON object.

    The parser stops after the first value; reading the text as the only item
    of a list makes anything that follows count.
    """
    def only_item(listed: Column) -> Column:
        items = F.from_json(listed, "array<map<string,string>>", STRICT_JSON)
        return F.when(F.try_parse_json(listed).isNotNull() & (F.size(items) == 1), items[0])

    return let(F.concat(F.lit("["), json, F.lit("]")), only_item)


def _whole_number(json: Column, fields: Column, key: str) -> Column:
    """An integer field: a number is cut towards zero, a quoted one must be whole."""
    text = strip(F.try_element_at(fields, F.lit(key)))
    quoted = F.rlike(json, F.lit(rf'"{key}"\s*:\s*"'))
    number = F.when(text == "true", F.lit(1)).when(text == "false", F.lit(0)).otherwise(
        text.try_cast("double").try_cast("int")
    )
    return F.when(quoted & ~F.rlike(text, F.lit(r"^[+-]?\d+$")), F.lit(None).cast("int")).otherwise(number)


def _clamp(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def _excerpt(prefix: str, text: Column, limits: Thresholds) -> Column:
    return F.concat(F.lit(prefix), F.substring(text, 1, limits.reply_excerpt))


def parse_judge(raw: Columnish, limits: Thresholds = THRESHOLDS) -> Column:
    """struct<judge_score:int, judge_feedback:string>; an unreadable reply scores 1."""
    reply = as_column(raw)

    def verdict(score: Column, feedback: Column) -> Column:
        return F.struct(score.cast("int").alias("judge_score"), feedback.alias("judge_feedback"))

    def read(json: Column) -> Column:
        def with_fields(fields: Column) -> Column:
            score = _whole_number(json, fields, "score")
            complete = (
                fields.isNotNull()
                & score.isNotNull()
                & F.map_contains_key(fields, F.lit("feedback"))
            )
            feedback = F.coalesce(F.try_element_at(fields, F.lit("feedback")), F.lit("None"))
            return (
                F.when(
                    json.isNull(),
                    verdict(F.lit(1), _excerpt(JUDGE_WITHOUT_JSON, reply, limits)),
                )
                .when(F.coalesce(complete, F.lit(False)), verdict(_clamp(score, 1, 5), feedback))
                .otherwise(verdict(F.lit(1), _excerpt(JUDGE_BAD_JSON, json, limits)))
            )

        return let(_fields(json), with_fields)

    return let(_json_object(reply), read)


def parse_check(
    raw: Columnish, finish_reason: Columnish | None = None, limits: Thresholds = THRESHOLDS
) -> Column:
    """A self-check verdict as ``CHECK_TYPE``.

    An unreadable reply is incoherent with score 0 and no quotes, and says in
    its notes whether it was cut at the answer ceiling or badly formed. Of the
    quotes the first ``limits.max_quotes`` are kept, or all.
    """
    reply = as_column(raw)
    finish = F.lit("") if finish_reason is None else F.coalesce(as_column(finish_reason), F.lit(""))

    def verdict(coherent, coherence, evidence, missing, notes) -> Column:
        return F.struct(
            coherent.alias("coherent"),
            coherence.cast("int").alias("coherence"),
            evidence.alias("coherence_evidence"),
            missing.alias("missing"),
            notes.alias("notes"),
        )

    def unusable(notes: Column) -> Column:
        return verdict(
            F.lit(False), F.lit(0), F.lit(""), F.array().cast("array<string>"), notes
        )

    def read(json: Column) -> Column:
        def with_fields(fields: Column) -> Column:
            def field(key: str) -> Column:
                return F.try_element_at(fields, F.lit(key))

            def present(key: str) -> Column:
                return F.map_contains_key(fields, F.lit(key))

            coherence = _whole_number(json, fields, "coherence")
            complete = fields.isNotNull() & coherence.isNotNull() & present("coherent") & present("notes")
            falsy = ("", "false", "0", "0.0", "[]", "{}")
            coherent = F.coalesce(~field("coherent").isin(*falsy), F.lit(False))
            missing = F.coalesce(json_list(field("missing")), F.array().cast("array<string>"))
            kept = missing if limits.max_quotes is None else F.slice(missing, 1, limits.max_quotes)
            missing = F.transform(kept, lambda q: F.coalesce(q, F.lit("None")))
            ceiling = CHECK_CUT.format(tokens=BUDGETS.check_answer_tokens)
            return (
                F.when(
                    json.isNull() & (finish == FINISH_TRUNCATED), unusable(_excerpt(ceiling, reply, limits))
                )
                .when(json.isNull(), unusable(_excerpt(CHECK_WITHOUT_JSON, reply, limits)))
                .when(
                    F.coalesce(complete, F.lit(False)),
                    verdict(
                        coherent,
                        _clamp(coherence, 0, limits.coherence_max),
                        F.coalesce(field("coherence_evidence"), F.lit("")),
                        missing,
                        F.coalesce(field("notes"), F.lit("None")),
                    ),
                )
                .otherwise(unusable(_excerpt(CHECK_BAD_JSON, json, limits)))
            )

        return let(_fields(json), with_fields)

    return let(_json_object(reply), read)


def json_list(text: Columnish, element_type: str = "string") -> Column:
    """A JSON text as an array; NULL, broken or anything but a list becomes []."""
    column = as_column(text)
    is_list = F.startswith(F.ltrim(column), F.lit("[")) & F.try_parse_json(column).isNotNull()
    empty = F.array().cast(f"array<{element_type}>")
    return F.coalesce(
        F.when(is_list, F.from_json(column, f"array<{element_type}>", STRICT_JSON)), empty
    )
