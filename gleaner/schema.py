"""Table schemas. Strings are UTF-8 throughout; lists are native arrays, not JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampNTZType(),
    "strings": T.ArrayType(T.StringType()),
    "doubles": T.ArrayType(T.DoubleType()),
}


def _struct(**columns: str | T.DataType) -> T.StructType:
    return T.StructType(
        [T.StructField(n, _TYPES[t] if isinstance(t, str) else t) for n, t in columns.items()]
    )


QUOTE_CHECK = _struct(quote="string", verdict="string", in_page="boolean", in_extraction="boolean")

PAGES = _struct(
    url="string", domain="string", title="string", html_text="string", created_at="timestamp"
)
GOLD = _struct(url="string", gold_text="string", created_at="timestamp")

METRIC_GROUP = ("precision_val", "recall_val", "f1", "cosine", "jaccard", "excess_ratio")
JUDGE_GROUP = ("judge_score",)
EVALUATIONS = _struct(
    url="string", **{m: "double" for m in METRIC_GROUP}, judge_score="int", updated_at="timestamp"
)

RUNS = _struct(
    run_id="long",
    label="string",
    model_name="string",
    provider="string",
    condition_name="string",
    budget_tokens="int",
    eur_per_usd="double",
    measured_cost_eur="double",
    created_at="timestamp",
)

# Columns of a page of a run as first shipped, then each later addition in order.
PAGE_RESULTS_V1 = _struct(
    url="string",
    domain="string",
    status="string",
    input_tokens="int",
    html_kb="int",
    seconds="double",
    chars="int",
    **{m: "double" for m in METRIC_GROUP},
    extracted_count="int",
    sample_count="int",
    parsed_text="string",
    note="string",
)
PAGE_RESULTS_LATER = _struct(
    cpu_seconds="double",
    fragments="int",
    empty_fragments="int",
    cost_usd="double",
    cost_eur="double",
    call_costs_usd="doubles",
    prompt_tokens="int",
    completion_tokens="int",
    grounded="double",
    check_complete="boolean",
    check_coherent="boolean",
    check_notes="string",
    check_fragments="int",
    check_cost_eur="double",
    providers="strings",
    generation_ids="strings",
    check_coherence="int",
    check_coherence_evidence="string",
    check_claimed_missing="strings",
    check_quote_verdicts=T.ArrayType(QUOTE_CHECK),
    check_omissions="int",
)
PAGE_RESULTS_COLUMNS = T.StructType([*PAGE_RESULTS_V1.fields, *PAGE_RESULTS_LATER.fields])
PAGE_RESULTS = T.StructType([T.StructField("run_id", T.LongType()), *PAGE_RESULTS_COLUMNS.fields])

GOLD_ENTRY = _struct(
    url="string", domain="string", title="string", html_text="string", gold_text="string"
)

_CALLS = {
    "call_costs_usd": "doubles",
    "cost_usd": "double",
    "cost_eur": "double",
    "prompt_tokens": "int",
    "completion_tokens": "int",
    "providers": "strings",
    "generation_ids": "strings",
}
RUN_RECORD = _struct(
    url="string",
    domain="string",
    input_tokens="int",
    html_kb="int",
    status="string",
    budget_tokens="int",
    seconds="double",
    cpu_seconds="double",
    chars="int",
    fragments="int",
    empty_fragments="int",
    **_CALLS,
    grounded="double",
    precision="double",
    recall="double",
    f1="double",
    cosine="double",
    jaccard="double",
    excess_ratio="double",
    extracted_count="int",
    sample_count="int",
    parsed_text="string",
    raw_responses="strings",
    error="string",
)
RUN_FILE = _struct(
    model="string",
    provider="string",
    provider_pinned="string",
    condition="string",
    budget_tokens="int",
    chunking="boolean",
    eur_per_usd="double",
    records=T.ArrayType(RUN_RECORD),
)
CHECK_RESULT = _struct(
    url="string",
    domain="string",
    f1="double",
    recall="double",
    precision="double",
    grounded="double",
    parse_fragments="int",
    status="string",
    seconds="double",
    coherence="int",
    coherence_evidence="string",
    coherent="boolean",
    coherent_by_score="boolean",
    complete="boolean",
    claimed_missing="strings",
    quote_checks=T.ArrayType(QUOTE_CHECK),
    omissions="int",
    notes="string",
    check_fragments="int",
    **_CALLS,
    per_fragment=T.ArrayType(_struct(coherence="int", missing="strings", notes="string")),
    error="string",
)
CHECK_FILE = _struct(
    model="string",
    provider="string",
    provider_pinned="string",
    source_run="string",
    condition="string",
    budget_tokens="int",
    eur_per_usd="double",
    results=T.ArrayType(CHECK_RESULT),
)
SEED_FILE = _struct(
    label="string",
    model_name="string",
    provider="string",
    condition_name="string",
    budget_tokens="int",
    eur_per_usd="double",
    measured_cost_eur="double",
    created_at="string",
    pages=T.ArrayType(PAGE_RESULTS_COLUMNS),
)


def run_id_of(label: Column) -> Column:
    """A run is its label; the id follows from it, so no counter is needed."""
    return F.xxhash64(label)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Known columns in order and type, unknown ones dropped, missing ones NULL."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
