from __future__ import annotations

import random

import pytest
from llm_helpers import prose

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd_rows():
    """Ordinary texts beside nulls, empty and long ones, copies, ties and repeated rows."""
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randint(1, 120)), "en", f"s{i % 3}", 1) for i in range(40)]
    rows += [(100 + i, rows[i][1], "en", rows[i][3], 1) for i in range(6)]
    rows += [(200 + i, rows[20][1] + f" extra{i}", "de", "s0", 1) for i in range(4)]
    rows += [(300, None, None, None, None), (301, "", "fr", "s1", 0), (302, " \n\t ", "fr", None, 3), (None, "no id here", "en", "s2", 10)]
    rows += [(303, prose(rng, 30_000), "en", "s1", 1), (304, "x" * 60_000, "en", "s2", 1), (305, "\n" * 500, "en", "s2", 1)]
    rows += [(5, rows[5][1], "en", rows[5][3], 1)] * 2
    return rows


@pytest.fixture
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)
