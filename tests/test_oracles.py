"""Every registered query against its SQL, or at least to its end."""

from __future__ import annotations

import __spark_entry__ as contract
import pytest
from compare import differences

QUERIES = contract.queries()
ORACLES = contract.oracle_sql()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, tiny, name):
    assert differences(spark, tiny, QUERIES[name], ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, tiny, name):
    assert QUERIES[name](spark, tiny).collect()


def test_entry(spark):
    df = contract.entry(spark)
    assert "f1" in df.columns
    assert df.collect()
