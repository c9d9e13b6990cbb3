"""Every registered query of the star against its DuckDB oracle on sf0.001, plus the entry smoke."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.paths import SF_SMALL
from oracle_compare import compare, duck
from starcart import registry

# The star's queries; the corpus operators are checked in their own folder.
QUERIES = registry.queries()
SQL = {k: v for k, v in entry.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    # Rows-only checks are listed here on purpose.
    assert set(QUERIES) - set(SQL) == set(entry.ROWS_ONLY)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, con, name):
    r = compare(spark, SF_SMALL, name, QUERIES[name], SQL[name], con)
    assert r["match"], r


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "recommendation_score" in df.columns
