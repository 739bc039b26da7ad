"""Every query with a SQL check, against DuckDB at the smallest scale."""

import pytest

import __spark_entry__ as entry
from tests.harness import DATA, compare, connect

SF = "0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert name in QUERIES
    assert compare(QUERIES[name](spark, DATA.format(SF)), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(n for n in set(QUERIES) - set(SQL) if n != "pipeline" and not n.startswith("op")))
def test_rows_only(spark, name):
    df = QUERIES[name](spark, DATA.format(SF))
    assert len(df.collect()) > 0


def test_entry(spark):
    rows = {r["dataset"]: r for r in entry.entry(spark).collect()}
    parts = [r for k, r in rows.items() if k != "ALL"]
    for c in ("n_rows", "rows_multi", "leaked_modulo", "leaked_contiguous", "leaked_position_groupkfold"):
        assert rows["ALL"][c] == sum(r[c] for r in parts)
