"""Every query with SQL gives the same rows and types as the SQL."""

import __spark_entry__ as entry
import pytest
from oracle_check import compare

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, spark, sf, duck):
    assert compare(QUERIES[name](spark, sf), duck, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(name, spark, sf):
    assert QUERIES[name](spark, sf).collect()


def test_entry_ranks_models(spark):
    rows = entry.entry(spark).collect()
    assert [r["rank"] for r in rows] and {r["model"] for r in rows} == {"ridge", "naive_persistence"}
