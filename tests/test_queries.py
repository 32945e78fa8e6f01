"""Every registered query against its DuckDB statement, on the smallest tables."""

import pytest
from conftest import DATA, rows_of, rows_of_sql

from vellum.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    if name not in SQL:
        assert df.count() > 0
        return
    names, want = rows_of_sql(duck, SQL[name])
    assert sorted(df.columns) == names
    assert rows_of(df) == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
