"""Every query with SQL gives the rows that DuckDB gives; the others give rows."""

import pytest
from compare import rows_of, rows_of_sql, same
from feldspark.plans import queries


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_sql(spark, duck, sf_dir, name):
    columns, got = rows_of(queries.QUERIES[name](spark, sf_dir))
    sql_columns, want = rows_of_sql(duck, queries.ORACLE[name])
    assert columns == sql_columns
    assert same(got, want)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLE])
def test_rows(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
