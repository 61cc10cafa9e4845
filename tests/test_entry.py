import duckdb

import __spark_entry__ as entry
from sparkwarden.plans import queries as monitoring


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(monitoring.queries()) <= set(queries) and set(sql) <= set(queries)
    assert len(monitoring.oracle_sql()) >= 55


def test_sql_parses():
    for name, text in monitoring.oracle_sql().items():
        assert duckdb.extract_statements(text), name


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "transaction_id"
