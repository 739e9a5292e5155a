"""Every registered query with SQL against DuckDB on the same tables."""

import duckdb
import pandas as pd
import pytest

from procweave import registry

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        connection.sql(f"create view {name} as select * from '{TABLES}/{name}.parquet'")
    return connection


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted((tuple(None if pd.isna(v) else v for v in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_against_sql(spark, duck, name):
    assert rows(registry.queries()[name](spark, TABLES).toPandas()) == rows(duck.sql(registry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_the_others_run(spark, name):
    assert registry.queries()[name](spark, TABLES).count() > 0
