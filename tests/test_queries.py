"""Every registered query against its SQL, on the small tables."""

import duckdb
import pytest

from tallyward.plans.oracles import ORACLES
from tallyward.plans.queries import REGISTRY

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def engine(tables):
    connection = duckdb.connect()
    for name in NAMES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tables}/{name}.parquet'")
    return connection


def ordered(rows, columns):
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(row[i]) for i in places) for row in rows)


def test_each_query_has_sql():
    assert set(ORACLES) == set(REGISTRY)


def test_each_query_reads_a_table(spark, tables):
    plan = REGISTRY["dq_required_columns"](spark, tables)._jdf.queryExecution().toString()
    assert "FileScan parquet" in plan


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_equals_sql(spark, tables, engine, name):
    df = REGISTRY[name](spark, tables)
    rows = df.collect()
    if name not in ORACLES:
        assert rows
        return
    result = engine.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert ordered(rows, df.columns) == ordered(result.fetchall(), columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 12
    assert set(entry.oracle_sql()) <= set(entry.queries())
