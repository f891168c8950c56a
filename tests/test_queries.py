"""Every registered query runs; those with SQL give the same rows in DuckDB."""

import math

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from workload.oracles import ORACLES
from workload.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def value(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v)
        return repr(v)

    return [columns[i] for i in order], sorted(tuple(value(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    assert rows
    if name in ORACLES:
        cursor = duck.execute(ORACLES[name])
        columns = [d[0] for d in cursor.description]
        assert canonical(df.columns, rows) == canonical(columns, cursor.fetchall())


def test_oracles_belong_to_queries():
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql()) <= set(queries())
    assert set(QUERIES) - set(ORACLES) == {"train_lr_metrics", "train_summary"}


def test_entry(spark):
    assert entry(spark).count() == 3


def test_scan_reads_only_what_is_needed(spark, sf):
    plan = QUERIES["flagship_goal_coverage"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string,lang:string>" in plan
    assert "CartesianProduct" not in plan and "SortMergeJoin" not in plan
