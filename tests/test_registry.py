"""Every registered query against its SQL, on the smallest tables."""

import datetime
import math

import pytest

from gavelspark import registry
from gavelspark.registry.fixtures import TABLES

registry.load_all()

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def database(tables):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from read_parquet('{tables}/{name}.parquet')")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return f"{type(value).__name__}:{value}"


def compared(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, tables, database, name):
    result = registry.QUERIES[name](spark, tables)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    cursor = database.execute(registry.ORACLES[name])
    expected = compared([d[0] for d in cursor.description], cursor.fetchall())
    assert compared(result.columns, result.collect()) == expected


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_other_queries_return_rows(spark, tables, name):
    assert registry.QUERIES[name](spark, tables).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 21
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_report_holds_source_text(spark, tables):
    """Metric, gate, drift and stream reports carry no text column."""
    for name in ("moderated_stream", "shadow_report", "canary_report", "error_taxonomy", "gate_checks", "candidate_evidence"):
        columns = registry.QUERIES[name](spark, tables).columns
        assert not {"text", "content", "prompt", "response", "user_input"} & set(columns)
