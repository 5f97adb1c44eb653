"""Every registered query against its DuckDB oracle at sf0.001 (the driver checks sf0.01)."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as E
from tools.check_oracle import TABLES, digest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(E.QUERY_NAMES) <= set(E.queries()) & set(E.oracle_sql())
    assert len(E.QUERY_NAMES) == len(set(E.QUERY_NAMES)) >= 26


@pytest.mark.parametrize("name", list(E.QUERY_NAMES))
def test_parity(spark, duck, name):
    got = digest(E.queries()[name](spark, SF).toPandas())
    want = digest(duck.execute(E.oracle_sql()[name]).df())
    assert got[1] == want[1], "columns differ"
    assert got[0] == want[0], "row counts differ"
    assert got == want


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert [f.name for f in df.schema.fields] == [
        "task", "job_day", "batch_guid", "job_date", "total_jobs", "metric", "completed_count",
        "percentage", "pending_for_target", "sla_order", "unfinished_count"]


_SPARK_TO_DUCK = {"IntegerType()": "INTEGER", "LongType()": "BIGINT", "StringType()": "VARCHAR",
                  "DoubleType()": "DOUBLE", "TimestampNTZType()": "TIMESTAMP", "BooleanType()": "BOOLEAN"}


def test_column_types_match(spark, duck):
    for name, fn in ((n, E.queries()[n]) for n in E.QUERY_NAMES):
        got = {f.name: _SPARK_TO_DUCK.get(repr(f.dataType), repr(f.dataType)) for f in fn(spark, SF).schema.fields}
        rel = duck.sql(E.oracle_sql()[name])
        assert got == dict(zip(rel.columns, map(str, rel.types))), name
