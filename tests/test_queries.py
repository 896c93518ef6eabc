"""Every registered query against its SQL equivalent, at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of, sql_rows
from tracehold.plans import queries as plans

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def connection(small):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, small, connection, name):
    frame = QUERIES[name](spark, small)
    columns, expected = sql_rows(connection, ORACLES[name])
    assert sorted(frame.columns) == columns
    assert rows_of(frame) == expected


@pytest.mark.parametrize("name", ["json_array_logs", "python_literal_logs", "broken_tail_logs", "file_errors"])
def test_array_files_grow_in_number(spark, small, connection, name, monkeypatch):
    written, folder = [], plans.new_folder
    monkeypatch.setattr(plans, "ARRAY_LOGS", 16, raising=False)
    monkeypatch.setattr(plans, "new_folder", lambda *a: written.append(folder(*a)) or written[-1])
    frame = QUERIES[name](spark, small)
    assert rows_of(frame) == sql_rows(connection, ORACLES[name])[1]
    files = spark.read.text(written[0], wholetext=True, recursiveFileLookup=True)
    assert files.count() > 13 and max(r.value.count("processId") for r in files.collect()) <= 16


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 22
