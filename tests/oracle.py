"""Compares a Spark result with DuckDB's, value by value."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

from tallyhouse.sources.tables import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return db


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        number = float(value)
        return None if math.isnan(number) else float(f"{number:.12g}")
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in values), key=repr)


def compare(spark_df, db, sql):
    """Raise AssertionError with the first difference."""
    relation = db.sql(sql)
    expected_columns, found_columns = relation.columns, spark_df.columns
    assert sorted(expected_columns) == sorted(found_columns), (sorted(found_columns), sorted(expected_columns))
    expected = rows(expected_columns, relation.fetchall())
    found = rows(found_columns, [tuple(r) for r in spark_df.collect()])
    assert len(expected) == len(found), f"{len(found)} rows, expected {len(expected)}"
    for mine, theirs in zip(found, expected):
        assert mine == theirs, f"{mine} != {theirs}"
    return len(found), {c: str(t) for c, t in zip(expected_columns, relation.types)}, dict(spark_df.dtypes)
