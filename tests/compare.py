"""Order-insensitive comparison of a Spark result with the SQL counterpart run by DuckDB."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle_connection(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, (int, float)):
        return repr(float(value) + 0.0)
    return str(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def difference(frame, connection, sql):
    """An empty string for equal results, else what differs."""
    spark_names, spark_rows = canonical(frame.columns, frame.collect())
    result = connection.execute(sql)
    sql_names, sql_rows = canonical([c[0] for c in result.description], result.fetchall())
    if spark_names != sql_names:
        return f"columns {spark_names} != {sql_names}"
    if len(spark_rows) != len(sql_rows):
        return f"rows {len(spark_rows)} != {len(sql_rows)}"
    pairs = [(a, b) for a, b in zip(spark_rows, sql_rows) if a != b]
    return f"{len(pairs)} rows differ, first {pairs[0]}" if pairs else ""
