"""Compare a Spark result with DuckDB's, as multisets of rows."""

import math
from collections import Counter
from pathlib import Path

import duckdb


def _value(value):
    return "NaN" if isinstance(value, float) and math.isnan(value) else value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(row[i]) for i in order) for row in rows)


def differences(result, sql, sf_dir):
    """Rows that only one of the two has: (only Spark, only SQL)."""
    with duckdb.connect() as connection:
        for path in Path(sf_dir).glob("*.parquet"):
            # A table is a file, or a folder of files as Spark writes it.
            files = f"{path}/*.parquet" if path.is_dir() else path
            connection.execute(f"create view {path.stem} as select * from read_parquet('{files}')")
        relation = connection.sql(sql)
        assert sorted(relation.columns) == sorted(result.columns)
        expected = _rows(relation.columns, relation.fetchall())
    actual = _rows(result.columns, result.collect())
    return actual - expected, expected - actual
