"""Run a registered query and its SQL side by side and report the first difference."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal

import duckdb

from tablegraph.workload.data import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        return value.replace(tzinfo=None)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark_df, con, sql: str) -> tuple[int, str | None]:
    """Row count and a description of the difference, None when there is none."""
    expected = con.execute(sql)
    names = [column[0] for column in expected.description]
    want = rows_of(names, expected.fetchall())
    got_rows = spark_df.collect()
    if sorted(names) != sorted(spark_df.columns):
        return len(got_rows), f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    got = rows_of(spark_df.columns, got_rows)
    if got != want:
        return len(got_rows), f"only spark: {list((got - want).items())[:3]} only sql: {list((want - got).items())[:3]}"
    return len(got_rows), None
