"""Pages of rows and of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegraph.operators.positions import ROW_ID

PAGE_DEFAULT = 50
PAGE_MOST = 500
SESSIONS_DEFAULT = 20
SESSIONS_MOST = 100

# The page sizes of the views over a table.
PREVIEW_ROWS = 5
DRILL_ROWS = 60
EXPLORER_ROWS = 25
SESSION_LIST_ROWS = 50


def _check(offset: int, limit: int, most: int) -> None:
    if offset < 0:
        raise ValueError("offset must not be negative")
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be between 1 and {most}")


def read_page(df: DataFrame, offset: int = 0, limit: int = PAGE_DEFAULT) -> DataFrame:
    """Rows ``offset`` to ``offset + limit - 1`` of a stored table, in order.

    A range of ``_row_id`` that reaches the Parquet scan, so only row groups
    holding the page are read; past the end the page is empty. The limit tells
    the planner how few rows are left to sort.
    """
    _check(offset, limit, PAGE_MOST)
    wanted = (F.col(ROW_ID) >= offset) & (F.col(ROW_ID) < offset + limit)
    return df.where(wanted).orderBy(ROW_ID).limit(limit)


def page_info(df: DataFrame, offset: int = 0, limit: int = PAGE_DEFAULT, total: int | None = None) -> DataFrame:
    """Total rows, first and last row shown (from 1), and whether pages lie before and after.

    The catalog's row count spares counting the table.
    """
    _check(offset, limit, PAGE_MOST)
    if total is None:
        counted = df.agg(F.count("*").alias("total_rows"))
    else:
        counted = df.sparkSession.range(1).select(F.lit(total).cast("bigint").alias("total_rows"))
    rows = F.col("total_rows")
    end = F.least(F.lit(offset + limit).cast("bigint"), rows)
    return counted.select(
        F.lit(offset).cast("bigint").alias("offset"),
        F.lit(limit).cast("bigint").alias("limit"),
        rows,
        F.when(rows > offset, F.lit(offset + 1).cast("bigint")).alias("first_row"),
        F.when(rows > offset, end).alias("last_row"),
        F.lit(offset > 0).alias("has_previous"),
        (rows > offset + limit).alias("has_next"),
    )


def session_total(sessions: DataFrame) -> DataFrame:
    return sessions.agg(F.count("*").alias("total"))


def session_page(sessions: DataFrame, limit: int = SESSIONS_DEFAULT, offset: int = 0) -> DataFrame:
    """A page of sessions, newest first, each row carrying the total beside it.

    Only the first ``offset + limit`` sessions of each partition leave it.
    """
    _check(offset, limit, SESSIONS_MOST)
    page = sessions.orderBy(F.desc("created_at"), "session_id").offset(offset).limit(limit)
    return page.withColumn("total", session_total(sessions).scalar())
