"""Size checks that decide between a broadcast or window and the general way."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# a narrow table of this many rows is some tens of MB on each executor
BROADCAST_ROWS = 200_000
# a group of this many narrow rows sorts inside one task
WINDOW_ROWS = 1_000_000
# distinct values that may become columns
PIVOT_VALUES = 1_000


def row_count(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]


def small_side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Marked for broadcast if its row count is known to be small; otherwise left
    to a shuffled join, where adaptive execution splits hot keys."""
    n = row_count(df) if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def column_values(df: DataFrame, column: str, limit: int = PIVOT_VALUES) -> list:
    """Sorted distinct values that will become columns; refuses an unbounded set."""
    found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"{column} has more than {limit} values; use the long form")
    return sorted(found)
