"""Broadcast hints behind a measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of narrow query-side data every task may hold.
SMALL_ROWS = 1_000_000


def is_small(df: DataFrame, rows: int = SMALL_ROWS) -> bool:
    """Does ``df`` have at most ``rows`` rows? Counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def small_side(df: DataFrame, measured: bool) -> DataFrame:
    """``df`` with a broadcast hint if its size was measured as small, else as it is, which leaves
    the join to adaptive execution with its skew handling."""
    return F.broadcast(df) if measured else df
