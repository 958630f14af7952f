"""Vectors that can be compared, and their form in work tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def comparable(vec: Column) -> Column:
    """Not null, with no null, infinite or undefined component."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vec.isNotNull() & fine, F.lit(False))


def one_per_id(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Columns id (long) and vec. Repeated rows count once; of several vectors under one id the first in
    array order stands. Rows without an id or a comparable vector take no part."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where(F.col("id").isNotNull() & comparable(F.col("vec")))
    return rows.groupBy("id").agg(F.min("vec").alias("vec"))


def matrix(blobs, dtype: str) -> np.ndarray:
    """Rows of packed numbers as one matrix."""
    data = b"".join(blobs)
    return np.frombuffer(data, dtype).reshape(len(blobs), -1) if len(blobs) else np.zeros((0, 0), dtype)
