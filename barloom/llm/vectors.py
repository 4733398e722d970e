"""Vectors as rows: which ones take part, and exact cosines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dimension(df: DataFrame, vector: str) -> int:
    """The most frequent length of a vector (of equally frequent ones the least); 0 without any."""
    row = (
        df.where(F.size(vector) > 0)
        .groupBy(F.size(vector).alias("d"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "d")
        .first()
    )
    return row.d if row else 0


def usable(vector: str, dim: int) -> Column:
    """Not null, of the given length, no null or non-finite component, not all zero."""
    v = F.col(vector).cast("array<double>")
    sane = F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= F.lit(1.7976931348623157e308))
    )
    return F.coalesce((F.size(v) == dim) & sane & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, max(dim, 1))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled by the largest component first, so nothing overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True) if len(x) else x
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)) if len(x) else x


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of paired rows, summed in a fixed order: equal vectors give equal scores wherever
    they are computed."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    y = y / np.abs(y).max(axis=1, keepdims=True)
    top = (x * y).sum(axis=1)
    return top / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
