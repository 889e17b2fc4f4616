"""What the operators on embeddings share: which vectors take part, and Arrow columns as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole(vector: str = "embedding") -> Column:
    """Not null, not zero, every component a finite number."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def common_size(rows: DataFrame, vector: str = "embedding") -> int:
    """The most frequent number of components (the smaller of ties); 0 without vectors."""
    top = rows.groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), "size").first()
    return top["size"] if top else 0


def matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """A list column without nulls as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def unit(rows: np.ndarray) -> np.ndarray:
    largest = np.abs(rows).max(axis=1, keepdims=True)
    scaled = rows / largest
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
