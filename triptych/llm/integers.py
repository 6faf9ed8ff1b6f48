"""Vectors of whole numbers: usable rows, exact integers of their entries, blocks for NumPy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole_vectors(vectors: DataFrame, column: str, scale: int, shift: int, below: float) -> tuple[DataFrame, int]:
    """The usable rows with the column `x` array<bigint> of floor(scale * c) + shift, and its width.

    Left out are vectors that are null, empty, or hold null or non-finite entries or entries of
    `below` or more in size, which have no exact integer here; also those of another width than the
    most frequent one (of several the largest).
    """
    entry = F.col(column).cast("array<double>")
    fits = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(below)))
    usable = vectors.where(F.col(column).isNotNull() & (F.size(column) > 0) & F.coalesce(fits, F.lit(False)))
    widths = usable.groupBy(F.size(column).alias("width")).count()
    most = widths.orderBy(F.desc("count"), F.desc("width")).first()
    width = most.width if most else 0
    whole = F.transform(entry, lambda c: F.floor(c * F.lit(float(scale))) + F.lit(shift).cast("bigint"))
    return usable.where(F.size(column) == width).withColumn("x", whole), width


def rows_of(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of one width as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
