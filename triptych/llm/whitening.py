"""Whitening of vectors: projections on the leading components of the corpus, each with variance one.

Sums and the centred covariance are added up in tasks and combined by Spark; only sums per dimension
and per pair of dimensions reach the driver, whose number the width bounds. There the covariance is
made tridiagonal by Householder reflections, bisection over Sturm counts finds the leading
eigenvalues, inverse iteration the components. The projection is broadcast to all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triptych.llm.integers import rows_of, whole_vectors
from triptych.llm.symmetric import leading_eigenpairs
from triptych.staging import staged

COMPONENTS = 16
# An entry c becomes the whole number floor(64 * c) + 1000000.
SCALE = 64
SHIFT = 1_000_000
# Entries of this size have no 64-bit whole number.
BELOW = 2.0**56
# An eigenvalue below this share of the trace and dimension is rounding, not variance.
NO_VARIANCE = 2.0**-48
DEVIATION = "decimal(38,0)"


@dataclass
class Whitening:
    """n distinct vectors, their sums, components as columns with falling eigenvalues, and the trace."""

    n: int
    total: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def projection(self) -> np.ndarray:
        return self.components / np.sqrt(self.values)


def whiten(
    embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """One row per usable vector: key, n, deviation, whitened, explained, identity_error.

    Entries become whole numbers x. Fitted is on each distinct x vector once: `n` of them with sums
    S. `deviation` is the exact sum of (n * x - S)^2 over the dimensions as decimal(38,0), null where
    it has more digits; `whitened` and `explained` are arrays over the components, numbered by
    falling eigenvalue; `identity_error` is the largest entry by which the covariance of the
    whitened fit vectors differs from the identity. There are as many components as asked for, or
    as have variance; where none has, the arrays are empty and the error is null.

    Vectors that are null, empty, hold null or non-finite entries or entries of 2^56 or more, and
    vectors of another width than the most frequent one are left out. Repeated rows are rows of
    their own, a null key stays null, equal vectors get equal results. Other columns are not read.
    An empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    rows, width = whole_vectors(embeddings.select(key, vector), vector, SCALE, SHIFT, BELOW)
    kind = embeddings.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n bigint, deviation {DEVIATION}, whitened array<double>, explained array<double>, identity_error double"
    if not width:
        return spark.createDataFrame([], schema)
    vectors = staged(rows.select("x").distinct(), "whitening-fit")
    model = fit(vectors, width, components)
    error = identity_error(vectors, width, model)
    shared = spark.sparkContext.broadcast((model.n, model.total, model.projection))
    explained = (model.values / model.trace).tolist()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, projection = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            offset = centred(rows_of(batch.column(1), width), n, total)
            whitened = offset.astype(np.float64) / n @ projection
            deviation = [s if s < 10**38 else None for s in square_sums(offset)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n] * len(whitened), pa.int64()),
                    pa.array(deviation, pa.decimal128(38, 0)),
                    pa.array(list(whitened), pa.list_(pa.float64())),
                    pa.array([explained] * len(whitened), pa.list_(pa.float64())),
                    pa.array([error] * len(whitened), pa.float64()),
                ],
                [key, "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select(key, "x").mapInArrow(project, schema)


def fit(vectors: DataFrame, width: int, components: int) -> Whitening:
    """The model of the distinct vectors `x`: exact sums first, then the covariance centred by them."""
    n, total = exact_sums(vectors, width)
    covariance = products(vectors, width, lambda x: centred(x, n, total).astype(np.float64) / n) / n
    trace = float(np.trace(covariance))
    values, found = leading_eigenpairs(covariance, min(components, width))
    some = int((values > trace * width * NO_VARIANCE).sum()) if trace > 0 else 0
    return Whitening(n, total, found[:, :some], values[:some], trace)


def identity_error(vectors: DataFrame, width: int, model: Whitening) -> float | None:
    """The largest entry of the covariance of the whitened vectors less the identity, in size."""
    some = len(model.values)
    if not some:
        return None
    n, total, projection = model.n, model.total, model.projection
    whitened = products(vectors, width, lambda x: centred(x, n, total).astype(np.float64) / n @ projection, some)
    return float(np.abs(whitened / n - np.eye(some)).max())


def exact_sums(vectors: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for batch in batches:
            if batch.num_rows:
                x = rows_of(batch.column(0), width)
                high, low = (x >> 20).sum(axis=0).tolist(), (x & 0xFFFFF).sum(axis=0).tolist()
                n, total = n + len(x), [t + (a << 20) + b for t, a, b in zip(total, high, low)]
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(width + 1), pa.int32()), pa.array([*total, n], pa.decimal128(38, 0))], ["at", "total"]
            )

    parts = vectors.select("x").mapInArrow(add, f"at int, total {DEVIATION}")
    found = {r.at: int(r.total) for r in parts.groupBy("at").agg(F.sum("total").alias("total")).collect()}
    return found[width], [found[i] for i in range(width)]


def products(vectors: DataFrame, width: int, centre, size: int | None = None) -> np.ndarray:
    """Sum over all vectors of the products of each two centred entries."""
    size = size or width
    first, second = np.triu_indices(size)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((size, size)), 0
        for batch in batches:
            if batch.num_rows:
                z = centre(rows_of(batch.column(0), width))
                total += z.T @ z
                rows += len(z)
        if rows:
            at = np.arange(len(first), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[first, second])], ["at", "total"])

    parts = vectors.select("x").mapInArrow(add, "at int, total double")
    out = np.zeros((size, size))
    for r in parts.groupBy("at").agg(F.sum("total").alias("total")).collect():
        out[first[r.at], second[r.at]] = out[second[r.at], first[r.at]] = r.total
    return out


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n * x - S exactly: in 64-bit numbers where they are wide enough, else in Python's."""
    if n * max(int(x.max()), -int(x.min())) + max(map(abs, total)) < 1 << 62:
        return n * x - np.array(total, dtype=np.int64)
    return n * x.astype(object) - np.array(total, dtype=object)


def square_sums(offset: np.ndarray) -> list[int]:
    """The exact sum of squares of each row."""
    if offset.dtype == object or max(int(offset.max()), -int(offset.min())) >= 1 << 56:
        return [sum(v * v for v in row) for row in offset.tolist()]
    sums = [0] * len(offset)
    for first in range(0, offset.shape[1], 64):
        # Halves of 28 bits: their products, 64 at a time, are in the range of 64-bit numbers.
        high, low = offset[:, first : first + 64] >> 28, offset[:, first : first + 64] & 0xFFFFFFF
        parts = [(a * b).sum(axis=1).tolist() for a, b in ((high, high), (high, low), (low, low))]
        sums = [s + (hh << 56) + (hl << 29) + ll for s, hh, hl, ll in zip(sums, *parts)]
    return sums
