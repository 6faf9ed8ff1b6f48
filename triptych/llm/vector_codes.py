"""Vectors as short codes: for each part of a vector the nearest entry of that part's codebook.

Everything is whole numbers. Parts and entries are padded with zeros to a power of two m and go
through an integer Walsh-Hadamard transform, after which squared distances are m times as large. The
squared differences of the transformed numbers are added up in sequency order, which puts what most
tells entries apart first; an entry whose sum already exceeds the distance of a known entry is out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triptych.llm.integers import rows_of, whole_vectors
from triptych.staging import staged

# A component c becomes the whole number floor(256 * c).
SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
# Squared distances of vectors with components of this size may pass 64 bits.
BELOW = 2.0**17
# Vectors whose distances to all entries of a codebook are held at a time.
BLOCK = 1024

Codebooks = list[np.ndarray]


def compress(
    embeddings: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    keep: tuple[str, ...] = (),
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> tuple[DataFrame, Codebooks]:
    """One row per usable vector (key, the columns to keep, code, error), and the codebooks.

    `code` is binary, a byte for the entry of each part in order; `error` is the squared distance of
    the vector from what its code says. Vectors are cut into equal consecutive `parts`; the codebook
    of a part starts as that part of the vectors with the smallest keys (`entries` of them, 256 at
    most; null keys come last, equal keys in the order of their vectors). Each round assigns all
    parts to their nearest entries, of equally near ones the first, and replaces an entry by the
    mean of its parts, rounded down; an entry without parts stays.

    Vectors that are null, empty, hold null or non-finite components or components of 2^17 or more,
    and vectors of another width than the most frequent one are left out. Repeated rows are rows of
    their own. Other columns are not read. An empty table gives an empty result and no codebooks.
    A width that `parts` does not divide is an error.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has a byte for each part: between 1 and 256 entries")
    rows, width = whole_vectors(embeddings.select(key, vector, *keep), vector, SCALE, 0, BELOW)
    kinds = [f"`{name}` {embeddings.schema[name].dataType.simpleString()}" for name in (key, *keep)]
    schema = ", ".join([*kinds, "code binary", "error bigint"])
    if not width:
        return embeddings.sparkSession.createDataFrame([], schema), []
    if width % parts:
        raise ValueError(f"{parts} equal parts do not make up a vector of {width} components")
    rows = rows.select(key, *keep, "x")
    codebooks = first_entries(rows.select(key, "x"), key, width, parts, entries)
    for _ in range(rounds):
        codebooks = moved(rows.select("x"), codebooks, width)
    return encode(rows, codebooks, width, schema), codebooks


def first_entries(rows: DataFrame, key: str, width: int, parts: int, entries: int) -> Codebooks:
    """The codebooks that the vectors with the smallest keys make up."""
    first = rows.orderBy(F.col(key).asc_nulls_last(), "x").limit(entries).select("x").toArrow().column(0)
    x = rows_of(first.combine_chunks(), width)
    return [np.ascontiguousarray(part) for part in np.split(x, parts, axis=1)]


def moved(rows: DataFrame, codebooks: Codebooks, width: int) -> Codebooks:
    """The codebooks after each entry has become the mean of the parts assigned to it, rounded down.

    Tasks count and add up their parts; one row per part, entry and component goes on.
    """
    size = len(codebooks[0])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = width // len(codebooks)
        counts = np.zeros((len(codebooks), size), dtype=np.int64)
        sums = np.zeros((len(codebooks), size, shape), dtype=np.int64)
        prepared = [transformed(entries) for entries in codebooks]
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK):
                x = rows_of(batch.column(0).slice(first, BLOCK), width)
                for p, part in enumerate(np.split(x, len(codebooks), axis=1)):
                    at, _ = nearest(transformed(part), prepared[p])
                    counts[p] += np.bincount(at, minlength=size)
                    np.add.at(sums[p], at, part)
        p, e = np.nonzero(counts)
        if len(p):
            columns = [np.repeat(p, shape), np.repeat(e, shape), np.tile(np.arange(shape), len(p))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32()) for c in columns] + [pa.array(sums[p, e].ravel()), pa.array(np.repeat(counts[p, e], shape))],
                ["part", "entry", "at", "total", "n"],
            )

    found = rows.mapInArrow(add, "part int, entry int, at int, total bigint, n bigint")
    # Totals over a large table may pass 64 bits; there are at most as many as numbers in the codebooks.
    whole = lambda name: F.sum(F.col(name).cast("decimal(38,0)")).alias(name)
    out = [entries.copy() for entries in codebooks]
    for r in found.groupBy("part", "entry", "at").agg(whole("total"), whole("n")).collect():
        out[r.part][r.entry, r.at] = int(r.total) // int(r.n)
    return out


def encode(rows: DataFrame, codebooks: Codebooks, width: int, schema: str) -> DataFrame:
    """The other columns of `rows` (x is last), with the code and the error of x."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepared = [transformed(entries) for entries in codebooks]
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK):
                block = batch.slice(first, BLOCK)
                x = rows_of(block.column(block.num_columns - 1), width)
                codes = np.empty((len(x), len(codebooks)), dtype=np.uint8)
                error = np.zeros(len(x), dtype=np.int64)
                for p, part in enumerate(np.split(x, len(codebooks), axis=1)):
                    codes[:, p], distance = nearest(transformed(part), prepared[p])
                    error += distance
                kept = [block.column(i) for i in range(block.num_columns - 1)]
                names = [*block.schema.names[:-1], "code", "error"]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], names
                )

    return rows.mapInArrow(code, schema)


def decode(codes: DataFrame, codebooks: Codebooks, key: str = "vec_id", code: str = "code") -> DataFrame:
    """key and `vector`, the floats that a code stands for."""
    kind = codes.schema[key].dataType.simpleString()

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, len(codebooks))
            parts = [entries[at[:, p]] for p, entries in enumerate(codebooks)]
            whole = np.concatenate(parts, axis=1) / float(SCALE)
            vectors = pa.array(list(whole.astype(np.float32)), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), vectors], [key, "vector"])

    return codes.select(key, code).mapInArrow(restore, f"`{key}` {kind}, vector array<float>")


def sequency_order(size: int) -> np.ndarray:
    """Rows of the Hadamard matrix of `size` by the number of their sign changes."""
    at = np.arange(size)
    bits = at[:, None] & at
    parity = np.zeros((size, size), dtype=np.int64)
    while bits.any():
        parity, bits = parity ^ (bits & 1), bits >> 1
    return np.argsort(np.count_nonzero(np.diff(parity, axis=1), axis=1))


def transformed(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, padded with zeros, in sequency order; one line per number."""
    size = 1 << (x.shape[1] - 1).bit_length()
    out = np.zeros((size, len(x)), dtype=np.int64)
    out[: x.shape[1]] = x.T
    step = 1
    while step < size:
        pairs = out.reshape(size // (2 * step), 2, step, len(x))
        out = np.stack([pairs[:, 0] + pairs[:, 1], pairs[:, 0] - pairs[:, 1]], axis=1).reshape(size, len(x))
        step *= 2
    out = out[sequency_order(size)]
    # The sum of squared differences is at most size^2 times that of the plain numbers.
    if 4 * size * int(np.abs(out).max(initial=0)) ** 2 >= 1 << 63:
        return out.astype(object)
    return out


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part, the first of equally near ones, and their squared distance.

    Both are transformed, so sums of squared differences are the distances times the lines.
    """
    size = len(parts)
    difference = parts[0][:, None] - entries[0]
    partial = difference * difference
    # The whole distance of the entry that looks nearest so far is a bound for the nearest one.
    bound = ((parts - entries[:, partial.argmin(axis=1)]) ** 2).sum(axis=0)
    row, entry = np.nonzero(partial <= bound[:, None])
    total = partial[row, entry]
    for line in range(1, size):
        difference = parts[line][row] - entries[line][entry]
        total = total + difference * difference
        left = total <= bound[row]
        row, entry, total = row[left], entry[left], total[left]
    # Rows are in order and each has one entry at least, with its entries in order.
    first = np.flatnonzero(np.diff(row, prepend=-1))
    least = np.minimum.reduceat(total, first)
    best = total == least[row]
    row, entry = row[best], entry[best]
    first = np.flatnonzero(np.diff(row, prepend=-1))
    return entry[first], (least // size).astype(np.int64)


def codebook_text(codebooks: Codebooks) -> str:
    """All components in decimals by part, entry and position, with commas."""
    return ",".join(str(int(v)) for entries in codebooks for v in entries.ravel())


def with_label_error(codes: DataFrame, label: str) -> DataFrame:
    """Coded vectors with `label_error`, the error summed over the rows of the same label; nulls are one label.

    The sums are combined before the shuffle. They are joined from a written table, so that a label
    with many rows is split.
    """
    written = staged(codes, "vector-codes")
    sums = staged(
        written.groupBy(F.col(label).alias("_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error")),
        "vector-label-errors",
    )
    return written.join(sums, F.col(label).eqNullSafe(F.col("_label")), "left").drop("_label")


ORACLE = """
WITH RECURSIVE kept AS (
  SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda c: CAST(floor(256 * c) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
piece AS (
  SELECT vec_id, p, list_slice(x, p * (len(x) // 16) + 1, (p + 1) * (len(x) // 16)) AS v
  FROM kept, range(16) t(p)),
start AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < 64),
book0 AS (SELECT p, e, v FROM piece JOIN start USING (vec_id)),
far0 AS (
  SELECT vec_id, a.p, e, a.v, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
  FROM piece a JOIN book0 b ON a.p = b.p),
near0 AS (SELECT vec_id, p, v, e FROM far0 QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) = 1),
mean0 AS (
  SELECT p, e, list(m ORDER BY i) AS v FROM (
    SELECT p, e, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS m
    FROM near0, range(1, 5) t(i) GROUP BY p, e, i) GROUP BY p, e),
book1 AS (SELECT p, e, coalesce(n.v, b.v) AS v FROM book0 b LEFT JOIN mean0 n USING (p, e)),
far1 AS (
  SELECT vec_id, a.p, e, a.v, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
  FROM piece a JOIN book1 b ON a.p = b.p),
near1 AS (SELECT vec_id, p, v, e FROM far1 QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) = 1),
mean1 AS (
  SELECT p, e, list(m ORDER BY i) AS v FROM (
    SELECT p, e, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS m
    FROM near1, range(1, 5) t(i) GROUP BY p, e, i) GROUP BY p, e),
book2 AS (SELECT p, e, coalesce(n.v, b.v) AS v FROM book1 b LEFT JOIN mean1 n USING (p, e)),
far2 AS (
  SELECT vec_id, a.p, e, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
  FROM piece a JOIN book2 b ON a.p = b.p),
near2 AS (SELECT vec_id, p, e, d FROM far2 QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) = 1),
coded AS (
  SELECT vec_id, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM near2 GROUP BY vec_id),
digest AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), digest"""
