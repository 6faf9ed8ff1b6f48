"""Near duplicates of vectors by product quantisation: inverted lists, residual codes, exact rerank.

Coarse centroids and the codes of residuals are trained on a bounded sample; every vector is put in
the list of its nearest centroid and coded. A vector probes every list that can hold one within the
distance asked for: beyond a bisecting plane at most that far away. Distances by table lookup, less
the coding error of each stored vector, are lower bounds, so the candidates that go on to the exact
cosine lack no link.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triptych.llm.components import components
from triptych.staging import staged

COSINE = 0.98
# Numbers of the sample that centroids and codes are trained on.
TRAIN_FLOATS = 2_000_000
LIST_ROWS = 1024
MOST_LISTS = 1024
SUBSPACES = 8
CODES = 256
KMEANS_STEPS = 12
# Vectors of a block: those that probe a list, and those that it holds.
BLOCK = 1024
SLACK = 1e-6

FOUND = "id bigint, root bigint, links bigint"


@dataclass
class Quantiser:
    """Centroids of the lists, and for each subspace its columns and the codes of residuals."""

    centroids: np.ndarray
    columns: list[np.ndarray]
    codes: list[np.ndarray]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances to all centroids, and the list of each vector."""
        square = (x * x).sum(1)[:, None] - 2 * x @ self.centroids.T + (self.centroids**2).sum(1)
        return square, square.argmin(1)

    def encode(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and how far each vector is from what its code says."""
        residual = x - self.centroids[at]
        code = np.empty((len(x), len(self.columns)), dtype=np.uint8)
        error = np.zeros(len(x))
        for m, (columns, codes) in enumerate(zip(self.columns, self.codes)):
            part = residual[:, columns]
            code[:, m] = ((codes**2).sum(1) - 2 * part @ codes.T).argmin(1)
            error += ((part - codes[code[:, m]]) ** 2).sum(1)
        return code, np.sqrt(error)

    def distances(self, queries: np.ndarray, at: int, code: np.ndarray) -> np.ndarray:
        """Distances of queries to the coded vectors of one list, by table lookup."""
        residual = queries - self.centroids[at]
        square = np.zeros((len(queries), len(code)))
        for m, (columns, codes) in enumerate(zip(self.columns, self.codes)):
            part = residual[:, columns]
            table = (part**2).sum(1)[:, None] - 2 * part @ codes.T + (codes**2).sum(1)
            square += table[:, code[:, m]]
        return np.sqrt(np.maximum(square, 0))

    def probed(self, square: np.ndarray, at: np.ndarray, radius: float) -> np.ndarray:
        """Which lists can hold a vector within `radius` of each query."""
        between = np.sqrt(((self.centroids[at][:, None] - self.centroids[None]) ** 2).sum(2))
        own = square[np.arange(len(at)), at]
        return square - own[:, None] <= 2 * radius * between + SLACK


def fit_quantiser(x: np.ndarray, lists: int) -> Quantiser:
    rng = np.random.default_rng(8)
    centroids = _kmeans(x, lists, rng)
    square = (x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids**2).sum(1)
    residual = x - centroids[square.argmin(1)]
    columns = [c for c in np.array_split(np.arange(x.shape[1]), SUBSPACES) if len(c)]
    return Quantiser(centroids, columns, [_kmeans(residual[:, c], CODES, rng) for c in columns])


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(KMEANS_STEPS):
        at = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        count = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def _usable(vector: Column) -> Column:
    """Not null or empty, only finite numbers, not all of them zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def embedding_dedup(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors with the same label are linked when their cosine is at least `cosine`; component_id is
    the smallest vec_id reachable, n_links the number of other vectors linked directly.

    Vectors that are null, empty, zero or hold null or non-finite numbers, vectors with a null label
    or vec_id, and vectors of different widths link with nothing. Equal vectors of a label are one
    class in the search and count one by one; repeated rows are vectors of their own. Without a
    vec_id, component_id is null and the row is kept. Other columns are not read. An empty table
    gives an empty result.
    """
    rows = embeddings.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").cast("string").alias("label")
    )
    usable = rows.where(_usable(F.col("vector")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    classes = staged(usable.groupBy("label", "vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")), "vector-classes")
    found = staged(_search(classes, cosine), "vector-found")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    tied = components(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
    named = staged(
        classes.join(links, "id", "left")
        .join(tied.withColumnRenamed("node", "id"), "id", "left")
        .select(
            F.col("label").alias("l"),
            F.col("vector").alias("v"),
            (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "id").alias("component"),
        ),
        "vector-named",
    )
    same = (F.col("label") == F.col("l")) & (F.col("vector") == F.col("v")) & F.col("vec_id").isNotNull()
    component = F.coalesce("component", "vec_id")
    return rows.join(named, same, "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def _search(classes: DataFrame, cosine: float) -> DataFrame:
    """id, root, links: in each block, links of a class to other classes (by their vectors), and a class it is tied to."""
    spark = classes.sparkSession
    shape = classes.agg(F.max(F.size("vector")).alias("width"), F.count("*").alias("n")).first()
    if not shape.n:
        return spark.range(0).selectExpr("id", "id root", "id links")
    width = shape.width
    ordered = classes.select("vector", "id").orderBy(F.xxhash64("id"), "id").limit(max(1, TRAIN_FLOATS // width))
    sample = _units(ordered.select("vector").toArrow().column(0), width)
    quantiser = fit_quantiser(sample, min(MOST_LISTS, max(1, shape.n // LIST_ROWS), len(sample)))
    # Plain arrays: what is broadcast is read without this package on the executors.
    shared = spark.sparkContext.broadcast((quantiser.centroids, quantiser.columns, quantiser.codes))
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + SLACK

    def index(batches):
        q = Quantiser(*shared.value)
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK):
                part = batch.slice(first, BLOCK)
                x = _units(part.column("vector"), width)
                square, at = q.nearest(x)
                code, error = q.encode(x, at)
                # A list holds its own vectors and is probed by all that may have a partner in it.
                row, place = np.nonzero(q.probed(square, at, radius))
                row, place = np.concatenate([np.arange(len(x)), row]), np.concatenate([at, place])
                probe = np.arange(len(row)) >= len(x)
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [taken.column("label"), pa.array(place, pa.int32()), pa.array(probe), taken.column("id"), taken.column("n"), taken.column("vector")]
                    + [pa.array([None if p else code[r].tobytes() for r, p in zip(row, probe)], pa.binary()), pa.array(error[row])],
                    ["label", "list", "probe", "id", "n", "vector", "code", "error"],
                )

    schema = "label string, list int, probe boolean, id bigint, n bigint, vector array<double>, code binary, error double"
    indexed = staged(classes.select("label", "id", "n", "vector").mapInArrow(index, schema), "vector-index")
    sizes = staged(
        indexed.groupBy("label", "list").agg(
            F.ceil(F.count_if("probe") / BLOCK).cast("int").alias("ps"),
            F.ceil(F.count_if(~F.col("probe")) / BLOCK).cast("int").alias("os"),
        ),
        "vector-sizes",
    )
    met = indexed.join(sizes, ["label", "list"]).where("ps > 0 and os > 0")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    mine = lambda count: F.pmod(F.xxhash64("id"), F.col(count)).cast("int")
    columns = ["label", "list", "probe", "id", "n", "vector", "code", "error"]
    blocks = met.where("probe").select(*columns, mine("ps").alias("p"), every("os").alias("o")).unionByName(
        met.where("not probe").select(*columns, every("ps").alias("p"), mine("os").alias("o"))
    )

    def compare(key, table):
        return _linked(Quantiser(*shared.value), key[1].as_py(), table, width, radius, cosine)

    return blocks.groupBy("label", "list", "p", "o").applyInArrow(compare, FOUND)


def _linked(q: Quantiser, at: int, table: pa.Table, width: int, radius: float, cosine: float) -> pa.Table:
    """Links of the probing classes to those stored in one list, with a smaller id first."""
    probe = table.column("probe").to_numpy()
    ids, n = table.column("id").to_numpy(), table.column("n").to_numpy()
    asking, stored = np.flatnonzero(probe), np.flatnonzero(~probe)
    total = np.zeros(len(ids), dtype=np.int64)
    root = np.arange(len(ids))
    if len(asking) and len(stored):
        raw = _matrix(table.column("vector"), width)
        size = np.array([len(v) for v in table.column("vector")])
        length = np.sqrt((raw * raw).sum(1))
        unit = raw / length[:, None]
        code = np.frombuffer(b"".join(table.column("code").take(pa.array(stored)).to_pylist()), dtype=np.uint8).reshape(len(stored), -1)
        error = table.column("error").to_numpy()[stored]
        near = q.distances(unit[asking], at, code) <= radius + error + SLACK
        # Each pair is found from either side; one of them is enough.
        near &= ids[asking][:, None] > ids[stored]
        near &= size[asking][:, None] == size[stored]
        a, b = np.nonzero(near)
        a, b = asking[a], stored[b]
        exact = np.concatenate(
            [(raw[a[k : k + 4096]] * raw[b[k : k + 4096]]).sum(1) for k in range(0, len(a), 4096)] or [np.zeros(0)]
        ) / (length[a] * length[b])
        linked = exact >= cosine
        a, b = a[linked], b[linked]
        np.add.at(total, a, n[b])
        np.add.at(total, b, n[a])
        for i in np.unique(a):
            tied = np.unique(np.append(root[b[a == i]], root[i]))
            root[np.isin(root, tied)] = tied[0]
    some = np.flatnonzero((total > 0) | (root != np.arange(len(ids))))
    columns = {"id": ids[some], "root": ids[root[some]], "links": total[some]}
    return pa.table({name: pa.array(values, pa.int64()) for name, values in columns.items()})


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The vectors as rows; shorter ones end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, size = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    out[np.arange(width) < size[:, None]] = flat
    return out


def _units(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    x = _matrix(column, width)
    # Scaled first, so that squares of very large or small numbers stay finite.
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND list_dot_product(e, e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
link AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
reach AS (SELECT u, v FROM link UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM v LEFT JOIN (SELECT u, count(*) AS n FROM link GROUP BY u) c ON c.u = vec_id
LEFT JOIN (SELECT u, min(v) AS m FROM reach GROUP BY u) r ON r.u = vec_id"""
