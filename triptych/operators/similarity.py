"""Exact cosine top-k between request vectors and a table of unit vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triptych.operators.grid import collect_if_small, parts_against_blocks
from triptych.staging import staged

# Scores are ranked at this precision, so that the order does not hang on the last float digits.
DIGITS = 6
MARGIN = 2 * 10.0**-DIGITS
# Scores held at once by a task, and the targets among them.
TILE_CELLS = 2_000_000
TILE_TARGETS = 4096
# Lengths up to this one are screened in single precision.
LONGEST = 1e15
# Of so many cells one candidate at most is scored by itself.
SPARSE = 64
# Whole numbers are of use while they are off by less than LOOSE; the coarser ones, which leave more
# candidates, pay for themselves when MANY times the wanted targets have been seen.
LOOSE, MANY = 0.12, 8192
# So many columns of products are looked at together.
FOLD = 16
# Requests up to this length count as unit rows.
UNIT = 1 + 1e-9
# So many more screenings by whole numbers may have left too much than left little.
VAIN = 64
BROADCAST_FLOATS = 8_000_000
BLOCK_ROWS = 16_384
HIT = "request_id bigint, item_id bigint, score double"
RANKED = HIT + ", rank int"


def cosine_topk(
    requests: DataFrame,
    targets: DataFrame,
    top_k: int | None = 5,
    dim: int | None = None,
    target_floats: int = BROADCAST_FLOATS,
    request_floats: int = BROADCAST_FLOATS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Best targets of every request: request_id, item_id, score, rank (from 1).

    `requests` has request_id, vector and, unless `top_k` is given, its own top_k; `targets` has
    item_id and a unit `embedding`. Both keys are unique. Every pair is scored, as a matrix product
    inside a task that keeps its best k per request: pairs never become rows. Rows without a vector
    take no part (the audit reports them), and a `top_k` beyond the targets gives all of them.

    Targets of a checked size are broadcast to the requests, else requests of a checked size to the
    targets; the other side is dealt out evenly, since a small file would be the work of one task.
    When both are large, parts of the requests that a task can hold meet the targets, at most
    `block_rows` of them at a time.
    """
    wanted = F.col("top_k") if top_k is None else F.lit(top_k)
    asked = requests.where(F.col("vector").isNotNull()).select(
        "request_id", "vector", F.greatest(F.coalesce(wanted, F.lit(0)), F.lit(0)).cast("int").alias("top_k")
    )
    stored = targets.where(F.col("embedding").isNotNull()).select("item_id", "embedding")
    dim = dim or _dimension(stored)
    if dim is None:
        return targets.sparkSession.createDataFrame([], RANKED)
    small_targets = collect_if_small(stored, target_floats // dim)
    if small_targets is not None:
        return _requests_in_place(asked, small_targets, dim)
    asked = staged(asked, "requests")
    small_requests = collect_if_small(asked, request_floats // dim)
    if small_requests is not None:
        hits = _targets_in_place(stored, small_requests, dim)
    else:
        held_rows = BROADCAST_FLOATS // dim
        left, right = packed(asked, "vector", dim), packed(stored.repartition("item_id"), "embedding", dim)
        hits = parts_against_blocks(left, right, "request_id", _part_search(dim), HIT, block_rows, held_rows)
    best = Window.partitionBy("request_id").orderBy(F.desc("score"), "item_id")
    ranked = hits.withColumn("rank", F.row_number().over(best))
    if top_k is not None:
        return ranked.where(F.col("rank") <= top_k)
    limits = asked.select("request_id", "top_k")
    return ranked.join(limits, "request_id").where(F.col("rank") <= F.col("top_k")).drop("top_k")


def _dimension(targets: DataFrame) -> int | None:
    return targets.agg(F.max(F.size("embedding")).alias("dim")).first().dim


def _requests_in_place(requests: DataFrame, targets: pa.Table, dim: int) -> DataFrame:
    shared = requests.sparkSession.sparkContext.broadcast(
        (_ids(targets, "item_id"), _matrix(targets, "embedding", dim))
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, matrix = shared.value
        for batch in batches:
            limits = _ids(batch, "top_k")
            best = BestRows(len(limits), int(limits.max(initial=0)))
            best.add(_unit_rows(_matrix(batch, "vector", dim)), items, matrix)
            yield from best.table(_ids(batch, "request_id"), limits, ranked=True).to_batches()

    return requests.repartition("request_id").mapInArrow(search, RANKED)


def _targets_in_place(targets: DataFrame, requests: pa.Table, dim: int) -> DataFrame:
    shared = targets.sparkSession.sparkContext.broadcast(
        (_ids(requests, "request_id"), _ids(requests, "top_k"), _unit_rows(_matrix(requests, "vector", dim)))
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        request_ids, limits, vectors = shared.value
        best = BestRows(len(request_ids), int(limits.max(initial=0)))
        for batch in batches:
            best.add(vectors, _ids(batch, "item_id"), _matrix(batch, "embedding", dim))
        yield from best.table(request_ids, limits).to_batches()

    return targets.repartition("item_id").mapInArrow(search, HIT)


def _part_search(dim: int) -> Callable[[pa.Table, Iterator[pa.RecordBatch]], pa.Table]:
    def search(requests: pa.Table, blocks: Iterator[pa.RecordBatch]) -> pa.Table:
        limits = _ids(requests, "top_k")
        best = BestRows(requests.num_rows, int(limits.max(initial=0)))
        vectors = _unit_rows(_matrix(requests, "vector", dim))
        for block in blocks:
            best.add(vectors, _ids(block, "item_id"), _matrix(block, "embedding", dim))
        return best.table(_ids(requests, "request_id"), limits)

    return search


def packed(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """Vectors as the bytes of their numbers, which are moved as a whole and not one by one."""
    kinds = ", ".join(f"`{name}` {'binary' if name == vector else kind}" for name, kind in df.dtypes)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = np.ascontiguousarray(_matrix(batch, vector, dim))
            ends = np.arange(len(numbers) + 1, dtype=np.int32) * (numbers.itemsize * dim)
            buffers = [None, pa.py_buffer(ends), pa.py_buffer(numbers)]
            as_bytes = pa.Array.from_buffers(pa.binary(), len(numbers), buffers)
            columns = [as_bytes if name == vector else batch.column(name) for name in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return df.mapInArrow(pack, kinds)


def _column(table: pa.Table | pa.RecordBatch, name: str) -> pa.Array:
    column = table.column(name)
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _ids(table: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    return _column(table, name).to_numpy(zero_copy_only=False)


def _matrix(table: pa.Table | pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    column = _column(table, name)
    if pa.types.is_binary(column.type):
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        held = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]] if len(column) else np.empty(0)
        return held.view(np.float64).reshape(len(column), dim)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if flat.size != len(column) * dim:
        raise ValueError(f"{name}: every vector must have {dim} elements")
    return flat.reshape(len(column), dim)


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def _below_best(scores: np.ndarray, k: int) -> np.ndarray:
    """A bound for each row that its k best scores reach.

    The k-th best of the maxima of groups is the score of at least k columns that reach it, and
    much cheaper to find than the k-th best score.
    """
    groups = 16 * k
    if scores.shape[1] > 2 * groups:
        scores = np.fmax.reduceat(scores, np.arange(groups) * scores.shape[1] // groups, axis=1)
    # What is no number would count as the best.
    return np.partition(np.fmax(scores, -np.inf), -k, axis=1)[:, -k]


def _longest(matrix: np.ndarray) -> float:
    """The greatest length of a row, without rows that are not numbers."""
    return float(np.fmax.reduce(_lengths(matrix), initial=0.0))


def _lengths(matrix: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", matrix, matrix))


def _screening(dim: int, longest: float, longest_target: float) -> tuple[type, float]:
    """The precision to screen in, and how far its scores may be off at most.

    A sum of n products in single precision is off by less than (n + 2) * 2**-24 of the product of
    both lengths; twice that leaves room for the bound itself to be rounded. Rows that are not
    numbers never score, and very long ones are screened in double precision, as they are scored.
    """
    if max(longest, longest_target) > LONGEST:
        return np.float64, 0.0
    return np.float32, 2 * (dim + 4) * 2.0**-24 * longest * longest_target


@dataclass(frozen=True)
class Lanes:
    """How a double holds products of several targets: `bits` wide lanes, for products up to `reach`.

    A lane holds the least product that is wanted less the product, offset so that its top bit is
    missing where the product is wanted. Beyond `highest` times `reach` all products are wanted;
    below that by 2 ** bits / 2 a lane overflows and looks wanted too, and adds one to the next lane.
    """

    count: int
    bits: int
    reach: float
    highest: float

    @property
    def unit(self) -> float:
        return float(sum(1 << self.bits * lane for lane in range(self.count)))

    @property
    def tops(self) -> np.ndarray:
        return np.array([1 << self.bits * lane + self.bits - 1 for lane in range(self.count)], np.int64)

    def scale(self, dim: int) -> float:
        """So long may unit rows be made that their products stay within `reach` after rounding."""
        return np.sqrt(self.reach) - np.sqrt(dim) / 2 - 1

    def slack(self, dim: int) -> float:
        """By how much scores are off at most, about."""
        scale = self.scale(dim)
        return 2 * np.sqrt(dim / 12) / scale if scale > 0 else np.inf


# The finer ones are tried where the coarser ones leave too much.
COARSE, FINE = Lanes(4, 13, 4000, 0.55), Lanes(3, 17, 32_700, 1.0)


class WholeRequests:
    """Unit rows as whole numbers, for products that are exact, with several targets in a double.

    By how much a product is off the score is bounded by what rounding took from both rows and by
    their lengths.
    """

    def __init__(self, vectors: np.ndarray, lanes: Lanes):
        rows, dim = vectors.shape
        self.lanes, self.scale = lanes, lanes.scale(dim)
        # The last columns meet the offsets of the targets.
        self.numbers = np.ones((rows, dim + 2))
        self.length, self.lost = np.empty(rows), np.empty(rows)
        for r in range(0, rows, TILE_TARGETS):
            part = slice(r, r + TILE_TARGETS)
            scaled = vectors[part] * self.scale
            whole = self.numbers[part, :dim]
            np.rint(scaled, out=whole)
            self.length[part], self.lost[part] = _lengths(whole), _lengths(scaled - whole)


class WholeTargets:
    """A tile of targets as whole numbers; target t is in lane t // width of column t % width.

    What rounding took from a target is given to its lane, times the length of the requests.
    The constant added puts the last bit of a double at one, and bit 52 is set unless the top lane
    overflows. Sums of products may pass 2 ** 53 on the way and lose one each time, so the lowest
    lane takes a little more for wanted.
    """

    def __init__(self, targets: np.ndarray, longest: float, requests: WholeRequests):
        (count, dim), lanes = targets.shape, requests.lanes
        self.count, self.longest, self.lanes, self.scale = count, longest, lanes, requests.scale
        self.width = -(-count // (lanes.count * FOLD)) * FOLD
        scaled = targets * (self.scale / longest)
        whole = np.zeros((lanes.count * self.width, dim))
        np.rint(scaled, out=whole[:count])
        lost = np.zeros(len(whole))
        lost[:count] = np.ceil(_lengths(scaled - whole[:count]) * np.fmax.reduce(requests.length, initial=0.0))
        self.lost = lost.max()
        self.numbers = np.empty((self.width, dim + 2))
        packed = self.numbers[:, :dim]
        packed[:] = 0
        for lane in reversed(whole.reshape(lanes.count, self.width, dim)):
            packed *= 2.0**lanes.bits
            packed -= lane
        self.numbers[:, dim] = lanes.unit
        given = lost.reshape(lanes.count, self.width).T @ 2.0 ** (lanes.bits * np.arange(lanes.count))
        self.numbers[:, dim + 1] = 2.0**52 + (2.0 ** (lanes.bits - 1) - 1) * lanes.unit - (dim + 2) - given

    def screen(
        self, requests: WholeRequests, part: slice, floor: np.ndarray, out: np.ndarray, most: int
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows and targets whose scores may reach the floor, and the rows for which lanes cannot tell.

        `FOLD` columns are looked at together first. If that leaves more than `most`, no row is told.
        """
        lanes, numbers = requests.lanes, requests.numbers[part]
        least = np.floor(floor * (self.scale**2 / self.longest) - requests.lost[part] * self.scale) - 2
        told, highest = least >= self.lost + numbers.shape[1], np.floor(lanes.highest * lanes.reach)
        none, every = np.empty(0, np.int64), np.arange(len(told))
        if 2 * np.count_nonzero(told) < len(told):
            return none, none, every
        numbers[:, -2] = np.where(told, np.minimum(least, highest), highest)
        sums = np.matmul(numbers, self.numbers.T, out=out[: len(numbers), : self.width]).view(np.int64)
        sums = sums.reshape(len(numbers), FOLD, -1)
        full = int(lanes.tops.sum()) | 1 << 52
        together = np.bitwise_and.reduce(sums, axis=1)
        row, place = np.divmod(np.flatnonzero(((together & full) != full) & told[:, None]), together.shape[1])
        if len(row) > most:
            return none, none, every
        held = sums[row, :, place]
        hit, fold = np.nonzero((held & full) != full)
        held = held[hit, fold]
        wanted = ((held[:, None] & lanes.tops) == 0) | ((held & 1 << 52) == 0)[:, None]
        which, lane = np.nonzero(wanted)
        hit, fold = hit[which], fold[which]
        target = lane * self.width + fold * together.shape[1] + place[hit]
        real = target < self.count
        return row[hit][real], target[real], np.flatnonzero(~told)


class BestRows:
    """The best k targets seen so far by each request of a block, best first."""

    def __init__(self, requests: int, k: int):
        self.k, self.seen, self.vain = k, 0, {COARSE: 0, FINE: 0}
        self.score = np.full((requests, 0), -np.inf)
        self.item = np.zeros((requests, 0), dtype=np.int64)
        # The requests last seen, their greatest length, their whole numbers and room for products.
        self.vectors, self.longest, self.whole, self.out = None, 0.0, None, None

    def add(self, vectors: np.ndarray, items: np.ndarray, targets: np.ndarray) -> None:
        """Score all requests against more targets, one tile of bounded size at a time.

        Where the k best of each request are known, tiles are screened in whole numbers, several
        targets at once; else in single precision. Both with the largest possible error as slack;
        what is left is scored in double precision.
        """
        self.seen += len(items)
        self._widen(min(self.k, self.seen))
        requests, k = self.score.shape
        if not k or not len(items):
            return
        if self.vectors is not vectors:
            self.vectors, self.longest, self.whole = vectors, _longest(vectors), None
        kind, slack = _screening(vectors.shape[1], self.longest, _longest(targets))
        for t in range(0, len(items), TILE_TARGETS):
            tile, ids = targets[t : t + TILE_TARGETS], items[t : t + TILE_TARGETS]
            rows = max(1, TILE_CELLS // len(ids))
            whole_tile = self._whole_tile(tile)
            coarse_tile = scores = None
            pending, waiting = [], 0
            for r in range(0, requests, rows):
                part = slice(r, min(r + rows, requests))
                rest = np.arange(r, part.stop)
                if whole_tile:
                    row, column, untold = self._reaching(part, whole_tile, rows)
                    pending.append((r + row, column))
                    waiting += len(row)
                    rest = r + untold
                if len(rest):
                    if coarse_tile is None:
                        coarse_tile = tile.astype(kind).T
                        scores = np.empty((min(rows, requests), len(ids)), dtype=kind)
                    coarse = np.matmul(vectors[rest].astype(kind), coarse_tile, out=scores[: len(rest)])
                    row, column = self._candidates(rest, coarse, slack)
                    if len(row) * SPARSE > coarse.size:
                        self._merge(rest[row], ids[column], (vectors[rest] @ tile.T)[row, column])
                    else:
                        pending.append((rest[row], column))
                        waiting += len(row)
                # Few candidates wait for those of other requests.
                if waiting * SPARSE > TILE_CELLS:
                    self._score(vectors, ids, tile, pending)
                    pending, waiting = [], 0
            self._score(vectors, ids, tile, pending)

    def _widen(self, k: int) -> None:
        """Room for k targets; there are never more places than targets seen."""
        more = k - self.score.shape[1]
        if more > 0:
            self.score = np.pad(self.score, ((0, 0), (0, more)), constant_values=-np.inf)
            self.item = np.pad(self.item, ((0, 0), (0, more)))

    def _whole_tile(self, tile: np.ndarray) -> WholeTargets | None:
        """The tile in whole numbers, if that is of use: most requests have their best k, rows are unit rows."""
        k, longest = self.score.shape[1], _lengths(tile).max()
        if self.longest > UNIT or not 1 / LONGEST < longest < LONGEST:
            return None
        if 2 * np.count_nonzero(self.score[:, -1] > -np.inf) < len(self.score):
            return None
        dim = tile.shape[1]
        lanes = COARSE if self.seen > MANY * k and COARSE.slack(dim) < LOOSE and self.vain[COARSE] <= VAIN else FINE
        if self.vain[lanes] > VAIN or FINE.slack(dim) >= LOOSE:
            return None
        if self.whole is None or self.whole.lanes != lanes:
            # The ones before go first, as these are as large as the requests.
            self.whole = None
            self.whole = WholeRequests(self.vectors, lanes)
        return WholeTargets(tile, longest, self.whole)

    def _reaching(self, part: slice, tile: WholeTargets, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows and targets that may be among the best by whole numbers, and rows for which these do not tell."""
        floor = self.score[part, -1] - MARGIN
        if self.out is None or len(self.out) < len(floor) or self.out.shape[1] != tile.width:
            self.out = np.empty((rows, tile.width))
        found = tile.screen(self.whole, part, floor, self.out, 4 * self.score.shape[1] * len(floor))
        vain = 2 * len(found[2]) > len(floor)
        self.vain[self.whole.lanes] = max(0, self.vain[self.whole.lanes] + (1 if vain else -1))
        return found

    def _candidates(self, rest: np.ndarray, coarse: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and targets whose coarse scores, with a margin, may be among the best of these requests."""
        k = self.score.shape[1]
        floor = (self.score[rest, -1] - MARGIN - slack).astype(coarse.dtype)
        candidate = coarse >= floor[:, None]
        if coarse.shape[1] > k and np.count_nonzero(candidate) > 4 * k * len(coarse):
            candidate &= coarse >= (_below_best(coarse, k) - MARGIN - 2 * slack).astype(coarse.dtype)[:, None]
        return np.divmod(np.flatnonzero(candidate), coarse.shape[1])

    def _score(
        self, vectors: np.ndarray, ids: np.ndarray, tile: np.ndarray, pending: list[tuple[np.ndarray, np.ndarray]]
    ) -> None:
        """Score candidates one by one and take them over."""
        if pending:
            row, column = (np.concatenate(x) for x in zip(*pending))
            self._merge(row, ids[column], np.einsum("ij,ij->i", vectors[row], tile[column]))

    def _merge(self, row: np.ndarray, items: np.ndarray, exact: np.ndarray) -> None:
        """Take over the scores of candidates that are among the best k of their requests.

        Only candidates are rounded and sorted, and only requests that have some are touched.
        """
        k = self.score.shape[1]
        # Adding zero turns -0.0 into 0.0.
        fresh = np.round(exact, DIGITS) + 0.0
        last, last_item = self.score[row, -1], self.item[row, -1]
        better = (fresh > last) | ((fresh == last) & (items < last_item))
        if not better.any():
            return
        touched, own = np.unique(row[better], return_inverse=True)
        old_row, old_place = np.nonzero(self.score[touched] > -np.inf)
        all_rows = np.concatenate([old_row, own])
        all_items = np.concatenate([self.item[touched[old_row], old_place], items[better]])
        all_scores = np.concatenate([self.score[touched[old_row], old_place], fresh[better]])
        order = np.lexsort((all_items, -all_scores, all_rows))
        all_rows = all_rows[order]
        place = np.arange(len(all_rows)) - np.searchsorted(all_rows, all_rows)
        kept = place < k
        at = (touched[all_rows[kept]], place[kept])
        self.score[at] = all_scores[order][kept]
        self.item[at] = all_items[order][kept]

    def table(self, request_ids: np.ndarray, limits: np.ndarray, ranked: bool = False) -> pa.Table:
        wanted = np.arange(self.score.shape[1]) < limits[:, None]
        row, place = np.nonzero(wanted & (self.score > -np.inf))
        columns = {
            "request_id": pa.array(request_ids[row], pa.int64()),
            "item_id": pa.array(self.item[row, place], pa.int64()),
            "score": pa.array(self.score[row, place], pa.float64()),
        }
        if ranked:
            columns["rank"] = pa.array(place + 1, pa.int32())
        return pa.table(columns)
