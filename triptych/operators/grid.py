"""Work on every combination of two tables, parts of one against blocks of the other.

For operators that must compare each row of one table with each row of another (exact similarity),
when neither side may be broadcast. A task holds a part of the left rows, of bounded size, while all
right rows go past it; it returns only the best rows, never the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Parts of the left rows, where there are enough of them; more only when a task could not hold a part.
PARTS = 64


def parts_of(rows: int, block_rows: int, held_rows: int) -> int:
    """Parts of at least `block_rows` rows, up to `PARTS` of them, and of at most about `held_rows`."""
    split = lambda size: -(-rows // max(1, size))
    return max(1, min(split(block_rows), PARTS), split(held_rows))


def parts_against_blocks(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    work: Callable[[pa.Table, Iterator[pa.RecordBatch]], pa.Table],
    schema: str,
    block_rows: int,
    held_rows: int,
) -> DataFrame:
    """`work` on each part of the left rows and all right rows, which come in blocks.

    Left rows are moved once, right rows once per part, so shuffles grow with the left rows only
    when these are more than `PARTS` tasks can hold. Left keys are unique, so their hash fills the
    parts evenly. Right rows should be dealt evenly, as the tasks that read them write all their copies.
    """
    parts = parts_of(left.count(), block_rows, held_rows)
    kinds = {"_left": left.schema, "_right": right.schema}
    own = F.pmod(F.xxhash64(left_key), F.lit(parts)).cast("int").alias("_part")
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part")
    none = lambda name: F.lit(None).cast(kinds[name]).alias(name)
    rows = left.select(own, F.struct(*left.columns).alias("_left"), none("_right")).unionAll(
        right.select(every, none("_left"), F.struct(*right.columns).alias("_right"))
    )
    # One part per task; a hash would give several to some tasks and none to others.
    dealt = rows.repartitionById(parts, F.col("_part")).sortWithinPartitions("_part", F.col("_right").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pieces in groupby(_pieces(batches, block_rows), key=lambda piece: piece[0]):
            held, block = [], None
            for _, is_left, block in pieces:
                if not is_left:
                    break
                held.append(block)
            if held:
                first = [] if is_left else [block]
                # groupby moves on to the next part by itself when `work` has not seen all blocks.
                yield from work(pa.Table.from_batches(held), _blocks(first, pieces)).to_batches()

    return dealt.mapInArrow(run, schema)


def _blocks(first: list[pa.RecordBatch], pieces: Iterator[tuple[int, bool, pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    yield from first
    for _, _, block in pieces:
        yield block


def _pieces(batches: Iterator[pa.RecordBatch], block_rows: int) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """Part, whether these are left rows, and the rows, cut where either changes."""
    for batch in batches:
        keys = list(zip(batch.column("_part").to_pylist(), batch.column("_right").is_null().to_pylist()))
        at = 0
        for (part, is_left), run in groupby(keys):
            end = at + sum(1 for _ in run)
            rows = batch.column("_left" if is_left else "_right")
            for start in range(at, end, end - at if is_left else block_rows):
                yield part, is_left, pa.RecordBatch.from_struct_array(rows.slice(start, min(end - start, end - at if is_left else block_rows)))
            at = end


def collect_if_small(df: DataFrame, most: int) -> pa.Table | None:
    """The table when it has at most `most` rows, else None. Counted first: pass a stored table."""
    return df.toArrow() if df.count() <= most else None
