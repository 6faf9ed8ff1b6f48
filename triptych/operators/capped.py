"""Picks in the order of a ranking while groups have room."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triptych.functions.cleaning import strip
from triptych.operators.ranking import descending, top_per_group
from triptych.operators.sampling import leftover
from triptych.staging import drop_staged, staged

# Rows of the ranking that are walked at a time, by one task.
BLOCK_ROWS = 1 << 18
# So many times its cap a group may have of the rows of a block.
DEPTH = 20


def capped_sample(
    df: DataFrame, scores: Sequence[str], key: str, group: str, cap: int, target: int
) -> DataFrame:
    """Best `target` rows with at most `cap` per group, then the best others if too few.

    Going down the ranking and skipping full groups picks exactly the first `cap` rows of every
    group, cut at `target`. The others are only looked for when these are too few.
    """
    order = descending(scores, key)
    capped = staged(top_per_group(df, [group], order, cap, key).orderBy(*order).limit(target), "capped")
    return filled_up(capped, df, order, key, target)


def filled_up(chosen: DataFrame, df: DataFrame, order: Sequence[Column], key: str, target: int) -> DataFrame:
    """The chosen rows, and the best others where they are fewer than `target`."""
    found = chosen.count()
    if found >= target:
        return chosen
    return chosen.unionByName(leftover(df, chosen, key).orderBy(*order).limit(target - found))


def twice_capped_sample(
    df: DataFrame,
    scores: Sequence[str],
    key: str,
    first: tuple[str, int],
    second: tuple[str, int],
    target: int,
    fill: bool = True,
    block_rows: int = BLOCK_ROWS,
    depth: int = DEPTH,
) -> DataFrame:
    """Going down the ranking, pick rows while neither of their two groups is full.

    `first` and `second` are (column, cap); blank groups and absent columns have no cap. A row
    counts against a cap only when picked, so what a row gets depends on all rows before it. Of a
    pair of groups only as many rows as the smaller cap can be picked, which prunes each pair before
    the shuffle. What is left is walked in blocks: the first `block_rows` of the ranking, with at
    most `depth` times its cap of any group, go to one task, which stops where a group that is not
    full has more rows than it got. Rows of full groups leave before the next block.

    So the number of blocks, of which each writes two tables, goes with `target`: a block that is
    walked to its end picks one row of every 2 * depth + 1 at least. With `fill`, the best other
    rows follow if too few.
    """
    caps = {"_a": first[1], "_b": second[1]}
    order = descending(scores, key)
    narrow = df.select(key, *scores, filled_text(df, first[0]).alias("_a"), filled_text(df, second[0]).alias("_b"))
    has = {group: F.col(group) != "" for group in caps}
    pair_cap = F.when(has["_a"] & has["_b"], min(caps.values())).when(has["_a"], caps["_a"]).otherwise(caps["_b"])
    pairs = top_per_group(narrow.where(has["_a"] | has["_b"]), ["_a", "_b"], order, max(caps.values()), key, rank="_place")
    pruned = pairs.where(F.col("_place") <= pair_cap).drop("_place")
    free = narrow.where(~has["_a"] & ~has["_b"]).orderBy(*order).limit(target)
    rest = staged(pruned.unionByName(free), "candidates")
    taken = rest.limit(0).select(key, "_a", "_b")
    found = 0
    while found < target:
        used = {group: taken.where(has[group]).groupBy(group).agg(F.count("*").alias(f"_used{group}")) for group in caps}
        walked = staged(_walk(rest, order, key, caps, used, target - found, block_rows, depth), "walked")
        if walked.isEmpty():
            break
        picked = walked.where("_picked").select(key, "_a", "_b")
        taken, found = taken.unionByName(picked), found + picked.count()
        before = rest.join(walked.select(key), key, "left_anti")
        for group, cap in caps.items():
            full = taken.where(has[group]).groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") >= cap)
            before = before.join(full.select(group), group, "left_anti")
        before, rest = rest, staged(before.select(*rest.columns), "candidates")
        drop_staged(before)
    chosen = staged(df.join(taken.select(key), key).select(*df.columns), "picked")
    return filled_up(chosen, df, order, key, target) if fill else chosen


def _walk(
    rest: DataFrame,
    order: Sequence[Column],
    key: str,
    caps: dict[str, int],
    used: dict[str, DataFrame],
    wanted: int,
    block_rows: int,
    depth: int,
) -> DataFrame:
    """The rows that a walk decides, from the first on: the key, both groups, and whether it is picked."""
    kept, marks = rest, []
    # A block that takes all rows needs no marks.
    for group, cap in caps.items() if rest.count() > block_rows else ():
        most = depth * cap
        of_group = top_per_group(rest.where(F.col(group) != ""), [group], order, most + 1, key, rank="_place")
        of_group = staged(of_group.select(key, "_place"), "places")
        inside = of_group.where(F.col("_place") <= most).select(key)
        kept = kept.join(inside.unionByName(rest.where(F.col(group) == "").select(key)), key, "left_semi")
        # A mark stands at the first row of a group that the block lacks.
        deep = of_group.where(F.col("_place") > most).select(key)
        marks.append(rest.join(deep, key, "left_semi").withColumn("_stop", F.lit(group)))
    block = kept.withColumn("_stop", F.lit(None).cast("string"))
    for mark in marks:
        block = block.unionByName(mark)
    leading = block.orderBy(*order).limit(block_rows)
    for group, counts in used.items():
        leading = leading.join(counts, group, "left")
    # At most `block_rows` rows.
    leading = leading.coalesce(1).sortWithinPartitions(*order)
    kind = rest.schema[key].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room: dict[str, dict[str, int]] = {group: {} for group in caps}
        left = wanted
        for batch in batches:
            kept, picked = [], []
            columns = [batch.column(i).to_pylist() for i in range(1, 6)]
            for at, (a, b, stop, used_a, used_b) in enumerate(zip(*columns)):
                room_a = room["_a"].setdefault(a, caps["_a"] - (used_a or 0)) if a else 1
                room_b = room["_b"].setdefault(b, caps["_b"] - (used_b or 0)) if b else 1
                if stop is not None:
                    if (room_a if stop == "_a" else room_b) > 0:
                        left = 0
                elif left:
                    fits = room_a > 0 and room_b > 0
                    kept.append(at)
                    picked.append(fits)
                    left -= fits
                    for group, name in (("_a", a), ("_b", b)):
                        if fits and name:
                            room[group][name] -= 1
                if not left:
                    break
            names = [key, "_a", "_b", "_picked"]
            taken = [batch.column(i).take(pa.array(kept, pa.int64())) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(picked, pa.bool_())], names)

    shown = leading.select(key, "_a", "_b", "_stop", "_used_a", "_used_b")
    return shown.mapInArrow(walk, f"`{key}` {kind}, _a string, _b string, _picked boolean")


def filled_text(df: DataFrame, column: str) -> Column:
    """Stripped text of a column, the empty text where it is missing or the column is absent."""
    if column not in df.columns:
        return F.lit("")
    return F.coalesce(strip(F.col(column).cast("string")), F.lit(""))
