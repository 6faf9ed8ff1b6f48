"""Ranked selections: top rows of groups, of the whole table, and keep-first deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Up to this many rows per group Spark's own pruning before the shuffle (rows kept per group and
# input partition) leaves little for one task. Larger selections first pick within salted parts.
PICK_DIRECTLY = 50
SALTS = 64


def descending(scores: Sequence[str], key: str) -> list[Column]:
    """Order by descending scores, missing ones last, then by the key so that ties are settled."""
    return [F.col(s).desc_nulls_last() for s in scores] + [F.col(key)]


def top_per_group(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    n: int,
    key: str,
    rank: str | None = None,
) -> DataFrame:
    """First `n` rows of every group under a total order, optionally with their rank.

    A group may hold any share of the table: rows are pruned before the shuffle, and for large
    `n` once more in `SALTS` parts of each group, so that the last step sees few rows per group.
    """
    if n <= 0:
        return df.limit(0).withColumn(rank, F.lit(0)) if rank else df.limit(0)
    if n > PICK_DIRECTLY:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)))
        part = Window.partitionBy(*by, "_salt").orderBy(*order)
        df = salted.withColumn("_rn", F.row_number().over(part)).where(F.col("_rn") <= n).drop("_rn", "_salt")
    whole = Window.partitionBy(*by).orderBy(*order)
    picked = df.withColumn("_rn", F.row_number().over(whole)).where(F.col("_rn") <= n)
    return picked.withColumnRenamed("_rn", rank) if rank else picked.drop("_rn")


def dedupe_first(df: DataFrame, keys: Sequence[str], row_id: str) -> DataFrame:
    """One row per key: the first in source order. Missing keys count as one value."""
    return top_per_group(df, keys, [F.col(row_id)], 1, row_id)


def dedupe_best(df: DataFrame, keys: Sequence[str], score: str, row_id: str) -> DataFrame:
    """One row per key: the highest score, missing scores last, then the first in source order."""
    return top_per_group(df, keys, descending([score], row_id), 1, row_id)


def top_rows(df: DataFrame, scores: Sequence[str], row_id: str, n: int) -> DataFrame:
    """First `n` rows by descending scores: one pass, only `n` rows per task leave it."""
    return df.orderBy(*descending(scores, row_id)).limit(n)
