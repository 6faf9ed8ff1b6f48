"""Checks of a vector table against its items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triptych.functions.vectors import norm


def embedding_audit(
    vectors: DataFrame, items: DataFrame, key: str = "item_id", item_key: str = "item_id", tolerance: float = 1e-5
) -> DataFrame:
    """Findings as (finding, n): sizes, widths, lengths off 1, repeated keys and orphans both ways."""
    ids = vectors.select(key)
    item_ids = items.select(F.col(item_key).alias(key))
    counts = vectors.agg(
        F.count("*").alias("vectors"),
        F.count_if(F.col("embedding").isNull()).alias("vectors missing"),
        F.count_if(F.abs(norm(F.col("embedding")) - 1) > tolerance).alias("vectors not of length one"),
    )
    names = ("vectors", "vectors missing", "vectors not of length one")
    whole = counts.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("finding"), F.col(n).alias("n")) for n in names]))
    )
    widths = (
        vectors.where(F.col("embedding").isNotNull())
        .groupBy(F.size("embedding").alias("width"))
        .agg(F.count("*").alias("n"))
        .select(F.concat(F.lit("vectors of width "), F.col("width").cast("string")).alias("finding"), "n")
    )

    def single(df: DataFrame, finding: str) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(finding).alias("finding"), "n")

    parts = [
        whole,
        widths,
        single(ids.groupBy(key).count().where("count > 1"), "keys with several vectors"),
        single(ids.join(item_ids, key, "left_anti"), "vectors without item"),
        single(item_ids.join(ids, key, "left_anti"), "items without vector"),
    ]
    return reduce(DataFrame.unionByName, parts)


def same_width(tables: dict[str, DataFrame]) -> DataFrame:
    """Width of the vectors of every table and the number of rows that have it."""
    parts = [
        df.groupBy(F.lit(kind).alias("kind"), F.size("embedding").alias("width")).agg(F.count("*").alias("n"))
        for kind, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)
