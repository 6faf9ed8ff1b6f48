"""Frequency tables, shares and table sizes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triptych.operators.ranking import top_per_group


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Rows per value, most frequent first, ties by value; missing values are left out."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), column).limit(top) if top is not None else counts.orderBy(F.desc("n"), column)


def value_counts_by_key(df: DataFrame, column: str) -> DataFrame:
    """Rows per value in the order of the values."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(column)


def top_values_per_group(df: DataFrame, group: str, column: str, top: int) -> DataFrame:
    """Most frequent values of every group."""
    counts = df.where(F.col(column).isNotNull()).groupBy(group, column).agg(F.count("*").alias("n"))
    return top_per_group(counts, [group], [F.desc("n"), F.col(column)], top, column)


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows per value with their percentage of all rows.

    The total is a scalar subquery over the counts, not a window over the whole table.
    """
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("percentage", F.col("n") / total * 100)


def table_sizes(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count per table."""
    sizes = [
        df.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n") for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, sizes)


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows and distinct values of columns; missing values do not count as a value.

    One column at a time: distinct counts of several columns in one aggregate would copy each row.
    """
    parts = [
        df.groupBy(column)
        .agg(F.count("*").alias("rows"))
        .agg(
            F.coalesce(F.sum("rows"), F.lit(0)).alias("n_rows"),
            F.count(column).alias("n_distinct"),
        )
        .select(F.lit(column).alias("column_name"), "n_rows", "n_distinct")
        for column in columns
    ]
    return reduce(DataFrame.unionByName, parts)


def union_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """All rows of all tables; columns absent in some are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def text_length_quartiles(texts: Mapping[str, Column], tables: Mapping[str, DataFrame]) -> DataFrame:
    """Five-number summary and whisker ends of text lengths per table, in characters.

    Lengths are counted first: one row per distinct length reaches the exact percentiles, which
    take the count as a weight.
    """
    lengths = [
        tables[kind].select(F.lit(kind).alias("kind"), F.length(text).cast("bigint").alias("length"))
        for kind, text in texts.items()
    ]
    counts = (
        reduce(DataFrame.unionByName, lengths)
        .where(F.col("length").isNotNull())
        .groupBy("kind", "length")
        .agg(F.count("*").alias("n"))
    )
    five = F.percentile("length", [0.0, 0.25, 0.5, 0.75, 1.0], F.col("n"))
    quartiles = counts.groupBy("kind").agg(F.sum("n").alias("n_texts"), five.alias("five"))
    reach = 1.5 * (F.get("five", F.lit(3)) - F.get("five", F.lit(1)))
    boxes = quartiles.select(
        "kind",
        "n_texts",
        *[F.get("five", F.lit(i)).alias(name) for i, name in enumerate(("shortest", "q1", "median", "q3", "longest"))],
        (F.get("five", F.lit(1)) - reach).alias("_low"),
        (F.get("five", F.lit(3)) + reach).alias("_high"),
    )
    whiskers = (
        counts.join(boxes, "kind")
        .where(F.col("length").between(F.col("_low"), F.col("_high")))
        .groupBy("kind")
        .agg(F.min("length").alias("whisker_low"), F.max("length").alias("whisker_high"))
    )
    return boxes.drop("_low", "_high").join(whiskers, "kind", "left")
