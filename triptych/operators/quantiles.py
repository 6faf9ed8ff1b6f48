"""Exact quantiles without gathering a column in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# `percentile` keeps one entry per distinct value in a single task; beyond this many values the
# range that holds the answer is narrowed first.
FEW_VALUES = 100_000
# approx_percentile is off by at most one row in ACCURACY.
ACCURACY = 10_000


def exact_quantile(df: DataFrame, column: str, q: float, few_values: int = FEW_VALUES) -> float | None:
    """Quantile with linear interpolation between neighbours; missing values are skipped.

    Runs at once and returns a number. `df` is read twice, more often beyond `few_values`.
    """
    number = F.col(column).cast("double")
    values = df.where(number.isNotNull() & ~F.isnan(number)).select(number.alias("v"))
    n, distinct = values.agg(F.count("v"), F.approx_count_distinct("v")).first()
    if n == 0:
        return None
    if distinct <= few_values:
        return values.agg(F.percentile("v", F.lit(q))).first()[0]
    position = (n - 1) * q
    low = _value_at(values, n, math.floor(position), few_values)
    if position == math.floor(position):
        return low
    high = _value_at(values, n, math.ceil(position), few_values)
    return low + (high - low) * (position - math.floor(position))


def _value_at(values: DataFrame, n: int, position: int, few_values: int) -> float:
    """Value at a 0-based position of the sorted column of `n` values.

    Each pass brackets the position by approximate percentiles and counts exactly what lies below
    and inside, which leaves about 4 rows in ACCURACY besides copies of the two ends. The ends are
    then answered or dropped, so that every pass narrows the range. What has few values in the end
    is counted value by value.
    """
    inside = values
    slack = 2 / ACCURACY
    while True:
        share = position / max(n - 1, 1)
        around = F.percentile_approx("v", [max(share - slack, 0.0), min(share + slack, 1.0)], ACCURACY)
        distinct, (low, high) = inside.agg(F.approx_count_distinct("v"), around).first()
        if distinct <= few_values:
            for value, count in inside.groupBy("v").count().orderBy("v").collect():
                if position < count:
                    return value
                position -= count
        v = F.col("v")
        below, at_low, between, at_high = inside.agg(
            F.count_if(v < low),
            F.count_if(v == low),
            F.count_if((v > low) & (v < high)),
            F.count_if((v == high) & F.lit(high > low)),
        ).first()
        steps = (
            (below, None, v < low),
            (at_low, low, None),
            (between, None, (v > low) & (v < high)),
            (at_high, high, None),
            (n - below - at_low - between - at_high, None, v > high),
        )
        for count, value, condition in steps:
            if position < count:
                break
            position -= count
        if value is not None:
            return value
        n, inside = count, inside.where(condition)
