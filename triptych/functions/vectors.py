"""Column expressions on `array<float>` vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_norm(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def norm(vector: Column) -> Column:
    return F.sqrt(squared_norm(vector))


def unit(vector: Column) -> Column:
    """Vector divided by its length; the zero vector stays zero.

    The length is the finish argument of the aggregate, so that it is computed once per vector
    and not once per element.
    """
    return F.aggregate(
        vector,
        F.lit(0.0),
        lambda acc, x: acc + x.cast("double") * x.cast("double"),
        lambda total: F.transform(
            vector, lambda x: F.when(total > 0, x.cast("double") / F.sqrt(total)).otherwise(F.lit(0.0))
        ),
    )


def weighted_mean(parts: Column, total_weight: Column) -> Column:
    """Mean of `array<struct<weight, vector>>`, element by element and without exploding.

    Elements are missing where the weights add up to zero.
    """
    zeros = F.transform(F.get(parts, F.lit(0))["vector"], lambda x: F.lit(0.0))
    return F.aggregate(
        parts,
        zeros,
        lambda acc, part: F.zip_with(
            acc, part["vector"], lambda a, x: a + F.try_divide(x.cast("double") * part["weight"], total_weight)
        ),
    )
