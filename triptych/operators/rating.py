"""Shrinkage rating: a plain average pulled towards the overall mean when votes are few."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triptych.operators.quantiles import exact_quantile


class Prior(NamedTuple):
    """Overall mean rating and the vote count at which an item's own average weighs half."""

    mean: float
    votes: float


def rating_prior(
    df: DataFrame,
    rating: str,
    votes: str,
    quantile: float,
    voted_only: bool = False,
    whole_votes: bool = False,
) -> Prior | None:
    """Mean rating and vote quantile of a table, two numbers on the driver; None without votes.

    Reads only the two columns, up to three times: pass a written table.
    """
    narrow = df.select(rating, votes)
    if voted_only:
        narrow = narrow.where(F.col(votes) > 0)
    weight = exact_quantile(narrow, votes, quantile)
    if weight is None:
        return None
    mean = narrow.agg(F.avg(rating)).first()[0]
    return None if mean is None else Prior(mean, float(int(weight)) if whole_votes else weight)


def shrunk(rating: Column, votes: Column, prior: Prior) -> Column:
    """votes/(votes+m) * rating + m/(votes+m) * mean; missing when either input is."""
    total = votes + F.lit(prior.votes)
    own = F.try_divide(votes.cast("double"), total) * rating
    return own + F.try_divide(F.lit(prior.votes), total) * F.lit(prior.mean)


def with_weighted_rating(
    df: DataFrame,
    rating: str,
    votes: str,
    quantile: float,
    name: str = "weighted_rating",
    voted_only: bool = False,
    whole_votes: bool = False,
) -> DataFrame:
    """Add the shrinkage rating.

    With `voted_only` rows without votes get none, and when no row has votes the plain rating is
    used for all of them.
    """
    prior = rating_prior(df, rating, votes, quantile, voted_only, whole_votes)
    if prior is None:
        plain = F.col(rating).cast("double") if voted_only else F.lit(None).cast("double")
        return df.withColumn(name, plain)
    score = shrunk(F.col(rating), F.col(votes), prior)
    return df.withColumn(name, F.when(F.col(votes) > 0, score) if voted_only else score)


def with_popularity_boost(
    df: DataFrame,
    score: str,
    popularity: str,
    name: str = "final_score",
    weight: float = 0.05,
    limit: float = 2.0,
) -> DataFrame:
    """Score plus a small bonus for the clipped z-score of popularity (population deviation).

    Mean and deviation are one aggregate row, joined in as scalar subqueries.
    """
    stats = df.agg(F.avg(popularity).alias("mean"), F.stddev_pop(popularity).alias("deviation"))
    z = (F.col(popularity) - stats.select("mean").scalar()) / (
        stats.select("deviation").scalar() + F.lit(1e-9)
    )
    clipped = F.when(z.isNotNull(), F.greatest(F.lit(-limit), F.least(F.lit(limit), z)))
    return df.withColumn(name, F.col(score) + F.lit(weight) * clipped)
