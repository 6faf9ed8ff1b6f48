"""Reports over the feedback log. Records have the columns of the log plus `row_id` (arrival)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triptych.operators.counting import distribution, top_values_per_group, value_counts, value_counts_by_key
from triptych.operators.lookup import MEDIA

FOUND_SIGN = "✅"


def status_of(records: DataFrame, medium: str) -> Column:
    """Status text under its present or its former name, the empty text where both are missing."""
    names = [n for n in ("status", "search_status") if n in records.columns]
    return F.coalesce(*[F.col(f"{n}.{medium}") for n in names], F.lit(""))


def flatten(records: DataFrame) -> DataFrame:
    """One flat row per submission, for export."""
    return records.select(
        "timestamp",
        *[F.col(f"inputs.{m}").alias(m) for m in MEDIA],
        "feedback.satisfaction",
        "feedback.stars",
        "feedback.comments",
        *[F.contains(status_of(records, m), F.lit(FOUND_SIGN)).alias(f"{m}_found") for m in MEDIA],
        F.get("recommendations", F.lit(0))["name"].alias("top_destination"),
    )


def satisfaction(records: DataFrame) -> DataFrame:
    """Submissions per answer and their percentage."""
    return distribution(records.select("feedback.satisfaction"), "satisfaction")


def star_average(records: DataFrame) -> DataFrame:
    """Number of submissions and mean stars."""
    return records.agg(F.count("*").alias("submissions"), F.avg("feedback.stars").alias("mean_stars"))


def star_counts(records: DataFrame) -> DataFrame:
    """Submissions per number of stars, ascending."""
    return value_counts_by_key(records.select("feedback.stars"), "stars")


def commented(records: DataFrame) -> DataFrame:
    return records.where(F.length("feedback.comments") > 0)


def comment_count(records: DataFrame) -> DataFrame:
    return commented(records).agg(F.count("*").alias("n"))


def recent_comments(records: DataFrame, most: int = 5) -> DataFrame:
    """The last comments in order of arrival.

    Records read from the log have no row_id: they arrive in the order of their timestamps, and at
    one time in the order of their comments.
    """
    arrival = ["row_id"] if "row_id" in records.columns else ["timestamp", "comment"]
    comments = commented(records).withColumn("comment", F.col("feedback.comments"))
    last = comments.orderBy(*map(F.desc, arrival)).limit(most)
    return last.select(arrival[0], "comment").orderBy(*arrival)


def top_inputs(records: DataFrame, most: int = 5) -> DataFrame:
    """Most frequent titles per medium, as typed, in one job for all media."""
    pairs = F.array(
        *[F.struct(F.lit(m).alias("media_type"), F.col(f"inputs.{m}").alias("title")) for m in MEDIA]
    )
    return top_values_per_group(records.select(F.inline(pairs)), "media_type", "title", most)


def top_recommended(records: DataFrame, most: int = 10) -> DataFrame:
    """Most frequent recommendations as "name, country"."""
    named = records.select(F.explode("recommendations").alias("r")).select(
        F.concat_ws(", ", "r.name", "r.country").alias("destination")
    )
    return value_counts(named, "destination", most)


def submission_day(timestamp: Column) -> Column:
    """Calendar date of a local timestamp; nothing is shifted between zones."""
    return F.to_date(timestamp.try_cast("timestamp_ntz"))


def daily_counts(records: DataFrame) -> DataFrame:
    """Submissions per date, ascending."""
    return value_counts_by_key(records.select(submission_day(F.col("timestamp")).alias("day")), "day")
