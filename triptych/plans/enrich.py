"""Descriptions from a landed table of summaries, with fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triptych.functions.cleaning import blank_to_null, collapse_spaces


def enrich_descriptions(places: DataFrame, summaries: DataFrame, order: str = "row_id") -> DataFrame:
    """Summary under "name, country", else under the name alone, else the place's own description.

    `summaries` has key and text; of repeated keys the first in `order` with a text counts.
    """
    usable = summaries.select(
        F.col("key").alias("_key"), blank_to_null(collapse_spaces(F.col("text"))).alias("_text"), order
    ).where(F.col("_text").isNotNull())
    texts = usable.groupBy("_key").agg(F.min_by("_text", order).alias("_text"))
    full = F.concat_ws(", ", "name", "country")
    by_full = texts.select(F.col("_key").alias("_full"), F.col("_text").alias("_by_full"))
    by_name = texts.select(F.col("_key").alias("_name"), F.col("_text").alias("_by_name"))
    found = places.join(by_full, full == F.col("_full"), "left").join(
        by_name, F.col("name") == F.col("_name"), "left"
    )
    return found.withColumn("description", F.coalesce("_by_full", "_by_name", "description")).drop(
        "_full", "_name", "_by_full", "_by_name"
    )
