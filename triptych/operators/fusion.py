"""Fuse the vectors of several media into one query vector per request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triptych.functions.vectors import weighted_mean
from triptych.operators.lookup import MEDIA


def media_parts(queries: DataFrame, key: str) -> DataFrame:
    """One row per found medium of a query: key, media_type, item_id, weight."""
    parts = F.array(
        *[
            F.struct(
                F.lit(m).alias("media_type"),
                F.col(f"{m}_item").alias("item_id"),
                F.col(f"{m}_weight").alias("weight"),
            )
            for m in MEDIA
        ]
    )
    return queries.select(key, F.inline(F.filter(parts, lambda p: p["item_id"].isNotNull())))


def fuse_vectors(parts: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Weighted mean of the stored vectors that were found, weights rescaled to them.

    `vectors` has media_type, item_id, embedding. Queries without any vector and those whose
    weights add up to zero give no row. At most one vector per medium is collected per query.
    """
    found = parts.join(vectors.where(F.col("embedding").isNotNull()), ["media_type", "item_id"])
    part = F.struct(
        "media_type", F.col("weight").cast("double").alias("weight"), F.col("embedding").alias("vector")
    )
    gathered = found.groupBy(key).agg(
        F.array_sort(F.collect_list(part)).alias("parts"), F.sum("weight").cast("double").alias("total")
    )
    return gathered.where(F.col("total") != 0).select(
        key, weighted_mean(F.col("parts"), F.col("total")).alias("vector")
    )
