"""Vector tables: one row per item, keyed by `item_id`, never aligned by position."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triptych.functions.vectors import unit
from triptych.operators.encode import Encoder, embed_texts
from triptych.sources import versions
from triptych.sources.tables import load_first, write_table

VECTOR_SCHEMA = "item_id bigint, embedding array<float>"


def load_vectors(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return load_first(spark, paths, VECTOR_SCHEMA)


def save_vectors(vectors: DataFrame, path: str) -> None:
    write_table(vectors.select("item_id", F.col("embedding").cast("array<float>").alias("embedding")), path)


def fingerprint(vectors: DataFrame, key: str = "item_id") -> DataFrame:
    """Key and a hash of the vector, to tell whether a derived table is still current."""
    return vectors.select(key, F.xxhash64("embedding").alias("source_hash"))


def search_table(vectors: DataFrame, key: str = "item_id") -> DataFrame:
    """Unit vectors with the hash of what they were made from: normalise once, search often."""
    return vectors.select(
        key, unit(F.col("embedding")).alias("embedding"), F.xxhash64("embedding").alias("source_hash")
    )


def save_search_table(vectors: DataFrame, path: str, key: str = "item_id") -> None:
    write_table(search_table(vectors, key), path)


def stale_keys(vectors: DataFrame, saved: DataFrame, key: str = "item_id") -> DataFrame:
    """Keys by which a saved search table differs from its source: new, changed or gone."""
    now = fingerprint(vectors, key).withColumnRenamed("source_hash", "now_hash")
    then = saved.select(key, F.col("source_hash").alias("then_hash"))
    reason = (
        F.when(F.col("then_hash").isNull(), "new")
        .when(F.col("now_hash").isNull(), "gone")
        .when(F.col("now_hash") != F.col("then_hash"), "changed")
    )
    return (
        now.join(then, key, "full_outer")
        .select(key, reason.alias("reason"))
        .where(F.col("reason").isNotNull())
    )


def refresh_vectors(
    items: DataFrame, folder: str, make_encoder: Callable[[], Encoder], encoder: str, text: str, key: str = "item_id"
) -> DataFrame:
    """Bring the saved vectors of items up to their texts; returns key and change (new, changed, gone).

    Only new and changed texts are encoded, all of them if the saved ones are from another `encoder`.
    A missing text counts as empty. Of rows with the same key the text with the smallest digest
    counts; rows without key are left out.
    """
    texts = items.select(key, F.coalesce(text, F.lit("")).alias("_text"))
    marked = texts.withColumn("fingerprint", versions.fingerprint(F.col("_text")))

    def encoded(keys: DataFrame) -> DataFrame:
        wanted = marked.join(keys, key, "left_semi").groupBy(key).agg(F.min_by("_text", "fingerprint").alias("_text"))
        return embed_texts(wanted, key, "_text", make_encoder)

    # Only digests are compared, so texts that stay are not shuffled.
    now = marked.groupBy(key).agg(F.min("fingerprint").alias("fingerprint"))
    kind = items.schema[key].dataType.simpleString()
    return versions.refresh(now, folder, encoded, f"`{key}` {kind}, embedding array<float>", encoder, key)


def refresh_search_table(vectors: DataFrame, folder: str, key: str = "item_id") -> DataFrame:
    """Bring the saved unit vectors up to the vectors, one per key; returns key and change."""
    marked = vectors.select(key, "embedding", versions.fingerprint(F.col("embedding")).alias("fingerprint"))

    def normalised(keys: DataFrame) -> DataFrame:
        return vectors.join(keys, key, "left_semi").select(key, unit(F.col("embedding")).alias("embedding"))

    kind = vectors.schema[key].dataType.simpleString()
    return versions.refresh(marked, folder, normalised, f"`{key}` {kind}, embedding array<double>", "unit", key)


def current_vectors(spark: SparkSession, folder: str, schema: str = VECTOR_SCHEMA) -> DataFrame:
    """The newest version of saved vectors."""
    return versions.read_version(spark, folder, schema)
