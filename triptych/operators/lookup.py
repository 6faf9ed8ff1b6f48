"""Titles to items, set at a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triptych.functions.cleaning import title_key

MEDIA = ("movie", "book", "music")


def title_lookup(
    items: DataFrame, titles: Sequence[str], item: str = "item_id", row_id: str = "row_id"
) -> DataFrame:
    """media_type, title_key, item_id: every title of every item, the last row wins.

    Items carry media_type. Title columns that do not exist are ignored, blank titles left out.
    Within a row the item is the same, so the order of the title columns does not matter.
    """
    found = [F.col(t) for t in titles if t in items.columns]
    if not found:
        return items.sparkSession.createDataFrame([], "media_type string, title_key string, item_id bigint")
    keys = F.array_distinct(F.array(*[title_key(t) for t in found]))
    return (
        items.select("media_type", F.explode(keys).alias("title_key"), item, row_id)
        .where(F.length("title_key") > 0)
        .groupBy("media_type", "title_key")
        .agg(F.max_by(item, row_id).alias("item_id"))
    )


def as_typed_titles(requests: DataFrame) -> DataFrame:
    """One row per request and media type from the columns movie_title, book_title, music_title."""
    typed = F.array(
        *[F.struct(F.lit(m).alias("media_type"), F.col(f"{m}_title").alias("title")) for m in MEDIA]
    )
    return requests.select("request_id", F.inline(typed))


def resolve_titles(typed: DataFrame, lookup: DataFrame) -> DataFrame:
    """Requests' titles with the item they name, NULL where there is none.

    The lookup has one row per key, so no request is multiplied; a title that very many requests
    ask for is a skewed key of the left side only, which adaptive execution splits.
    """
    probe = typed.withColumn("title_key", title_key(F.col("title")))
    return probe.join(lookup, ["media_type", "title_key"], "left").drop("title_key")


def known_media(media_type: str) -> str:
    if media_type not in MEDIA:
        raise ValueError(f"Unsupported media_type: {media_type}")
    return media_type
