"""Titles near to mistyped ones by edit distance, without comparing every two.

An edit changes at most as many grams (pieces of `GRAM` characters) as a gram is long. So of the
rarest `GRAM * distance + 1` grams of a title one is left in every title within the distance, and it
is among the rarest of that one too: titles meet on those grams only. Titles too short to have that
many meet on what is left after deletions. The edit distance itself then decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triptych.functions.cleaning import title_key
from triptych.operators.lookup import MEDIA
from triptych.operators.ranking import top_per_group
from triptych.staging import staged

GRAM = 3


def fuzzy_titles(typed: DataFrame, lookup: DataFrame, distance: int = 2, most: int = 3, gram: int = GRAM) -> DataFrame:
    """The nearest titles of requests whose title the lookup does not hold.

    Takes request_id, media_type, title; returns request_id, media_type, rank, title_key, item_id and
    distance, at most `most` per request, by distance and then by title. Distances count characters
    of the title as the lookup stores it. Blank titles and unknown media give none.
    """
    asked = typed.select("request_id", "media_type", title_key(F.col("title")).alias("typed_key")).where(
        (F.length("typed_key") > 0) & F.col("media_type").isin(*MEDIA)
    )
    missing = asked.select("media_type", "typed_key").distinct()
    known = lookup.select("media_type", F.col("title_key").alias("typed_key"))
    missing = staged(missing.join(known, ["media_type", "typed_key"], "left_anti"), "fuzzy-missing")
    near = near_titles(missing, lookup, distance, gram)
    best = top_per_group(near, ["media_type", "typed_key"], [F.col("distance"), F.col("title_key")], most, "title_key", rank="rank")
    return asked.join(best, ["media_type", "typed_key"]).select(
        "request_id", "media_type", "rank", "title_key", "item_id", "distance"
    )


def near_titles(missing: DataFrame, lookup: DataFrame, distance: int, gram: int = GRAM) -> DataFrame:
    """media_type, typed_key, title_key, item_id, distance of all pairs within the distance."""
    pairs = candidates(missing, lookup.select("media_type", "title_key"), distance, gram)
    measured = pairs.withColumn("distance", F.levenshtein("typed_key", "title_key", distance)).where("distance >= 0")
    return measured.join(lookup.select("media_type", "title_key", "item_id"), ["media_type", "title_key"])


def candidates(missing: DataFrame, titles: DataFrame, distance: int, gram: int = GRAM) -> DataFrame:
    """media_type, typed_key, title_key: all pairs within the distance, and few others."""
    # Shorter titles have too few grams for one to be left after so many edits.
    enough = gram * (distance + 1)
    prefix = gram * distance + 1
    pieces = staged(_grams(titles, "title_key", enough, gram), "fuzzy-grams")
    counts = pieces.groupBy("media_type", "gram").agg(F.count("*").alias("n"))
    counts = staged(counts, "fuzzy-counts")
    rare_typed = _rarest(_grams(missing, "typed_key", enough, gram), counts, "typed_key", prefix)
    rare_titles = _rarest(pieces, counts, "title_key", prefix)
    short = lambda df, key: df.where(F.length(key) < enough + distance).select(
        "media_type", key, F.explode(deletions(F.col(key), distance)).alias("gram")
    )
    near_in_length = F.abs(F.length("typed_key") - F.length("title_key")) <= distance
    some_short = F.least(F.length("typed_key"), F.length("title_key")) < enough
    long = rare_typed.join(rare_titles, ["media_type", "gram"]).where(near_in_length)
    little = short(missing, "typed_key").join(short(titles, "title_key"), ["media_type", "gram"]).where(near_in_length & some_short)
    return long.unionByName(little).select("media_type", "typed_key", "title_key").distinct()


def _grams(titles: DataFrame, key: str, enough: int, gram: int) -> DataFrame:
    """One row per gram of each title of at least so many characters."""
    starts = F.sequence(F.lit(1), F.length(key) - (gram - 1))
    pieces = F.transform(starts, lambda at: F.substring(key, at, gram))
    return titles.where(F.length(key) >= enough).select("media_type", key, F.explode(pieces).alias("gram"))


def _rarest(pieces: DataFrame, counts: DataFrame, key: str, prefix: int) -> DataFrame:
    """The first grams of each title in the order of how many titles have them, then by text."""
    ranked = pieces.join(counts, ["media_type", "gram"], "left").groupBy("media_type", key).agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("all")
    )
    # A gram that comes several times counts as often among the first, and is met once.
    first = F.array_distinct(F.transform(F.slice("all", 1, prefix), lambda g: g["gram"]))
    return ranked.select("media_type", key, F.explode(first).alias("gram"))


def deletions(text: Column, most: int) -> Column:
    """The text, and all texts that are left when up to `most` characters are taken out."""
    without_one = lambda s: F.transform(
        F.when(F.length(s) > 0, F.sequence(F.lit(1), F.length(s))).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)),
    )
    found = F.array(text)
    for _ in range(most):
        found = F.array_distinct(F.concat(found, F.flatten(F.transform(found, without_one))))
    return found
