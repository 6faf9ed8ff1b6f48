"""From raw item tables to processed tables: clean, score, sample, describe, emphasise.

Every job takes raw tables with a `row_id` that gives their source order; an `item_id`, where there
is one, goes through to the processed table. The cleaned table is written once in between, since
scores and samples read it several times.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triptych.functions.cleaning import first_filled, strip, title_case
from triptych.functions.describing import describe_audio, describe_place, text_representation
from triptych.operators.counting import union_tables, value_counts
from triptych.operators.ranking import dedupe_best, dedupe_first
from triptych.operators.rating import with_weighted_rating
from triptych.operators.sampling import Stratum, filled_sample
from triptych.operators.tags import tag_lists_by_id, with_tag_list
from triptych.operators.tfidf import emphasised
from triptych.plans import constants as fixed
from triptych.sources.tables import (
    coerce_numeric,
    ensure_columns,
    fill_missing,
    keep_columns,
    lower_names,
    put_back,
    rename_if_absent,
)
from triptych.staging import staged


def finish(
    sampled: DataFrame, text: str, wanted: Sequence[str], use_tfidf: bool = True, **settings
) -> DataFrame:
    """Emphasise the texts of a written sample and keep the processed columns, item_id first if there is one.

    An item drawn by two strata counts as two texts, so copies get a key of their own.
    """
    wanted = ("item_id", *wanted)
    if not use_tfidf:
        return keep_columns(sampled.withColumn("text_representation", F.col(text)), wanted)
    keyed = sampled.withColumn("_copy", F.concat_ws("\n", F.col("row_id").cast("string"), "_stratum"))
    return keep_columns(emphasised(keyed, "_copy", text, **settings), wanted)


def clean_movies(raw: DataFrame) -> DataFrame:
    """Released films with a title and an overview of more than 20 characters, one per original title."""
    df = coerce_numeric(ensure_columns(raw, {"genres": "string"}), fixed.MOVIE_NUMBERS)
    df = df.where((F.length("title") > 0) & (F.length("overview") > fixed.MOVIE_OVERVIEW))
    if "status" in df.columns:
        df = df.where(F.col("status") == "Released")
    if "original_title" in df.columns:
        df = dedupe_first(df, ["original_title"], "row_id")
    return df


def score_movies(cleaned: DataFrame) -> DataFrame:
    return with_weighted_rating(
        cleaned, "vote_average", "vote_count", fixed.MOVIE_QUANTILE, "weighted_rating", voted_only=True
    )


def prepare_movies(
    raw: DataFrame,
    rows: int = fixed.TARGET_ROWS["movie"],
    strata: Sequence[Stratum] = fixed.MOVIE_STRATA,
    use_tfidf: bool = True,
    whole: DataFrame | None = None,
    **settings,
) -> DataFrame:
    """With `whole`, the long texts of `raw` are set aside, and those of the sample are read from there."""
    scored = score_movies(staged(clean_movies(raw), "movies"))
    sampled = filled_sample(scored, rows, strata, "weighted_rating", "row_id")
    if whole is not None:
        sampled = put_back(sampled, whole, fixed.LONG_TEXTS["movie"])
    described = sampled.withColumn(
        "_text", text_representation(F.col("title"), F.col("overview"), F.col("genres"))
    )
    return finish(described, "_text", fixed.MOVIE_COLUMNS, use_tfidf, **settings)


def tagged_books(books: DataFrame, book_tags: DataFrame, tags: DataFrame, first: int) -> DataFrame:
    """Books with their first tags; the bridge may name its key book_id, the books theirs id."""
    if "book_id" in book_tags.columns:
        book_tags = book_tags.withColumnRenamed("book_id", "goodreads_book_id")
    lists = tag_lists_by_id(book_tags, tags, "goodreads_book_id", "row_id", first=first)
    return with_tag_list(rename_if_absent(books, "id", "book_id"), lists, "book_id", "goodreads_book_id")


def clean_books(books: DataFrame, book_tags: DataFrame, tags: DataFrame, condition: str, first: int) -> DataFrame:
    """Books that meet the condition, with filled titles, authors and tag lists. No deduplication.

    The filter runs before the tags are joined; it does not look at them.
    """
    filled = fill_missing(
        coerce_numeric(books, fixed.BOOK_NUMBERS), {"authors": "Unknown"}, {"original_title": "title"}
    )
    return tagged_books(filled.where(condition), book_tags, tags, first)


def prepare_books(
    books: DataFrame,
    book_tags: DataFrame,
    tags: DataFrame,
    rows: int = fixed.TARGET_ROWS["book"],
    strata: Sequence[Stratum] = fixed.BOOK_STRATA,
    condition: str = fixed.BOOK_FILTER,
    use_tfidf: bool = True,
    **settings,
) -> DataFrame:
    cleaned = staged(clean_books(books, book_tags, tags, condition, fixed.BOOK_TAGS), "books")
    scored = with_weighted_rating(
        cleaned, "average_rating", "ratings_count", fixed.BOOK_QUANTILE, "weighted_score"
    )
    sampled = filled_sample(scored, rows, strata, "weighted_score", "row_id")
    described = sampled.withColumn(
        "_text", text_representation(F.col("title"), F.col("authors"), F.col("tag_list"))
    )
    return finish(described, "_text", fixed.BOOK_COLUMNS, use_tfidf, **settings)


def clean_music(raw: DataFrame) -> DataFrame:
    """One row per track id, then tracks of 30 s to 10 min with a name; missing popularity is 0."""
    df = coerce_numeric(raw, fixed.MUSIC_NUMBERS)
    if "track_id" in df.columns:
        df = dedupe_first(df, ["track_id"], "row_id")
    if "duration_ms" in df.columns:
        df = df.where(F.col("duration_ms").between(30_000, 600_000))
    if "track_name" in df.columns:
        df = df.where(F.length("track_name") > 0)
    return df.withColumn("popularity", F.coalesce("popularity", F.lit(0.0)))


def audio_text() -> list:
    return [F.col(c) for c in ("track_name", "artists", "track_genre", "energy", "valence", "danceability")]


def prepare_music(
    raw: DataFrame,
    rows: int = fixed.TARGET_ROWS["music"],
    strata: Sequence[Stratum] = fixed.MUSIC_STRATA,
    use_tfidf: bool = True,
    **settings,
) -> DataFrame:
    cleaned = staged(clean_music(raw), "music")
    sampled = filled_sample(cleaned, rows, strata, "popularity", "row_id")
    kinds = {c: "string" for c in ("track_name", "artists", "track_genre")}
    kinds |= {c: "double" for c in ("energy", "valence", "danceability")}
    described = ensure_columns(sampled, kinds).withColumn("audio_description", describe_audio(*audio_text()))
    return finish(described, "audio_description", fixed.MUSIC_COLUMNS, use_tfidf, **settings)


def clean_places(raw: DataFrame, required: Sequence[str] = ("latitude",), fill_population: bool = True) -> DataFrame:
    """Named places with coordinates, the most populous per name and country."""
    df = lower_names(raw.select(*[c for c in raw.columns if c in (*fixed.PLACE_SOURCE, "row_id", "item_id")]))
    df = df.withColumnsRenamed({"country": "country_code", "accentcity": "city_display"})
    df = df.withColumns({c: strip(F.col(c)) for c in ("city", "city_display", "country_code", "region")})
    df = coerce_numeric(df, fixed.PLACE_NUMBERS)
    df = df.where(F.length("city") > 0)
    for column in required:
        df = df.where(F.col(column).isNotNull())
    df = df.withColumns(
        {
            "name": first_filled(F.col("city_display"), title_case(F.col("city"))),
            "country": F.upper("country_code"),
        }
    )
    if fill_population:
        df = df.withColumn("population", F.coalesce("population", F.lit(0.0)))
    return dedupe_best(df, ["name", "country"], "population", "row_id")


def prepare_places(
    raw: DataFrame,
    rows: int = fixed.TARGET_ROWS["destination"],
    strata: Sequence[Stratum] = fixed.PLACE_STRATA,
    use_tfidf: bool = True,
    **settings,
) -> DataFrame:
    sampled = filled_sample(staged(clean_places(raw), "places"), rows, strata, "population", "row_id")
    described = sampled.withColumn(
        "description",
        describe_place(F.col("name"), F.col("country"), F.col("population"), F.col("region")),
    )
    return finish(described, "description", fixed.PLACE_COLUMNS, use_tfidf, **settings)


def strata_summary(processed: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per stratum of every processed table."""
    return union_tables(
        [
            value_counts(df, "_stratum").select(F.lit(kind).alias("kind"), F.col("_stratum").alias("stratum"), "n")
            for kind, df in processed.items()
        ]
    )
