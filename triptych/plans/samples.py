"""Small best-of samples of every item kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triptych.functions.cleaning import is_true_text, word_count
from triptych.functions.describing import describe_place_sentences
from triptych.operators.counting import coverage
from triptych.operators.ranking import dedupe_first, top_rows
from triptych.operators.rating import with_popularity_boost, with_weighted_rating
from triptych.operators.capped import capped_sample, twice_capped_sample
from triptych.operators.sampling import relaxed_filter
from triptych.plans import constants as fixed
from triptych.plans.preparation import clean_books, clean_places
from triptych.sources.tables import coerce_numeric, ensure_columns, keep_columns
from triptych.staging import staged


def sample_movies(
    raw: DataFrame,
    rows: int = fixed.SAMPLE_MOVIE_ROWS,
    condition: str = fixed.SAMPLE_MOVIE_FILTER,
    words: int = fixed.SAMPLE_MOVIE_WORDS,
) -> DataFrame:
    """Best films by shrinkage rating with a small popularity bonus."""
    df = coerce_numeric(raw, fixed.MOVIE_NUMBERS)
    df = df.where(condition).where(word_count(F.col("overview")) >= words)
    if "status" in df.columns:
        df = df.where(F.col("status") == "Released")
    if "original_title" in df.columns:
        df = dedupe_first(df, ["original_title"], "row_id")
    rated = with_weighted_rating(
        staged(df, "movie-sample"), "vote_average", "vote_count", fixed.SAMPLE_QUANTILE, whole_votes=True
    )
    boosted = with_popularity_boost(rated, "weighted_rating", "popularity")
    return keep_columns(top_rows(boosted, ["final_score", "vote_count"], "row_id", rows), fixed.SAMPLE_MOVIE_COLUMNS)


def sample_books(
    books: DataFrame,
    book_tags: DataFrame,
    tags: DataFrame,
    rows: int = fixed.SAMPLE_BOOK_ROWS,
    condition: str = fixed.SAMPLE_BOOK_FILTER,
) -> DataFrame:
    """Best books by shrinkage rating, with their first tags."""
    cleaned = staged(clean_books(books, book_tags, tags, condition, fixed.SAMPLE_BOOK_TAGS), "book-sample")
    rated = with_weighted_rating(
        cleaned, "average_rating", "ratings_count", fixed.SAMPLE_QUANTILE, "weighted_score"
    )
    return keep_columns(top_rows(rated, ["weighted_score"], "row_id", rows), fixed.SAMPLE_BOOK_COLUMNS)


def sample_places(
    raw: DataFrame, rows: int = fixed.SAMPLE_PLACE_ROWS, per_country: int = fixed.SAMPLE_PLACES_PER_COUNTRY
) -> DataFrame:
    """Most populous places with a cap per country, described in sentences."""
    cleaned = staged(clean_places(raw, ("latitude", "longitude"), fill_population=False), "place-sample")
    picked = capped_sample(cleaned, ["population"], "row_id", "country", per_country, rows)
    described = picked.withColumn(
        "description",
        describe_place_sentences(
            *[F.col(c) for c in ("name", "country", "population", "region", "latitude", "longitude")]
        ),
    )
    return keep_columns(described, fixed.SAMPLE_PLACE_COLUMNS)


def sample_music(
    raw: DataFrame,
    rows: int = fixed.SAMPLE_MUSIC_ROWS,
    popularity: float = fixed.SAMPLE_MUSIC_POPULARITY,
    length: str = fixed.SAMPLE_MUSIC_LENGTH,
    per_artist: int = fixed.SAMPLE_MUSIC_PER_ARTIST,
    per_genre: int = fixed.SAMPLE_MUSIC_PER_GENRE,
) -> DataFrame:
    """Most popular clean tracks with caps per artist and genre.

    When too few reach the popularity, that condition alone is dropped.
    """
    df = coerce_numeric(raw, fixed.SAMPLE_MUSIC_NUMBERS)
    df = ensure_columns(df, {"popularity": "double"}, {"popularity": 0.0})
    keys = ["track_id"] if "track_id" in df.columns else ["artists", "track_name"]
    df = dedupe_first(df, keys, "row_id")
    kept = F.expr(length) if "duration_ms" in df.columns else F.lit(True)
    if "explicit" in df.columns:
        kept = kept & ~is_true_text(F.col("explicit"))
    df = staged(df.where(kept), "music-sample")
    found = relaxed_filter(df, f"popularity >= {popularity}", "true", rows, keys, "row_id")
    picked = twice_capped_sample(
        found, ["popularity"], "row_id", ("artists", per_artist), ("track_genre", per_genre), rows
    )
    return keep_columns(picked, fixed.SAMPLE_MUSIC_COLUMNS)


def sample_coverage(sample: DataFrame) -> DataFrame:
    """Artists and genres that a sample of tracks covers."""
    return coverage(sample, [c for c in ("artists", "track_genre") if c in sample.columns])
