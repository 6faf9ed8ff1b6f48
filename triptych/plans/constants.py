"""Filters, strata and columns of the prepared tables, as the results need them."""

from __future__ import annotations

from triptych.operators.sampling import Stratum

# --- movies -------------------------------------------------------------------------------------
MOVIE_NUMBERS = ("runtime", "vote_average", "vote_count", "popularity")
MOVIE_QUANTILE = 0.25
# An overview has more characters than this.
MOVIE_OVERVIEW = 20
MOVIE_STRATA = (
    Stratum("High-Score Classics (40%)", "weighted_rating >= 8.0 and vote_count >= 10000", 0.40),
    Stratum(
        "Strong but Less Mainstream (30%)",
        "weighted_rating >= 7.0 and weighted_rating < 8.0 and vote_count >= 1000",
        0.30,
    ),
    Stratum("Genre/Theme Variety (20%)", "weighted_rating >= 6.5 and vote_count >= 500", 0.20),
    Stratum("Random Niche (10%)", "weighted_rating >= 6.0 and vote_count >= 100", 0.10),
)
MOVIE_COLUMNS = (
    "title",
    "original_title",
    "overview",
    "genres",
    "release_date",
    "runtime",
    "vote_average",
    "vote_count",
    "popularity",
    "weighted_rating",
    "_stratum",
    "text_representation",
)

# --- books --------------------------------------------------------------------------------------
BOOK_NUMBERS = ("average_rating", "ratings_count", "original_publication_year")
BOOK_FILTER = (
    "average_rating >= 3.0 and ratings_count >= 50 and original_publication_year between 1800 and 2025"
)
BOOK_QUANTILE = 0.40
BOOK_TAGS = 15
BOOK_STRATA = (
    Stratum("Bestselling Classics (40%)", "average_rating >= 4.3 and ratings_count >= 10000", 0.40),
    Stratum(
        "High-Quality Works (30%)",
        "average_rating >= 4.0 and average_rating < 4.3 and ratings_count >= 1000",
        0.30,
    ),
    Stratum("Thematically Diverse (20%)", "average_rating >= 3.8 and ratings_count >= 500", 0.20),
    Stratum("Across Time Periods (10%)", "average_rating >= 3.5 and ratings_count >= 100", 0.10),
)
BOOK_COLUMNS = (
    "book_id",
    "title",
    "original_title",
    "authors",
    "original_publication_year",
    "average_rating",
    "ratings_count",
    "tag_list",
    "weighted_score",
    "_stratum",
    "text_representation",
)

# --- music --------------------------------------------------------------------------------------
MUSIC_NUMBERS = ("popularity", "duration_ms", "danceability", "energy", "valence")
# Numbers and columns of the small samples.
SAMPLE_MUSIC_NUMBERS = (
    "popularity", "duration_ms", "danceability", "energy", "key", "loudness", "mode", "speechiness",
    "acousticness", "instrumentalness", "liveness", "valence", "tempo", "time_signature",
)
SAMPLE_MOVIE_COLUMNS = (
    "title", "original_title", "overview", "genres", "keywords", "production_countries", "release_date", "runtime",
    "original_language", "vote_average", "vote_count", "popularity", "weighted_rating", "final_score",
)
SAMPLE_BOOK_COLUMNS = (
    "book_id", "title", "original_title", "authors", "original_publication_year", "average_rating", "ratings_count",
    "tag_list", "image_url", "small_image_url",
)
SAMPLE_PLACE_COLUMNS = ("name", "country", "city", "region", "population", "latitude", "longitude", "description")
SAMPLE_MUSIC_COLUMNS = (
    "track_id", "artists", "album_name", "track_name", "track_genre", "popularity", "duration_ms", "explicit",
    "danceability", "energy", "loudness", "speechiness", "acousticness", "instrumentalness", "liveness", "valence",
    "tempo", "key", "mode", "time_signature",
)
MUSIC_STRATA = (
    Stratum("Highly Popular (30%)", "popularity >= 70", 0.30),
    Stratum("Moderately Popular (30%)", "popularity >= 40 and popularity < 70", 0.30),
    Stratum("Emotionally Varied (20%)", "popularity >= 20 and popularity < 40", 0.20),
    Stratum("Independent / Niche (20%)", "popularity < 20", 0.20),
)
MUSIC_COLUMNS = (
    "track_id",
    "track_name",
    "artists",
    "track_genre",
    "popularity",
    "danceability",
    "energy",
    "valence",
    "audio_description",
    "_stratum",
    "text_representation",
)

# --- places -------------------------------------------------------------------------------------
PLACE_SOURCE = ("Country", "City", "AccentCity", "Region", "Population", "Latitude", "Longitude")
PLACE_NUMBERS = ("population", "latitude", "longitude")
PLACE_STRATA = (
    Stratum("Metropolitan (30%)", "population > 1000000", 0.30),
    Stratum("Large Cities (30%)", "population > 500000 and population <= 1000000", 0.30),
    Stratum("Medium Cities (20%)", "population > 100000 and population <= 500000", 0.20),
    Stratum("Small Towns (20%)", "population <= 100000", 0.20),
)
PLACE_COLUMNS = (
    "name",
    "country",
    "city",
    "region",
    "population",
    "latitude",
    "longitude",
    "description",
    "_stratum",
    "text_representation",
)

# --- keys and titles ----------------------------------------------------------------------------
# Columns with the key of an item, in order of preference, and columns that name an item.
SOURCE_KEYS = {"movie": ("id",), "book": ("book_id", "id")}
TITLE_COLUMNS = {
    "movie": ("title", "original_title"),
    "book": ("title", "original_title"),
    "music": ("track_name", "track_id"),
}

# Long texts of the raw files, with the characters of each that stay beside the numbers while a sample is drawn.
LONG_TEXTS = {"movie": {"overview": MOVIE_OVERVIEW + 1}}

# --- sizes of the prepared tables ---------------------------------------------------------------
TARGET_ROWS = {"movie": 1000, "book": 2000, "music": 2000, "destination": 1000}

# --- small samples ------------------------------------------------------------------------------
SAMPLE_MOVIE_FILTER = "runtime between 70 and 190 and vote_count >= 1000 and vote_average >= 7.0"
SAMPLE_MOVIE_WORDS = 40
SAMPLE_MOVIE_ROWS = 50
SAMPLE_BOOK_FILTER = (
    "average_rating >= 4.0 and ratings_count >= 5000 and original_publication_year between 1900 and 2025"
)
SAMPLE_BOOK_TAGS = 10
SAMPLE_BOOK_ROWS = 100
SAMPLE_QUANTILE = 0.75
SAMPLE_PLACES_PER_COUNTRY = 5
SAMPLE_PLACE_ROWS = 150
SAMPLE_MUSIC_POPULARITY = 50
SAMPLE_MUSIC_LENGTH = "duration_ms between 90000 and 360000"
SAMPLE_MUSIC_PER_ARTIST = 2
SAMPLE_MUSIC_PER_GENRE = 10
SAMPLE_MUSIC_ROWS = 100
