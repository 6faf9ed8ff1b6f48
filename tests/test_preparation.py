"""Whole jobs on small raw tables with the awkward rows."""

import pytest

from triptych.operators.sampling import Stratum
from triptych.plans import constants as fixed
from triptych.plans import preparation, samples

LONG = "An overview that is longer than twenty characters"


@pytest.fixture(scope="module")
def movies(spark):
    rows = [
        (1, "A", "A0", LONG, "Released", "9.0", "20000", "[]"),
        (2, "B", "A0", LONG, "Released", "9.9", "90000", "[]"),
        (3, "C", "C0", "x" * 20, "Released", "9.0", "20000", "[]"),
        (4, "D", "D0", "x" * 21, "Released", "8.5", "15000", None),
        (5, "E", "E0", LONG, "Rumored", "9.0", "20000", "[]"),
        (6, None, "F0", LONG, "Released", "9.0", "20000", "[]"),
        (7, "G", "G0", LONG, "Released", "7.5", "n/a", ""),
        (8, "H", "H0", LONG, "Released", "6.0", "0", "[]"),
    ]
    return spark.createDataFrame(
        rows,
        "row_id bigint, title string, original_title string, overview string, status string, "
        "vote_average string, vote_count string, genres string",
    )


def test_movies(movies):
    cleaned = preparation.clean_movies(movies)
    assert sorted(r.row_id for r in cleaned.collect()) == [1, 4, 7, 8]
    out = preparation.prepare_movies(movies, rows=10, use_tfidf=False)
    assert out.columns == [c for c in fixed.MOVIE_COLUMNS if c not in ("release_date", "runtime", "popularity")]
    rows = out.collect()
    # The two best are drawn by three overlapping strata each; the others fill up.
    assert sorted((r.title, r._stratum[:6]) for r in rows if r._stratum != "Extra") == sorted(
        [(t, s) for t in "AD" for s in ("High-S", "Genre/")] + [("A", "Random")]
    )
    assert sorted(r.title for r in rows if r._stratum == "Extra") == ["G", "H"]
    assert {r.title: r.text_representation for r in rows}["G"] == f"G. {LONG}"
    assert {r.title: r.weighted_rating for r in rows}["H"] is None


def test_books(spark):
    books = spark.createDataFrame(
        [
            (1, 10, "T1", None, None, "4.5", "20000", "1999"),
            (2, 11, "T2", "O2", "W", "4.1", "50", "1800"),
            (3, 12, "T3", "O3", "W", "2.9", "500", "2000"),
            (4, 13, "T4", "O4", "W", "4.0", "500", "abc"),
        ],
        "row_id bigint, id bigint, title string, original_title string, authors string, "
        "average_rating string, ratings_count string, original_publication_year string",
    )
    bridge = spark.createDataFrame(
        [(i, 10, i % 20) for i in range(18)] + [(50, 11, 99), (51, 11, 3), (52, None, 3)],
        "row_id bigint, goodreads_book_id bigint, tag_id bigint",
    )
    tags = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "tag_id bigint, tag_name string")
    out = {r.book_id: r for r in preparation.prepare_books(books, bridge, tags, rows=4, use_tfidf=False).collect()}
    assert sorted(out) == [10, 11]
    assert out[10].tag_list == ", ".join(f"t{i}" for i in range(15))
    assert out[11].tag_list == "t3"
    assert (out[10].original_title, out[10].authors) == ("T1", "Unknown")
    assert out[11].text_representation == "T2. W. t3"


def test_music_deduplicates_before_it_filters(spark):
    rows = [
        (1, "t1", "first", "29999", "80"),
        (2, "t1", "second", "30000", "90"),
        (3, "t2", "kept", "600000", "x"),
        (4, "t3", "", "40000", "50"),
        (5, "t4", "best", "30000", "70"),
    ]
    raw = spark.createDataFrame(rows, "row_id bigint, track_id string, track_name string, duration_ms string, popularity string")
    out = preparation.prepare_music(raw, rows=10, use_tfidf=False).collect()
    assert {(r.track_name, r.popularity, r._stratum) for r in out} == {
        ("kept", 0.0, "Independent / Niche (20%)"),
        ("best", 70.0, "Highly Popular (30%)"),
    }
    assert {r.audio_description for r in out} == {"kept", "best"}


@pytest.fixture(scope="module")
def cities(spark):
    rows = [
        (1, "na", "windhoek", " ", "21", "268132", "-22.57", "17.08", "x"),
        (2, "it", " o'brien-sul ", None, None, None, "40.1", None, "x"),
        (3, "it", "napoli", "Napoli", "04", "988972", "40.8", "14.2", "x"),
        (4, "it", "napoli", "Napoli", "04", "1000001", "40.8", "14.2", "x"),
        (5, "it", "", "Ghost", "04", "5", "40.8", "14.2", "x"),
        (6, "it", "nowhere", "Nowhere", "04", "5", "abc", "14.2", "x"),
    ]
    return spark.createDataFrame(
        rows,
        "row_id bigint, Country string, City string, AccentCity string, Region string, Population string, "
        "Latitude string, Longitude string, Unused string",
    )


def test_places(cities):
    out = {r.name: r for r in preparation.prepare_places(cities, rows=10, use_tfidf=False).collect()}
    assert set(out) == {"Windhoek", "O'Brien-Sul", "Napoli"}
    assert out["Windhoek"].country == "NA"
    assert out["Napoli"].description == (
        "Napoli is a city in IT. major metropolitan area. population 1,000,001. in 04 region."
    )
    assert out["O'Brien-Sul"].population == 0.0


def test_place_sample_needs_both_coordinates(cities):
    out = {r.name: r for r in samples.sample_places(cities, rows=5, per_country=1).collect()}
    assert set(out) == {"Windhoek", "Napoli"}
    assert out["Windhoek"].description.endswith("The city lies in the southern and eastern hemispheres.")


def test_sources_without_optional_columns(spark):
    raw = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "y")], "row_id bigint, artists string, track_name string")
    out = samples.sample_music(raw, rows=5)
    assert sorted(r.track_name for r in out.collect()) == ["x", "y"]


def test_copies_from_two_strata_count_as_two_texts(spark, movies):
    strata = (Stratum("one", "vote_count > 0", 0.5), Stratum("two", "vote_count > 0", 0.5))
    out = preparation.prepare_movies(movies, rows=4, strata=strata).collect()
    assert sorted((r.title, r._stratum) for r in out) == [("A", "one"), ("A", "two"), ("D", "one"), ("D", "two")]
    assert all("overview" in r.text_representation for r in out if r.title == "A")
    assert preparation.strata_summary({"movie": spark.createDataFrame(out)}).collect() == [("movie", "one", 2), ("movie", "two", 2)]
