"""Column expressions that turn fields into descriptions, links and display texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from triptych.functions.cleaning import blank_to_null, strip

MILLION, HALF_MILLION, HUNDRED_THOUSAND = 1_000_000, 500_000, 100_000


def grouped_digits(c: Column) -> Column:
    """Whole part with thousands separators (cast first: format_number would round)."""
    return F.format_number(c.cast("bigint"), 0)


def place_tier(population: Column) -> Column:
    """Size words of a place; the limits are exclusive."""
    return (
        F.when(population > MILLION, "major metropolitan area")
        .when(population > HALF_MILLION, "large city")
        .when(population > HUNDRED_THOUSAND, "medium-sized city")
        .otherwise("charming town")
    )


def population_badge(population: Column) -> Column:
    """Size text shown on a result card; limits inclusive, empty when unknown or not positive."""
    people = F.concat(F.lit(" ("), grouped_digits(population), F.lit(" people)"))
    # format_number rounds the binary value to even, format_string its decimal digits upwards.
    millions = F.concat(F.lit(" ("), F.format_number(population.cast("double") / MILLION, 1), F.lit("M people)"))
    return (
        F.when(population.isNull() | (population <= 0), "")
        .when(population >= MILLION, F.concat(F.lit("🏙️ Major city"), millions))
        .when(population >= HALF_MILLION, F.concat(F.lit("🌆 Large city"), people))
        .when(population >= HUNDRED_THOUSAND, F.concat(F.lit("🏘️ Medium city"), people))
        .otherwise(F.concat(F.lit("🏡 Small town"), people))
    )


def describe_audio(
    name: Column, artists: Column, genre: Column, energy: Column, valence: Column, danceability: Column
) -> Column:
    """Words for a track: missing parts are left out, limits are exclusive."""
    return F.concat_ws(
        ". ",
        name,
        F.concat(F.lit("by "), artists),
        F.concat(genre, F.lit(" genre")),
        F.when(energy > 0.7, "high energy").when(energy < 0.3, "calm low energy"),
        F.when(valence > 0.7, "joyful upbeat").when(valence < 0.3, "melancholic sad"),
        F.when(danceability > 0.7, "danceable"),
    )


def describe_place(name: Column, country: Column, population: Column, region: Column) -> Column:
    """Dotted description of a place for the text representation."""
    return F.concat(
        F.concat_ws(
            ". ",
            F.concat(name, F.lit(" is a city in "), country),
            place_tier(population),
            F.when(population > 0, F.concat(F.lit("population "), grouped_digits(population))),
            F.when(F.length(strip(region)) > 0, F.concat(F.lit("in "), region, F.lit(" region"))),
        ),
        F.lit("."),
    )


def describe_place_sentences(
    name: Column, country: Column, population: Column, region: Column, lat: Column, lng: Column
) -> Column:
    """Description of a place in sentences, with its hemispheres."""
    north_south = F.when(lat >= 0, "northern").otherwise("southern")
    east_west = F.when(lng >= 0, "eastern").otherwise("western")
    return F.concat_ws(
        " ",
        F.concat(name, F.lit(" is a city in "), country, F.lit(".")),
        F.when(
            population > 0,
            F.concat(
                F.lit("It has an estimated population of about "), grouped_digits(population), F.lit(" people.")
            ),
        ),
        F.when(F.length(strip(region)) > 0, F.concat(F.lit("It is located in region "), region, F.lit("."))),
        F.when(
            lat.isNotNull() & lng.isNotNull(),
            F.concat(
                F.lit("The city lies in the "), north_south, F.lit(" and "), east_west, F.lit(" hemispheres.")
            ),
        ),
    )


def text_representation(*parts: Column) -> Column:
    """Non-empty parts joined with ". "."""
    return F.concat_ws(". ", *[blank_to_null(p) for p in parts])


def embedding_text(*columns: Column) -> Column:
    """Columns joined with a space, missing ones left out."""
    return F.concat_ws(" ", *[c.cast("string") for c in columns])


def excerpt(text: Column, shortest: int = 50, longest: int = 300) -> Column:
    """Nothing for very short texts, an ellipsis for long ones."""
    return F.when(
        F.length(text) > longest, F.concat(F.substring(text, 1, longest - 3), F.lit("..."))
    ).when(F.length(text) > shortest, text)


def code_point_bucket(text: Column, buckets: int = 1000) -> Column:
    """Sum of the code points modulo `buckets`: a bucket that is the same on every run."""
    points = F.transform(F.split(text, ""), lambda ch: F.ascii(ch).cast("bigint"))
    return F.aggregate(points, F.lit(0).cast("bigint"), lambda acc, p: acc + p) % buckets


def percent_encoded(text: Column) -> Column:
    """Percent-encoding that keeps letters, digits, `_.-~` and `/`."""
    encoded = F.url_encode(text)
    for java, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        encoded = F.replace(encoded, F.lit(java), F.lit(plain))
    return encoded


def wiki_link(name: Column) -> Column:
    return F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.replace(name, F.lit(" "), F.lit("_")))


def maps_link(name: Column, country: Column) -> Column:
    return F.concat(
        F.lit("https://www.google.com/maps/search/"), percent_encoded(name), F.lit("+"), country
    )


def placeholder_image(name: Column) -> Column:
    return F.concat(
        F.lit("https://picsum.photos/seed/"), code_point_bucket(name).cast("string"), F.lit("/800/280")
    )


def rank_medal(rank: Column) -> Column:
    return F.when(rank == 1, "🏆").when(rank == 2, "🥈").when(rank == 3, "🥉").otherwise("")


def present(names: Sequence[str], wanted: Sequence[str]) -> list[str]:
    """The wanted column names that exist, in the wanted order."""
    return [name for name in wanted if name in set(names)]
