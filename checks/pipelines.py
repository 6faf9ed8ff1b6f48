"""Whole preparation and sampling jobs on raw tables made from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import bind
from checks.bind import table
from checks.cleaning import AUDIO, PLACE_SENTENCES, PLACE_TEXT, SPACE
from checks.ranking import strata_sql, twice_capped_sql
from checks.registry import query
from checks.text import emphasis_sql
from triptych.operators.sampling import stratified_sample
from triptych.plans import constants as fixed
from triptych.plans import preparation, samples
from triptych.plans.enrich import enrich_descriptions
from triptych.staging import staged

COUNT_DOCUMENTS = "(SELECT count(*) FROM documents)"


# --- raw tables ---------------------------------------------------------------------------------
def raw_movies(spark, folder):
    """Items as films: titles that repeat, numbers as text, some unreleased, some without votes."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    k = F.col("item_id")
    place = F.pmod(k, F.lit(documents.count()))
    films = bind.items(spark, folder).join(documents, place == F.col("doc_id"))
    return films.select(
        k.alias("row_id"),
        F.concat("title", F.lit(" "), k.cast("string")).alias("title"),
        F.concat("title", F.lit(" "), F.floor(k / 3).cast("string")).alias("original_title"),
        F.col("text").alias("overview"),
        F.when(k % 4 == 0, "").otherwise(F.col("category")).alias("genres"),
        F.lit("2001-01-01").alias("release_date"),
        F.when(k % 10 == 0, "Rumored").otherwise("Released").alias("status"),
        (60 + k % 150).cast("string").alias("runtime"),
        (F.col("rating") / 3.5).alias("vote_average"),
        F.when(k % 13 == 0, "n/a").otherwise((F.col("votes") * 400).cast("string")).alias("vote_count"),
        F.col("price").alias("popularity"),
    )


RAW_MOVIES = (
    bind.ITEMS
    + f""",
raw AS (
  SELECT item_id AS row_id, title || ' ' || item_id AS title, title || ' ' || (item_id // 3) AS original_title,
         text AS overview, CASE WHEN item_id % 4 = 0 THEN '' ELSE category END AS genres,
         '2001-01-01' AS release_date, CASE WHEN item_id % 10 = 0 THEN 'Rumored' ELSE 'Released' END AS status,
         CAST(60 + item_id % 150 AS DOUBLE) AS runtime, rating / 3.5 AS vote_average,
         CASE WHEN item_id % 13 <> 0 THEN CAST(votes * 400 AS DOUBLE) END AS vote_count, price AS popularity
  FROM items JOIN documents ON doc_id = item_id % {COUNT_DOCUMENTS})"""
)


def raw_books(spark, folder):
    """Items as books: some without original title, authors, or with a year that is no number.

    Written like a landed raw table. Otherwise the optimizer infers the filter on the year, which is
    made from the key, for every order line as well.
    """
    k = F.col("item_id")
    made = bind.items(spark, folder).select(
        k.alias("row_id"),
        k.alias("id"),
        F.concat("title", F.lit(" "), k.cast("string")).alias("title"),
        F.when(k % 2 == 0, F.col("category")).alias("original_title"),
        F.when(k % 5 != 0, F.col("brand")).alias("authors"),
        F.when(k % 31 == 0, "unknown").otherwise((1780 + (k * 7) % 250).cast("string")).alias("original_publication_year"),
        (F.col("rating") / 6.2).alias("average_rating"),
        (F.col("votes") * 400).alias("ratings_count"),
    )
    return staged(made, "raw-books")


RAW_BOOKS = (
    bind.ITEMS
    + """,
raw AS (
  SELECT item_id AS row_id, item_id AS book_id, title || ' ' || item_id AS title,
         CASE WHEN item_id % 2 = 0 THEN category ELSE title || ' ' || item_id END AS original_title,
         CASE WHEN item_id % 5 <> 0 THEN brand ELSE 'Unknown' END AS authors,
         CASE WHEN item_id % 31 <> 0 THEN CAST(1780 + (item_id * 7) % 250 AS DOUBLE) END AS original_publication_year,
         rating / 6.2 AS average_rating, CAST(votes * 400 AS DOUBLE) AS ratings_count
  FROM items),
bridge AS (
  SELECT (o_orderkey * 7) % (SELECT count(*) FROM part) AS book_id, o_orderkey % (SELECT count(*) + 10 FROM supplier) AS tag_id,
         o_orderkey AS row_id FROM orders),
tags AS (SELECT s_suppkey AS tag_id, s_name AS tag_name FROM supplier)"""
)


def raw_book_tags(spark, folder):
    books = table(spark, folder, "part").count()
    tags = table(spark, folder, "supplier").count() + 10
    k = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        F.pmod(k * 7, F.lit(books)).alias("book_id"), F.pmod(k, F.lit(tags)).alias("tag_id"), k.alias("row_id")
    )


def raw_tags(spark, folder):
    return table(spark, folder, "supplier").select(F.col("s_suppkey").alias("tag_id"), F.col("s_name").alias("tag_name"))


def raw_music(spark, folder):
    """Items as tracks: repeated ids, popularity missing or no number, some explicit."""
    k = F.col("item_id")
    return bind.items(spark, folder).select(
        k.alias("row_id"),
        F.concat(F.lit("t"), F.pmod(k, F.lit(1700)).cast("string")).alias("track_id"),
        F.when(k % 29 == 0, "").otherwise(F.concat("title", F.lit(" "), k.cast("string"))).alias("track_name"),
        F.concat("brand", F.lit(" "), (k % 9).cast("string")).alias("artists"),
        F.col("category").alias("track_genre"),
        F.when(k % 17 == 0, "").otherwise((F.col("votes") * 2 - 5).cast("string")).alias("popularity"),
        (F.col("size") * 13000).alias("duration_ms"),
        ((k % 7) / 6).alias("danceability"),
        ((k % 11) / 10).alias("energy"),
        ((k % 13) / 12).alias("valence"),
        F.when(k % 3 == 0, "True").when(k % 3 == 1, "no").alias("explicit"),
    )


RAW_MUSIC = (
    bind.ITEMS
    + """,
raw AS (
  SELECT item_id AS row_id, 't' || (item_id % 1700) AS track_id,
         CASE WHEN item_id % 29 = 0 THEN '' ELSE title || ' ' || item_id END AS track_name,
         brand || ' ' || (item_id % 9) AS artists, category AS track_genre,
         CASE WHEN item_id % 17 <> 0 THEN CAST(votes * 2 - 5 AS DOUBLE) END AS popularity,
         CAST(size * 13000 AS DOUBLE) AS duration_ms, (item_id % 7) / 6 AS danceability,
         (item_id % 11) / 10 AS energy, (item_id % 13) / 12 AS valence, coalesce(item_id % 3 = 0, false) AS explicit
  FROM items),
tracks AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY row_id) = 1)"""
)


def raw_places(spark, folder):
    """Customers as places under repeated names, with blanks, missing numbers and spaces."""
    nation = table(spark, folder, "nation")
    k = F.col("c_custkey")
    city = F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit("-on-sea "), (k % 40).cast("string"), F.lit("\t"))
    named = table(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return named.select(
        k.alias("row_id"),
        F.concat(F.lit(" "), F.lower("n_name")).alias("Country"),
        F.when(k % 37 != 0, city).otherwise("  ").alias("City"),
        F.when(k % 4 == 0, "").when(k % 4 == 1, F.concat(F.lit("Ville "), (k % 30).cast("string"))).alias("AccentCity"),
        F.when(k % 6 == 0, " ").otherwise((F.col("n_regionkey")).cast("string")).alias("Region"),
        F.when(k % 9 == 0, "").otherwise(bind.people("c_acctbal").cast("string")).alias("Population"),
        F.when(k % 23 == 0, "north").otherwise((F.col("c_acctbal") / 100 - 40).cast("string")).alias("Latitude"),
        F.when(k % 19 == 0, "").otherwise((k % 360 - 180).cast("string")).alias("Longitude"),
    )


RAW_PLACES = """
named AS (
  SELECT c_custkey AS row_id, upper(n_name) AS country,
         CASE WHEN c_custkey % 37 <> 0 THEN lower(c_mktsegment) || '-on-sea ' || (c_custkey % 40) ELSE '' END AS city,
         CASE WHEN c_custkey % 37 <> 0 THEN upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2))
           || '-On-Sea ' || (c_custkey % 40) END AS titled,
         CASE WHEN c_custkey % 4 = 1 THEN 'Ville ' || (c_custkey % 30) END AS display,
         CASE WHEN c_custkey % 6 = 0 THEN '' ELSE CAST(n_regionkey AS VARCHAR) END AS region,
         CASE WHEN c_custkey % 9 <> 0 THEN CAST(floor(c_acctbal * 200) AS DOUBLE) END AS population,
         CASE WHEN c_custkey % 23 <> 0 THEN c_acctbal / 100 - 40 END AS latitude,
         CASE WHEN c_custkey % 19 <> 0 THEN CAST(c_custkey % 360 - 180 AS DOUBLE) END AS longitude
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
raw AS (SELECT *, coalesce(display, titled) AS name FROM named WHERE city <> '')"""


# --- preparation --------------------------------------------------------------------------------
MOVIES = (
    RAW_MOVIES
    + """,
cleaned AS (
  SELECT * FROM raw WHERE length(title) > 0 AND length(overview) > 20 AND status = 'Released'
  QUALIFY row_number() OVER (PARTITION BY original_title ORDER BY row_id) = 1),
prior AS (SELECT avg(vote_average) AS c, quantile_cont(vote_count, 0.25) AS m FROM cleaned WHERE vote_count > 0),
scored AS (
  SELECT cleaned.*, CASE WHEN vote_count > 0
    THEN vote_count / (vote_count + m) * vote_average + m / (vote_count + m) * c END AS weighted_rating
  FROM cleaned, prior),"""
    + strata_sql("scored", 1000, fixed.MOVIE_STRATA, "weighted_rating", "row_id")
    + """,
sampled AS (
  SELECT *, row_id || chr(10) || _stratum AS copy,
         concat_ws('. ', title, overview, CASE WHEN genres <> '' THEN genres END) AS full_text
  FROM filled),"""
    + emphasis_sql("sampled", "copy", "full_text")
)


@query(
    "prepare_movies",
    f"""WITH {MOVIES}
        SELECT title, original_title, genres, vote_count, round(weighted_rating, 6) AS weighted_rating, _stratum, text_representation
        FROM sampled JOIN emphasised USING (copy)""",
)
def prepare_movies(spark, folder):
    movies = preparation.prepare_movies(raw_movies(spark, folder))
    return movies.select(
        "title", "original_title", "genres", "vote_count", F.round("weighted_rating", 6).alias("weighted_rating"), "_stratum", "text_representation"
    )


def tag_lists_sql(first: int) -> str:
    return f"""
lists AS (
  SELECT book_id, string_agg(tag_name, ', ' ORDER BY row_id) AS tag_list
  FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY row_id) AS n FROM bridge) t
  LEFT JOIN tags USING (tag_id) WHERE n <= {first} GROUP BY book_id)"""


BOOKS = (
    RAW_BOOKS
    + ","
    + tag_lists_sql(15)
    + f""",
cleaned AS (
  SELECT raw.*, coalesce(tag_list, '') AS tag_list FROM raw LEFT JOIN lists USING (book_id) WHERE {fixed.BOOK_FILTER}),
prior AS (SELECT avg(average_rating) AS c, quantile_cont(ratings_count, 0.4) AS m FROM cleaned),
scored AS (
  SELECT cleaned.*, ratings_count / (ratings_count + m) * average_rating + m / (ratings_count + m) * c AS weighted_score
  FROM cleaned, prior),"""
    + strata_sql("scored", 2000, fixed.BOOK_STRATA, "weighted_score", "row_id")
    + """,
sampled AS (
  SELECT *, row_id || chr(10) || _stratum AS copy,
         concat_ws('. ', title, authors, CASE WHEN tag_list <> '' THEN tag_list END) AS full_text
  FROM filled),"""
    + emphasis_sql("sampled", "copy", "full_text")
)


@query(
    "prepare_books",
    f"""WITH {BOOKS}
        SELECT book_id, title, original_title, authors, tag_list, round(weighted_score, 6) AS weighted_score, _stratum, text_representation
        FROM sampled JOIN emphasised USING (copy)""",
)
def prepare_books(spark, folder):
    books = preparation.prepare_books(raw_books(spark, folder), raw_book_tags(spark, folder), raw_tags(spark, folder))
    return books.select(
        "book_id", "title", "original_title", "authors", "tag_list", F.round("weighted_score", 6).alias("weighted_score"), "_stratum", "text_representation"
    )


MUSIC = (
    RAW_MUSIC
    + """,
cleaned AS (
  SELECT * REPLACE (coalesce(popularity, 0) AS popularity) FROM tracks
  WHERE duration_ms BETWEEN 30000 AND 600000 AND track_name <> ''),"""
    + strata_sql("cleaned", 2000, fixed.MUSIC_STRATA, "popularity", "row_id")
    + f""",
sampled AS (SELECT *, row_id || chr(10) || _stratum AS copy, {AUDIO} AS audio_description FROM filled),"""
    + emphasis_sql("sampled", "copy", "audio_description")
)


@query(
    "prepare_music",
    f"""WITH {MUSIC} SELECT track_id, track_name, popularity, s.audio_description, _stratum, text_representation
        FROM sampled s JOIN emphasised USING (copy)""",
)
def prepare_music(spark, folder):
    music = preparation.prepare_music(raw_music(spark, folder))
    return music.select("track_id", "track_name", "popularity", "audio_description", "_stratum", "text_representation")


PLACES = (
    RAW_PLACES
    + """,
cleaned AS (
  SELECT * REPLACE (coalesce(population, 0) AS population) FROM raw WHERE latitude IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY name, country ORDER BY coalesce(population, 0) DESC, row_id) = 1),"""
    + strata_sql("cleaned", 1000, fixed.PLACE_STRATA, "population", "row_id")
    + f""",
whole AS (SELECT * REPLACE (CAST(population AS BIGINT) AS population) FROM filled),
sampled AS (SELECT *, row_id || chr(10) || _stratum AS copy, {PLACE_TEXT} AS description FROM whole),"""
    + emphasis_sql("sampled", "copy", "description")
)


@query(
    "prepare_places",
    f"""WITH {PLACES} SELECT name, country, city, region, population, s.description, _stratum, text_representation
        FROM sampled s JOIN emphasised USING (copy)""",
)
def prepare_places(spark, folder):
    places = preparation.prepare_places(raw_places(spark, folder))
    return places.select(
        "name", "country", "city", "region", F.col("population").cast("bigint").alias("population"), "description", "_stratum", "text_representation"
    )


@query(
    "strata_counts",
    f"""WITH {bind.PLACES}, banded AS (SELECT CASE WHEN population > 1000000 THEN 'Metropolitan (30%)'
          WHEN population > 500000 THEN 'Large Cities (30%)' WHEN population > 100000 THEN 'Medium Cities (20%)'
          WHEN population <= 100000 THEN 'Small Towns (20%)' END AS stratum FROM places)
        SELECT 'destination' AS kind, stratum, least(count(*), CASE WHEN stratum LIKE '%30%' THEN 300 ELSE 200 END) AS n
        FROM banded WHERE stratum IS NOT NULL GROUP BY stratum""",
)
def strata_counts(spark, folder):
    """Rows per stratum of a run, without its fill."""
    sample = stratified_sample(
        bind.places(spark, folder), fixed.TARGET_ROWS["destination"], fixed.PLACE_STRATA, "population", "place_id"
    )
    return preparation.strata_summary({"destination": sample})


# --- small samples ------------------------------------------------------------------------------
SAMPLE_MOVIES = "runtime between 70 and 190 and vote_count >= 8000 and vote_average >= 7.0"


@query(
    "sample_movies",
    f"""WITH {RAW_MOVIES},
        cleaned AS (
          SELECT * FROM raw WHERE {SAMPLE_MOVIES} AND status = 'Released'
            AND len(regexp_extract_all(overview, '{SPACE.replace("[", "[^", 1)}+')) >= 40
          QUALIFY row_number() OVER (PARTITION BY original_title ORDER BY row_id) = 1),
        prior AS (
          SELECT avg(vote_average) AS c, floor(quantile_cont(vote_count, 0.75)) AS m,
                 avg(popularity) AS mean, stddev_pop(popularity) AS deviation FROM cleaned),
        scored AS (
          SELECT cleaned.*, vote_count / (vote_count + m) * vote_average + m / (vote_count + m) * c AS weighted_rating,
                 (popularity - mean) / (deviation + 1e-9) AS z FROM cleaned, prior)
        SELECT title, original_title, vote_count, round(weighted_rating, 6) AS weighted_rating,
               round(weighted_rating + 0.05 * greatest(-2, least(2, z)), 6) AS final_score
        FROM scored ORDER BY weighted_rating + 0.05 * greatest(-2, least(2, z)) DESC, vote_count DESC, row_id LIMIT 50""",
)
def sample_movies(spark, folder):
    best = samples.sample_movies(raw_movies(spark, folder), condition=SAMPLE_MOVIES)
    return best.select(
        "title", "original_title", "vote_count", F.round("weighted_rating", 6).alias("weighted_rating"), F.round("final_score", 6).alias("final_score")
    )


@query(
    "sample_books",
    f"""WITH {RAW_BOOKS}, {tag_lists_sql(10)},
        cleaned AS (
          SELECT raw.*, coalesce(tag_list, '') AS tag_list FROM raw LEFT JOIN lists USING (book_id)
          WHERE {fixed.SAMPLE_BOOK_FILTER}),
        prior AS (SELECT avg(average_rating) AS c, quantile_cont(ratings_count, 0.75) AS m FROM cleaned),
        scored AS (
          SELECT cleaned.*, ratings_count / (ratings_count + m) * average_rating + m / (ratings_count + m) * c AS weighted_score
          FROM cleaned, prior)
        SELECT book_id, title, authors, average_rating, ratings_count, tag_list
        FROM scored ORDER BY scored.weighted_score DESC, row_id LIMIT 100""",
)
def sample_books(spark, folder):
    best = samples.sample_books(raw_books(spark, folder), raw_book_tags(spark, folder), raw_tags(spark, folder))
    return best.select("book_id", "title", "authors", "average_rating", "ratings_count", "tag_list")


@query(
    "sample_places",
    f"""WITH {RAW_PLACES},
        cleaned AS (
          SELECT * FROM raw WHERE latitude IS NOT NULL AND longitude IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY name, country ORDER BY population DESC NULLS LAST, row_id) = 1),
        ranked AS (
          SELECT * REPLACE (CAST(population AS BIGINT) AS population),
                 row_number() OVER (PARTITION BY country ORDER BY population DESC NULLS LAST, row_id) AS n FROM cleaned),
        picked AS (
          SELECT * FROM ranked ORDER BY CASE WHEN n <= 5 THEN 0 ELSE 1 END, population DESC NULLS LAST, row_id LIMIT 150)
        SELECT name, country, city, region, population, {PLACE_SENTENCES} AS description FROM picked""",
)
def sample_places(spark, folder):
    picked = samples.sample_places(raw_places(spark, folder))
    return picked.select(
        "name", "country", "city", "region", F.col("population").cast("bigint").alias("population"), "description"
    )


@query(
    "sample_music",
    f"""WITH {RAW_MUSIC},
        allowed AS (SELECT * FROM tracks WHERE duration_ms BETWEEN 90000 AND 360000 AND NOT explicit),
        found AS (
          SELECT * FROM allowed WHERE popularity >= 50 OR (SELECT count(*) FROM allowed WHERE popularity >= 50) < 100),
        {twice_capped_sql("found", "popularity DESC NULLS LAST, row_id", "row_id", "artists", 2, "track_genre", 10, 100)}
        SELECT track_id, track_name, artists, track_genre, popularity FROM result""",
)
def sample_music(spark, folder):
    return samples.sample_music(raw_music(spark, folder)).select(
        "track_id", "track_name", "artists", "track_genre", "popularity"
    )


# --- enrichment ---------------------------------------------------------------------------------
@query(
    "enrich_fallback",
    f"""WITH {bind.PLACES},
        summaries AS (
          SELECT doc_id AS row_id,
                 CASE WHEN doc_id % 3 = 0 THEN 'Customer#' || lpad(CAST(doc_id // 2 AS VARCHAR), 9, '0') || ', ' || country
                      ELSE 'Customer#' || lpad(CAST(doc_id // 2 AS VARCHAR), 9, '0') END AS key,
                 regexp_replace(regexp_replace(CASE WHEN doc_id % 7 = 0 THEN '  ' ELSE text END, '{SPACE}+', ' ', 'g'), '^ | $', '', 'g') AS text
          FROM documents LEFT JOIN places ON place_id = doc_id // 2),
        usable AS (SELECT key, arg_min(text, row_id) AS text FROM summaries WHERE text <> '' AND key IS NOT NULL GROUP BY key)
        SELECT place_id, coalesce(f.text, n.text, 'A place in ' || country) AS description
        FROM places LEFT JOIN usable f ON f.key = name || ', ' || country LEFT JOIN usable n ON n.key = name""",
)
def enrich_fallback(spark, folder):
    """Documents as landed summaries: some under the full key, some under the name, some blank."""
    places = bind.places(spark, folder).withColumn("description", F.concat(F.lit("A place in "), "country"))
    k = F.col("doc_id")
    number = F.floor(k / 2)
    name = F.concat(F.lit("Customer#"), F.lpad(number.cast("string"), 9, "0"))
    countries = places.select("place_id", "country")
    summaries = (
        table(spark, folder, "documents")
        .join(countries, number == F.col("place_id"), "left")
        .select(
            k.alias("row_id"),
            F.when(k % 3 == 0, F.concat(name, F.lit(", "), "country")).otherwise(name).alias("key"),
            F.when(k % 7 == 0, "  ").otherwise(F.col("text")).alias("text"),
        )
    )
    return enrich_descriptions(places, summaries).select("place_id", "description")
