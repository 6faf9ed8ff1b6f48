"""The roles of the test tables: items with votes, places, vectors, requests, feedback records.

Each role is a DataFrame here and a common table expression of the same content below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from triptych.operators.lookup import title_lookup
from triptych.operators.sampling import Stratum
from triptych.plans.recommend import FOUND, NOT_FOUND
from triptych.sources.feedback_log import feedback_record, media_struct
from triptych.sources.vectors import search_table


SCHEMAS: dict[tuple[str, str], StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A test table; its schema is looked up in the file once per process."""
    path = f"{folder}/{name}.parquet"
    if (folder, name) not in SCHEMAS:
        SCHEMAS[folder, name] = spark.read.parquet(path).schema
    return spark.read.schema(SCHEMAS[folder, name]).parquet(path)


# --- items with ratings and votes ---------------------------------------------------------------
def items(spark: SparkSession, folder: str) -> DataFrame:
    """Parts; orders lines are votes, quantities are ratings. Votes are counted before the join."""
    votes = (
        table(spark, folder, "lineitem")
        .groupBy("l_partkey")
        .agg(F.count("l_orderkey").alias("votes"), F.avg("l_quantity").alias("rating"))
    )
    parts = table(spark, folder, "part")
    return parts.join(votes, F.col("p_partkey") == F.col("l_partkey"), "left").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"),
        F.col("p_size").cast("bigint").alias("size"),
        F.col("p_retailprice").alias("price"),
        F.coalesce("votes", F.lit(0)).alias("votes"),
        "rating",
    )


ITEMS = """
items AS (
  SELECT p_partkey AS item_id, p_name AS title, p_type AS category, p_brand AS brand,
         CAST(p_size AS BIGINT) AS size, p_retailprice AS price, coalesce(votes, 0) AS votes, rating
  FROM part LEFT JOIN (
    SELECT l_partkey, count(l_orderkey) AS votes, avg(l_quantity) AS rating FROM lineitem GROUP BY l_partkey
  ) v ON l_partkey = p_partkey)"""

ITEM_STRATA = (
    Stratum("s1", "weighted_rating >= 27 and votes >= 30", 0.4),
    Stratum("s2", "weighted_rating >= 26 and weighted_rating < 27 and votes >= 25", 0.3),
    Stratum("s3", "weighted_rating >= 25 and votes >= 20", 0.2),
    Stratum("s4", "weighted_rating >= 24 and votes >= 15", 0.1),
)

# The prior and the rating with it, as used by the scored items.
SCORED = (
    ITEMS
    + """,
prior AS (SELECT avg(rating) AS c, quantile_cont(votes, 0.25) AS m FROM items WHERE votes > 0),
scored AS (
  SELECT items.*, round(CASE WHEN votes > 0
    THEN votes / (votes + m) * rating + m / (votes + m) * c END, 6) AS weighted_rating
  FROM items, prior)"""
)


# --- places -------------------------------------------------------------------------------------
def people(balance: str) -> Column:
    return F.floor(F.col(balance) * 200).cast("bigint")


def places(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as places: some without population or region, some with a blank region."""
    nation = table(spark, folder, "nation")
    region = table(spark, folder, "region")
    k = F.col("c_custkey")
    return (
        table(spark, folder, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            k.alias("place_id"),
            F.col("c_name").alias("name"),
            F.col("n_name").alias("country"),
            F.when(k % 9 != 0, people("c_acctbal")).alias("population"),
            F.when(k % 5 == 0, " ").when(k % 7 != 0, F.col("r_name")).alias("region"),
            F.when(k % 11 != 0, F.col("c_acctbal") / 100 - 40).alias("latitude"),
            (k % 360 - 180).cast("double").alias("longitude"),
        )
    )


PLACES = """
places AS (
  SELECT c_custkey AS place_id, c_name AS name, n_name AS country,
         CASE WHEN c_custkey % 9 <> 0 THEN CAST(floor(c_acctbal * 200) AS BIGINT) END AS population,
         CASE WHEN c_custkey % 5 = 0 THEN ' ' WHEN c_custkey % 7 <> 0 THEN r_name END AS region,
         CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal / 100 - 40 END AS latitude,
         CAST(c_custkey % 360 - 180 AS DOUBLE) AS longitude
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


# --- vectors, lookup, targets, requests ---------------------------------------------------------
def medium(key: str) -> Column:
    return F.element_at(F.array(F.lit("movie"), F.lit("book"), F.lit("music")), (F.col(key) % 3 + 1).cast("int"))


MEDIUM = "CASE p_partkey % 3 WHEN 0 THEN 'movie' WHEN 1 THEN 'book' ELSE 'music' END"


def titled_items(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as movies, books and tracks, with a second title, in the order of their keys."""
    return table(spark, folder, "part").select(
        medium("p_partkey").alias("media_type"),
        F.col("p_partkey").alias("item_id"),
        F.col("p_partkey").alias("row_id"),
        F.col("p_name").alias("title"),
        F.concat_ws(" ", "p_brand", "p_type").alias("original_title"),
    )


def lookup(spark: SparkSession, folder: str) -> DataFrame:
    return title_lookup(titled_items(spark, folder), ["title", "original_title"])


LOOKUP = f"""
titled AS (
  SELECT {MEDIUM} AS media_type, p_partkey AS item_id, p_name AS title, p_brand || ' ' || p_type AS original_title
  FROM part),
lookup AS (
  SELECT media_type, title_key, max(item_id) AS item_id FROM (
    SELECT media_type, item_id, lower(trim(title)) AS title_key FROM titled
    UNION ALL
    SELECT media_type, item_id, lower(trim(original_title)) FROM titled) t
  WHERE title_key <> '' GROUP BY media_type, title_key)"""


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """A vector for every part."""
    stored = table(spark, folder, "embeddings")
    place = F.pmod(F.col("p_partkey"), F.lit(stored.count()))
    return (
        table(spark, folder, "part")
        .select(medium("p_partkey").alias("media_type"), F.col("p_partkey").alias("item_id"), place.alias("vec_id"))
        .join(stored, "vec_id")
        .select("media_type", "item_id", "embedding")
    )


VECTORS = f"""
vectors AS (
  SELECT {MEDIUM} AS media_type, p_partkey AS item_id, CAST(embedding AS DOUBLE[]) AS embedding
  FROM part JOIN embeddings ON vec_id = p_partkey % (SELECT count(*) FROM embeddings))"""


def targets(spark: SparkSession, folder: str) -> DataFrame:
    """Unit vectors with the metadata of a supplier and its nation."""
    suppliers = table(spark, folder, "supplier")
    count = suppliers.count()
    nation = table(spark, folder, "nation")
    named = suppliers.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", F.col("s_name").alias("name"), F.col("n_name").alias("country"), people("s_acctbal").alias("population")
    )
    unit = search_table(table(spark, folder, "embeddings").withColumnRenamed("vec_id", "item_id")).drop("source_hash")
    return unit.join(named, F.pmod(F.col("item_id"), F.lit(count)) == F.col("s_suppkey")).drop("s_suppkey")


def target_vectors(spark: SparkSession, folder: str) -> DataFrame:
    stored = table(spark, folder, "embeddings").withColumnRenamed("vec_id", "item_id")
    return search_table(stored).drop("source_hash")


TARGETS = """
targets AS (
  SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS embedding,
         sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS length,
         s_name AS name, n_name AS country, CAST(floor(s_acctbal * 200) AS BIGINT) AS population
  FROM embeddings JOIN supplier ON s_suppkey = vec_id % (SELECT count(*) FROM supplier)
  JOIN nation ON s_nationkey = n_nationkey)"""


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """One request per customer: some titles unknown or blank, some weights zero."""
    parts = table(spark, folder, "part").select("p_partkey", "p_name")
    count = parts.count()
    asked = table(spark, folder, "customer").select(F.col("c_custkey").alias("request_id"))
    k = F.col("request_id")
    for m, step in (("movie", 7), ("book", 11), ("music", 13)):
        named = parts.select(F.col("p_partkey").alias(f"{m}_key"), F.col("p_name").alias(f"{m}_name"))
        asked = asked.join(named, F.pmod(k * step, F.lit(count)) == F.col(f"{m}_key"))
    zero = k % 97 == 0
    return asked.select(
        "request_id",
        F.when(k % 50 == 0, " ").when(k % 4 == 0, "no such film").otherwise(F.upper("movie_name")).alias("movie_title"),
        F.when(k % 6 == 0, "no such book").otherwise(F.concat(F.lit("  "), "book_name")).alias("book_title"),
        F.when(k % 4 == 0, "no such track").otherwise(F.col("music_name")).alias("music_title"),
        F.when(zero, 0.0).otherwise(1.0).alias("movie_weight"),
        F.when(zero, 0.0).otherwise(1.0 + k % 2).alias("book_weight"),
        F.when(zero, 0.0).otherwise(0.5).alias("music_weight"),
        (k % 5 + 1).cast("int").alias("top_k"),
    )


REQUESTS = """
requests AS (
  SELECT c_custkey AS request_id,
         CASE WHEN c_custkey % 50 = 0 THEN ' ' WHEN c_custkey % 4 = 0 THEN 'no such film' ELSE upper(a.p_name) END AS movie_title,
         CASE WHEN c_custkey % 6 = 0 THEN 'no such book' ELSE '  ' || b.p_name END AS book_title,
         CASE WHEN c_custkey % 4 = 0 THEN 'no such track' ELSE c.p_name END AS music_title,
         CASE WHEN c_custkey % 97 = 0 THEN 0.0 ELSE 1.0 END AS movie_weight,
         CASE WHEN c_custkey % 97 = 0 THEN 0.0 ELSE 1.0 + c_custkey % 2 END AS book_weight,
         CASE WHEN c_custkey % 97 = 0 THEN 0.0 ELSE 0.5 END AS music_weight,
         c_custkey % 5 + 1 AS top_k
  FROM customer
  JOIN part a ON a.p_partkey = (c_custkey * 7) % (SELECT count(*) FROM part)
  JOIN part b ON b.p_partkey = (c_custkey * 11) % (SELECT count(*) FROM part)
  JOIN part c ON c.p_partkey = (c_custkey * 13) % (SELECT count(*) FROM part))"""

# Items found for the three titles of each request, and the fused query vectors.
RESOLVED = (
    LOOKUP
    + ","
    + REQUESTS
    + """,
resolved AS (
  SELECT r.*, m.item_id AS movie_item, b.item_id AS book_item, u.item_id AS music_item,
         trim(movie_title) <> '' AND trim(book_title) <> '' AND trim(music_title) <> '' AS filled
  FROM requests r
  LEFT JOIN lookup m ON m.media_type = 'movie' AND m.title_key = lower(trim(movie_title))
  LEFT JOIN lookup b ON b.media_type = 'book' AND b.title_key = lower(trim(book_title))
  LEFT JOIN lookup u ON u.media_type = 'music' AND u.title_key = lower(trim(music_title)))"""
)

FUSED = (
    RESOLVED
    + ","
    + VECTORS
    + """,
parts AS (
  SELECT request_id, top_k, movie_weight AS weight, embedding FROM resolved JOIN vectors ON item_id = movie_item WHERE filled
  UNION ALL
  SELECT request_id, top_k, book_weight, embedding FROM resolved JOIN vectors ON item_id = book_item WHERE filled
  UNION ALL
  SELECT request_id, top_k, music_weight, embedding FROM resolved JOIN vectors ON item_id = music_item WHERE filled),
elements AS (
  SELECT request_id, top_k, pos, sum(weight * embedding[pos]) / sum(weight) AS x
  FROM parts, (SELECT unnest(range(1, 65)) AS pos) p
  GROUP BY request_id, top_k, pos HAVING sum(weight) <> 0),
fused AS (
  SELECT request_id, top_k, list(x ORDER BY pos) AS vector, sqrt(sum(x * x)) AS length
  FROM elements GROUP BY request_id, top_k)"""
)

RECOMMENDED = (
    FUSED
    + ","
    + TARGETS
    + """,
scored AS (
  SELECT request_id, top_k, item_id, name, country, population,
         round(list_dot_product(f.vector, t.embedding) / (f.length * t.length), 6) + 0.0 AS score
  FROM fused f, targets t),
recommended AS (
  SELECT request_id, top_k, item_id, name, country, population, score,
         row_number() OVER (PARTITION BY request_id ORDER BY score DESC, item_id) AS rank
  FROM scored QUALIFY rank <= top_k)"""
)


# --- feedback records ---------------------------------------------------------------------------
def feedback(spark: SparkSession, folder: str) -> DataFrame:
    """Events as feedback records, `row_id` is the order of arrival."""
    k, u = F.col("event_id"), F.col("user_id")
    movie = F.concat(F.lit("film "), F.get_json_object("props", "$.k"))
    book = F.concat(F.lit("book "), (u % 50).cast("string"))
    music = F.when(u % 8 != 0, F.concat(F.lit("Track "), F.col("event_type")))
    found = lambda every, title: F.concat(
        F.when(k % every == 0, NOT_FOUND).otherwise(FOUND), F.coalesce(title, F.lit(""))
    )
    status = media_struct(found(3, movie), found(4, book), found(5, music))
    results = F.transform(
        F.sequence(F.lit(1), F.lit(5)),
        lambda i: F.struct(
            i.alias("rank"),
            F.concat(F.lit("Place "), ((u + i) % 40).cast("string")).alias("name"),
            F.concat(F.lit("C"), ((u + i) % 7).cast("string")).alias("country"),
            F.round(F.col("value") / i, 4).alias("score"),
        ),
    )
    record = feedback_record(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
        media_struct(movie, book, music),
        status,
        F.slice(results, F.lit(1), (k % 4).cast("int")),
        F.col("event_type"),
        1 + k % 5,
        F.when(k % 6 == 1, "").when(k % 6 != 0, F.concat(F.lit("note "), k.cast("string"))),
    )
    return (
        table(spark, folder, "events")
        .select(k.alias("row_id"), record.alias("r"))
        .select("row_id", "r.*")
        .withColumn("search_status", F.when(F.col("row_id") % 11 == 0, F.col("status")))
        .withColumn("status", F.when(F.col("row_id") % 11 != 0, F.col("status")))
    )


FEEDBACK = """
feedback AS (
  SELECT event_id AS row_id, ts, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, user_id, value,
         'film ' || json_extract_string(props, '$.k') AS movie,
         'book ' || (user_id % 50) AS book,
         CASE WHEN user_id % 8 <> 0 THEN 'Track ' || event_type END AS music,
         event_id % 3 <> 0 AS movie_found, event_id % 4 <> 0 AS book_found, event_id % 5 <> 0 AS music_found,
         event_id % 4 AS n_results, event_type AS satisfaction, 1 + event_id % 5 AS stars,
         CASE WHEN event_id % 6 > 1 THEN 'note ' || event_id END AS comments
  FROM events)"""
