"""The whole catalogue: raw CSV files to processed tables, lookup, vectors, and their renewal."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import pipelines
from checks.bind import table
from checks.registry import query
from checks.text import TOKEN
from triptych.operators.encode import hashing_encoder
from triptych.plans import catalogue
from triptych.sources import tables, vectors
from triptych.staging import new_path

ENCODER = "hashing 384"


def raw_files(spark, folder):
    """The raw tables as CSV files, several of each, in the order of their keys."""
    raw = {
        "movie": pipelines.raw_movies(spark, folder),
        "book": pipelines.raw_books(spark, folder),
        "book_tags": pipelines.raw_book_tags(spark, folder),
        "tags": pipelines.raw_tags(spark, folder).withColumn("row_id", F.col("tag_id")),
        "music": pipelines.raw_music(spark, folder),
        "destination": pipelines.raw_places(spark, folder),
    }
    paths = {}
    for kind, df in raw.items():
        paths[kind] = new_path(spark, f"raw-{kind}")
        encoding = catalogue.PLACE_ENCODING if kind == "destination" else "UTF-8"
        tables.export_csv(df.orderBy("row_id").drop("row_id"), paths[kind], encoding=encoding)
    return paths


def prepared(spark, folder):
    """The processed tables of all kinds, from the raw files."""
    out = new_path(spark, "prepared")
    catalogue.prepare_all(spark, raw_files(spark, folder), out)
    return {kind: spark.read.parquet(f"{out}/{kind}") for kind in ("movie", "book", "music", "destination")}


def all_sql(columns: str, book_key: str = "book_id") -> str:
    """Rows of all kinds as the SQL of each one's own job gives them."""
    return f"""
  SELECT 'movie' AS kind, row_id AS item_id, {columns} FROM (WITH {pipelines.MOVIES}
    SELECT row_id, _stratum, title AS t1, original_title AS t2, text_representation FROM sampled JOIN emphasised USING (copy))
  UNION ALL SELECT 'book', {book_key}, {columns} FROM (WITH {pipelines.BOOKS}
    SELECT book_id, _stratum, title AS t1, original_title AS t2, text_representation FROM sampled JOIN emphasised USING (copy))
  UNION ALL SELECT 'music', row_id, {columns} FROM (WITH {pipelines.MUSIC}
    SELECT row_id, _stratum, track_name AS t1, track_id AS t2, text_representation FROM sampled JOIN emphasised USING (copy))
  UNION ALL SELECT 'destination', row_id, {columns} FROM (WITH {pipelines.PLACES}
    SELECT row_id, _stratum, name AS t1, NULL AS t2, text_representation FROM sampled JOIN emphasised USING (copy))"""


def elements_sql(key: str, source: str) -> str:
    """Non-zero elements of the vectors of texts: the key, pos and x."""
    return f"""
words AS (SELECT {key}, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS word FROM {source}),
slots AS (
  SELECT {key}, CAST(('0x' || substr(md5(word), 1, 8)) AS BIGINT) % 384 AS pos,
         CASE WHEN CAST(('0x' || substr(md5(word), 9, 1)) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END AS sign FROM words),
summed AS (SELECT {key}, pos, CAST(sum(sign) AS DOUBLE) AS x FROM slots GROUP BY {key}, pos),
elements AS (
  SELECT {key}, pos, round(CAST(CAST(x / sqrt(sum(x * x) OVER (PARTITION BY {key})) AS FLOAT) AS DOUBLE), 5) AS x
  FROM summed QUALIFY x <> 0)"""


@query("prepare_all", f"SELECT * FROM ({all_sql('_stratum, text_representation')}) t")
def prepare_all(spark, folder):
    """Every kind from raw CSV files to its processed table, with the ids of the items."""
    parts = [
        df.select(F.lit(kind).alias("kind"), "item_id", "_stratum", "text_representation")
        for kind, df in prepared(spark, folder).items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    "catalogue_lookup",
    f"""WITH every AS ({all_sql('t1, t2')}),
        titled AS (
          SELECT kind, item_id, lower(trim(t1)) AS title_key FROM every UNION ALL SELECT kind, item_id, lower(trim(t2)) FROM every)
        SELECT kind AS media_type, title_key, max(item_id) AS item_id FROM titled
        WHERE kind <> 'destination' AND title_key <> '' GROUP BY kind, title_key""",
)
def catalogue_lookup(spark, folder):
    """Titles of the prepared films, books and tracks, each kind with its own two title columns."""
    return catalogue.catalogue_lookup(prepared(spark, folder))


@query(
    "embed_all",
    f"""WITH every AS (SELECT kind, item_id, any_value(text_representation) AS text
          FROM ({all_sql('text_representation')}) t GROUP BY kind, item_id),
        {elements_sql('kind, item_id', 'every')}
        SELECT kind, item_id, pos, x FROM elements""",
)
def embed_all(spark, folder):
    """Vectors of all items of a prepared catalogue; a second run finds nothing to do."""
    out, tables_ = new_path(spark, "embedded"), prepared(spark, folder)
    for _ in range(2):
        catalogue.embed_all(tables_, out, hashing_encoder(384), ENCODER)
    parts = [
        vectors.current_vectors(spark, catalogue.vectors_folder(out, kind)).select(
            F.lit(kind).alias("kind"), "item_id", F.posexplode("embedding").alias("pos", "x")
        )
        for kind in tables_
    ]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return both.where("x <> 0").withColumn("x", F.round(F.col("x").cast("double"), 5))


@query(
    "refresh_vectors",
    f"""WITH items AS (
          SELECT p_partkey AS item_id, CASE WHEN p_partkey % 10 = 5 THEN p_name ELSE concat_ws(' ', p_name, p_brand, p_type) END AS text
          FROM part WHERE p_partkey % 10 <> 7),
        {elements_sql('item_id', 'items')}
        SELECT item_id, CASE item_id % 10 WHEN 3 THEN 'new' WHEN 5 THEN 'changed' ELSE 'kept' END AS change, pos, x FROM elements
        UNION ALL SELECT p_partkey, 'gone', NULL, NULL FROM part WHERE p_partkey % 10 = 7""",
)
def refresh_vectors(spark, folder):
    """Saved vectors after a second delivery of the items: some new, some with other texts, some gone."""
    folder_ = new_path(spark, "refreshed")
    k = F.col("item_id")
    items = table(spark, folder, "part").select(
        F.col("p_partkey").alias("item_id"), "p_name", F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text")
    )
    second = items.where(k % 10 != 7).withColumn("text", F.when(k % 10 == 5, F.col("p_name")).otherwise(F.col("text")))
    for delivery in (items.where(k % 10 != 3), second):
        changes = vectors.refresh_vectors(delivery, folder_, hashing_encoder(384), ENCODER, "text")
    saved = vectors.current_vectors(spark, folder_).join(changes, "item_id", "left")
    elements = saved.select("item_id", F.coalesce("change", F.lit("kept")).alias("change"), F.posexplode("embedding").alias("pos", "x"))
    shown = elements.where("x <> 0").withColumn("x", F.round(F.col("x").cast("double"), 5))
    gone = changes.where("change = 'gone'")
    return shown.unionByName(gone, allowMissingColumns=True)
