"""All item kinds at once: raw files to processed tables, processed tables to vectors."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triptych.functions.cleaning import to_number
from triptych.operators.audit import same_width
from triptych.operators.counting import table_sizes, union_tables
from triptych.operators.encode import Encoder
from triptych.operators.lookup import title_lookup
from triptych.plans import constants as fixed
from triptych.plans.preparation import prepare_books, prepare_movies, prepare_music, prepare_places, strata_summary
from triptych.sources.tables import exists, read_csv, set_aside, with_source_order, write_table
from triptych.sources.vectors import current_vectors, refresh_search_table, refresh_vectors

PLACE_ENCODING = "ISO-8859-1"


class DifferentWidths(ValueError):
    """Vectors of different tables, or within one, differ in width."""


def raw_file(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A raw CSV file as text columns.

    Files without line breaks in fields are split over tasks. Of places only the columns in use are read.
    """
    if kind == "destination":
        return read_csv(spark, path, fixed.PLACE_SOURCE, encoding=PLACE_ENCODING, multiline=None)
    return read_csv(spark, path, multiline=None)


def raw_table(read: DataFrame, kind: str) -> DataFrame:
    """A raw file with the number of each row as `row_id` and, for items, their lasting `item_id`.

    This is a written table. Long texts are set aside, since only those of a sample are needed.
    """
    return with_item_id(with_source_order(set_aside(read, fixed.LONG_TEXTS.get(kind, {}))), kind)


def with_item_id(raw: DataFrame, kind: str) -> DataFrame:
    """item_id: the whole number in the key column of the source, else the number of the row.

    Where the source has a key column, a row whose key is no whole number from 0 on gets a number
    below 0 that no key can be.
    """
    named = [c for c in fixed.SOURCE_KEYS.get(kind, ()) if c in raw.columns]
    if kind not in fixed.TARGET_ROWS or not named:
        return raw.withColumn("item_id", F.col("row_id")) if kind in fixed.TARGET_ROWS else raw
    number = to_number(F.col(named[0]).cast("string"))
    whole = F.when((number == F.floor(number)) & number.between(0, 2**53), number.cast("bigint"))
    return raw.withColumn("item_id", F.coalesce(whole, -1 - F.col("row_id")))


def prepare_all(
    spark: SparkSession,
    sources: Mapping[str, str],
    out: str,
    rows: Mapping[str, int] = fixed.TARGET_ROWS,
    use_tfidf: bool = True,
    **settings,
) -> tuple[DataFrame, DataFrame]:
    """Prepare every kind whose files exist; returns rows per table and rows per stratum.

    `sources` has the paths of movie, book, book_tags, tags, music and destination, each one file or
    a folder of files. The processed tables are written to `out`, one folder per kind, and begin with
    item_id; an item that several strata drew has a row for each. They are the same however the rows
    are dealt over files and files are split over tasks. Further settings, such as `stop_words`, are
    those of the emphasis on keywords.
    """
    read = {kind: raw_file(spark, path, kind) for kind, path in sources.items() if exists(spark, path)}
    # Tags are only looked up, so their order is not needed.
    raw = {kind: df if kind == "tags" else raw_table(df, kind) for kind, df in read.items()}
    jobs: dict[str, Callable[[], DataFrame]] = {}
    if "movie" in raw:
        jobs["movie"] = lambda: prepare_movies(
            raw["movie"], rows["movie"], use_tfidf=use_tfidf, whole=read["movie"], **settings
        )
    if {"book", "book_tags", "tags"} <= raw.keys():
        jobs["book"] = lambda: prepare_books(
            raw["book"], raw["book_tags"], raw["tags"], rows["book"], use_tfidf=use_tfidf, **settings
        )
    if "music" in raw:
        jobs["music"] = lambda: prepare_music(raw["music"], rows["music"], use_tfidf=use_tfidf, **settings)
    if "destination" in raw:
        jobs["destination"] = lambda: prepare_places(raw["destination"], rows["destination"], use_tfidf=use_tfidf, **settings)
    written = {}
    for kind, job in jobs.items():
        processed = job()
        write_table(processed, f"{out}/{kind}")
        written[kind] = spark.read.schema(processed.schema).parquet(f"{out}/{kind}")
    return table_sizes(written), strata_summary(written)


def embed_all(
    tables: Mapping[str, DataFrame],
    out: str,
    make_encoder: Callable[[], Encoder],
    encoder: str,
    text: str = "text_representation",
) -> tuple[DataFrame, DataFrame]:
    """Bring the vectors of every table (item_id and a text column) in `out` up to its texts.

    Returns the widths, and how many items of each kind were new, changed and gone. Only texts that
    are new or changed since the last run with the same `encoder` are encoded. The unit vectors of
    the targets follow for searching. Raises when widths differ.
    """
    saved, changes = {}, []
    for kind, df in tables.items():
        changed = refresh_vectors(df, vectors_folder(out, kind), make_encoder, encoder, text)
        changes.append(changed.select(F.lit(kind).alias("kind"), "change"))
        saved[kind] = current_vectors(df.sparkSession, vectors_folder(out, kind))
    widths = same_width(saved)
    found = widths.select("width").distinct().limit(2).collect()
    if len(found) > 1:
        raise DifferentWidths(", ".join(str(r.width) for r in found))
    if "destination" in saved:
        refresh_search_table(saved["destination"], search_folder(out))
    return widths, union_tables(changes).groupBy("kind", "change").agg(F.count("*").alias("n"))


def vectors_folder(out: str, kind: str) -> str:
    return f"{out}/{kind}_vectors"


def search_folder(out: str) -> str:
    return f"{out}/destination_search"


def catalogue_lookup(tables: Mapping[str, DataFrame]) -> DataFrame:
    """media_type, title_key, item_id over the processed tables, each kind with its own title columns.

    A title that several items have names the one with the largest item_id.
    """
    lookups = [
        title_lookup(df.withColumn("media_type", F.lit(kind)), fixed.TITLE_COLUMNS[kind], row_id="item_id")
        for kind, df in tables.items()
        if kind in fixed.TITLE_COLUMNS
    ]
    return union_tables(lookups)
