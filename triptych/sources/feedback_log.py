"""The append-only feedback log: a folder of JSON-lines files, also readable as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triptych.sources.tables import load_table

FEEDBACK_SCHEMA = (
    "timestamp string, "
    "inputs struct<movie: string, book: string, music: string>, "
    "status struct<movie: string, book: string, music: string>, "
    "search_status struct<movie: string, book: string, music: string>, "
    "recommendations array<struct<rank: int, name: string, country: string, score: double>>, "
    "feedback struct<satisfaction: string, stars: int, comments: string>"
)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """All records; lines that are not a JSON object are skipped, a missing log is empty.

    A field of another type than the schema's is NULL, and its record stays.
    """
    return parsed(load_table(spark, path, "value string", format="text", required=False))


def is_record(line: Column) -> Column:
    """Whether a line of the log holds a JSON object."""
    return F.coalesce(F.ltrim(line).startswith("{") & F.try_parse_json(line).isNotNull(), F.lit(False))


def parsed(lines: DataFrame) -> DataFrame:
    """The records of lines of text (value), each parsed once."""
    record = F.from_json("value", FEEDBACK_SCHEMA, {"mode": "PERMISSIVE"})
    return lines.where(is_record(F.col("value"))).select(record.alias("r")).select("r.*")


def rejected_lines(spark: SparkSession, path: str) -> DataFrame:
    """How many lines of the log are not records: n. Blank lines do not count."""
    lines = load_table(spark, path, "value string", format="text", required=False)
    return lines.where((F.trim("value") != "") & ~is_record(F.col("value"))).agg(F.count("*").alias("n"))


def append_feedback(records: DataFrame, path: str) -> None:
    """Add records to the log; text is kept as typed."""
    records.write.mode("append").json(path)


def media_struct(movie: Column, book: Column, music: Column) -> Column:
    return F.struct(movie.alias("movie"), book.alias("book"), music.alias("music"))


def feedback_record(
    timestamp: Column,
    inputs: Column,
    status: Column,
    results: Column,
    satisfaction: Column,
    stars: Column,
    comments: Column,
) -> Column:
    """One log record; of the results only rank, name, country and score are kept."""
    kept = F.transform(
        results,
        lambda r: F.struct(
            r["rank"].cast("int").alias("rank"),
            r["name"].alias("name"),
            r["country"].alias("country"),
            r["score"].cast("double").alias("score"),
        ),
    )
    return F.struct(
        timestamp.alias("timestamp"),
        inputs.alias("inputs"),
        status.alias("status"),
        kept.alias("recommendations"),
        F.struct(
            satisfaction.alias("satisfaction"),
            stars.cast("int").alias("stars"),
            F.when(F.length(comments) > 0, comments).alias("comments"),
        ).alias("feedback"),
    )


def collect_results(results: DataFrame, key: str) -> DataFrame:
    """Ranked result rows of each request as one array, in rank order (top-k rows per request)."""
    item = F.struct("rank", "name", "country", "score")
    return results.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("results"))
