"""The feedback report as a continuous job over the log folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from triptych.sources import versions
from triptych.sources.feedback_log import is_record, parsed
from triptych.staging import new_path, staged

LATENESS = "1 day"
# One row per day and answer, one per kind of line that no day has, and one for the latest time seen.
DAYS = "key string, kind string, day date, satisfaction string, n bigint, stars bigint, latest timestamp"
DAY_BUCKETS = 16
PRODUCER = "daily feedback"


def feedback_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The log as a stream; lines are parsed and skipped as in the batch reader."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return parsed(reader.text(path))


def daily_report(records: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Per day: submissions, stars, and submissions per satisfaction answer.

    The state is one row per day and answer; the watermark lets days be closed and dropped. The
    sum and number of stars are kept, so that days can be added up over the answers.
    """
    # Log times carry no zone. Read as UTC, the days of windows and of the log are the same.
    timed = records.withColumn("ts", F.concat("timestamp", F.lit("Z")).try_cast("timestamp"))
    return (
        timed.where(F.col("ts").isNotNull())
        .withWatermark("ts", lateness)
        .groupBy(F.window("ts", "1 day").alias("w"), F.col("feedback.satisfaction").alias("satisfaction"))
        .agg(F.count("*").alias("n"), F.sum("feedback.stars").alias("stars"))
        .select(
            F.date_from_unix_date((F.unix_seconds("w.start") / 86400).cast("int")).alias("day"),
            "satisfaction",
            "n",
            "stars",
        )
    )


def run_to_table(report: DataFrame, out: str, mode: str = "complete", checkpoint: str | None = None) -> StreamingQuery:
    """Process what has arrived since the last run with this `checkpoint` and stop.

    The checkpoint belongs to the table and lies beside it unless it is named, so that a later run
    for the same table reads new files of the log only.

    In complete mode the table is replaced by every batch and holds all days; in append mode days
    are added once the watermark has passed them, and a batch that is run again replaces its own
    folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        target = out if mode == "complete" else f"{out}/batch={number}"
        batch.write.mode("overwrite").parquet(target)

    checkpoint = checkpoint or f"{out.rstrip('/')}-checkpoint"
    query = (
        report.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def daily_report_table(spark: SparkSession, log: str, out: str | None = None) -> DataFrame:
    """Run the report over the log as a stream and return the written table."""
    out = out or new_path(spark, "daily-report")
    report = daily_report(feedback_stream(spark, log))
    run_to_table(report, out)
    return spark.read.schema(report.schema).parquet(out)


def run_daily_upserts(
    spark: SparkSession,
    log: str,
    out: str,
    lateness: str = LATENESS,
    files_per_batch: int | None = None,
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Bring the days in the versioned table `out` up to the log, and stop.

    Each batch changes only the days it has lines of, and is counted once even if it is run again.
    Readers see the table before or after a batch. A line whose day had been passed by the latest
    time seen in earlier batches, less `lateness`, is late: its day is closed, and it is counted as
    `late`. Lines that are no record, or have no time that can be read, are counted as `unreadable`.
    """
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    checkpoint = checkpoint or f"{out.rstrip('/')}-checkpoint"
    query = (
        reader.text(log)
        .writeStream.foreachBatch(lambda lines, number: upsert_days(lines, out, number, lateness))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def upsert_days(lines: DataFrame, out: str, batch: int, lateness: str = LATENESS) -> bool:
    """Add one batch of lines (value) of the log to the table of days; whether it was not in it before."""
    spark = lines.sparkSession
    before = staged(versions.read_version(spark, out, DAYS), "days-before")
    seen = before.where("kind = 'latest'").agg(F.max("latest").alias("latest")).first().latest
    lines = lines.where(F.trim("value") != "")
    bad = lines.where(~is_record(F.col("value"))).agg(F.count("*").alias("n")).select(F.lit("unreadable").alias("kind"), "n")
    timed = parsed(lines).select(
        F.concat("timestamp", F.lit("Z")).try_cast("timestamp").alias("ts"), F.col("feedback.satisfaction").alias("satisfaction"), "feedback.stars"
    )
    # Log times carry no zone; read as UTC, their dates are those of the log.
    day = F.date_from_unix_date(F.floor(F.unix_seconds("ts") / 86400).cast("int"))
    closed = F.lit(False)
    if seen is not None:
        end_of_day = F.timestamp_seconds((F.floor(F.unix_seconds("ts") / 86400) + 1) * 86400)
        closed = end_of_day <= F.lit(seen) - F.expr(f"interval {lateness}")
    kind = F.when(F.col("ts").isNull(), "unreadable").when(closed, "late").otherwise("day")
    summed = (
        timed.select(kind.alias("kind"), day.alias("day"), "satisfaction", "stars", "ts")
        .withColumns({c: F.when(F.col("kind") == "day", F.col(c)) for c in ("day", "satisfaction", "stars")})
        .groupBy("kind", "day", "satisfaction")
        .agg(F.count("*").alias("n"), F.sum("stars").alias("stars"), F.max("ts").alias("latest"))
    )
    summed = staged(summed.unionByName(bad.where("n > 0"), allowMissingColumns=True), "days-batch")
    latest = summed.agg(F.max("latest").alias("latest")).where("latest is not null").select(F.lit("latest").alias("kind"), "latest")
    rows = before.drop("key").unionByName(summed.drop("latest").unionByName(latest, allowMissingColumns=True), allowMissingColumns=True)
    # A missing answer is one of its own.
    key = F.to_json(F.struct("kind", "day", "satisfaction"))
    total = rows.withColumn("key", key).groupBy("key", "kind", "day", "satisfaction").agg(
        F.sum("n").alias("n"), F.sum("stars").alias("stars"), F.max("latest").alias("latest")
    )
    changed = summed.select(key.alias("key")).unionByName(latest.select(F.to_json(F.struct("kind")).alias("key"))).distinct()
    return versions.upsert(total.join(changed, "key", "left_semi"), out, DAYS, batch, PRODUCER, buckets=DAY_BUCKETS)


def daily_table(spark: SparkSession, out: str) -> DataFrame:
    """kind, day, satisfaction, n, stars: the days, and the lines that no day has as `late` and `unreadable`."""
    return versions.read_version(spark, out, DAYS).where("kind <> 'latest'").select("kind", "day", "satisfaction", "n", "stars")
