"""The feedback log and its reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import bind
from checks.bind import table
from checks.registry import query
from triptych.plans import feedback_report as report
from triptych.sources.feedback_log import append_feedback, collect_results, feedback_record, media_struct, read_feedback
from triptych.staging import new_path
from triptych.streaming.feedback_stream import daily_report_table, daily_table, run_daily_upserts

LOG = f"WITH {bind.FEEDBACK}"


def record_lines(spark, folder):
    """Records as log lines, among them cut-off and blank lines that readers must skip."""
    records = bind.feedback(spark, folder)
    line = F.to_json(F.struct(*[c for c in records.columns if c != "row_id"]))
    k = F.col("row_id")
    lines = F.array(
        line, F.when(k % 10 == 0, F.substr(line, F.lit(1), (F.length(line) / 2).cast("int"))), F.when(k % 25 == 0, "")
    )
    return records.select(F.explode(F.array_compact(lines)).alias("value"))


@query(
    "feedback_scan",
    f"""{LOG} SELECT timestamp, movie, music, satisfaction, stars, comments, n_results FROM feedback""",
)
def feedback_scan(spark, folder):
    path = new_path(spark, "log")
    record_lines(spark, folder).write.text(path)
    return read_feedback(spark, path).select(
        "timestamp",
        "inputs.movie",
        "inputs.music",
        "feedback.satisfaction",
        "feedback.stars",
        "feedback.comments",
        F.size(F.coalesce("recommendations", F.array())).alias("n_results"),
    )


@query(
    "feedback_flat",
    f"""{LOG} SELECT timestamp, movie, book, music, satisfaction, stars, comments, movie_found, book_found, music_found,
          CASE WHEN n_results > 0 THEN 'Place ' || ((user_id + 1) % 40) END AS top_destination
        FROM feedback""",
)
def feedback_flat(spark, folder):
    return report.flatten(bind.feedback(spark, folder))


@query(
    "satisfaction_dist",
    f"""{LOG} SELECT satisfaction, count(*) AS n, round(count(*) / (SELECT count(*) FROM feedback) * 100, 6) AS percentage
        FROM feedback GROUP BY satisfaction""",
)
def satisfaction_dist(spark, folder):
    return report.satisfaction(bind.feedback(spark, folder)).withColumn("percentage", F.round("percentage", 6))


@query("star_average", f"{LOG} SELECT count(*) AS submissions, avg(stars) AS mean_stars FROM feedback")
def star_average(spark, folder):
    return report.star_average(bind.feedback(spark, folder))


@query("star_stats", f"{LOG} SELECT stars, count(*) AS n FROM feedback GROUP BY stars")
def star_stats(spark, folder):
    return report.star_counts(bind.feedback(spark, folder))


@query("comment_count", f"{LOG} SELECT count(*) AS n FROM feedback WHERE comments <> ''")
def comment_count(spark, folder):
    return report.comment_count(bind.feedback(spark, folder))


@query(
    "recent_comments",
    f"{LOG} SELECT row_id, comments AS comment FROM feedback WHERE comments <> '' ORDER BY row_id DESC LIMIT 5",
)
def recent_comments(spark, folder):
    return report.recent_comments(bind.feedback(spark, folder))


@query(
    "top_inputs",
    f"""{LOG}, typed AS (
          SELECT 'movie' AS media_type, movie AS title FROM feedback UNION ALL SELECT 'book', book FROM feedback
          UNION ALL SELECT 'music', music FROM feedback),
        counted AS (SELECT media_type, title, count(*) AS n FROM typed WHERE title IS NOT NULL GROUP BY ALL)
        SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY media_type ORDER BY n DESC, title) <= 5""",
)
def top_inputs(spark, folder):
    return report.top_inputs(bind.feedback(spark, folder))


@query(
    "top_recommended",
    f"""{LOG}, named AS (SELECT user_id + unnest(range(1, n_results + 1)) AS x FROM feedback)
        SELECT 'Place ' || (x % 40) || ', C' || (x % 7) AS destination, count(*) AS n
        FROM named GROUP BY destination ORDER BY n DESC, destination LIMIT 10""",
)
def top_recommended(spark, folder):
    return report.top_recommended(bind.feedback(spark, folder))


@query("daily_counts", f"{LOG} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM feedback GROUP BY day")
def daily_counts(spark, folder):
    return report.daily_counts(bind.feedback(spark, folder))


@query(
    "stream_daily_counts",
    f"""{LOG} SELECT strftime(ts, '%Y-%m-%d') AS day, satisfaction, count(*) AS n, CAST(sum(stars) AS BIGINT) AS stars
        FROM feedback GROUP BY day, satisfaction""",
)
def stream_daily_counts(spark, folder):
    path = new_path(spark, "log")
    append_feedback(bind.feedback(spark, folder).drop("row_id"), path)
    return daily_report_table(spark, path)


@query(
    "stream_upserts",
    f"""{LOG} SELECT 'day' AS kind, strftime(ts, '%Y-%m-%d') AS day, satisfaction, count(*) AS n, CAST(sum(stars) AS BIGINT) AS stars
        FROM feedback GROUP BY day, satisfaction
        UNION ALL SELECT 'unreadable', NULL, NULL, count(*), NULL FROM feedback WHERE row_id % 10 = 0""",
)
def stream_upserts(spark, folder):
    """Days from a log of several files, taken in batches of two, with cut-off lines among them."""
    path, out = new_path(spark, "log"), new_path(spark, "days")
    record_lines(spark, folder).repartition(5).write.text(path)
    # Files come in any order, so no day is closed.
    run_daily_upserts(spark, path, out, lateness="1000 days", files_per_batch=2)
    return daily_table(spark, out)


@query(
    "build_feedback",
    """WITH named AS (
         SELECT l_orderkey, l_linenumber AS rank, 'Supplier ' || l_suppkey AS name, l_returnflag AS country, l_discount AS score
         FROM lineitem)
       SELECT o_orderkey, 'film ' || o_custkey AS movie, CASE WHEN o_orderkey % 3 <> 0 THEN 'note' END AS comments,
              CAST(1 + o_orderkey % 5 AS BIGINT) AS stars, count(rank) AS n_results,
              coalesce(string_agg(rank || ' ' || name || ' ' || country || ' ' || printf('%.2f', score), '; '
                ORDER BY rank, name, country, score), '') AS results
       FROM orders LEFT JOIN named ON l_orderkey = o_orderkey GROUP BY ALL""",
)
def build_feedback(spark, folder):
    """Records assembled from requests and their results, read back from their JSON form."""
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.col("l_linenumber").alias("rank"),
        F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string")).alias("name"),
        F.col("l_returnflag").alias("country"),
        F.col("l_discount").alias("score"),
    )
    k = F.col("o_orderkey")
    titles = [F.concat(F.lit(f"{kind} "), F.col("o_custkey").cast("string")) for kind in ("film", "book", "track")]
    results = F.coalesce("results", F.array().cast("array<struct<rank:int,name:string,country:string,score:double>>"))
    record = feedback_record(
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
        media_struct(*titles),
        media_struct(*titles),
        results,
        F.col("o_orderpriority"),
        1 + k % 5,
        F.when(k % 3 == 0, "").otherwise("note"),
    )
    joined = table(spark, folder, "orders").join(collect_results(lines, "o_orderkey"), "o_orderkey", "left")
    kind = joined.select(record.alias("r")).schema["r"].dataType.simpleString()
    built = joined.select(k, F.from_json(F.to_json(record), kind).alias("r"))
    shown = F.transform(
        "r.recommendations", lambda x: F.format_string("%d %s %s %.2f", x["rank"], x["name"], x["country"], x["score"])
    )
    return built.select(
        "o_orderkey",
        "r.inputs.movie",
        "r.feedback.comments",
        F.col("r.feedback.stars").cast("bigint").alias("stars"),
        F.size("r.recommendations").cast("bigint").alias("n_results"),
        F.array_join(shown, "; ").alias("results"),
    )
