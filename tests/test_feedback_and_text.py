"""Feedback reports, the stream, and TF-IDF against plain Python."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from triptych.functions.text import STOP_WORDS
from triptych.operators import counting, tfidf
from triptych.plans import feedback_report as report
from triptych.plans.enrich import enrich_descriptions
from triptych.sources import feedback_log, versions
from triptych.sources.feedback_log import FEEDBACK_SCHEMA, append_feedback, read_feedback
from triptych.streaming import feedback_stream as streams
from triptych.streaming.feedback_stream import daily_report, daily_report_table, feedback_stream, run_to_table


def record(at, movie="Up", status="status", found=True, results=(), stars=4, comments=None, satisfaction="😐 It's okay"):
    said = {"movie": ("✅ Found: " if found else "❌ Not found: ") + movie, "book": None, "music": "❌ Not found: m"}
    return {
        "timestamp": at,
        "inputs": {"movie": movie, "book": None, "music": "m"},
        "status": said if status == "status" else None,
        "search_status": said if status == "search_status" else None,
        "recommendations": [{"rank": i + 1, "name": n, "country": "IT", "score": 0.1} for i, n in enumerate(results)],
        "feedback": {"satisfaction": satisfaction, "stars": stars, "comments": comments},
    }


RECORDS = [
    record("2025-12-05T23:59:59.729311", results=("Naples", "Rome"), comments="first"),
    record("2025-12-06T00:00:01", status="search_status", results=("Rome",), comments=""),
    record("2025-12-06T10:00:00", movie="Heat", found=False, stars=2, comments="third", satisfaction="😍 Love them!"),
    record("2025-12-08T10:00:00", status=None, movie="up"),
]


@pytest.fixture(scope="module")
def records(spark):
    rows = [{**r, "row_id": i} for i, r in enumerate(RECORDS)]
    return spark.createDataFrame(rows, FEEDBACK_SCHEMA + ", row_id int")


def test_flat_rows_read_both_status_names(records):
    flat = records.transform(report.flatten).orderBy("timestamp").collect()
    assert [r.movie_found for r in flat] == [True, True, False, False]
    assert [r.book_found for r in flat] == [False] * 4
    assert [r.top_destination for r in flat] == ["Naples", "Rome", None, None]


def test_reports(records):
    shares = {r.satisfaction: (r.n, r.percentage) for r in report.satisfaction(records).collect()}
    assert shares == {"😐 It's okay": (3, 75.0), "😍 Love them!": (1, 25.0)}
    assert report.star_average(records).first() == (4, 3.5)
    assert report.star_counts(records).collect() == [(2, 1), (4, 3)]
    assert report.comment_count(records).first().n == 2
    assert [r.comment for r in report.recent_comments(records, 1).collect()] == ["third"]
    assert [r.comment for r in report.recent_comments(records).collect()] == ["first", "third"]
    assert {(r.title, r.n) for r in report.top_inputs(records).collect()} == {("Up", 2), ("Heat", 1), ("up", 1), ("m", 4)}
    assert report.top_recommended(records, 1).collect() == [("Rome, IT", 2)]
    assert [(str(r.day), r.n) for r in report.daily_counts(records).collect()] == [
        ("2025-12-05", 1), ("2025-12-06", 2), ("2025-12-08", 1)
    ]


def test_stream_equals_batch_and_appends_closed_days_only(spark, records, tmp_path):
    log = str(tmp_path / "log")
    for i in range(len(RECORDS)):
        append_feedback(records.where(F.col("row_id") == i).drop("row_id"), log)
    streamed = daily_report_table(spark, log)
    days = {str(r.day): r.n for r in streamed.groupBy("day").agg(F.sum("n").alias("n")).collect()}
    batch = {str(r.day): r.n for r in report.daily_counts(read_feedback(spark, log)).collect()}
    assert days == batch
    out = str(tmp_path / "closed")
    run_to_table(daily_report(feedback_stream(spark, log, files_per_batch=1), "1 hour"), out, mode="append")
    closed = spark.read.parquet(out).groupBy("day").agg(F.sum("n").alias("n"), F.sum("stars").alias("stars"))
    assert {str(r.day): (r.n, r.stars) for r in closed.collect()} == {"2025-12-05": (1, 4), "2025-12-06": (2, 6)}


def test_days_are_upserted_once_and_late_lines_counted(spark, tmp_path):
    log, out = tmp_path / "log", str(tmp_path / "days")
    log.mkdir()
    line = '{"timestamp": "2025-01-%02dT12:00:00", "feedback": {"satisfaction": "%s", "stars": %s}}\n'
    table = lambda: sorted(((r.kind, str(r.day or ""), r.satisfaction, r.n, r.stars) for r in streams.daily_table(spark, out).collect()), key=str)
    (log / "a.jsonl").write_text(line % (1, "ok", 4) + line % (2, "ok", 5) + "not json\n\n" + line.replace("2025", "someday") % (3, "ok", 1))
    streams.run_daily_upserts(spark, str(log), out)
    first = [("day", "2025-01-01", "ok", 1, 4), ("day", "2025-01-02", "ok", 1, 5), ("unreadable", "", None, 2, None)]
    assert table() == first
    # Nothing new: the same table, and no version more.
    versions_before = versions.versions(spark, out)
    streams.run_daily_upserts(spark, str(log), out)
    assert table() == first and versions.versions(spark, out) == versions_before
    (log / "b.jsonl").write_text(line % (2, "ok", 1) + line % (9, "bad", "null"))
    streams.run_daily_upserts(spark, str(log), out)
    second = [first[0], ("day", "2025-01-02", "ok", 2, 6), ("day", "2025-01-09", "bad", 1, None), first[2]]
    assert table() == second
    # The second day is closed now.
    (log / "c.jsonl").write_text(line % (2, "ok", 3) + line % (8, "ok", 3))
    streams.run_daily_upserts(spark, str(log), out)
    third = [first[0], second[1], ("day", "2025-01-08", "ok", 1, 3), second[2], ("late", "", None, 1, None), first[2]]
    assert table() == third
    # A batch that is run again changes nothing.
    replayed = spark.read.text(str(log / "c.jsonl"))
    assert not streams.upsert_days(replayed, out, 2) and table() == third
    assert streams.upsert_days(replayed, out, 3) and table() != third


def plain_keywords(texts, max_terms, min_documents, top):
    terms = {}
    for key, text in texts.items():
        words = [w for w in re.findall(r"\w{2,}", text.lower()) if w not in STOP_WORDS]
        terms[key] = Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
    totals, df = Counter(), Counter()
    for counted in terms.values():
        totals.update(counted)
        df.update(counted.keys())
    known = sorted((t for t in totals if df[t] >= min_documents), key=lambda t: (-totals[t], t))[:max_terms]
    idf = {t: math.log((1 + len(texts)) / (1 + df[t])) + 1 for t in known}
    out = {}
    for key, counted in terms.items():
        ranked = sorted((t for t in counted if t in idf), key=lambda t: (-round(counted[t] * idf[t], 6), t))
        out[key] = " ".join(ranked[:top])
    return out


@pytest.mark.parametrize("max_terms", [5, 40, 1000])
def test_keywords_equal_plain_python(spark, max_terms):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)] + ["the", "of", "é1", "x"]
    texts = {i: " ".join(rng.choices(words, [1 / (j + 1) for j in range(len(words))], k=rng.randrange(0, 60))) for i in range(40)}
    df = spark.createDataFrame(list(texts.items()), "id bigint, text string")
    out = tfidf.emphasised(df, "id", "text", max_terms=max_terms).collect()
    wanted = plain_keywords(texts, max_terms, 2, 10)
    assert {r.id: r.text_representation for r in out} == {k: f"{texts[k]} {wanted[k]}" for k in texts}


def test_without_any_frequent_term_texts_stay(spark):
    df = spark.createDataFrame([(1, "alpha"), (2, "")], "id bigint, text string")
    assert sorted(r.text_representation for r in tfidf.emphasised(df, "id", "text").collect()) == ["", "alpha"]


def test_texts_without_keywords_keep_a_trailing_space(spark):
    df = spark.createDataFrame([(1, "alpha"), (2, "alpha"), (3, "")], "id bigint, text string")
    got = sorted(r.text_representation for r in tfidf.emphasised(df, "id", "text").collect())
    assert got == [" ", "alpha alpha", "alpha alpha"]


def test_reports_of_one_log_agree(spark, tmp_path):
    """A field of another type is NULL; its record counts in every report, whatever columns it reads."""
    log, out = str(tmp_path / "log"), str(tmp_path / "daily")
    (tmp_path / "log").mkdir()
    line = '{"timestamp": "2025-01-0%dT10:00:00", "feedback": {"satisfaction": "a", "stars": %s, "comments": "c%d"}}'
    (tmp_path / "log" / "a.jsonl").write_text("\n".join([line % (1, 5, 1), line % (2, '"many"', 2), line % (2, 3, 3), "[1]", "no"]))
    records = read_feedback(spark, log)
    assert records.count() == 3
    assert sum(r.n for r in report.daily_counts(records).collect()) == 3
    assert records.select("feedback.stars").where("stars is not null").count() == 2
    assert [r.comment for r in report.recent_comments(records, 2).collect()] == ["c2", "c3"]
    assert feedback_log.rejected_lines(spark, log).first().n == 2
    days = lambda: {str(r.day): r.n for r in streams.daily_report_table(spark, log, out).collect()}
    assert days() == {"2025-01-01": 1, "2025-01-02": 2}
    (tmp_path / "log" / "a.jsonl").write_text("")
    (tmp_path / "log" / "b.jsonl").write_text(line % (3, 1, 4))
    assert days() == {"2025-01-01": 1, "2025-01-02": 2, "2025-01-03": 1}


def test_word_join_without_broadcast_gives_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"aa bb cc{i % 3} aa bb dd{i}") for i in range(20)], "id bigint, text string")
    rows = lambda: sorted(map(tuple, tfidf.vocabulary(tfidf.tokenised(df, "id", "text"), 4).collect()))
    first = rows()
    monkeypatch.setattr(tfidf, "BROADCAST_WORDS", 0)
    assert rows() == first and ("aa bb", 20, 40) in first


def test_enrichment_falls_back(spark):
    places = spark.createDataFrame(
        [("Rome", "IT", "own 1"), ("Rome", "US", "own 2"), ("Oslo", "NO", "own 3")], "name string, country string, description string"
    )
    summaries = spark.createDataFrame(
        [(1, "Rome, IT", "  "), (2, "Rome, IT", " the\ncity "), (3, "Rome", "a town"), (4, "Oslo", None)], "row_id int, key string, text string"
    )
    out = {(r.name, r.country): r.description for r in enrich_descriptions(places, summaries).collect()}
    assert out == {("Rome", "IT"): "the city", ("Rome", "US"): "a town", ("Oslo", "NO"): "own 3"}


def test_distinct_counts_skip_missing(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "x string")
    assert counting.coverage(df, ["x"]).collect() == [("x", 3, 1)]
    assert counting.value_counts(df, "x").collect() == [("a", 2)]


def test_texts_are_emphasised_in_their_row(spark, folder):
    """Neither a join nor a shuffle of the texts."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    plan = tfidf.emphasised(docs, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_terms_are_weighed_in_a_row(spark):
    words = spark.createDataFrame([(1, ["b", "a", "b", "c"]), (2, []), (3, None), (4, ["x"])], "k int, w array<string>")
    factors = tfidf.Weights([[("a", 1.0), ("b a", 3.0), ("b", 2.0), ("a b", 0.5)]])
    found = {r.k: [tuple(t) for t in r.t or []] for r in tfidf.weighed(words, "w", factors, "t").collect()}
    assert found == {1: [("a", 1, 1.0), ("a b", 1, 0.5), ("b", 2, 4.0), ("b a", 1, 3.0)], 2: [], 3: [], 4: []}


def exchanges(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [line for line in plan.splitlines() if "Exchange" in line]


def test_terms_are_counted_without_a_shuffle_of_their_own(spark):
    """Rows of one key count together, words of two rows are no pair."""
    from triptych.operators.tfidf import term_counts

    words = spark.createDataFrame([(1, ["a", "b", "a", "b"]), (1, ["b", "a"]), (2, []), (None, ["a"]), (3, None)], "k bigint, w array<string>")
    counts = term_counts(words, "k")
    assert {(r.k, r.term): r.tf for r in counts.collect()} == {(1, "a"): 3, (1, "b"): 3, (1, "a b"): 2, (1, "b a"): 2, (None, "a"): 1}
    moved = exchanges(counts)
    assert len(moved) == 1 and "term" not in moved[0]


def test_documents_of_one_file_are_tokenised_by_several_tasks(spark):
    from triptych.operators.tfidf import emphasised, tokenised

    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.md5((F.col("id") * i).cast("string"))))
    docs = spark.range(0, 2000, 1, 1).select("id", text.alias("text"))
    assert len(tokenised(docs, "id", "text").inputFiles()) > 1
    assert emphasised(docs, "id", "text").select(F.spark_partition_id()).distinct().count() > 1
