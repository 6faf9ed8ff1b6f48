"""Files in and out."""

import pytest
from pyspark.sql import functions as F

from triptych.operators.sampling import seeded_sample
from triptych.sources import feedback_log, tables, vectors
from triptych.staging import shared_dir, staged


def test_csv_keeps_line_breaks_quotes_spaces_and_na(spark, tmp_path):
    rows = [(1, 'two\nlines, "quoted"', "NA"), (2, "  spaced ", "None"), (3, None, "null")]
    df = spark.createDataFrame(rows, "id bigint, text string, country string")
    tables.export_csv(df, str(tmp_path / "t"))
    back = tables.load_table(spark, str(tmp_path / "t"), df.schema, format="csv")
    assert sorted(map(tuple, back.collect())) == rows


def test_latin_text_and_chosen_columns(spark, tmp_path):
    (tmp_path / "c.csv").write_bytes("City,Extra,AccentCity\na,1,Æbeltoft é\n".encode("latin-1"))
    df = tables.read_csv(spark, str(tmp_path / "c.csv"), ["City", "AccentCity"], encoding="ISO-8859-1")
    assert df.collect() == [("a", "Æbeltoft é")]


def test_missing_source_raises_or_is_empty(spark, tmp_path):
    path = str(tmp_path / "none")
    with pytest.raises(tables.MissingSource):
        tables.load_table(spark, path, "a int")
    empty = tables.load_table(spark, path, "a int, b string", required=False)
    assert empty.columns == ["a", "b"] and empty.count() == 0
    with pytest.raises(tables.MissingSource):
        tables.load_first(spark, [path, path + "2"], "a int")


def test_processed_table_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", 2.0)], "id bigint, title string, extra double")
    path = str(tmp_path / "p")
    tables.write_table(df, path, ["title", "absent", "id"])
    assert spark.read.parquet(path).collect() == [("x", 1)]


def test_source_order_follows_the_file(spark, tmp_path):
    path = tmp_path / "o.csv"
    path.write_text("v\n" + "\n".join(str(i) for i in range(500)) + "\n")
    df = tables.with_source_order(tables.read_csv(spark, str(path), multiline=False))
    assert [r.v for r in df.orderBy("row_id").collect()] == [str(i) for i in range(500)]


def test_row_numbers_do_not_depend_on_splits(spark, tmp_path):
    for name, first in (("b", 300), ("a", 0), ("c", 500)):
        (tmp_path / f"{name}.csv").write_text("v\n" + "".join(f"{i}\n" for i in range(first, first + (300, 200, 0)["abc".index(name)])))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for split in ("200", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            df = tables.with_source_order(tables.read_csv(spark, str(tmp_path), multiline=None))
            assert df.columns == ["v", "row_id"]
            assert sorted((r.row_id, int(r.v)) for r in df.collect()) == [(i, i) for i in range(500)]
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_line_breaks_in_fields_are_noticed(spark, tmp_path):
    (tmp_path / "plain.csv").write_text('a,b\n1,"x ""y"""\n2,\n')
    (tmp_path / "broken.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
    assert not tables.holds_line_breaks(spark, str(tmp_path / "plain.csv"))
    assert tables.holds_line_breaks(spark, str(tmp_path / "broken.csv"))
    read = tables.read_csv(spark, str(tmp_path / "broken.csv"), multiline=None)
    assert [tuple(r) for r in read.collect()] == [("1", "x\ny"), ("2", "z")]


def test_plain_files_are_split(spark, tmp_path):
    (tmp_path / "city.csv").write_text("Country,City\n" + "".join(f"na,town {i}\n" for i in range(5000)), encoding="latin-1")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = tables.read_csv(spark, str(tmp_path / "city.csv"), ["City"], encoding="ISO-8859-1", multiline=None)
        assert df.rdd.getNumPartitions() > 1 and df.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_schema_goes_by_the_names_of_the_header(spark, tmp_path):
    (tmp_path / "t.csv").write_text("lang,id,text\nen,1,hello\nde,x,\nfr,,3\n")
    df = tables.load_table(spark, str(tmp_path / "t.csv"), "id bigint, text string, lang string, score double", format="csv", rescued="_rescued")
    got = sorted(map(tuple, df.collect()), key=str)
    assert got == [(1, "hello", "en", None, None), (None, "3", "fr", None, None), (None, None, "de", None, {"id": "x"})]
    assert [tuple(r) for r in tables.rescued_counts(df, "_rescued").collect()] == [("id", 1)]


def test_files_with_another_header_are_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,text\n1,x\n")
    (tmp_path / "b.csv").write_text("text,id\ny,2\n")
    with pytest.raises(Exception, match="header"):
        tables.read_csv(spark, str(tmp_path), schema="id bigint, text string", multiline=False).collect()


def test_draws_need_a_plain_key(spark):
    df = spark.range(3).select(F.struct("id").alias("k"))
    with pytest.raises(ValueError):
        seeded_sample(df, 1, "k")


def test_vectors_round_trip_and_stale_keys(spark, tmp_path):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0])], "item_id bigint, embedding array<float>")
    vectors.save_vectors(df, str(tmp_path / "v"))
    loaded = vectors.load_vectors(spark, [str(tmp_path / "preferred"), str(tmp_path / "v")])
    assert sorted(r.item_id for r in loaded.collect()) == [1, 2, 3]
    saved = vectors.search_table(loaded)
    assert saved.where("item_id = 1").first().embedding == pytest.approx([0.6, 0.8])
    assert saved.where("item_id = 2").first().embedding == [0.0, 0.0]
    assert vectors.stale_keys(loaded, saved).count() == 0
    changed = spark.createDataFrame([(1, [4.0, 3.0]), (3, [1.0, 0.0]), (4, [1.0, 1.0])], df.schema)
    assert sorted(map(tuple, vectors.stale_keys(changed, saved).collect())) == [(1, "changed"), (2, "gone"), (4, "new")]


def test_log_skips_malformed_and_blank_lines(spark, tmp_path):
    good = '{"timestamp": "2025-01-01T00:00:00.5", "feedback": {"satisfaction": "😍", "stars": 5, "comments": null}}'
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text(f"{good}\n\nnot json\n{good[:40]}\n{good}\n", encoding="utf-8")
    records = feedback_log.read_feedback(spark, str(tmp_path / "log"))
    assert records.count() == 2
    assert {r.satisfaction for r in records.select("feedback.satisfaction").collect()} == {"😍"}
    assert feedback_log.read_feedback(spark, str(tmp_path / "nothing")).count() == 0


def test_appended_records_keep_text_and_null_for_empty_comment(spark, tmp_path):
    path = str(tmp_path / "log")
    inputs = feedback_log.media_struct(F.lit("Amélie"), F.lit("b"), F.lit("m"))
    results = F.array(F.struct(F.lit(1).alias("rank"), F.lit("Æ").alias("name"), F.lit("DK").alias("country"), F.lit(0.5).alias("score"), F.lit(9).alias("population")))
    record = feedback_log.feedback_record(F.lit("2025-01-01T00:00:00"), inputs, inputs, results, F.lit("ok"), F.lit(4), F.lit(""))
    for _ in range(2):
        feedback_log.append_feedback(spark.range(1).select(record.alias("r")).select("r.*"), path)
    back = feedback_log.read_feedback(spark, path)
    assert back.count() == 2
    row = back.first()
    assert row.inputs.movie == "Amélie" and row.feedback.comments is None
    assert row.recommendations[0].asDict() == {"rank": 1, "name": "Æ", "country": "DK", "score": 0.5}


def test_staged_tables_are_written_once(spark):
    df = staged(spark.range(10).withColumn("x", F.rand()), "test")
    assert df.collect() == df.collect()
    assert f"{shared_dir(spark)}/triptych-stage/test-" in df.inputFiles()[0]


def test_long_texts_are_set_aside_and_put_back(spark):
    rows = [(1, "a" * 30 + "x", "t"), (2, "a" * 30 + "y", "t"), (3, None, "t"), (4, "", None), (5, "short", "t"), (5, "short", "t"), (None, "é" * 12, "t")]
    whole = spark.createDataFrame(rows, "id bigint, text string, title string")
    aside = tables.set_aside(whole, {"text": 10, "absent": 3})
    assert {r.text for r in aside.collect()} == {"a" * 10, None, "", "short", "é" * 10}
    back = tables.put_back(staged(aside, "aside"), whole, {"text": 10, "absent": 3})
    assert back.columns == whole.columns and sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    assert tables.set_aside(whole, {"absent": 3}) is whole and tables.put_back(whole, whole, {"absent": 3}) is whole


def test_texts_that_changed_in_between_are_an_error(spark):
    first, then = (spark.createDataFrame([(1, text * 9)], "id bigint, text string") for text in ("a", "b"))
    with pytest.raises(tables.ChangedSource):
        tables.put_back(staged(tables.set_aside(first, {"text": 2}), "aside"), then, {"text": 2})
