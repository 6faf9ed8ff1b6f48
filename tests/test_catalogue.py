"""From raw CSV files to processed tables, vectors and a recommendation."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from triptych.operators import sampling, tfidf
from triptych.operators.encode import hashing_encoder
from triptych.plans import preparation, recommend
from triptych.plans.catalogue import (
    DifferentWidths,
    catalogue_lookup,
    embed_all,
    prepare_all,
    search_folder,
    vectors_folder,
    with_item_id,
)
from triptych.sources import tables as files
from triptych.sources.vectors import current_vectors
from triptych.staging import staged

FILES = {
    "movie": "title,original_title,overview,genres,status,vote_average,vote_count\n"
    + "".join(f'M{i},M{i},"An overview of\nfilm {i}, ""long"" enough",[],Released,{5 + i % 5},{i * 900}\n' for i in range(40)),
    "book": "id,title,original_title,authors,average_rating,ratings_count,original_publication_year\n"
    + "".join(f"{i},B{i},,Author {i % 3},{3 + i % 3 / 2},{i * 1000},19{i:02}\n" for i in range(1, 30)),
    "book_tags": "goodreads_book_id,tag_id\n" + "".join(f"{i},{t}\n" for i in range(1, 30) for t in (3, 1, 2)),
    "tags": "tag_id,tag_name\n1,fiction\n2,classics\n3,to-read\n",
    "destination": "Country,City,AccentCity,Region,Population,Latitude,Longitude\n"
    + "".join(f"na,town {i},Tówn {i},0{i % 3},{i * 90000},{i},{i}\n" for i in range(1, 25)),
}

ROWS = {"movie": 30, "book": 20, "music": 5, "destination": 12}


@pytest.fixture(scope="module")
def prepared(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    for name, text in FILES.items():
        (folder / f"{name}.csv").write_text(text, encoding="latin-1" if name == "destination" else "utf-8")
    sources = {name: str(folder / f"{name}.csv") for name in [*FILES, "music"]}
    out = str(folder / "out")
    return out, *prepare_all(spark, sources, out, ROWS)


def test_kinds_without_files_are_skipped(prepared):
    _, sizes, strata = prepared
    assert {r.kind: r.n for r in sizes.collect()} == {"movie": 30, "book": 20, "destination": 12}
    assert strata.groupBy("kind").agg(F.sum("n").alias("n")).where("kind = 'movie'").first().n == 30


def test_processed_rows_keep_their_text(spark, prepared):
    out = prepared[0]
    movie = spark.read.parquet(f"{out}/movie").first()
    assert 'An overview of\nfilm' in movie.overview and '"long"' in movie.text_representation
    book = spark.read.parquet(f"{out}/book").first()
    assert book.tag_list == "to-read, fiction, classics" and book.original_title == book.title
    place = spark.read.parquet(f"{out}/destination").orderBy(F.desc("population")).first()
    assert (place.name, place.country) == ("Tówn 24", "NA")


def test_items_keep_their_source_keys(spark, prepared):
    out = prepared[0]
    assert {r.item_id for r in spark.read.parquet(f"{out}/book").collect()} <= set(range(1, 30))
    for r in spark.read.parquet(f"{out}/movie").collect():
        assert r.title == f"M{r.item_id}"
    for r in spark.read.parquet(f"{out}/destination").collect():
        assert r.name == f"Tówn {r.item_id + 1}"


def test_keys_that_are_no_numbers(spark):
    raw = spark.createDataFrame([(0, "7"), (1, "x"), (2, None), (3, "-1"), (4, "2.5")], "row_id bigint, id string")
    assert [r.item_id for r in with_item_id(raw, "movie").orderBy("row_id").collect()] == [7, -2, -3, -4, -5]
    assert with_item_id(raw, "music").columns == ["row_id", "id", "item_id"]
    assert with_item_id(raw, "tags").columns == ["row_id", "id"]


@pytest.mark.parametrize("files, bytes_of_a_split", [(1, "128m"), (1, "300"), (7, "128m"), (7, "150")])
def test_tables_do_not_depend_on_files_and_splits(spark, tmp_path, prepared, files, bytes_of_a_split):
    sources = {}
    for name in ("movie", "destination"):
        header, *lines = re.split(r"\n(?=M|na)", FILES[name].rstrip("\n"))
        folder, step = tmp_path / name, -(-len(lines) // files)
        folder.mkdir()
        for n in range(files):
            text = "\n".join([header, *lines[n * step : (n + 1) * step]]) + "\n"
            (folder / f"part-{n}.csv").write_text(text, encoding="latin-1" if name == "destination" else "utf-8")
        sources[name] = str(folder)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_of_a_split)
    try:
        prepare_all(spark, sources, str(tmp_path / "out"), ROWS)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name in sources:
        got, want = (spark.read.parquet(f"{place}/{name}").collect() for place in (tmp_path / "out", prepared[0]))
        assert sorted(got, key=str) == sorted(want, key=str)


def test_long_texts_are_only_written_for_the_sample(spark, tmp_path, monkeypatch):
    beginning = "All of these overviews begin alike, "
    lines = [f'M{i},O{i // 2},"{beginning}\nand go on {"in their own way " * 9}{i}",[],Released,{5 + i % 5},{i * 900}' for i in range(60)]
    (tmp_path / "movie.csv").write_text("\n".join(["title,original_title,overview,genres,status,vote_average,vote_count", *lines, lines[3], ""]))
    held = {}

    def counted(df, label):
        table = staged(df, label)
        held[label] = table.where(F.concat_ws("|", *[c for c, t in table.dtypes if t == "string"]).contains("in their own way")).count()
        return table

    for module in (files, preparation, sampling, tfidf):
        monkeypatch.setattr(module, "staged", counted)
    prepare_all(spark, {"movie": str(tmp_path / "movie.csv")}, str(tmp_path / "out"), {"movie": 8})
    rows = spark.read.parquet(f"{tmp_path}/out/movie").collect()
    assert len(rows) >= 8 and max(held.values()) <= len(rows) and not held["landed"] and not held["movies"]
    for r in rows:
        assert r.overview == f"{beginning}\nand go on {'in their own way ' * 9}{r.title[1:]}"
        assert r.text_representation.startswith(f"{r.title}. {r.overview}. []")


def test_vectors_of_all_tables_and_a_recommendation(spark, prepared, tmp_path):
    tables = {kind: spark.read.parquet(f"{prepared[0]}/{kind}") for kind in ("movie", "book", "destination")}
    widths, changes = embed_all(tables, str(tmp_path), hashing_encoder(384), "hashing")
    assert {(r.kind, r.width) for r in widths.collect()} == {(k, 384) for k in tables}
    assert {r.change for r in changes.collect()} == {"new"}
    vectors = None
    for kind in ("movie", "book"):
        part = current_vectors(spark, vectors_folder(str(tmp_path), kind)).withColumn("media_type", F.lit(kind))
        vectors = part if vectors is None else vectors.unionByName(part)
    lookup = catalogue_lookup(tables)
    targets = current_vectors(spark, search_folder(str(tmp_path)), "item_id bigint, embedding array<double>").join(
        tables["destination"].select("item_id", "name", "country"), "item_id"
    )
    title = tables["movie"].first().title
    results = recommend.recommend_from_media(lookup, vectors, targets, "movie", title).collect()
    assert [r["rank"] for r in results] == [1, 2, 3, 4, 5] and all(r.country == "NA" for r in results)


def test_different_widths_are_an_error(spark, tmp_path):
    schema = "item_id bigint, text_representation string"
    tables = {"movie": spark.createDataFrame([(1, "ab")], schema), "book": spark.createDataFrame([(1, "abc")], schema)}
    as_wide_as_the_text = lambda: lambda texts: np.ones((len(texts), len(texts[0])))
    with pytest.raises(DifferentWidths):
        embed_all(tables, str(tmp_path), as_wide_as_the_text, "by length")


def test_tracks_are_found_by_name_and_by_id(spark):
    schema = "item_id bigint, track_name string, track_id string"
    lookup = catalogue_lookup({"music": spark.createDataFrame([(1, "Song ", "t1"), (2, "song", None)], schema)})
    assert sorted(map(tuple, lookup.collect())) == [("music", "song", 2), ("music", "t1", 1)]
