"""Keyed tables that are renewed piece by piece."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from triptych.operators.encode import hashing_encoder
from triptych.sources import versions
from triptych.sources.vectors import current_vectors, refresh_search_table, refresh_vectors

SCHEMA = "item_id bigint, text string"


@pytest.fixture
def counted(spark):
    """An encoder that counts the texts it gets."""
    texts = spark.sparkContext.accumulator(0)

    def make():
        def encode(batch):
            texts.add(len(batch))
            return np.array([[len(t), 1.0] for t in batch])

        return encode

    return texts, make


def rows(spark, *pairs):
    return spark.createDataFrame(pairs, SCHEMA)


def vectors_of(spark, folder):
    return {r.item_id: round(r.embedding[0] / r.embedding[1]) for r in current_vectors(spark, folder).collect()}


def test_only_what_differs_is_encoded(spark, tmp_path, counted):
    texts, make = counted
    folder = str(tmp_path)
    run = lambda *pairs, encoder="a": sorted(map(tuple, refresh_vectors(rows(spark, *pairs), folder, make, encoder, "text").collect()))
    assert run((1, "a"), (2, "bb"), (3, None), (None, "lost")) == [(1, "new"), (2, "new"), (3, "new")]
    assert (texts.value, vectors_of(spark, folder)) == (3, {1: 1, 2: 2, 3: 0})
    assert run((1, "a"), (2, "bb"), (3, "")) == []
    assert (texts.value, versions.versions(spark, folder)) == (3, [1])
    assert run((1, "a"), (2, "ccc"), (4, "dddd")) == [(2, "changed"), (3, "gone"), (4, "new")]
    assert (texts.value, vectors_of(spark, folder)) == (5, {1: 1, 2: 3, 4: 4})
    # Vectors of another encoder are no use.
    assert run((1, "a"), (2, "ccc"), (4, "dddd"), encoder="b") == [(1, "changed"), (2, "changed"), (4, "changed")]
    assert texts.value == 8
    assert run(encoder="b") == [(1, "gone"), (2, "gone"), (4, "gone")]
    assert vectors_of(spark, folder) == {} and versions.versions(spark, folder) == [1, 2, 3, 4]


def test_repeated_keys_have_one_vector(spark, tmp_path, counted):
    texts, make = counted
    refresh_vectors(rows(spark, (1, "a"), (1, "a"), (1, "bb")), str(tmp_path), make, "a", "text")
    assert texts.value == 1 and len(vectors_of(spark, str(tmp_path))) == 1
    assert refresh_vectors(rows(spark, (1, "bb"), (1, "a")), str(tmp_path), make, "a", "text").count() == 0


def test_buckets_without_changes_keep_their_files(spark, tmp_path):
    folder = str(tmp_path)
    items = spark.range(500).select(F.col("id").alias("item_id"), F.concat(F.lit("text "), "id").alias("text"))
    refresh_vectors(items, folder, hashing_encoder(8), "h", "text")
    before = versions.current(spark, folder)
    refresh_vectors(items.withColumn("text", F.when(F.col("item_id") == 7, "other").otherwise(F.col("text"))), folder, hashing_encoder(8), "h", "text")
    after = versions.current(spark, folder)
    assert sum(after.places[b] != before.places[b] for b in before.places) == 1 and len(before.places) == versions.BUCKETS
    old = versions.read_version(spark, folder, "item_id bigint, embedding array<float>", before)
    assert old.count() == 500 == current_vectors(spark, folder).count()


def test_an_unfinished_version_is_not_seen(spark, tmp_path):
    folder = str(tmp_path)
    refresh_vectors(rows(spark, (1, "a")), folder, hashing_encoder(8), "h", "text")
    (tmp_path / "manifest" / "00000002").mkdir()
    assert versions.versions(spark, folder) == [1] and current_vectors(spark, folder).count() == 1


def test_old_versions_go(spark, tmp_path):
    folder = str(tmp_path)
    for text in ("a", "b", "c"):
        refresh_vectors(rows(spark, (1, text), (2, "stays")), folder, hashing_encoder(8), "h", "text")
    assert versions.forget_old(spark, folder) == 1 and versions.versions(spark, folder) == [2, 3]
    assert versions.forget_old(spark, folder) == 0
    assert current_vectors(spark, folder).count() == 2


def test_search_table_follows_the_vectors(spark, tmp_path):
    schema, folder = "item_id bigint, embedding array<float>", str(tmp_path)
    refresh_search_table(spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], schema), folder)
    changes = refresh_search_table(spark.createDataFrame([(1, [4.0, 3.0]), (2, [0.0, 0.0])], schema), folder)
    assert [tuple(r) for r in changes.collect()] == [(1, "changed")]
    saved = current_vectors(spark, folder, "item_id bigint, embedding array<double>")
    assert {r.item_id: r.embedding for r in saved.collect()} == {1: pytest.approx([0.8, 0.6]), 2: [0.0, 0.0]}
