"""Similarity search, lookup, fusion, suggestions and recommendations."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from triptych.operators import audit, encode, similarity, suggest
from triptych.operators.lookup import title_lookup
from triptych.operators.patterns import matching, needed_trigrams, title_postings
from triptych.operators.similarity import cosine_topk
from triptych.plans import recommend
from triptych.sources.vectors import search_table

STRATEGIES = [{}, {"target_floats": 0}, {"target_floats": 0, "request_floats": 0, "block_rows": 13}]


def brute(requests, targets, k):
    unit = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=1, keepdims=True) > 0)
    scores = np.round(unit(requests) @ unit(targets).T, 6) + 0.0
    return {
        (i, int(j), rank + 1, scores[i, j])
        for i in range(len(requests))
        for rank, j in enumerate(sorted(range(len(targets)), key=lambda j: (-scores[i, j], j))[: k(i)])
    }


def vector_frame(spark, matrix, names):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{names[0]} bigint, {names[1]} array<float>")


@pytest.mark.parametrize("settings", STRATEGIES)
def test_topk_equals_brute_force(spark, settings):
    rng = np.random.default_rng(5)
    # Few distinct values: many equal scores, so that ties are settled by key.
    requests = rng.integers(-1, 2, (40, 6)).astype(np.float32)
    targets = rng.integers(-1, 2, (70, 6)).astype(np.float32)
    requests[3] = 0
    targets[5] = 0
    asked = vector_frame(spark, requests, ("request_id", "vector")).withColumn("top_k", (F.col("request_id") % 7 + 1).cast("int"))
    stored = search_table(vector_frame(spark, targets, ("item_id", "embedding")).repartition(3))
    got = cosine_topk(asked, stored, top_k=None, **settings).collect()
    wanted = brute(requests.astype(float), targets.astype(float), lambda i: i % 7 + 1)
    assert {(r.request_id, r.item_id, r["rank"], r.score) for r in got} == wanted
    assert len(got) == len(wanted)


@pytest.mark.parametrize("settings", STRATEGIES)
def test_more_wanted_than_there_is(spark, settings):
    asked = vector_frame(spark, np.eye(3, dtype=np.float32), ("request_id", "vector"))
    stored = vector_frame(spark, np.eye(3, dtype=np.float32)[:2], ("item_id", "embedding"))
    assert cosine_topk(asked, stored, 5, **settings).count() == 6
    assert cosine_topk(asked, stored.limit(0), 5, **settings).count() == 0


def test_parts_move_the_other_side_a_bounded_number_of_times(spark):
    """Once it went to each block of the requests, 1,758 times for these."""
    from triptych.operators.grid import parts_of

    assert parts_of(7_200_000, 4096, 125_000) == 64
    assert parts_of(80_000_000, 4096, 125_000) == 640
    assert parts_of(10_000, 4096, 125_000) == 3 and parts_of(0, 4096, 125_000) == 1


def test_candidates_that_differ_by_less_than_single_precision():
    """Also rows that are no numbers, very long ones, and more targets than a tile holds."""
    rng = np.random.default_rng(3)
    near = rng.normal(size=64) + 1e-6 * rng.normal(size=(6000, 64))
    targets = near / np.linalg.norm(near, axis=1, keepdims=True)
    vectors = np.concatenate([targets[:9], -targets[:3]])
    wanted = np.round(vectors @ targets.T, 6)
    for length, odd in ((1.0, None), (1.0, np.nan), (1e20, None)):
        given, items = targets * length, np.arange(6000)
        if odd is not None:
            given, items = np.concatenate([given, np.full((2, 64), odd)]), np.arange(6002)
        best = similarity.BestRows(len(vectors), 7)
        best.add(vectors, items[:2500], given[:2500])
        best.add(vectors, items[2500:], given[2500:])
        if length == 1.0:
            order = np.lexsort((np.broadcast_to(np.arange(6000), wanted.shape), -wanted), axis=1)[:, :7]
            assert (best.item == order).all() and np.allclose(best.score, np.take_along_axis(wanted, order, 1), atol=1.1e-6)
        else:
            assert (best.score > 0).sum() == 63 and np.isfinite(best.score).all()


@pytest.mark.parametrize("settings", STRATEGIES[2:])
def test_vectors_of_another_width_are_refused_in_blocks(spark, settings):
    asked = vector_frame(spark, np.eye(3, dtype=np.float32), ("request_id", "vector"))
    stored = vector_frame(spark, np.eye(2, dtype=np.float32), ("item_id", "embedding"))
    with pytest.raises((PySparkException, ValueError)):
        cosine_topk(asked, stored, 1, **settings).count()


def many_vectors(spark, names):
    """20,000 of them in one file, as it were."""
    vector = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sin(F.col("id") * i).cast("float"))
    return spark.range(0, 20_000, 1, 1).select(F.col("id").alias(names[0]), vector.alias(names[1]))


def tasks_of(df):
    return df.select(F.spark_partition_id()).distinct().count()


def test_requests_of_one_file_are_searched_by_several_tasks(spark):
    stored = vector_frame(spark, np.eye(64, dtype=np.float32)[:5], ("item_id", "embedding"))
    assert tasks_of(cosine_topk(many_vectors(spark, ("request_id", "vector")), stored, 1)) > 1


def test_targets_of_one_file_are_searched_by_several_tasks(spark):
    from triptych.operators.similarity import _targets_in_place

    asked = vector_frame(spark, np.eye(64, dtype=np.float32)[:5], ("request_id", "vector")).withColumn("top_k", F.lit(1))
    hits = _targets_in_place(many_vectors(spark, ("item_id", "embedding")), asked.toArrow(), 64)
    assert hits.groupBy("request_id").count().where("count > 1").count() == 5


@pytest.mark.parametrize("dim, k", [(5, 1), (64, 5), (384, 20)])
def test_whole_numbers_find_the_same_as_single_precision(monkeypatch, dim, k):
    """Ties, copies, zero rows, rows that are no numbers, targets that are longer or shorter than one."""
    rng = np.random.default_rng(dim)
    targets = rng.normal(size=(9000, dim)) * rng.uniform(0.5, 3, (9000, 1))
    targets[4500:4600], targets[8000:8050], targets[8100:8110], targets[8200] = targets[:100], 0, -targets[0], np.nan
    targets[8300:8400] = np.sign(targets[8300:8400])
    vectors = np.concatenate([targets[:150], rng.normal(size=(150, dim)), np.zeros((1, dim))])
    vectors[:301:7] = np.sign(vectors[:301:7])
    vectors[:300] /= np.linalg.norm(vectors[:300], axis=1, keepdims=True)
    found = []
    for longest_row in (2.0, 0.0):
        # Rows beyond this length are screened in floating point.
        monkeypatch.setattr(similarity, "UNIT", longest_row)
        best = similarity.BestRows(len(vectors), k)
        for start in range(0, 9000, 3000):
            best.add(vectors, np.arange(start, start + 3000)[::-1], targets[start : start + 3000][::-1])
        found.append((best.score, best.item, best.whole is not None))
    assert found[0][2] and not found[1][2]
    assert (found[0][0] == found[1][0]).all() and (found[0][1] == found[1][1]).all()
    scores = np.round(vectors @ np.nan_to_num(targets, nan=-9.0).T, similarity.DIGITS)
    scores[:, 8200] = -np.inf
    assert np.allclose(found[0][0], -np.sort(-scores, axis=1)[:, :k], atol=1.1e-6)


def test_known_requests_are_screened_several_targets_at_a_time(monkeypatch):
    """Single precision, at twice the work, is for the first tile only."""
    calls, candidates = [], similarity.BestRows._candidates
    monkeypatch.setattr(similarity.BestRows, "_candidates", lambda *given: calls.append(1) or candidates(*given))
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(20_000, 64))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    best = similarity.BestRows(200, 5)
    best.add(rows[:200], np.arange(20_000), rows)
    assert len(calls) == 1 and (best.item[:, 0] == np.arange(200)).all() and not any(best.vain.values())


def test_each_part_is_the_work_of_a_task_of_its_own(spark):
    """Dealt by a hash, some tasks had several parts and others none."""
    import pyarrow as pa

    from triptych.operators.grid import parts_against_blocks

    def work(rows, blocks):
        return pa.table({"n": [rows.num_rows], "seen": [sum(block.num_rows for block in blocks)]})

    left, right = spark.range(4000).toDF("a"), spark.range(50).toDF("b")
    done = parts_against_blocks(left, right, "a", work, "n bigint, seen bigint", 100, 1000)
    got = done.select("n", "seen", F.spark_partition_id().alias("task")).collect()
    assert len(got) == 40 and len({r.task for r in got}) == 40
    assert sum(r.n for r in got) == 4000 and {r.seen for r in got} == {50}


def test_copies_of_targets_of_one_file_are_written_by_several_tasks(spark, monkeypatch):
    given, real = [], similarity.parts_against_blocks
    monkeypatch.setattr(similarity, "parts_against_blocks", lambda left, right, *more: given.append(right) or real(left, right, *more))
    asked = vector_frame(spark, np.eye(64, dtype=np.float32)[:5], ("request_id", "vector"))
    cosine_topk(asked, many_vectors(spark, ("item_id", "embedding")), 1, target_floats=0, request_floats=0)
    assert tasks_of(given[0]) > 1


@pytest.mark.parametrize("settings", STRATEGIES)
def test_rows_without_a_vector_take_no_part(spark, settings):
    targets = spark.createDataFrame([(1, None), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "item_id bigint, embedding array<double>").coalesce(1)
    asked = spark.createDataFrame(
        [(1, [1.0, 0.0], 2_000_000_000), (2, None, 5), (3, [0.0, 1.0], 1), (4, [0.0, 1.0], 0)],
        "request_id bigint, vector array<double>, top_k int",
    )
    got = cosine_topk(asked, targets, top_k=None, **settings).collect()
    assert sorted((r.request_id, r["rank"], r.item_id) for r in got) == [(1, 1, 2), (1, 2, 3), (3, 1, 3)]


def test_an_item_without_a_vector_counts_as_not_found(spark, world):
    _, lookup, vectors, targets = world
    none = vectors.withColumn("embedding", F.when(F.col("media_type") == "book", F.col("embedding")))
    results, status = recommend.recommend_from_combined_media(lookup, none, targets, "Up", "Dune", "t1")
    row = status.first()
    assert (row.movie_status, row.book_status, row.outcome) == ("❌ Not found: Up", "✅ Found: Dune", "ok")
    assert results.count() == 4
    _, status = recommend.recommend_from_combined_media(lookup, none.where("media_type <> 'book'"), targets, "Up", "Dune", "t1")
    assert status.first().outcome == "nothing found"


def test_repeated_summaries_show_one_card(spark):
    results = spark.createDataFrame([(1, 1, "Rome", "Italy", 0.5, 10)], "request_id int, rank int, name string, country string, score double, population int")
    texts = spark.createDataFrame([("Rome", "b"), ("Rome", "a"), ("Oslo", "c")], "name string, text string")
    assert recommend.result_cards(results, texts).count() == 1


def test_cards_of_texts_that_are_equal_for_long(spark):
    """Whole texts are neither compared nor joined."""
    names = ["a", "b", "c", "d", "e"]
    results = spark.createDataFrame([(1, i + 1, n, "Italy", 0.5, 10) for i, n in enumerate(names)], "request_id int, rank int, name string, country string, score double, population int")
    long = "ü" * 300
    said = [("a", long + "z"), ("a", long + "b"), ("b", long), ("b", long + "b"), ("c", None), ("c", "y" * 51), ("d", "x" * 50)]
    cards = recommend.result_cards(results, spark.createDataFrame(said, "name string, text string"))
    assert {r["rank"]: r.excerpt for r in cards.collect()} == {1: "ü" * 297 + "...", 2: long, 3: "y" * 51, 4: None, 5: None}
    assert "min(substring(text" in cards._jdf.queryExecution().optimizedPlan().toString()


def test_vectors_of_another_width_are_refused(spark):
    asked = vector_frame(spark, np.eye(3, dtype=np.float32), ("request_id", "vector"))
    stored = vector_frame(spark, np.eye(2, dtype=np.float32), ("item_id", "embedding"))
    with pytest.raises((PySparkException, ValueError)):
        cosine_topk(asked, stored, 1).count()


@pytest.fixture(scope="module")
def world(spark):
    """Three items per medium, four targets, four-dimensional vectors."""
    items = spark.createDataFrame(
        [
            ("movie", 1, 1, "Up", "Up!"),
            ("movie", 2, 2, " Heat ", None),
            ("movie", 3, 3, "heat", "nan"),
            ("book", 1, 1, "Dune", "Dune"),
            ("book", 2, 2, "", "Emma"),
            ("music", 1, 1, "Die For You", "t1"),
            ("music", 2, 2, None, "t2"),
        ],
        "media_type string, item_id bigint, row_id bigint, title string, original_title string",
    )
    vectors = spark.createDataFrame(
        [
            ("movie", 1, [1.0, 0.0, 0.0, 0.0]),
            ("movie", 2, [0.0, 1.0, 0.0, 0.0]),
            ("movie", 3, [0.0, 2.0, 0.0, 0.0]),
            ("book", 1, [0.0, 0.0, 3.0, 0.0]),
            ("music", 1, [0.0, 0.0, 0.0, 1.0]),
            ("music", 2, [0.0, 1.0, 0.0, 1.0]),
        ],
        "media_type string, item_id bigint, embedding array<float>",
    )
    raw = spark.createDataFrame(
        [
            (1, [1.0, 0.0, 0.0, 0.0], "Naples", "IT"),
            (2, [0.0, 1.0, 0.0, 0.0], "Windhoek", "NA"),
            (3, [0.0, 0.0, 5.0, 0.0], "Lima", "PE"),
            (4, [0.0, 0.0, 0.0, 2.0], "Oslo", "NO"),
        ],
        "item_id bigint, embedding array<float>, name string, country string",
    )
    targets = search_table(raw).drop("source_hash").join(raw.drop("embedding"), "item_id")
    return items, title_lookup(items, ["title", "original_title", "absent"]), vectors, targets


def test_lookup_keeps_the_last_row_and_skips_blanks(spark, world):
    found = {(r.media_type, r.title_key): r.item_id for r in world[1].collect()}
    assert found == {
        ("movie", "up"): 1,
        ("movie", "up!"): 1,
        ("movie", "heat"): 3,
        ("movie", "nan"): 3,
        ("book", "dune"): 1,
        ("book", "emma"): 2,
        ("music", "die for you"): 1,
        ("music", "t1"): 1,
        ("music", "t2"): 2,
    }
    assert title_lookup(world[0], ["absent"]).count() == 0


def test_single_title(world):
    _, lookup, vectors, targets = world
    results = recommend.recommend_from_media(lookup, vectors, targets, "movie", " UP ", top_k=3).collect()
    assert [(r["rank"], r.name) for r in results] == [(1, "Naples"), (2, "Windhoek"), (3, "Lima")]
    assert isinstance(results[0]["rank"], int) and isinstance(results[0].score, float)
    assert recommend.recommend_from_media(lookup, vectors, targets, "movie", "No such film").count() == 0
    with pytest.raises(ValueError):
        recommend.recommend_from_media(lookup, vectors, targets, "game", "Up")


def test_three_titles(world):
    _, lookup, vectors, targets = world
    ask = lambda *titles, **more: recommend.recommend_from_combined_media(lookup, vectors, targets, *titles, **more)
    results, status = ask("Up", "Dune", "nothing", weights=(1.0, 2.0, 9.0), top_k=2)
    # Raw vectors are averaged, weights are rescaled to the two found: (1/3, 0, 2/3 * 3, 0).
    length = np.hypot(1 / 3, 2.0)
    assert [(r["rank"], r.country, r.score) for r in results.collect()] == [
        (1, "PE", round(2.0 / length, 6)),
        (2, "IT", round(1 / 3 / length, 6)),
    ]
    found = status.first()
    assert (found.movie_status, found.music_status) == ("✅ Found: Up", "❌ Not found: nothing")
    assert found.outcome == "ok"
    results, status = ask("x", "y", "z")
    assert results.count() == 0 and status.first().outcome == "nothing found"
    for titles in ((" ", "a", "b"), ("a", "", "b"), ("a", "b", None)):
        with pytest.raises(ValueError, match="cannot be empty"):
            ask(*titles)


def test_weights_that_cancel_give_a_status_and_no_rows(world):
    _, lookup, vectors, targets = world
    results, status = recommend.recommend_from_combined_media(
        lookup, vectors, targets, "Up", "Dune", "t1", weights=(0.0, 0.0, 0.0)
    )
    assert results.count() == 0 and status.first().outcome == "invalid weights"


def test_same_request_many_times_is_answered_each_time(spark, world):
    _, lookup, vectors, targets = world
    requests = spark.range(200).select(
        F.col("id").alias("request_id"),
        F.lit("Up").alias("movie_title"),
        F.when(F.col("id") % 2 == 0, "Dune").otherwise("gone").alias("book_title"),
        F.lit("t2").alias("music_title"),
    )
    results = recommend.recommend_fused(requests, lookup, vectors, targets)
    assert results.count() == 800
    assert results.where("rank = 1").groupBy("item_id").count().count() == 2


SUGGEST = ["title", "original_title"]


def test_suggestions_are_literal_unless_asked_for_patterns(world):
    items = world[0]
    one = lambda *args, **more: [r.title for r in suggest.suggest_for_one(items, SUGGEST, *args, **more).collect()]
    assert one("movie", " HEA ") == [" Heat ", "heat"]
    assert one("movie", "up!") == ["Up"]
    assert one("movie", "u.") == [] and one("movie", "u.", regex=True) == ["Up"]
    assert one("movie", "harry (") == []
    with pytest.raises(ValueError):
        one("movie", "harry (", regex=True)
    assert one("movie", "  ") == [] and one("game", "up") == []
    assert one("movie", "e", 1) == [" Heat "]
    # A missing first title is not shown as the text "nan".
    assert one("music", "t2") == []


@pytest.mark.parametrize("settings", [{}, {"broadcast_queries": 0, "part_rows": 2}])
@pytest.mark.parametrize("regex", [False, True])
def test_suggestions_for_many_requests_equal_single_ones(spark, world, settings, regex):
    items = world[0]
    asked = [("movie", "hea"), ("movie", "t"), ("book", "un"), ("music", "t1"), ("movie", " "), ("game", "up"), ("movie", "hea"), ("movie", "p!")]
    requests = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "request_id bigint, media_type string, query string")
    got = suggest.suggest_titles(requests, items, SUGGEST, 2, regex, **settings).collect()
    for i, (media, query) in enumerate(asked):
        single = [r.title for r in suggest.suggest_for_one(items, SUGGEST, media, query, 2, regex).collect()]
        many = [r.title for r in sorted((r for r in got if r.request_id == i), key=lambda r: r["rank"])]
        assert many == single


PATTERNS = [
    "hea", "^heat", "h.at", "he?at", "hea*t", "heat|up", "(heat)?", "un(der)? the", "[hu]eat", "heat[ed]*", "x{0,2}heat", "hea{1}t", "he\\w+t",
    r"\bheat\b", r"\qheat\e", r"hea\x74", r"\(19\d\d\)", "harry (", "the +sea", "the sea$", "u.der", "(?i)heat", "s(e|a)a", "(a)(b)?c", "", "a**", "sea.?$", "th[[a-e]&&[e]] sea",
]


def test_patterns_through_trigrams(spark):
    """Against each title by itself."""
    titles = ["Heat", "heat (1995)", "Up", "Under the Sea", "Un the  sea", "over the sea", "h\x00at", "Heaat", "ht", "x heat", "saa", "ac", "", None, "THE SEA?"]
    items = spark.createDataFrame([("movie", t, None, i) for i, t in enumerate(titles)], "media_type string, title string, original_title string, row_id bigint")
    requests = spark.createDataFrame([(i, "movie", p) for i, p in enumerate(PATTERNS)], "request_id bigint, media_type string, query string")
    got = suggest.suggest_titles(requests, items, SUGGEST, 50, regex=True).collect()
    for i, pattern in enumerate(PATTERNS):
        many = [r.title for r in sorted((r for r in got if r.request_id == i), key=lambda r: r["rank"])]
        try:
            single = [r.title for r in suggest.suggest_for_one(items, SUGGEST, "movie", pattern, 50, regex=True).collect()]
        except ValueError:
            single = []
        assert many == single, pattern


def test_trigrams_that_a_pattern_needs(spark):
    needed = lambda p: spark.createDataFrame([(p,)], "p string").select(needed_trigrams(F.col("p")).alias("g")).first().g
    assert needed("heat") == ["hea", "eat"] and needed("^the .*sea+s$") == ["the", "he ", "sea"]
    assert needed("colou?r") == ["col", "olo"] and needed("abcd{2}efg") == ["abc", "efg"]
    for pattern in ("heat|up", r"\x41bcd", "(?x)a b c d", r"\Qabcd", "ab", "a.b.c", "(abc)"):
        assert needed(pattern) == []


def test_patterns_scan_no_titles(spark):
    """A pattern that needs trigrams meets only titles that hold the rarest of them."""
    items = spark.range(2000).select(F.lit("movie").alias("media_type"), F.concat(F.lit("story number "), "id").alias("title"), F.col("id").alias("row_id"))
    stock = items.withColumn("text0", F.lower("title"))
    queries = spark.createDataFrame([(1, "movie", "story.*199\\d")], "query_id bigint, media_type string, query string")
    assert matching(queries, stock, 1).count() == 10
    counted = title_postings(stock.withColumn("stock_id", F.col("row_id")), 1).where("gram = '199'").count()
    assert counted < 50


def test_row_ids_of_any_kind_order_suggestions(spark):
    items = spark.createDataFrame([("movie", "heat", ("b", 1)), ("movie", "heated", ("a", 7))], "media_type string, title string, row_id struct<f: string, n: int>")
    requests = spark.createDataFrame([(1, "movie", "hea.")], "request_id bigint, media_type string, query string")
    got = suggest.suggest_titles(requests, items, SUGGEST, regex=True).collect()
    assert [r.title for r in sorted(got, key=lambda r: r["rank"])] == ["heated", "heat"]


def test_audit_counts_what_is_wrong(spark):
    vectors = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [0.6, 0.9]), (2, [0.0, 1.0]), (3, [1.0]), (9, None)], "item_id bigint, embedding array<float>"
    )
    items = spark.createDataFrame([(1,), (2,), (3,), (4,)], "item_id bigint")
    found = {r.finding: r.n for r in audit.embedding_audit(vectors, items).collect()}
    assert found == {
        "vectors": 5,
        "vectors missing": 1,
        "vectors not of length one": 1,
        "vectors of width 2": 3,
        "vectors of width 1": 1,
        "keys with several vectors": 1,
        "vectors without item": 1,
        "items without vector": 1,
    }


def test_encoder_runs_in_small_batches_and_gives_unit_vectors(spark):
    seen = spark.sparkContext.accumulator(0)

    def make():
        def run(texts):
            seen.add(1 if len(texts) <= 2 else 1000)
            return np.array([[len(t), 1.0 if t else 0.0] for t in texts])

        return run

    df = spark.createDataFrame([(1, "abc"), (2, None), (3, ""), (4, "x"), (5, "yy")], "id bigint, text string").coalesce(1)
    out = {r.id: r.embedding for r in encode.embed_texts(df, "id", "text", make, batch=2).collect()}
    assert out[2] == [0.0, 0.0] and out[3] == [0.0, 0.0]
    assert np.linalg.norm(out[1]) == pytest.approx(1.0, abs=1e-5)
    assert 0 < seen.value < 1000
    with pytest.raises(ValueError):
        encode.embed_texts(df, "id", "absent", make)


def test_hashing_encoder_has_the_wanted_width(spark):
    df = spark.createDataFrame([(1, "Naples is a city, a city in Italy"), (2, "")], "id bigint, text string")
    out = {r.id: np.array(r.embedding) for r in encode.embed_texts(df, "id", "text", encode.hashing_encoder()).collect()}
    assert out[1].shape == (384,) and np.linalg.norm(out[1]) == pytest.approx(1, abs=1e-5)
    assert not out[2].any()


def test_hashing_encoder_equals_a_loop_over_words():
    rng = np.random.default_rng(4)
    letters = ["a", "B", "é", "İ", "Σ", "ß", "_", "7", "٣", "中", "😀", "\0", "\n", " ", ".", "-", "\u0301", "ʼ", "\x1c"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 30))) for _ in range(300)] + ["", "\0\0", "ΑΣ", "one"]
    for some in (texts, [t for t in texts if "\0" not in t], [""], ["a b c"]):
        got = encode.hashing_encoder(16)()(some)
        want = np.zeros((len(some), 16))
        for row, text in enumerate(some):
            for word in re.findall(r"\w{2,}", text.lower()):
                digest = hashlib.md5(word.encode()).hexdigest()
                want[row, int(digest[:8], 16) % 16] += 1 if int(digest[8], 16) % 2 == 0 else -1
        assert (got == want).all()
