"""Near titles against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from triptych.operators.fuzzy import candidates, deletions, fuzzy_titles, near_titles


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        previous, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            previous, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, previous + (x != y))
    return row[-1]


def mistyped(rng: random.Random, title: str, times: int) -> str:
    text = list(title)
    for _ in range(times):
        at = rng.randrange(len(text) + 1)
        kind = rng.randrange(3)
        if kind == 0 or not text:
            text.insert(at, rng.choice("abé 😀"))
        elif kind == 1:
            del text[min(at, len(text) - 1)]
        else:
            text[min(at, len(text) - 1)] = rng.choice("abc")
    return "".join(text)


@pytest.mark.parametrize("distance, gram", [(1, 2), (2, 3), (3, 2), (0, 3)])
def test_all_pairs_within_the_distance_and_no_others(spark, distance, gram):
    rng = random.Random(distance)
    titles = {"", "a", "ab", "aaaaaaaaaaaa", "aaaaaaaaaaaaa", "😀😀😀😀😀😀😀😀😀😀"}
    titles |= {"".join(rng.choice("ab c") for _ in range(rng.randrange(1, 16))) for _ in range(120)}
    typed = {mistyped(rng, t, rng.randrange(0, distance + 2)) for t in titles} - {""}
    media = lambda i: ("movie", "book")[i % 2]
    titles, typed = [(media(i), t, i) for i, t in enumerate(sorted(titles))], [(media(i), t) for i, t in enumerate(sorted(typed))]
    lookup = spark.createDataFrame(titles, "media_type string, title_key string, item_id bigint")
    missing = spark.createDataFrame(typed, "media_type string, typed_key string")
    got = near_titles(missing, lookup, distance, gram).select("media_type", "typed_key", "title_key", "item_id", "distance")
    want = [(m, a, b, i, edits(a, b)) for m, a in typed for n, b, i in titles if m == n and edits(a, b) <= distance]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 20


def test_few_candidates(spark):
    """Far fewer pairs are compared than there are, though all titles share words."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(300)]
    titles = sorted({f"the story of {rng.choice(words)} and {rng.choice(words)}" for _ in range(1000)})
    lookup = spark.createDataFrame([("movie", t) for t in titles], "media_type string, title_key string")
    typed = [mistyped(rng, t, 1) for t in titles[:200]]
    missing = spark.createDataFrame([("movie", t) for t in typed], "media_type string, typed_key string").distinct()
    pairs = candidates(missing, lookup, 2).count()
    assert 200 <= pairs < len(titles) * 200 / 30


def test_requests(spark):
    lookup = spark.createDataFrame(
        [("movie", "the godfather", 1), ("movie", "the godmother", 2), ("book", "the godfather", 3), ("movie", "up", 4), ("movie", "it", 5)],
        "media_type string, title_key string, item_id bigint",
    )
    typed = spark.createDataFrame(
        [(1, "movie", " The Godfater"), (2, "movie", "The Godfather"), (3, "game", "The Godfater"), (4, "movie", "  "), (5, "movie", "Ip"), (6, "movie", None), (7, "movie", "The Godfater")],
        "request_id bigint, media_type string, title string",
    )
    got = sorted(map(tuple, fuzzy_titles(typed, lookup).collect()))
    near = ("movie", 1, "the godfather", 1, 1)
    assert got == [
        (1, *near),
        (5, "movie", 1, "it", 5, 1),
        (5, "movie", 2, "up", 4, 1),
        (7, *near),
    ]
    assert {r.rank for r in fuzzy_titles(typed, lookup, most=1).collect()} == {1}


def test_deletions(spark):
    row = spark.createDataFrame([("abca",), ("",)], "t string").select(deletions(F.col("t"), 2).alias("d")).collect()
    assert set(row[0].d) == {"abca", "bca", "aca", "aba", "abc", "ca", "ba", "bc", "aa", "ac", "ab"}
    assert row[1].d == [""]
