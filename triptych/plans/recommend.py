"""Recommend target items for requests: resolve titles, fuse vectors, rank by exact cosine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triptych.functions.cleaning import strip, title_key
from triptych.functions.describing import (
    excerpt,
    maps_link,
    placeholder_image,
    population_badge,
    rank_medal,
    wiki_link,
)
from triptych.operators.fusion import fuse_vectors, media_parts
from triptych.operators.lookup import MEDIA, known_media, resolve_titles
from triptych.operators.similarity import cosine_topk
from triptych.staging import staged

# Status texts and the default number of results.
FOUND, NOT_FOUND = "✅ Found: ", "❌ Not found: "
TOP_K = 5
# Fixed value: longest text of a card.
LONGEST_EXCERPT = 300

REQUEST_SCHEMA = (
    "request_id bigint, movie_title string, book_title string, music_title string, "
    "movie_weight double, book_weight double, music_weight double, top_k int"
)
ITEMS = [f"{m}_item" for m in MEDIA]
WEIGHTS = [f"{m}_weight" for m in MEDIA]
TITLES = [f"{m}_title" for m in MEDIA]


def complete(requests: DataFrame) -> DataFrame:
    """Requests with all columns: equal weights and five results unless told otherwise."""
    have = set(requests.columns)
    weights = {w: F.coalesce(w, F.lit(1.0)).cast("double") if w in have else F.lit(1.0) for w in WEIGHTS}
    top_k = F.coalesce("top_k", F.lit(TOP_K)) if "top_k" in have else F.lit(TOP_K)
    return requests.withColumns(weights | {"top_k": top_k.cast("int")})


def filled(title: str) -> Column:
    return F.coalesce(F.length(strip(F.col(title))) > 0, F.lit(False))


def all_filled() -> Column:
    return filled(TITLES[0]) & filled(TITLES[1]) & filled(TITLES[2])


def resolve_requests(requests: DataFrame, lookup: DataFrame) -> DataFrame:
    """Requests with the items their three titles name, NULL where there is none.

    One left join per medium against that medium's part of the lookup: broadcast while it is small,
    else one shuffle of the requests each. The lookup has one row per title, so a title asked for
    by very many requests is a skewed key of the request side only, which adaptive execution splits.
    """
    for m in MEDIA:
        known = lookup.where(F.col("media_type") == m).select(
            F.col("title_key").alias("_key"), F.col("item_id").alias(f"{m}_item")
        )
        requests = requests.join(known, title_key(F.col(f"{m}_title")) == F.col("_key"), "left").drop("_key")
    return requests


def recommend_resolved(resolved: DataFrame, vectors: DataFrame, targets: DataFrame, dim: int | None = None) -> DataFrame:
    """request_id, rank, item_id, score for requests whose items are known.

    Requests that name the same items with the same weights are one query, searched once: popular
    combinations cost no more than rare ones.
    """
    same = [*ITEMS, *WEIGHTS, "top_k"]
    resolved = staged(resolved.select("request_id", *same), "resolved")
    queries = resolved.groupBy(*same).agg(F.min("request_id").alias("query_id"))
    fused = fuse_vectors(media_parts(queries, "query_id"), vectors, "query_id")
    asked = fused.join(queries.select("query_id", "top_k"), "query_id").withColumnRenamed(
        "query_id", "request_id"
    )
    hits = cosine_topk(asked, targets, top_k=None, dim=dim).withColumnRenamed("request_id", "query_id")
    together = [F.col(f"r.{c}").eqNullSafe(F.col(f"q.{c}")) for c in same]
    members = resolved.alias("r").join(queries.alias("q"), together).select("r.request_id", "q.query_id")
    return members.join(hits, "query_id").select("request_id", "rank", "item_id", "score")


def with_metadata(results: DataFrame, targets: DataFrame, key: str = "item_id") -> DataFrame:
    """Result rows with the fields of the target items."""
    return results.join(targets.drop("embedding"), key)


def recommend_fused(
    requests: DataFrame, lookup: DataFrame, vectors: DataFrame, targets: DataFrame, dim: int | None = None
) -> DataFrame:
    """Ranked targets for requests with a movie, a book and a track.

    Requests with a blank title, without any known title or with weights that add up to zero give
    no rows; `request_status` tells why.
    """
    valid = complete(requests).where(all_filled())
    return recommend_resolved(resolve_requests(valid, lookup), vectors, targets, dim)


def request_status(requests: DataFrame, lookup: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """Per request what was found, with the titles as typed, and the outcome as a whole.

    With `vectors`, an item without a vector counts as not found, since it cannot be searched for.
    """
    if vectors is not None:
        lookup = lookup.join(vectors.where(F.col("embedding").isNotNull()).select("item_id", "media_type"), ["item_id", "media_type"], "left_semi")
    resolved = resolve_requests(complete(requests), lookup)
    ok = all_filled()
    found = [F.col(i).isNotNull() for i in ITEMS]
    total = sum((F.when(f, F.col(w)).otherwise(0.0) for f, w in zip(found, WEIGHTS)), F.lit(0.0))
    messages = [
        F.when(ok, F.concat(F.when(f, FOUND).otherwise(NOT_FOUND), F.col(t))).alias(f"{m}_status")
        for m, f, t in zip(MEDIA, found, TITLES)
    ]
    outcome = (
        F.when(~ok, "blank title")
        .when(~(found[0] | found[1] | found[2]), "nothing found")
        .when(total == 0, "invalid weights")
        .otherwise("ok")
    )
    return resolved.select("request_id", *messages, outcome.alias("outcome"))


def recommend_single(
    requests: DataFrame, lookup: DataFrame, vectors: DataFrame, targets: DataFrame, dim: int | None = None
) -> DataFrame:
    """Ranked targets for requests with one title: request_id, media_type, title, top_k."""
    named = resolve_titles(complete(requests), lookup).where(F.col("item_id").isNotNull())
    one = {f"{m}_item": F.when(F.col("media_type") == m, F.col("item_id")) for m in MEDIA}
    return recommend_resolved(
        named.withColumns(one | {w: F.lit(1.0) for w in WEIGHTS}), vectors, targets, dim
    )


def recommend_all(vectors: DataFrame, targets: DataFrame, top_k: int = TOP_K, **settings) -> DataFrame:
    """Best targets for every item of a vector table."""
    asked = vectors.select(F.col("item_id").alias("request_id"), F.col("embedding").alias("vector"))
    return cosine_topk(asked, targets, top_k, **settings)


def recommend_from_media(
    lookup: DataFrame, vectors: DataFrame, targets: DataFrame, media_type: str, title: str, top_k: int = TOP_K
) -> DataFrame:
    """One request with one title, results with metadata; empty when the title is unknown."""
    request = lookup.sparkSession.createDataFrame(
        [(0, known_media(media_type), title, top_k)], "request_id bigint, media_type string, title string, top_k int"
    )
    return with_metadata(recommend_single(request, lookup, vectors, targets), targets).orderBy("rank")


def recommend_from_combined_media(
    lookup: DataFrame,
    vectors: DataFrame,
    targets: DataFrame,
    movie_title: str,
    book_title: str,
    music_title: str,
    weights: Sequence[float] | None = None,
    top_k: int = TOP_K,
) -> tuple[DataFrame, DataFrame]:
    """One request with three titles: results with metadata, and the status. Blank titles raise."""
    titles = (movie_title, book_title, music_title)
    for medium, title in zip(MEDIA, titles):
        if not title or not title.strip():
            raise ValueError(f"{medium.capitalize()} title cannot be empty.")
    weights = [float(w) for w in (weights or (1.0, 1.0, 1.0))]
    request = lookup.sparkSession.createDataFrame([(0, *titles, *weights, top_k)], REQUEST_SCHEMA)
    results = with_metadata(recommend_fused(request, lookup, vectors, targets), targets)
    return results.orderBy("rank"), request_status(request, lookup, vectors)


def result_cards(results: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """Display fields of ranked results: heading, badge, size text, excerpt, links.

    `summaries` (name, text) is a landed table; without it, or without a match, there is no excerpt.
    Of several texts of a name the first in text order counts, so that no card is shown twice.
    """
    name = F.coalesce("name", F.lit("Unknown"))
    country = F.coalesce("country", F.lit("Unknown"))
    heading = F.concat(rank_medal(F.col("rank")), F.lit(" "), F.col("rank").cast("string"), F.lit(". "), name)
    if summaries is None:
        results = results.withColumn("_excerpt", F.lit(None).cast("string"))
    else:
        # One character more than is shown tells whether a text is longer, and beginnings are in the
        # order of their texts. So whole texts go neither to the first of a name nor to every result.
        beginning = F.substring("text", 1, LONGEST_EXCERPT + 1)
        texts = summaries.groupBy("name").agg(F.min(beginning).alias("_summary"))
        excerpts = texts.select("name", excerpt(F.col("_summary"), longest=LONGEST_EXCERPT).alias("_excerpt"))
        results = results.join(excerpts, "name", "left")
    return results.select(
        "request_id",
        F.col("rank").cast("int").alias("rank"),
        F.concat(heading, F.lit(", "), country).alias("heading"),
        F.concat(F.lit("Match: "), F.format_number("score", 4)).alias("match"),
        population_badge(F.col("population")).alias("population_text"),
        F.col("_excerpt").alias("excerpt"),
        placeholder_image(name).alias("image"),
        wiki_link(name).alias("wiki_link"),
        maps_link(name, country).alias("maps_link"),
    )
