"""Titles that contain what was typed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triptych.functions.cleaning import title_key
from triptych.operators.lookup import MEDIA
from triptych.operators.patterns import PART_ROWS, is_pattern, matching
from triptych.operators.ranking import top_per_group
from triptych.staging import staged

BROADCAST_QUERIES = 100_000


def suggest_for_one(
    items: DataFrame, titles: Sequence[str], media_type: str, query: str, most: int = 5, regex: bool = False
) -> DataFrame:
    """First distinct titles, in table order, of items with the typed text in any title column.

    Shows the first title column. Blank queries and unknown media give none. The text is taken
    literally, or with `regex` as a pattern of the JVM; one that is none is an error.
    """
    columns = [t for t in titles if t in items.columns]
    wanted = query.strip().lower()
    if not wanted or media_type not in MEDIA or not columns:
        return items.sparkSession.createDataFrame([], "title string")
    if regex and not items.sparkSession.range(1).select(is_pattern(F.lit(wanted))).first()[0]:
        raise ValueError(f"{wanted!r} is not a pattern")
    hit = lambda c: F.lower(c).rlike(wanted) if regex else F.contains(F.lower(c), F.lit(wanted))
    matches = _any([F.coalesce(hit(F.col(c)), F.lit(False)) for c in columns])
    shown = items.where((F.col("media_type") == media_type) & matches & F.col(columns[0]).isNotNull())
    first_seen = shown.groupBy(F.col(columns[0]).alias("title")).agg(F.min("row_id").alias("_at"))
    return first_seen.orderBy("_at").limit(most).drop("_at")


def suggest_titles(
    requests: DataFrame,
    items: DataFrame,
    titles: Sequence[str],
    most: int = 5,
    regex: bool = False,
    broadcast_queries: int = BROADCAST_QUERIES,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Suggestions for a table of requests (request_id, media_type, query): request_id, rank, title.

    Equal queries and equal titles are searched once. Literal queries are looked up among the
    substrings of the titles; patterns (of the JVM) select titles by trigrams (`patterns.py`), and
    texts that are no pattern have no suggestions. `row_id` orders the titles.
    """
    columns = [t for t in titles if t in items.columns]
    asked = requests.select("request_id", "media_type", title_key(F.col("query")).alias("query")).where(
        (F.length("query") > 0) & F.col("media_type").isin(*MEDIA)
    )
    distinct = asked.groupBy("media_type", "query").agg(F.min("request_id").alias("query_id"))
    queries = staged(distinct, "queries")
    shown = items.where(F.col(columns[0]).isNotNull())
    texts = [F.lower(F.col(c)).alias(f"text{i}") for i, c in enumerate(columns)]
    stock = (
        shown.select("media_type", F.col(columns[0]).alias("title"), *texts, "row_id")
        .groupBy("media_type", "title", *[f"text{i}" for i in range(len(columns))])
        .agg(F.min("row_id").alias("row_id"))
    )
    if regex:
        return _best(asked, queries, matching(queries, stock, len(columns), part_rows), most)
    small = queries.count() <= broadcast_queries
    seen = _containing(F.broadcast(queries) if small else queries, queries, stock, len(columns))
    return _best(asked, queries, seen, most)


def _containing(known: DataFrame, queries: DataFrame, stock: DataFrame, texts: int) -> DataFrame:
    """query_id, title, row_id of the titles that contain a query.

    The substrings of a title that are as long as some query of its medium are looked up among the
    queries, on the spot when these are broadcast.
    """
    # One row for each medium.
    sizes = queries.groupBy("media_type").agg(F.collect_set(F.length("query")).alias("sizes"))

    def parts(text: str) -> Column:
        of_size = lambda size: F.when(
            F.length(text) >= size,
            F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda at: F.substring(text, at, size)),
        )
        return F.coalesce(F.flatten(F.array_compact(F.transform("sizes", of_size))), F.array().cast("array<string>"))

    held = F.array_distinct(F.concat(*[parts(f"text{i}") for i in range(texts)]))
    cut = stock.join(F.broadcast(sizes), "media_type").select("media_type", "title", "row_id", F.explode(held).alias("query"))
    found = cut.join(known, ["media_type", "query"])
    return found.groupBy("query_id", "title").agg(F.min("row_id").alias("row_id"))


def _best(asked: DataFrame, queries: DataFrame, seen: DataFrame, most: int) -> DataFrame:
    best = top_per_group(seen, ["query_id"], [F.col("row_id"), F.col("title")], most, "row_id", rank="rank")
    named = best.join(queries, "query_id").select("media_type", "query", "rank", "title")
    return asked.join(named, ["media_type", "query"]).select("request_id", "rank", "title")


def _any(conditions: Sequence[Column]) -> Column:
    met = conditions[0]
    for condition in conditions[1:]:
        met = met | condition
    return met
