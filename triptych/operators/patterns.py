"""Titles that match a pattern, found through the trigrams that every match must hold.

A written posting table says which titles hold a trigram. Of the trigrams that a pattern needs the
rarest selects titles, and the pattern then decides on the JVM. Patterns that need none are tried on
all titles of their medium.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triptych.staging import staged

# Titles of a part that one pattern without trigrams is tried on by one task.
PART_ROWS = 50_000
# Stands for what a pattern does not fix; no title holds it.
GAP = "\x00"
# What a pattern may say beside plain characters, in the order in which it is taken out. Whatever is
# not understood here must only shorten the runs of characters that are left.
UNFIXED = (
    r"\\[dDwWsSbB]",  # classes and bounds
    r"\\[^a-zA-Z0-9]",  # escaped signs
    r"(?s)\[.*\]",  # from the first class to the last
    r"(?s)\(.*\)",  # from the first group to the last
    r"(?s).\{[^}]*\}",  # a counted character
    r"(?s).[?*]",  # one that may be missing
    r"[+.^$]",
)
# Escapes and flags beyond these make a pattern one that needs nothing.
NOT_UNDERSTOOD = r"\\[a-zA-Z0-9&&[^dDwWsSbB]]|\(\?"


def is_pattern(pattern: Column) -> Column:
    """Whether the text is a pattern that the JVM understands."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern).isNotNull()


def needed_trigrams(pattern: Column) -> Column:
    """Trigrams that every text with a match holds; none where that is not known."""
    left = reduce(lambda text, unfixed: F.regexp_replace(text, unfixed, GAP), UNFIXED, pattern)
    plain = ~pattern.rlike(NOT_UNDERSTOOD) & ~left.contains("|")
    return F.when(plain, F.array_distinct(F.filter(trigrams(left), lambda g: ~g.contains(GAP)))).otherwise(
        F.array().cast("array<string>")
    )


def trigrams(text: Column) -> Column:
    """All pieces of three characters, in order."""
    starts = F.when(F.length(text) >= 3, F.sequence(F.lit(1), F.length(text) - 2)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda at: F.substring(text, at, 3))


def title_postings(stock: DataFrame, texts: int) -> DataFrame:
    """media_type, gram, stock_id: the titles that hold each trigram in one of their texts, written."""
    held = F.array_distinct(F.concat(*[F.coalesce(trigrams(F.col(f"text{i}")), F.array().cast("array<string>")) for i in range(texts)]))
    return staged(stock.select("media_type", F.explode(held).alias("gram"), "stock_id"), "title-postings")


def matching(queries: DataFrame, stock: DataFrame, texts: int, part_rows: int = PART_ROWS) -> DataFrame:
    """query_id, title, row_id: the first row of each title that matches a pattern.

    `queries` has query_id, media_type and query, `stock` media_type, title, row_id and the lower-case
    texts to look at, text0 and so on. Texts that are no pattern match nothing.
    """
    stock = staged(stock.withColumn("stock_id", F.monotonically_increasing_id()), "title-stock")
    asked = staged(queries.where(is_pattern(F.col("query"))).withColumn("needed", needed_trigrams(F.col("query"))), "patterns")
    postings = title_postings(stock, texts)
    counts = postings.groupBy("media_type", "gram").agg(F.count("*").alias("n"))
    wanted = asked.select("query_id", "media_type", "query", F.explode("needed").alias("gram")).join(counts, ["media_type", "gram"], "left")
    # A trigram that no title holds is the rarest of all.
    rarest = wanted.groupBy("query_id", "media_type", "query").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    selected = rarest.join(postings, ["media_type", "gram"]).join(stock.drop("media_type"), "stock_id")
    parts = max(1, -(-stock.count() // part_rows))
    everywhere = asked.where(F.size("needed") == 0).select(
        "query_id", "media_type", "query", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    )
    dealt = stock.withColumn("part", F.pmod(F.xxhash64("stock_id"), F.lit(parts)).cast("int"))
    tried = everywhere.join(dealt, ["media_type", "part"])
    hit = reduce(Column.__or__, [F.coalesce(F.rlike(F.col(f"text{i}"), F.col("query")), F.lit(False)) for i in range(texts)])
    columns = ["query_id", "title", "row_id"]
    found = selected.where(hit).select(*columns).unionByName(tried.where(hit).select(*columns))
    return found.groupBy("query_id", "title").agg(F.min("row_id").alias("row_id"))
