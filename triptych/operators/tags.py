"""Tag bridge: items to tags, and the ordered tag list of every item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triptych.operators.ranking import top_per_group


def join_tags(bridge: DataFrame, tags: DataFrame, tag_id: str = "tag_id") -> DataFrame:
    """Bridge rows with the tag's name; unknown tags keep their row with a missing name.

    The strategy is left to the optimizer: small tag tables are broadcast by their size.
    """
    return bridge.join(tags, tag_id, "left")


def tag_lists(
    bridge: DataFrame, item: str, name: str, order: str, first: int = 15, out: str = "tag_list"
) -> DataFrame:
    """First `first` tag names of every item in source order, joined with ", "."""
    kept = top_per_group(bridge.where(F.col(item).isNotNull()), [item], [F.col(order)], first, order)
    return join_names(kept, item, name, order, out)


def tag_lists_by_id(
    bridge: DataFrame,
    tags: DataFrame,
    item: str,
    order: str,
    tag_id: str = "tag_id",
    name: str = "tag_name",
    first: int = 15,
    out: str = "tag_list",
) -> DataFrame:
    """Tag lists of a bridge that holds ids: cut to the first rows before the names are joined."""
    kept = top_per_group(bridge.where(F.col(item).isNotNull()), [item], [F.col(order)], first, order)
    return join_names(join_tags(kept, tags, tag_id), item, name, order, out)


def join_names(kept: DataFrame, item: str, name: str, order: str, out: str) -> DataFrame:
    """Names of each item (a bounded number) in order as one text; missing names are skipped."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(name).alias("name"))))
    return kept.groupBy(item).agg(
        F.array_join(F.transform(ordered, lambda t: t["name"]), ", ").alias(out)
    )


def with_tag_list(
    items: DataFrame, lists: DataFrame, item_key: str, list_key: str, out: str = "tag_list"
) -> DataFrame:
    """Items with their tag list, the empty text where there is none."""
    named = lists.select(F.col(list_key).alias("_tagged"), F.col(out).alias("_list"))
    joined = items.join(named, F.col(item_key) == F.col("_tagged"), "left")
    return joined.withColumn(out, F.coalesce("_list", F.lit(""))).drop("_tagged", "_list")
