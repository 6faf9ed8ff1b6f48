"""Stratified and seeded samples."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triptych.operators import ranking
from triptych.operators.cutoffs import above_cutoffs
from triptych.operators.ranking import descending, top_per_group
from triptych.staging import staged

EXTRA = "Extra"
SEED = "42"


class Stratum(NamedTuple):
    """Name, SQL predicate and share of the total of one stratum."""

    name: str
    predicate: str
    ratio: float


def quotas(total: int, strata: Sequence[Stratum]) -> dict[str, int]:
    """Rows per stratum; the product is cut, not rounded, as floating point gives it."""
    return {s.name: int(total * s.ratio) for s in strata}


def stratified_sample(
    df: DataFrame,
    total: int,
    strata: Sequence[Stratum],
    sort: str,
    key: str,
    allow_overlap: bool = True,
    label: str = "_stratum",
) -> DataFrame:
    """Best rows of every stratum by `sort`, up to its share of `total`.

    Small shares take one pass; for large ones cutoffs are found first (`cutoffs.py`).

    Predicates may overlap. Then a row is drawn by every stratum it is among the best of, or with
    `allow_overlap=False` only competes in the first stratum that it matches.
    """
    size = quotas(total, strata)
    names = [F.when(F.expr(s.predicate), F.lit(s.name)) for s in strata if size[s.name] > 0]
    if not names:
        return df.limit(0).withColumn(label, F.lit(None).cast("string"))
    if allow_overlap:
        placed = df.withColumn(label, F.explode(F.array_compact(F.array(*names))))
    else:
        placed = df.withColumn(label, F.coalesce(*names)).where(F.col(label).isNotNull())
    if max(size.values()) > ranking.PICK_DIRECTLY and isinstance(df.schema[sort].dataType, T.NumericType):
        # Only rows near the best ones are ranked; a stratum may hold any share of the table.
        placed = above_cutoffs(placed, label, sort, key, {name: n for name, n in size.items() if n > 0})
    best = top_per_group(placed, [label], descending([sort], key), max(size.values()), key, rank="_rank")
    quota = F.coalesce(*[F.when(F.col(label) == name, F.lit(n)) for name, n in size.items()])
    return best.where(F.col("_rank") <= quota).drop("_rank")


def leftover(df: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """Rows whose key was not chosen."""
    return df.join(chosen.select(key), key, "left_anti").select(*df.columns)


def seeded_order(key: str, seed: str = SEED) -> list[Column]:
    """A shuffled order that is the same on every run and in every engine."""
    return [F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), F.col(key)]


def seeded_sample(df: DataFrame, n: int, key: str, seed: str = SEED) -> DataFrame:
    """`n` rows picked by a hash of their key, which is a number or a text."""
    if isinstance(df.schema[key].dataType, (T.StructType, T.ArrayType, T.MapType)):
        raise ValueError(f"{key} is no plain value, so its text says nothing lasting about the row")
    return df.orderBy(*seeded_order(key, seed)).limit(n)


def filled_sample(
    df: DataFrame,
    total: int,
    strata: Sequence[Stratum],
    sort: str,
    key: str,
    allow_overlap: bool = True,
    label: str = "_stratum",
) -> DataFrame:
    """Stratified sample, filled up to `total` with random leftover rows when strata fall short.

    The sample (at most the sum of the quotas) is written once; its size decides whether the table
    has to be read again for the fill. Returns a written table.
    """
    chosen = staged(stratified_sample(df, total, strata, sort, key, allow_overlap, label), "strata")
    missing = total - chosen.count()
    if missing <= 0:
        return chosen
    extra = seeded_sample(leftover(df, chosen, key), missing, key)
    return staged(chosen.unionByName(extra.withColumn(label, F.lit(EXTRA))), "filled")


def relaxed_filter(
    df: DataFrame, strict: str, relaxed: str, enough: int, keys: Sequence[str], row_id: str
) -> DataFrame:
    """Rows under the strict predicate; when fewer than `enough`, the rows under the relaxed one too.

    Deduplicated by `keys` with strict rows first. Looks at no more than `enough` rows to decide.
    """
    kept = df.where(strict)
    if kept.limit(enough).count() >= enough:
        return kept
    both = df.withColumn("_loose", F.coalesce(~F.expr(strict), F.lit(True))).where(
        ~F.col("_loose") | F.expr(relaxed)
    )
    best = both.withColumn("_source", F.struct("_loose", row_id))
    return top_per_group(best, keys, [F.col("_source")], 1, row_id).drop("_loose", "_source")
