"""The best rows of a few large groups, found by cutoffs instead of sorting the groups.

Approximate percentiles give a cutoff for every group at once, exact counts say whether enough rows
lie above it, and what lies above is narrowed again until few rows more than wanted are left.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

# A group is narrow enough with so many times the rows wanted of it.
ENOUGH = 4
# approx_percentile is off by at most one row in ACCURACY, so a pass narrows to a few rows in as many.
ACCURACY = 10_000
SHARES = tuple(2.0**-k for k in range(1, 13))


def above_cutoffs(df: DataFrame, group: str, score: str, key: str, wanted: Mapping[str, int]) -> DataFrame:
    """Rows of `df` that hold the best `wanted` ones of each group by falling score and rising key.

    Missing scores are last. Of a group there are at most about `ENOUGH` times the rows wanted; only
    of equal scores at the cutoff there may be more, where the key is no number. Rows of other
    groups are left out. The groups are few: their numbers go through the driver.
    """
    df = df.where(F.col(group).isin(*wanted))
    value = F.coalesce(F.when(~F.isnan(F.col(score).cast("double")), F.col(score).cast("double")), F.lit(float("-inf")))
    cuts, sizes = _narrowed(df, group, value, wanted)
    kept = df.where(_at_least(group, value, cuts))
    # Many rows with the score of the cutoff: of these the smallest keys.
    tied = {name: wanted[name] for name, n in sizes.items() if n > ENOUGH * wanted[name] and name in cuts}
    if not tied or not isinstance(df.schema[key].dataType, NumericType):
        return kept
    at_cut = F.coalesce(F.col(group).isin(*tied) & (value == _cut(group, cuts)), F.lit(False))
    rising = -F.col(key).cast("double")
    ties = kept.where(at_cut)
    key_cuts, _ = _narrowed(ties, group, rising, tied)
    return kept.where(~at_cut).unionByName(ties.where(_at_least(group, rising, key_cuts)))


def _narrowed(df: DataFrame, group: str, value: Column, wanted: Mapping[str, int]) -> tuple[dict[str, float], dict[str, int]]:
    """The least value that each narrowed group is cut at, and how many rows each group has from there on."""
    cuts: dict[str, float] = {}
    percentiles = F.percentile_approx(value, [1 - share for share in SHARES], ACCURACY).alias("at")
    found = df.groupBy(group).agg(F.count("*").alias("n"), percentiles).collect()
    sizes = {r[group]: r["n"] for r in found}
    while True:
        tried: dict[str, list[float]] = {}
        for r in found:
            name, n = r[group], r["n"]
            if n > ENOUGH * wanted[name]:
                # From the highest cutoff that should leave enough rows down to lower ones.
                fits = [at for share, at in zip(SHARES, r["at"]) if share * n >= 1.5 * wanted[name]]
                tried[name] = [at for at in dict.fromkeys(reversed(fits)) if at > cuts.get(name, float("-inf"))][:3]
        tried = {name: values for name, values in tried.items() if values}
        if not tried:
            return cuts, sizes
        counts = [
            F.count_if(value >= _cut(group, {name: values[min(i, len(values) - 1)] for name, values in tried.items()})).alias(f"n{i}")
            for i in range(3)
        ]
        inside = df.where(F.col(group).isin(*tried) & _at_least(group, value, cuts))
        moved = []
        for r in inside.groupBy(group).agg(*counts).collect():
            for i, cut in enumerate(tried[r[group]]):
                if r[f"n{i}"] >= wanted[r[group]]:
                    cuts[r[group]], sizes[r[group]] = cut, r[f"n{i}"]
                    moved.append(r[group])
                    break
        still = [name for name in moved if sizes[name] > ENOUGH * wanted[name]]
        if not still:
            return cuts, sizes
        inside = df.where(F.col(group).isin(*still) & _at_least(group, value, cuts))
        found = inside.groupBy(group).agg(F.count("*").alias("n"), percentiles).collect()


def _cut(group: str, cuts: Mapping[str, float]) -> Column:
    return F.coalesce(*[F.when(F.col(group) == name, F.lit(cut)) for name, cut in cuts.items()], F.lit(None).cast("double"))


def _at_least(group: str, value: Column, cuts: Mapping[str, float]) -> Column:
    """Whether a row is not below the cutoff of its group."""
    return F.coalesce(value >= _cut(group, cuts), F.lit(True)) if cuts else F.lit(True)
