"""Samples against plain loops over sorted rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from triptych.operators import capped, ranking, sampling
from triptych.operators.cutoffs import above_cutoffs
from triptych.operators.quantiles import exact_quantile
from triptych.operators.rating import rating_prior, with_popularity_boost, with_weighted_rating
from triptych.operators.sampling import Stratum
from triptych.staging import staged


@pytest.mark.parametrize(
    "values",
    [
        [1, 2, 3, 10],
        [5],
        [7, 7, 7, 7],
        list(np.random.default_rng(1).integers(0, 1000, 3000)),
        list(np.random.default_rng(2).normal(size=2000)),
        list(10.0 ** np.random.default_rng(3).uniform(-300, 300, 500)),
        [0] * 5000 + list(range(1, 60)) + [10**9] * 5000,
        [float("-inf"), 0.0, float("inf"), 1.0, 1.0000000000000002],
    ],
)
def test_exact_quantile_also_without_gathering_values(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
    for q in (0.0, 0.25, 0.75):
        few = exact_quantile(df, "v", q)
        if np.isfinite(values).all():
            assert few == pytest.approx(float(np.quantile(np.array(values, dtype=float), q)), rel=1e-9)
        for limit in (0, 40):
            assert exact_quantile(df, "v", q, few_values=limit) == pytest.approx(few, rel=1e-9)


def test_quantile_of_nothing(spark):
    assert exact_quantile(spark.createDataFrame([], "v double"), "v", 0.5) is None


def test_rating_uses_voted_rows_only(spark):
    df = spark.createDataFrame([(1, 8.0, 100), (2, 6.0, 300), (3, 9.0, 0), (4, 7.0, None)], "id int, r double, v int")
    prior = rating_prior(df, "r", "v", 0.25, voted_only=True)
    assert prior == (7.0, 150.0)
    out = {r.id: r.weighted_rating for r in with_weighted_rating(df, "r", "v", 0.25, voted_only=True).collect()}
    assert out[1] == pytest.approx(100 / 250 * 8 + 150 / 250 * 7)
    assert out[3] is None and out[4] is None


def test_rating_without_any_votes_is_the_plain_average(spark):
    df = spark.createDataFrame([(8.0, 0), (6.0, None)], "r double, v int")
    assert [r.weighted_rating for r in with_weighted_rating(df, "r", "v", 0.25, voted_only=True).collect()] == [8.0, 6.0]


def test_boost_is_clipped_and_keeps_missing(spark):
    df = spark.createDataFrame([(5.0, float(p)) for p in [1] * 30 + [1000]] + [(5.0, None)], "s double, p double")
    scores = [r.final_score for r in with_popularity_boost(df, "s", "p").orderBy("p").collect()]
    assert scores[0] is None and scores[-1] == pytest.approx(5.1)


def test_quotas_are_cut_as_floats_give_them():
    assert sampling.quotas(100, [Stratum("a", "true", 0.29)]) == {"a": 28}


def frame(spark, n=300, seed=0):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, *range(40)]), rng.randrange(10)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id bigint, score int, kind int")


def by_rank(rows):
    return sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))


STRATA = (Stratum("high", "score >= 30", 0.4), Stratum("even", "kind % 2 = 0 and score >= 5", 0.3), Stratum("none", "score > 1000", 0.2), Stratum("rest", "kind >= 3", 0.1))
TESTS = {"high": lambda r: (r[1] or 0) >= 30, "even": lambda r: r[2] % 2 == 0 and r[1] is not None and r[1] >= 5, "none": lambda r: False, "rest": lambda r: r[2] >= 3}


@pytest.mark.parametrize("total", [10, 200, 260])
def test_stratified_sample_picks_the_best_of_each_stratum(spark, total, monkeypatch):
    rows, df = frame(spark)
    wanted = {
        (s.name, r[0]) for s in STRATA for r in [x for x in by_rank(rows) if TESTS[s.name](x)][: int(total * s.ratio)]
    }
    for directly in (0, 1000):
        monkeypatch.setattr(ranking, "PICK_DIRECTLY", directly)
        got = sampling.stratified_sample(df, total, STRATA, "score", "id").collect()
        assert len(got) == len(wanted) and {(r._stratum, r.id) for r in got} == wanted


@pytest.mark.parametrize("kind", ["spread", "ties", "missing", "few values", "text key"])
def test_cutoffs_keep_the_best_rows_and_few_others(spark, kind):
    rng = random.Random(7)
    value = {
        "spread": lambda: rng.random() * 1000 - 500, "text key": lambda: rng.random(), "ties": lambda: rng.choice([1.0, 1.0, 1.0, 2.0]) if rng.random() < 0.9 else rng.random(),
        "missing": lambda: rng.choice([None, None, float("nan"), rng.random()]), "few values": lambda: float(rng.randrange(3)),
    }[kind]
    key = (lambda i: f"k{i:06}") if kind == "text key" else (lambda i: i)
    rows = [(key(i), value(), rng.choice(["big", "big", "big", "small", "not wanted"])) for i in range(20_000)]
    wanted = {"big": 130, "small": 700, "absent": 5}
    df = spark.createDataFrame(rows, f"id {'string' if kind == 'text key' else 'bigint'}, score double, g string")
    left = above_cutoffs(df, "g", "score", "id", wanted)
    best = lambda rs, name: sorted((r for r in rs if r[2] == name), key=lambda r: (r[1] is None or r[1] != r[1], -(r[1] or 0) if r[1] == r[1] else 0, r[0]))[: wanted[name]]
    got = [tuple(r) for r in left.collect()]
    for name in ("big", "small"):
        assert [r[0] for r in best(got, name)] == [r[0] for r in best(rows, name)]
        assert sum(r[2] == name for r in got) <= 10 * wanted[name]
    assert {r[2] for r in got} == {"big", "small"}


def test_large_strata_are_not_sorted_as_a_whole(spark):
    df = spark.range(300_000).select("id", F.pmod(F.xxhash64("id"), F.lit(1_000_003)).alias("score"))
    strata = (Stratum("all", "true", 0.8), Stratum("half", "id % 2 = 0", 0.2))
    sample = sampling.stratified_sample(df, 5000, strata, "score", "id")
    assert sample.count() == 5000
    narrowed = above_cutoffs(df.withColumn("g", F.lit("all")), "g", "score", "id", {"all": 4000})
    assert 4000 <= narrowed.count() <= 16_000


def test_fill_draws_rows_not_chosen_before(spark):
    rows, df = frame(spark)
    got = sampling.filled_sample(df, 260, STRATA, "score", "id").collect()
    chosen = {r.id for r in got if r._stratum != "Extra"}
    extra = [r.id for r in got if r._stratum == "Extra"]
    assert len(got) == 260 and extra and len(set(extra)) == len(extra) and not chosen & set(extra)
    again = sampling.filled_sample(df.repartition(7), 260, STRATA, "score", "id").collect()
    assert sorted(r.id for r in again) == sorted(r.id for r in got)


def test_overlap_can_be_switched_off(spark):
    rows, df = frame(spark)
    got = sampling.stratified_sample(df, 200, STRATA, "score", "id", allow_overlap=False).collect()
    assert len({r.id for r in got}) == len(got)


def test_empty_strata_give_an_empty_frame(spark):
    _, df = frame(spark)
    none = (Stratum("none", "score > 1000", 1.0),)
    assert sampling.stratified_sample(df, 10, none, "score", "id").count() == 0
    assert sampling.stratified_sample(df, 10, (Stratum("tiny", "true", 0.01),), "score", "id").count() == 0


@pytest.mark.parametrize("target,cap", [(20, 2), (100, 5), (400, 1)])
def test_capped_sample_equals_the_loop(spark, target, cap):
    rows, df = frame(spark, 250, target)
    used, picked = {}, []
    for row in by_rank(rows):
        if used.get(row[2], 0) < cap and len(picked) < target:
            picked.append(row[0])
            used[row[2]] = used.get(row[2], 0) + 1
    rest = [r[0] for r in by_rank(rows) if r[0] not in picked]
    wanted = picked + rest[: target - len(picked)]
    got = [r.id for r in capped.capped_sample(df, ["score"], "id", "kind", cap, target).collect()]
    assert sorted(got) == sorted(wanted)


def walk(rows, cap_a, cap_b, target):
    used_a, used_b, picked = {}, {}, []
    for row in by_rank(rows):
        a, b = (row[2] or "").strip(), (row[3] or "").strip()
        if len(picked) == target:
            break
        if (a and used_a.get(a, 0) >= cap_a) or (b and used_b.get(b, 0) >= cap_b):
            continue
        picked.append(row[0])
        used_a[a], used_b[b] = used_a.get(a, 0) + 1, used_b.get(b, 0) + 1
    return picked


@pytest.mark.parametrize("seed", range(6))
def test_twice_capped_sample_equals_the_loop(spark, seed):
    rng = random.Random(seed)
    blanks = ["", " ", None] if seed % 2 else []
    names = [f"a{i}" for i in range(rng.randrange(2, 30))] + blanks
    kinds = [f"g{i}" for i in range(rng.randrange(2, 8))] + blanks
    rows = [(i, rng.choice([None, *range(25)]), rng.choice(names), rng.choice(kinds)) for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, score int, artist string, genre string")
    cap_a, cap_b, target = rng.randrange(1, 4), rng.randrange(1, 12), rng.randrange(5, 120)
    wanted = walk(rows, cap_a, cap_b, target)
    got = capped.twice_capped_sample(df, ["score"], "id", ("artist", cap_a), ("genre", cap_b), target, fill=False)
    assert sorted(r.id for r in got.collect()) == sorted(wanted)
    filled = capped.twice_capped_sample(df, ["score"], "id", ("artist", cap_a), ("genre", cap_b), target)
    rest = [r[0] for r in by_rank(rows) if r[0] not in wanted][: target - len(wanted)]
    assert sorted(r.id for r in filled.collect()) == sorted(wanted + rest)


@pytest.mark.parametrize("block_rows, depth", [(7, 1), (40, 2), (90, 1)])
def test_twice_capped_sample_in_blocks(spark, block_rows, depth):
    """Hot groups, so that walks stop at rows that the block lacks."""
    rng = random.Random(block_rows)
    rows = [(i, 1000 - i if i % 3 else None, rng.choice(["hot", "hot", "", None, *"abcdef"]), rng.choice(["warm", "warm", " ", *"pqrs"])) for i in range(120)]
    df = spark.createDataFrame(rows, "id bigint, score int, artist string, genre string")
    for target in (9, 27):
        got = capped.twice_capped_sample(
            df, ["score"], "id", ("artist", 2), ("genre", 5), target, fill=False, block_rows=block_rows * target // 9, depth=depth
        )
        assert sorted(r.id for r in got.collect()) == sorted(walk(rows, 2, 5, target))


def test_a_chain_is_walked_in_few_tables(spark, monkeypatch):
    """Each row is decided by the one before it."""
    written = []
    monkeypatch.setattr(capped, "staged", lambda df, label: written.append(label) or staged(df, label))
    n = 10_000
    df = spark.range(n).select("id", (-F.col("id")).alias("score"), F.floor((F.col("id") + 1) / 2).cast("string").alias("a"), F.floor(F.col("id") / 2).cast("string").alias("b"))
    got = capped.twice_capped_sample(df, ["score"], "id", ("a", 1), ("b", 1), n, fill=False)
    assert sorted(r.id for r in got.collect()) == list(range(0, n, 2))
    assert len(written) <= 20


def test_backfill_only_when_caps_fall_short(spark):
    _, df = frame(spark)
    plan = lambda target: capped.capped_sample(df, ["score"], "id", "kind", 5, target)._jdf.queryExecution().executedPlan().toString()
    assert "Anti" not in plan(20) and "Anti" in plan(200)


def test_relaxed_filter_prefers_strict_rows(spark):
    rows = [(1, "a", 60), (2, "a", 10), (3, "b", 10), (4, "b", 70), (5, "c", None), (6, "d", 5)]
    df = spark.createDataFrame(rows, "id bigint, name string, popularity int")
    enough = sampling.relaxed_filter(df, "popularity >= 50", "id < 6", 2, ["name"], "id")
    assert sorted(r.id for r in enough.collect()) == [1, 4]
    short = sampling.relaxed_filter(df, "popularity >= 50", "id < 6", 3, ["name"], "id")
    assert sorted(r.id for r in short.collect()) == [1, 4, 5]


def test_deduplication_treats_missing_keys_as_one(spark):
    rows = [(3, None, 1), (1, None, 2), (2, "x", None), (4, "x", 5)]
    df = spark.createDataFrame(rows, "id bigint, name string, score int")
    assert sorted(r.id for r in ranking.dedupe_first(df, ["name"], "id").collect()) == [1, 2]
    assert sorted(r.id for r in ranking.dedupe_best(df, ["name"], "score", "id").collect()) == [1, 4]


def test_large_picks_are_pruned_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    plan = ranking.top_per_group(df, ["g"], [F.col("id")], 5, "id")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
