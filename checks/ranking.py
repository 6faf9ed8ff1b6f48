"""Joins, aggregates, scores, samples and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import bind
from checks.bind import table
from checks.registry import query
from triptych.operators import capped, counting, ranking, rating, sampling, tags
from triptych.staging import staged

# --- tags ---------------------------------------------------------------------------------------
BRIDGE = """
bridge AS (SELECT o_custkey AS item, o_orderkey % 6 AS tag_id, o_orderkey AS row_id FROM orders),
tags AS (SELECT CAST(r_regionkey AS BIGINT) AS tag_id, r_name AS tag_name FROM region)"""


def bridge(spark, folder):
    """Orders as the bridge from customers to regions; tag 5 is not in the tag table."""
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("item"), (F.col("o_orderkey") % 6).alias("tag_id"), F.col("o_orderkey").alias("row_id")
    )


def tag_names(spark, folder):
    return table(spark, folder, "region").select(
        F.col("r_regionkey").cast("bigint").alias("tag_id"), F.col("r_name").alias("tag_name")
    )


@query("join_tags", f"WITH {BRIDGE} SELECT item, tag_id, row_id, tag_name FROM bridge LEFT JOIN tags USING (tag_id)")
def join_tags(spark, folder):
    return tags.join_tags(bridge(spark, folder), tag_names(spark, folder)).select("item", "tag_id", "row_id", "tag_name")


@query(
    "tag_list",
    """SELECT o_custkey AS item, string_agg(o_orderpriority, ', ' ORDER BY o_orderkey) AS tag_list
       FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) t
       WHERE n <= 15 GROUP BY o_custkey""",
)
def tag_list(spark, folder):
    named = table(spark, folder, "orders").select(F.col("o_custkey").alias("item"), "o_orderpriority", "o_orderkey")
    return tags.tag_lists(named, "item", "o_orderpriority", "o_orderkey", 15)


LISTS = (
    BRIDGE
    + """,
lists AS (
  SELECT item, coalesce(string_agg(tag_name, ', ' ORDER BY row_id), '') AS tag_list
  FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY row_id) AS n FROM bridge) t
  LEFT JOIN tags USING (tag_id) WHERE n <= 5 GROUP BY item)"""
)


@query(
    "join_tag_list",
    f"""WITH {LISTS} SELECT c_custkey, c_name, coalesce(tag_list, '') AS tag_list
        FROM customer LEFT JOIN lists ON item = c_custkey""",
)
def join_tag_list(spark, folder):
    lists = tags.tag_lists_by_id(bridge(spark, folder), tag_names(spark, folder), "item", "row_id", first=5)
    customers = table(spark, folder, "customer").select("c_custkey", "c_name")
    return tags.with_tag_list(customers, lists, "c_custkey", "item")


# --- scores -------------------------------------------------------------------------------------
def voted_items(spark, folder):
    """Items, written once: scores read them several times, the order lines only once."""
    return staged(bind.items(spark, folder), "items")


def scored_items(spark, folder):
    scored = rating.with_weighted_rating(voted_items(spark, folder), "rating", "votes", 0.25, voted_only=True)
    return scored.withColumn("weighted_rating", F.round("weighted_rating", 6))


@query("rating_prior", f"WITH {bind.SCORED} SELECT round(c, 6) AS mean_rating, CAST(m AS DOUBLE) AS prior_votes FROM prior")
def rating_prior(spark, folder):
    prior = rating.rating_prior(voted_items(spark, folder), "rating", "votes", 0.25, voted_only=True)
    return spark.createDataFrame([(round(prior.mean, 6), prior.votes)], "mean_rating double, prior_votes double")


@query("weighted_rating", f"WITH {bind.SCORED} SELECT item_id, weighted_rating FROM scored")
def weighted_rating(spark, folder):
    return scored_items(spark, folder).select("item_id", "weighted_rating")


@query(
    "popularity_boost",
    f"""WITH {bind.SCORED},
        moments AS (SELECT avg(price) AS mean, stddev_pop(price) AS deviation FROM scored)
        SELECT item_id, round(weighted_rating
          + 0.05 * greatest(-2, least(2, (price - mean) / (deviation + 1e-9))), 6) AS final_score
        FROM scored, moments""",
)
def popularity_boost(spark, folder):
    boosted = rating.with_popularity_boost(scored_items(spark, folder), "weighted_rating", "price")
    return boosted.select("item_id", F.round("final_score", 6).alias("final_score"))


# --- counts -------------------------------------------------------------------------------------
@query(
    "value_counts_topn",
    "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, l_partkey LIMIT 10",
)
def value_counts_topn(spark, folder):
    return counting.value_counts(table(spark, folder, "lineitem"), "l_partkey", 10)


@query("value_counts_by_key", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority")
def value_counts_by_key(spark, folder):
    return counting.value_counts_by_key(table(spark, folder, "orders"), "o_orderpriority")


SIZED = ("customer", "documents", "events", "lineitem", "orders", "part", "supplier")


@query("dataset_sizes", " UNION ALL ".join(f"SELECT '{n}' AS kind, count(*) AS n FROM {n}" for n in SIZED))
def dataset_sizes(spark, folder):
    return counting.table_sizes({name: table(spark, folder, name) for name in SIZED})


COVERED = ("l_partkey", "l_suppkey", "l_returnflag", "l_shipdate")


@query(
    "coverage_counts",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(DISTINCT {c}) AS n_distinct FROM lineitem"
        for c in COVERED
    ),
)
def coverage_counts(spark, folder):
    return counting.coverage(table(spark, folder, "lineitem"), COVERED)


TEXTS = {"documents": "text", "pages": "html", "conversations": "text", "benchmark": "text"}
LENGTHS = " UNION ALL ".join(f"SELECT '{k}' AS kind, length({c}) AS length FROM {k}" for k, c in TEXTS.items())


@query(
    "text_length_quartiles",
    f"""WITH lengths AS ({LENGTHS}),
        boxes AS (
          SELECT kind, count(*) AS n_texts, CAST(min(length) AS DOUBLE) AS shortest, quantile_cont(length, 0.25) AS q1,
                 quantile_cont(length, 0.5) AS median, quantile_cont(length, 0.75) AS q3,
                 CAST(max(length) AS DOUBLE) AS longest
          FROM lengths GROUP BY kind)
        SELECT b.*, min(length) AS whisker_low, max(length) AS whisker_high
        FROM boxes b JOIN lengths l ON l.kind = b.kind
         AND length BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)
        GROUP BY ALL""",
)
def text_length_quartiles(spark, folder):
    tables = {kind: table(spark, folder, kind) for kind in TEXTS}
    return counting.text_length_quartiles({kind: F.col(c) for kind, c in TEXTS.items()}, tables)


@query(
    "union_tables",
    """SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
       UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier
       UNION ALL SELECT p_partkey, p_name, NULL, NULL FROM part""",
)
def union_tables(spark, folder):
    customer = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
    )
    supplier = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")
    )
    part = table(spark, folder, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("id"))
    return counting.union_tables([customer, supplier, part])


# --- samples ------------------------------------------------------------------------------------
SAMPLE_ROWS = 1000


def strata_sql(scored: str, total: int, strata, sort: str, key: str) -> str:
    """Common table expressions `chosen` and `filled` for a stratified sample of a relation."""
    picks = " UNION ALL ".join(
        f"""SELECT * FROM (SELECT *, '{s.name}' AS _stratum FROM {scored} WHERE {s.predicate}
              ORDER BY {sort} DESC NULLS LAST, {key} LIMIT {sampling.quotas(total, strata)[s.name]})"""
        for s in strata
    )
    return f"""
chosen AS ({picks}),
filled AS (
  SELECT * FROM chosen
  UNION ALL
  SELECT * FROM (SELECT *, 'Extra' AS _stratum FROM {scored} WHERE {key} NOT IN (SELECT {key} FROM chosen)
    ORDER BY md5(concat({key}, '42')), {key} LIMIT (SELECT greatest({total} - count(*), 0) FROM chosen)))"""


STRATA = bind.SCORED + "," + strata_sql("scored", SAMPLE_ROWS, bind.ITEM_STRATA, "weighted_rating", "item_id")


@query("stratified_sample", f"WITH {STRATA} SELECT item_id, weighted_rating, votes, _stratum FROM chosen")
def stratified_sample(spark, folder):
    sample = sampling.stratified_sample(
        scored_items(spark, folder), SAMPLE_ROWS, bind.ITEM_STRATA, "weighted_rating", "item_id"
    )
    return sample.select("item_id", "weighted_rating", "votes", "_stratum")


@query("stratified_fill", f"WITH {STRATA} SELECT item_id, weighted_rating, votes, _stratum FROM filled")
def stratified_fill(spark, folder):
    sample = sampling.filled_sample(
        scored_items(spark, folder), SAMPLE_ROWS, bind.ITEM_STRATA, "weighted_rating", "item_id"
    )
    return sample.select("item_id", "weighted_rating", "votes", "_stratum")


EXCLUSIVE = """
placed AS (
  SELECT *, CASE WHEN weighted_rating >= 27 AND votes >= 30 THEN 's1'
    WHEN weighted_rating >= 26 AND weighted_rating < 27 AND votes >= 25 THEN 's2'
    WHEN weighted_rating >= 25 AND votes >= 20 THEN 's3'
    WHEN weighted_rating >= 24 AND votes >= 15 THEN 's4' END AS _stratum
  FROM scored),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY _stratum ORDER BY weighted_rating DESC, item_id) AS n
  FROM placed WHERE _stratum IS NOT NULL)"""


@query(
    "stratified_exclusive",
    f"""WITH {bind.SCORED}, {EXCLUSIVE} SELECT item_id, weighted_rating, _stratum FROM ranked
        WHERE n <= CASE _stratum WHEN 's1' THEN 400 WHEN 's2' THEN 300 WHEN 's3' THEN 200 ELSE 100 END""",
)
def stratified_exclusive(spark, folder):
    sample = sampling.stratified_sample(
        scored_items(spark, folder), SAMPLE_ROWS, bind.ITEM_STRATA, "weighted_rating", "item_id", allow_overlap=False
    )
    return sample.select("item_id", "weighted_rating", "_stratum")


@query(
    "leftover_anti",
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
       WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
)
def leftover_anti(spark, folder):
    chosen = table(spark, folder, "lineitem").where("l_returnflag = 'R'").withColumnRenamed("l_orderkey", "o_orderkey")
    return sampling.leftover(table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), chosen, "o_orderkey")


@query(
    "seeded_sample",
    "SELECT c_custkey, c_name FROM customer ORDER BY md5(concat(c_custkey, '42')), c_custkey LIMIT 100",
)
def seeded_sample(spark, folder):
    return sampling.seeded_sample(table(spark, folder, "customer").select("c_custkey", "c_name"), 100, "c_custkey")


@query(
    "dedupe_first",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM orders
       QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1""",
)
def dedupe_first(spark, folder):
    return ranking.dedupe_first(table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey")


@query(
    "dedupe_best",
    f"""WITH {bind.PLACES} SELECT place_id, country, region, population FROM places
        QUALIFY row_number() OVER (PARTITION BY country, region ORDER BY population DESC NULLS LAST, place_id) = 1""",
)
def dedupe_best(spark, folder):
    columns = bind.places(spark, folder).select("place_id", "country", "region", "population")
    return ranking.dedupe_best(columns, ["country", "region"], "population", "place_id")


@query(
    "topn_composite",
    f"""WITH {bind.ITEMS} SELECT item_id, votes, price FROM items
        ORDER BY votes DESC NULLS LAST, price DESC NULLS LAST, item_id LIMIT 50""",
)
def topn_composite(spark, folder):
    return ranking.top_rows(bind.items(spark, folder), ["votes", "price"], "item_id", 50).select("item_id", "votes", "price")


@query(
    "capped_topn",
    f"""WITH {bind.PLACES},
        ranked AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY population DESC NULLS LAST, place_id) AS n FROM places)
        SELECT place_id, country, population FROM ranked
        ORDER BY CASE WHEN n <= 5 THEN 0 ELSE 1 END, population DESC NULLS LAST, place_id LIMIT 150""",
)
def capped_topn(spark, folder):
    picked = capped.capped_sample(bind.places(spark, folder), ["population"], "place_id", "country", 5, 150)
    return picked.select("place_id", "country", "population")


def twice_capped_sql(relation: str, order: str, key: str, a: str, cap_a: int, b: str, cap_b: int, target: int) -> str:
    """Common table expressions that go down the ranking row by row, then fill up: `picked`, `result`."""
    return f"""
walked AS (
  SELECT list_reduce(list([{{'k': {key}, 'a': trim({a}), 'b': trim({b})}}] ORDER BY {order}), lambda seen, row:
    CASE WHEN len(seen) >= {target} THEN seen
      WHEN row[1].a <> '' AND len(list_filter(seen, lambda s: s.a = row[1].a)) >= {cap_a} THEN seen
      WHEN row[1].b <> '' AND len(list_filter(seen, lambda s: s.b = row[1].b)) >= {cap_b} THEN seen
      ELSE list_concat(seen, row) END) AS seen
  FROM {relation}),
picked AS (SELECT s.k AS {key} FROM (SELECT unnest(seen) AS s FROM walked) t),
result AS (
  SELECT * FROM {relation} WHERE {key} IN (SELECT {key} FROM picked)
  UNION ALL
  SELECT * FROM (SELECT * FROM {relation} WHERE {key} NOT IN (SELECT {key} FROM picked)
    ORDER BY {order} LIMIT (SELECT {target} - count(*) FROM picked)))"""


CAPPED = twice_capped_sql("items", "price DESC NULLS LAST, item_id", "item_id", "brand", 3, "category", 10, 100)


@query("double_capped_topn", f"WITH {bind.ITEMS}, {CAPPED} SELECT item_id, brand, category, price FROM result")
def double_capped_topn(spark, folder):
    picked = capped.twice_capped_sample(
        bind.items(spark, folder), ["price"], "item_id", ("brand", 3), ("category", 10), 100
    )
    return picked.select("item_id", "brand", "category", "price")


@query(
    "relaxed_filter",
    f"""WITH {bind.ITEMS}
        SELECT item_id, title, votes, round(rating, 6) AS rating FROM items WHERE rating >= 28 OR votes >= 25
        QUALIFY row_number() OVER (PARTITION BY title ORDER BY CASE WHEN rating >= 28 THEN 0 ELSE 1 END, item_id) = 1""",
)
def relaxed_filter(spark, folder):
    found = sampling.relaxed_filter(
        voted_items(spark, folder), "rating >= 28", "votes >= 25", 100_000_000, ["title"], "item_id"
    )
    return found.select("item_id", "title", "votes", F.round("rating", 6).alias("rating"))
