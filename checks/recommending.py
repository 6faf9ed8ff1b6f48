"""Vectors, lookup, similarity search and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import bind
from checks.bind import table
from checks.cleaning import BADGE, MAPS, WIKI
from checks.registry import query
from triptych.functions.vectors import unit
from triptych.operators import audit, fusion, lookup, similarity
from triptych.operators.fuzzy import fuzzy_titles as nearest
from triptych.operators.suggest import suggest_titles as suggest
from triptych.plans import recommend

# --- vectors ------------------------------------------------------------------------------------
@query(
    "l2_normalise",
    """WITH scaled AS (
         SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * (vec_id % 5)) AS v FROM embeddings),
       measured AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS length FROM scaled)
       SELECT vec_id, unnest(range(0, len(v))) AS pos,
              round(unnest(list_transform(v, lambda x: CASE WHEN length > 0 THEN x / length ELSE 0.0 END)), 6) + 0.0 AS x
       FROM measured""",
)
def l2_normalise(spark, folder):
    """Vectors of several lengths, zero vectors among them."""
    factor = F.col("vec_id") % 5
    scaled = table(spark, folder, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") * factor).alias("v")
    )
    elements = scaled.select("vec_id", F.posexplode(unit(F.col("v"))).alias("pos", "x"))
    return elements.withColumn("x", F.round("x", 6) + F.lit(0.0))


@query(
    "embedding_audit",
    """WITH shown AS (
         SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN NULL WHEN vec_id % 9 = 1 THEN embedding[1:32] ELSE embedding END AS embedding
         FROM embeddings
         UNION ALL SELECT vec_id, embedding FROM embeddings WHERE vec_id % 10 = 3),
       items AS (SELECT p_partkey AS item_id FROM part WHERE p_partkey % 7 <> 0)
       SELECT 'vectors' AS finding, count(*) AS n FROM shown
       UNION ALL SELECT 'vectors missing', count(*) FROM shown WHERE embedding IS NULL
       UNION ALL SELECT 'vectors not of length one', count(*) FROM shown
         WHERE abs(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) - 1) > 1e-5
       UNION ALL SELECT 'vectors of width ' || len(embedding), count(*) FROM shown WHERE embedding IS NOT NULL GROUP BY len(embedding)
       UNION ALL SELECT 'keys with several vectors', count(*) FROM (SELECT vec_id FROM shown GROUP BY vec_id HAVING count(*) > 1) t
       UNION ALL SELECT 'vectors without item', count(*) FROM shown WHERE vec_id NOT IN (SELECT item_id FROM items)
       UNION ALL SELECT 'items without vector', count(*) FROM items WHERE item_id NOT IN (SELECT vec_id FROM shown)""",
)
def embedding_audit(spark, folder):
    """Vectors with gaps, short ones and repeated keys, against items of which some are missing."""
    k = F.col("vec_id")
    stored = table(spark, folder, "embeddings").select("vec_id", "embedding")
    damaged = F.when(k % 9 == 1, F.slice("embedding", 1, 32)).when(k % 9 != 0, F.col("embedding"))
    shown = stored.withColumn("embedding", damaged).unionByName(stored.where(k % 10 == 3))
    items = table(spark, folder, "part").where(F.col("p_partkey") % 7 != 0).select(F.col("p_partkey").alias("item_id"))
    return audit.embedding_audit(shown, items, "vec_id", "item_id")


@query(
    "embedding_widths",
    """SELECT 'targets' AS kind, CAST(len(embedding) AS BIGINT) AS width, count(*) AS n FROM embeddings GROUP BY 2
       UNION ALL SELECT 'items', len(embedding), count(*) FROM part
         JOIN embeddings ON vec_id = p_partkey % (SELECT count(*) FROM embeddings) GROUP BY 2""",
)
def embedding_widths(spark, folder):
    return audit.same_width({"targets": table(spark, folder, "embeddings"), "items": bind.vectors(spark, folder)})


# --- lookup -------------------------------------------------------------------------------------
@query("title_lookup", f"WITH {bind.LOOKUP} SELECT * FROM lookup")
def title_lookup(spark, folder):
    return bind.lookup(spark, folder)


@query(
    "title_resolve",
    f"""WITH {bind.RESOLVED}
        SELECT request_id, 'movie' AS media_type, movie_title AS title, movie_item AS item_id FROM resolved
        UNION ALL SELECT request_id, 'book', book_title, book_item FROM resolved
        UNION ALL SELECT request_id, 'music', music_title, music_item FROM resolved""",
)
def title_resolve(spark, folder):
    typed = lookup.as_typed_titles(bind.requests(spark, folder))
    named = lookup.resolve_titles(typed, bind.lookup(spark, folder))
    return named.select("request_id", "media_type", "title", "item_id")


@query(
    "suggest_titles",
    f"""WITH {bind.LOOKUP},
        asked AS (
          SELECT c_custkey AS request_id,
                 CASE c_custkey % 3 WHEN 0 THEN 'movie' WHEN 1 THEN 'book' ELSE 'music' END AS media_type,
                 CASE WHEN c_custkey % 20 = 0 THEN '  ' WHEN c_custkey % 20 = 1 THEN '#' || (c_custkey % 7)
                   ELSE lower(substr(p_name, 1 + c_custkey % 4, 2 + c_custkey % 5)) END AS typed
          FROM customer JOIN part ON p_partkey = (c_custkey * 7) % (SELECT count(*) FROM part)),
        matches AS (
          SELECT request_id, title, min(item_id) AS first_id FROM asked JOIN titled USING (media_type)
          WHERE trim(typed) <> '' AND (contains(lower(title), trim(typed)) OR contains(lower(original_title), trim(typed)))
          GROUP BY request_id, title)
        SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY first_id) AS rank, title
        FROM matches QUALIFY rank <= 5""",
)
def suggest_titles(spark, folder):
    """Pieces of titles, in capitals and with spaces around, as customers type them."""
    parts = table(spark, folder, "part").select("p_partkey", "p_name")
    k = F.col("c_custkey")
    piece = F.substr("p_name", (1 + k % 4).cast("int"), (2 + k % 5).cast("int"))
    typed = F.when(k % 20 == 0, "  ").when(k % 20 == 1, F.concat(F.lit("#"), (k % 7).cast("string"))).otherwise(
        F.concat(F.lit(" "), F.upper(piece), F.lit(" "))
    )
    asked = (
        table(spark, folder, "customer")
        .join(parts, F.pmod(k * 7, F.lit(parts.count())) == F.col("p_partkey"))
        .select(k.alias("request_id"), bind.medium("c_custkey").alias("media_type"), typed.alias("query"))
    )
    return suggest(asked, bind.titled_items(spark, folder), ["title", "original_title"])


PATTERNS = ("^{0}", "{0}.*{1}$", "{0} ?.{2}", "[{0}]+ {1}", "{0}|{1}", "{0} (", r"{0}\s\w*{2}")


@query(
    "suggest_patterns",
    f"""WITH {bind.LOOKUP},
        words AS (
          SELECT c_custkey AS request_id, lower(split_part(p_name, ' ', 1)) AS w0, lower(split_part(p_name, ' ', 2)) AS w1,
                 CASE c_custkey % 3 WHEN 0 THEN 'movie' WHEN 1 THEN 'book' ELSE 'music' END AS media_type
          FROM customer JOIN part ON p_partkey = (c_custkey * 7) % (SELECT count(*) FROM part)),
        asked AS (
          SELECT request_id, media_type, CASE request_id % 7 WHEN 0 THEN '^' || w0 WHEN 1 THEN w0 || '.*' || w1 || '$'
            WHEN 2 THEN w0 || ' ?.' || substr(w1, 2) WHEN 3 THEN '[' || w0 || ']+ ' || w1 WHEN 4 THEN w0 || '|' || w1
            WHEN 6 THEN w0 || '\\s\\w*' || substr(w1, 2) END AS pattern
          FROM words),
        matches AS (
          SELECT request_id, title, min(item_id) AS first_id
          FROM (SELECT DISTINCT media_type, pattern FROM asked WHERE pattern IS NOT NULL) p
          JOIN titled t ON t.media_type = p.media_type
            AND (regexp_matches(lower(title), pattern) OR regexp_matches(lower(original_title), pattern))
          JOIN asked a ON a.media_type = p.media_type AND a.pattern = p.pattern
          GROUP BY request_id, title)
        SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY first_id) AS rank, title
        FROM matches QUALIFY rank <= 5""",
)
def suggest_patterns(spark, folder):
    """Patterns of words of titles; some need no trigram, some are no pattern."""
    parts = table(spark, folder, "part").select("p_partkey", "p_name")
    k, words = F.col("c_custkey"), F.split(F.lower("p_name"), " ")
    said = {"{0}": words[0], "{1}": words[1], "{2}": F.substr(words[1], F.lit(2))}
    typed = F.lit(None).cast("string")
    for i, pattern in enumerate(PATTERNS):
        text = F.lit(pattern)
        for mark, value in said.items():
            text = F.replace(text, F.lit(mark), value)
        typed = F.when(k % len(PATTERNS) == i, text).otherwise(typed)
    asked = (
        table(spark, folder, "customer")
        .join(parts, F.pmod(k * 7, F.lit(parts.count())) == F.col("p_partkey"))
        .select(k.alias("request_id"), bind.medium("c_custkey").alias("media_type"), typed.alias("query"))
    )
    return suggest(asked, bind.titled_items(spark, folder), ["title", "original_title"], regex=True)


@query(
    "fuzzy_titles",
    f"""WITH {bind.LOOKUP},
        asked AS (
          SELECT c_custkey AS request_id,
                 CASE c_custkey % 3 WHEN 0 THEN 'movie' WHEN 1 THEN 'book' ELSE 'music' END AS media_type,
                 CASE c_custkey % 6 WHEN 0 THEN title WHEN 1 THEN substr(title, 2)
                   WHEN 2 THEN substr(title, 1, 4) || '##' || substr(title, 5) WHEN 3 THEN substr(title, 1, length(title) - 2)
                   WHEN 4 THEN substr(title, 1, 3) || 'x' || substr(title, 5, length(title) - 5) ELSE '###' || title END AS typed
          FROM customer JOIN (
            SELECT p_partkey, lower(CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand || ' ' || p_type END) AS title FROM part) p
            ON p_partkey = (c_custkey * 7) % (SELECT count(*) FROM part)),
        missing AS (
          SELECT DISTINCT media_type, trim(typed) AS typed_key FROM asked
          WHERE trim(typed) <> '' AND NOT EXISTS (
            SELECT * FROM lookup l WHERE l.media_type = asked.media_type AND title_key = trim(typed))),
        near AS (
          SELECT m.media_type, typed_key, title_key, item_id, levenshtein(typed_key, title_key) AS distance
          FROM missing m JOIN lookup l ON l.media_type = m.media_type WHERE levenshtein(typed_key, title_key) <= 2),
        best AS (
          SELECT *, row_number() OVER (PARTITION BY media_type, typed_key ORDER BY distance, title_key) AS rank FROM near
          QUALIFY rank <= 3)
        SELECT request_id, media_type, rank, title_key, item_id, distance
        FROM asked JOIN best USING (media_type) WHERE trim(typed) = typed_key""",
)
def fuzzy_titles(spark, folder):
    """Titles with letters left out, put in or replaced; some right, some too far off."""
    k, p = F.col("c_custkey"), F.col("p_partkey")
    other = F.concat_ws(" ", "p_brand", "p_type")
    parts = table(spark, folder, "part").select(p, F.when(p % 2 == 0, F.col("p_name")).otherwise(other).alias("t"))
    size = F.length("t")
    cut = lambda first, count=None: F.substr("t", F.lit(first), F.lit(1000) if count is None else count)
    typed = (
        F.when(k % 6 == 0, F.col("t"))
        .when(k % 6 == 1, cut(2))
        .when(k % 6 == 2, F.concat(cut(1, F.lit(4)), F.lit("##"), cut(5)))
        .when(k % 6 == 3, cut(1, size - 2))
        .when(k % 6 == 4, F.concat(cut(1, F.lit(3)), F.lit("x"), cut(5, size - 5)))
        .otherwise(F.concat(F.lit("###"), "t"))
    )
    asked = (
        table(spark, folder, "customer")
        .join(parts, F.pmod(k * 7, F.lit(parts.count())) == p)
        .select(k.alias("request_id"), bind.medium("c_custkey").alias("media_type"), F.upper(typed).alias("title"))
    )
    return nearest(asked, bind.lookup(spark, folder))


# --- search -------------------------------------------------------------------------------------
@query(
    "cosine_topk",
    f"""WITH {bind.TARGETS},
        scored AS (
          SELECT q.vec_id AS request_id, item_id,
                 round(list_dot_product(CAST(q.embedding AS DOUBLE[]), t.embedding) / t.length
                   / sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))), 6) + 0.0 AS score
          FROM embeddings q, targets t)
        SELECT request_id, item_id, score, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, item_id) AS rank
        FROM scored QUALIFY rank <= 10""",
)
def cosine_topk(spark, folder):
    asked = table(spark, folder, "embeddings").select(F.col("vec_id").alias("request_id"), F.col("embedding").alias("vector"))
    return similarity.cosine_topk(asked, bind.target_vectors(spark, folder), 10)


BATCH = f"""WITH {bind.VECTORS}, {bind.TARGETS},
        scored AS (
          SELECT v.item_id AS request_id, t.item_id,
                 round(list_dot_product(v.embedding, t.embedding) / t.length
                   / sqrt(list_dot_product(v.embedding, v.embedding)), 6) + 0.0 AS score
          FROM vectors v, targets t)
        SELECT request_id, item_id, score, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, item_id) AS rank
        FROM scored QUALIFY rank <= 5"""


@query("recommend_batch", BATCH)
def recommend_batch(spark, folder):
    return recommend.recommend_all(bind.vectors(spark, folder), bind.target_vectors(spark, folder))


@query("recommend_to_requests", BATCH)
def recommend_to_requests(spark, folder):
    """The same as when the targets are too many to broadcast, but the requests are not."""
    return recommend.recommend_all(bind.vectors(spark, folder), bind.target_vectors(spark, folder), target_floats=0)


@query("recommend_blocks", BATCH)
def recommend_blocks(spark, folder):
    """The same as when neither side may be broadcast: block against block."""
    return recommend.recommend_all(
        bind.vectors(spark, folder), bind.target_vectors(spark, folder), target_floats=0, request_floats=0, block_rows=4096
    )


@query(
    "fuse_vectors",
    f"WITH {bind.FUSED} SELECT request_id, CAST(pos - 1 AS BIGINT) AS pos, round(x, 6) + 0.0 AS x FROM elements",
)
def fuse_vectors(spark, folder):
    valid = recommend.complete(bind.requests(spark, folder)).where(recommend.all_filled())
    resolved = recommend.resolve_requests(valid, bind.lookup(spark, folder))
    fused = fusion.fuse_vectors(fusion.media_parts(resolved, "request_id"), bind.vectors(spark, folder), "request_id")
    return fused.select("request_id", F.posexplode("vector").alias("pos", "x")).withColumn("x", F.round("x", 6) + F.lit(0.0))


@query(
    "recommend_fused",
    f"WITH {bind.RECOMMENDED} SELECT request_id, rank, item_id, score, name, country, population FROM recommended",
)
def recommend_fused(spark, folder):
    goal = bind.targets(spark, folder)
    results = recommend.recommend_fused(
        bind.requests(spark, folder),
        bind.lookup(spark, folder),
        bind.vectors(spark, folder),
        bind.target_vectors(spark, folder),
    )
    named = recommend.with_metadata(results, goal)
    return named.select("request_id", "rank", "item_id", "score", "name", "country", "population")


def message(medium: str) -> str:
    return f"""CASE WHEN filled THEN CASE WHEN {medium}_item IS NULL THEN '❌ Not found: ' ELSE '✅ Found: ' END
      || {medium}_title END AS {medium}_status"""


@query(
    "recommend_status",
    f"""WITH {bind.RESOLVED}
        SELECT request_id, {message('movie')}, {message('book')}, {message('music')},
          CASE WHEN NOT filled THEN 'blank title'
            WHEN movie_item IS NULL AND book_item IS NULL AND music_item IS NULL THEN 'nothing found'
            WHEN CASE WHEN movie_item IS NULL THEN 0 ELSE movie_weight END + CASE WHEN book_item IS NULL THEN 0 ELSE book_weight END
               + CASE WHEN music_item IS NULL THEN 0 ELSE music_weight END = 0 THEN 'invalid weights'
            ELSE 'ok' END AS outcome
        FROM resolved""",
)
def recommend_status(spark, folder):
    return recommend.request_status(bind.requests(spark, folder), bind.lookup(spark, folder))


@query(
    "recommend_single",
    f"""WITH {bind.LOOKUP}, {bind.VECTORS}, {bind.TARGETS},
        asked AS (
          SELECT p_partkey AS request_id, {bind.MEDIUM} AS media_type,
                 CASE WHEN p_partkey % 5 = 0 THEN 'unknown ' || p_partkey WHEN p_partkey % 5 = 1 THEN upper(p_name) ELSE p_name END AS title
          FROM part),
        found AS (
          SELECT request_id, l.item_id AS query_item, embedding FROM asked a
          JOIN lookup l ON l.media_type = a.media_type AND title_key = lower(trim(title))
          JOIN vectors v ON v.media_type = l.media_type AND v.item_id = l.item_id),
        scored AS (
          SELECT request_id, t.item_id, round(list_dot_product(f.embedding, t.embedding) / t.length
                   / sqrt(list_dot_product(f.embedding, f.embedding)), 6) + 0.0 AS score
          FROM found f, targets t)
        SELECT request_id, item_id, score, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, item_id) AS rank
        FROM scored QUALIFY rank <= 3""",
)
def recommend_single(spark, folder):
    k = F.col("p_partkey")
    title = (
        F.when(k % 5 == 0, F.concat(F.lit("unknown "), k.cast("string")))
        .when(k % 5 == 1, F.concat(F.lit(" "), F.upper("p_name")))
        .otherwise(F.col("p_name"))
    )
    asked = table(spark, folder, "part").select(
        k.alias("request_id"), bind.medium("p_partkey").alias("media_type"), title.alias("title"), F.lit(3).alias("top_k")
    )
    return recommend.recommend_single(
        asked, bind.lookup(spark, folder), bind.vectors(spark, folder), bind.target_vectors(spark, folder)
    )


@query(
    "result_cards",
    f"""WITH {bind.RECOMMENDED},
        summaries AS (SELECT s_name AS name, text FROM supplier JOIN documents ON doc_id = s_suppkey * 3)
        SELECT request_id, rank,
          CASE rank WHEN 1 THEN '🏆' WHEN 2 THEN '🥈' WHEN 3 THEN '🥉' ELSE '' END || ' ' || rank || '. ' || name || ', ' || country AS heading,
          'Match: ' || printf('%.4f', score) AS match, {BADGE} AS population_text,
          CASE WHEN length(text) > 300 THEN substr(text, 1, 297) || '...' WHEN length(text) > 50 THEN text END AS excerpt,
          'https://picsum.photos/seed/'
            || CAST(list_sum(list_transform(string_split(name, ''), lambda ch: ord(ch))) % 1000 AS BIGINT) || '/800/280' AS image,
          {WIKI.format(name='name')} AS wiki_link, {MAPS.format(name='name', country='country')} AS maps_link
        FROM recommended LEFT JOIN summaries USING (name)""",
)
def result_cards(spark, folder):
    goal = bind.targets(spark, folder)
    results = recommend.recommend_fused(
        bind.requests(spark, folder),
        bind.lookup(spark, folder),
        bind.vectors(spark, folder),
        bind.target_vectors(spark, folder),
    )
    documents = table(spark, folder, "documents")
    summaries = (
        table(spark, folder, "supplier")
        .join(documents, F.col("s_suppkey") * 3 == F.col("doc_id"))
        .select(F.col("s_name").alias("name"), "text")
    )
    return recommend.result_cards(recommend.with_metadata(results, goal), summaries)
