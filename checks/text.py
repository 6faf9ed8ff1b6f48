"""Tokens, TF-IDF and vectors from texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.bind import table
from checks.registry import query
from triptych.functions.text import STOP_WORDS, tokens
from triptych.operators import tfidf
from triptych.operators.encode import embed_texts, hashing_encoder

# Written out again, so that a change of the library's values shows in the checks.
TOKEN = r"[\p{L}\p{N}_]{2,}"
STOPPED = (
    "a about above after again all am an and any are as at be because been before being below "
    "between both but by can could did do does doing down during each few for from further had "
    "has have having he her here hers him his how i if in into is it its itself just me more "
    "most my no nor not now of off on once only or other our ours out over own same she should "
    "so some such than that the their theirs them then there these they this those through to "
    "too under until up very was we were what when where which while who whom why will with "
    "would you your yours"
).split()
STOP_LIST = "[" + ", ".join(f"'{w}'" for w in STOPPED) + "]"


def words_sql(relation: str, key: str, text: str) -> str:
    """`words`: the words of every document in a list, stop words dropped."""
    return f"""
words AS (
  SELECT {key}, list_filter(regexp_extract_all(lower({text}), '{TOKEN}'),
                            lambda w: NOT list_contains({STOP_LIST}, w)) AS w
  FROM {relation})"""


def weights_sql(relation: str, key: str, text: str) -> str:
    """`term_weights`: tf * idf of the vocabulary terms of every document."""
    return (
        words_sql(relation, key, text)
        + f""",
terms AS (
  SELECT {key}, unnest(w) AS term FROM words
  UNION ALL
  SELECT {key}, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words),
counted AS (SELECT {key}, term, count(*) AS tf FROM terms GROUP BY {key}, term),
vocabulary AS (
  SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM counted GROUP BY term
  HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT 1000),
term_weights AS (
  SELECT {key}, term, tf, tf * (ln((1 + (SELECT count(*) FROM {relation})) / (1 + df)) + 1) AS weight
  FROM counted JOIN vocabulary USING (term))"""
    )


def emphasis_sql(relation: str, key: str, text: str) -> str:
    """`emphasised`: key and text_representation of every document of a relation."""
    return (
        weights_sql(relation, key, text)
        + f""",
best AS (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY round(weight, 6) DESC, term) AS rank
  FROM term_weights QUALIFY rank <= 10),
emphasised AS (
  SELECT {key}, any_value({text}) || ' ' || coalesce(string_agg(term, ' ' ORDER BY rank), '') AS text_representation
  FROM {relation} LEFT JOIN best USING ({key}) GROUP BY {key})"""
    )


def documents(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "text")


@query(
    "tokenise",
    f"""WITH {words_sql('documents', 'doc_id', 'text')}
        SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM words""",
)
def tokenise(spark, folder):
    words = documents(spark, folder).select("doc_id", tokens(F.col("text"), STOP_WORDS).alias("w"))
    return words.select("doc_id", F.posexplode("w").alias("pos", "word"))


@query(
    "ngrams",
    f"""WITH {weights_sql('documents', 'doc_id', 'text')} SELECT doc_id, term, tf FROM counted""",
)
def ngrams(spark, folder):
    words = documents(spark, folder).select("doc_id", tokens(F.col("text"), STOP_WORDS).alias("w"))
    return tfidf.term_counts(words, "doc_id")


@query("vocabulary", f"WITH {weights_sql('documents', 'doc_id', 'text')} SELECT term, df, total FROM vocabulary")
def vocabulary(spark, folder):
    return tfidf.vocabulary(tfidf.tokenised(documents(spark, folder), "doc_id", "text"))


@query(
    "tfidf_scores",
    f"""WITH {weights_sql('documents', 'doc_id', 'text')}
        SELECT doc_id, term, tf, round(weight / sqrt(sum(weight * weight) OVER (PARTITION BY doc_id)), 6) AS score
        FROM term_weights""",
)
def tfidf_scores(spark, folder):
    scores = tfidf.tfidf_scores(documents(spark, folder), "doc_id", "text")
    return scores.withColumn("score", F.round("score", 6))


@query(
    "tfidf_keywords",
    f"""WITH {emphasis_sql('documents', 'doc_id', 'text')}
        SELECT doc_id, term, tf, round(weight, 6) AS weight, rank FROM best""",
)
def tfidf_keywords(spark, folder):
    return tfidf.keywords(documents(spark, folder), "doc_id", "text").withColumn("weight", F.round("weight", 6))


@query(
    "tfidf_reweight",
    f"WITH {emphasis_sql('documents', 'doc_id', 'text')} SELECT doc_id, text_representation FROM emphasised",
)
def tfidf_reweight(spark, folder):
    return tfidf.emphasised(documents(spark, folder), "doc_id", "text").drop("text")


@query(
    "embed_hash",
    f"""WITH words AS (
          SELECT doc_id, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS word FROM documents),
        slots AS (
          SELECT doc_id, CAST(('0x' || substr(md5(word), 1, 8)) AS BIGINT) % 384 AS pos,
                 CASE WHEN CAST(('0x' || substr(md5(word), 9, 1)) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END AS sign
          FROM words),
        summed AS (SELECT doc_id, pos, CAST(sum(sign) AS DOUBLE) AS x FROM slots GROUP BY doc_id, pos)
        SELECT doc_id, pos, round(CAST(CAST(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS FLOAT) AS DOUBLE), 5) AS x
        FROM summed QUALIFY x <> 0""",
)
def embed_hash(spark, folder):
    vectors = embed_texts(documents(spark, folder), "doc_id", "text", hashing_encoder(384))
    elements = vectors.select("doc_id", F.posexplode("embedding").alias("pos", "x"))
    return elements.where("x <> 0").withColumn("x", F.round(F.col("x").cast("double"), 5))
