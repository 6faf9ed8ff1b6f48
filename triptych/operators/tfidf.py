"""TF-IDF keywords, and texts emphasised with their own keywords.

Documents are dealt out evenly, and their words are written once to count them. No step moves all
word pairs between machines: counts of words are combined before the shuffle, pairs are counted only
where both words are frequent enough, and terms are weighed within the row of their document, where
they meet the vocabulary, whose size is bounded, as constants.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triptych.functions.text import STOP_WORDS, bigrams, tokens
from triptych.staging import staged

# Size of the vocabulary, least document frequency, words appended per text.
MAX_TERMS = 1000
MIN_DOCUMENTS = 2
KEYWORDS = 10

# Frequent words are broadcast up to this many, beyond it they are joined with a shuffle.
BROADCAST_WORDS = 500_000
# Parts of the vocabulary, one of which is looked through for a term.
PARTS = 64


def dealt(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The same documents, spread evenly: those of one large file would be the work of one task."""
    return docs.repartition(F.xxhash64(key, text))


def tokenised(docs: DataFrame, key: str, text: str, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """The words `w` of every document, written once, by as many tasks as the texts are worth."""
    even = dealt(docs.select(key, text), key, text)
    return staged(even.select(key, tokens(F.col(text), stop_words).alias("w")), "words")


def document_terms(words: DataFrame, key: str, pairs: bool = True) -> DataFrame:
    """One row per occurrence of a term: words and, by default, pairs of neighbours."""
    terms = F.concat("w", bigrams(F.col("w"))) if pairs else F.col("w")
    return words.select(key, F.explode(terms).alias("term"))


def term_counts(words: DataFrame, key: str, pairs: bool = True) -> DataFrame:
    """Occurrences of each term in each document.

    Rows are dealt by their document before terms are made, so words are moved once and terms never.
    """
    return document_terms(words.repartition(key), key, pairs).groupBy(key, "term").agg(F.count("*").alias("tf"))


def _exploded(words: DataFrame, terms: Column) -> DataFrame:
    """Each occurrence of a term, then each term once per document, told apart by two counters."""
    found = words.select(terms.alias("t"))
    both = found.select(
        F.size("t").alias("n"), F.posexplode(F.concat("t", F.array_distinct("t"))).alias("at", "term")
    )
    once = F.col("at") >= F.col("n")
    return both.select("term", once.cast("int").alias("df"), (~once).cast("int").alias("total"))


def _summed(exploded: DataFrame, min_documents: int) -> DataFrame:
    """Document frequency and total of every term, combined before the shuffle."""
    sums = exploded.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    return sums.where(F.col("df") >= min_documents)


def _most_frequent(terms: DataFrame, most: int) -> DataFrame:
    return terms.orderBy(F.desc("total"), "term").limit(most)


def vocabulary(
    words: DataFrame, max_terms: int = MAX_TERMS, min_documents: int = MIN_DOCUMENTS, pairs: bool = True
) -> DataFrame:
    """Most frequent terms among those found in enough documents, with both counts.

    A pair is at most as frequent as either of its words. So once single words have filled the
    vocabulary, only pairs of words as frequent as its last entry can enter it; all other pairs are
    dropped where they are read, which leaves the result as it is.
    """
    single = staged(_summed(_exploded(words, F.col("w")), min_documents), "word-counts")
    if not pairs:
        return _most_frequent(single, max_terms)
    last = _most_frequent(single, max_terms).agg(F.count("*").alias("n"), F.min("total").alias("total")).first()
    least = last.total if last.n == max_terms else min_documents
    frequent = single.where(F.col("total") >= least).select("term")
    if frequent.count() <= BROADCAST_WORDS:
        frequent = F.broadcast(frequent)
    candidates = _exploded(words, bigrams(F.col("w")))
    for place in (1, -1):
        word = F.substring_index("term", " ", place)
        named = frequent.withColumnRenamed("term", "_word")
        candidates = candidates.join(named, word == F.col("_word"), "left_semi")
    return _most_frequent(single.unionByName(_summed(candidates, min_documents)), max_terms)


class Weights(NamedTuple):
    """Vocabulary terms in parts by their hash, each with ln((1 + documents) / (1 + df)) + 1."""

    parts: list[list[tuple[str, float]]]

    def of(self, term: Column) -> Column:
        """The factor of a term, NULL if the vocabulary lacks it. One part is looked through."""
        maps = [
            F.map_from_arrays(F.split(F.lit("|".join(t for t, _ in part)), "[|]"), F.array(*[F.lit(x) for _, x in part]))
            if part
            else F.create_map().cast("map<string,double>")
            for part in self.parts
        ]
        place = F.pmod(F.xxhash64(term), F.lit(len(maps))).cast("int")
        return F.try_element_at(F.get(F.array(*maps), place), term)


def weights(
    words: DataFrame, max_terms: int = MAX_TERMS, min_documents: int = MIN_DOCUMENTS, pairs: bool = True
) -> Weights:
    """The factors of the vocabulary of a table of words; at most `max_terms` rows reach the driver."""
    documents = words.agg(F.count("*")).scalar()
    factor = F.log((1 + documents) / (1 + F.col("df"))) + 1
    place = F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int")
    parts: list[list[tuple[str, float]]] = [[] for _ in range(PARTS)]
    for r in vocabulary(words, max_terms, min_documents, pairs).select("term", factor.alias("idf"), place.alias("part")).collect():
        parts[r.part].append((r.term, r.idf))
    return Weights(parts)


def weighed(df: DataFrame, words: str, factors: Weights, out: str, pairs: bool = True) -> DataFrame:
    """`df` with `out`: term, tf and weight (tf times its factor) of the document's vocabulary terms, by term."""
    terms = F.concat(words, bigrams(F.col(words))) if pairs else F.col(words)
    found = F.transform(terms, lambda t: F.struct(t.alias("term"), factors.of(t).alias("idf")))
    # Equal terms stand next to each other; a run of them begins where the term before is another.
    known = df.withColumn("_known", F.array_sort(F.filter(found, lambda t: t["idf"].isNotNull())))
    at = F.when(F.size("_known") > 0, F.sequence(F.lit(0), F.size("_known") - 1)).otherwise(F.array().cast("array<int>"))
    term = lambda i: F.get("_known", i)["term"]
    runs = known.withColumn("_first", F.filter(at, lambda i: (i == 0) | (term(i) != term(i - 1))))
    after = F.concat(F.slice("_first", F.lit(2), F.greatest(F.size("_first") - 1, F.lit(0))), F.array(F.size("_known")))
    counted = F.zip_with(
        F.col("_first"),
        F.when(F.size("_first") > 0, after).otherwise(F.array().cast("array<int>")),
        lambda first, end: F.struct(
            term(first).alias("term"), (end - first).cast("bigint").alias("tf"), ((end - first) * F.get("_known", first)["idf"]).alias("weight")
        ),
    )
    return runs.withColumn(out, counted).drop("_known", "_first")


def best_terms(terms: str, top: int) -> Column:
    """The `top` terms of highest weight, ties by term, with their weights."""
    ordered = F.transform(terms, lambda t: F.struct((-F.round(t["weight"], 6)).alias("by"), t["term"].alias("term"), t["tf"].alias("tf"), t["weight"].alias("weight")))
    return F.slice(F.array_sort(ordered), 1, top)


def tfidf_scores(docs: DataFrame, key: str, text: str, stop_words: Sequence[str] = STOP_WORDS, **settings) -> DataFrame:
    """Weights divided by the length of the document's weight vector."""
    words = tokenised(docs, key, text, stop_words)
    found = weighed(words, "w", weights(words, **settings), "_terms", settings.get("pairs", True))
    length = F.sqrt(F.aggregate("_terms", F.lit(0.0), lambda total, t: total + t["weight"] * t["weight"]))
    # Named twice, so that the optimizer does not put the whole sum in the place of each name.
    share = lambda t: F.when(F.col("_length") > 0, t["weight"] / F.col("_length"))
    scored = found.withColumn("_length", length).withColumn(
        "_terms", F.transform("_terms", lambda t: F.struct(t["term"].alias("term"), t["tf"].alias("tf"), share(t).alias("score")))
    )
    return _exploded_terms(scored.select(key, F.posexplode_outer("_terms").alias("at", "t"))).select(key, "t.term", "t.tf", "t.score")


def _exploded_terms(rows: DataFrame) -> DataFrame:
    """Rows of terms without those of documents that have none.

    An inner explode would be preceded by a filter that holds all of the weighing once more.
    """
    return rows.where(F.col("at").isNotNull())


def keywords(
    docs: DataFrame,
    key: str,
    text: str,
    top: int = KEYWORDS,
    stop_words: Sequence[str] = STOP_WORDS,
    **settings,
) -> DataFrame:
    """Highest terms of every document. Dividing by the length would not change their order."""
    words = tokenised(docs, key, text, stop_words)
    found = weighed(words, "w", weights(words, **settings), "_terms", settings.get("pairs", True))
    best = found.select(key, F.posexplode_outer(best_terms("_terms", top)).alias("at", "t"))
    return _exploded_terms(best).select(key, "t.term", "t.tf", "t.weight", (F.col("at") + 1).alias("rank"))


def emphasised(
    docs: DataFrame,
    key: str,
    text: str,
    out: str = "text_representation",
    top: int = KEYWORDS,
    stop_words: Sequence[str] = STOP_WORDS,
    **settings,
) -> DataFrame:
    """Every text followed by a space and its keywords; without keywords only the space is added.

    When no term at all is frequent enough, the texts stay as they are. The texts are written beside
    their words instead of being joined with them.
    """
    kept = staged(dealt(docs, key, text).withColumn("_w", tokens(F.col(text), stop_words)), "texts")
    factors = weights(kept.select(key, F.col("_w").alias("w")), **settings)
    if not any(factors.parts):
        return docs.withColumn(out, F.col(text))
    found = weighed(kept, "_w", factors, "_terms", settings.get("pairs", True))
    words = F.array_join(F.transform(best_terms("_terms", top), lambda t: t["term"]), " ")
    return found.withColumn(out, F.concat(F.col(text), F.lit(" "), F.coalesce(words, F.lit("")))).drop("_w", "_terms")
