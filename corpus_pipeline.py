"""From raw documents to packed training sequences.

Each stage takes the documents that its predecessor kept and returns documents with the same
columns; the last one returns the pieces of the sequences.

In every stage a null text counts as empty, rows with a null doc_id are documents of their own, and
rows that repeat a doc_id are kept or dropped together where a stage decides by doc_id (near
duplicates). Empty and very long texts are documents like others. Further columns are handed on
whatever their names, and an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triptych.llm import line_dedup, minhash, mixing, packing, quality
from triptych.llm.text import table
from triptych.staging import staged

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifiers accept: of good quality and not toxic."""
    models = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select(F.struct("*").alias("doc"), quality.score(docs, models).alias("scores"))
    return scored.where(quality.accepted(F.col("scores"))).select("doc.*")


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the chunks of lines that occur before; n_chars is that of the new text."""
    return line_dedup.line_dedup(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates."""
    dropped = staged(minhash.minhash_dedup(docs).where("not kept").select("doc_id"), "pipeline-dropped")
    return docs.join(dropped.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def mixed_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose expected tokens have the target shares of source, language and topic."""
    return mixing.mix_sources(docs).where("kept").select("doc.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences that hold all tokens of all documents."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("quality", good_documents),
    ("line_dedup", without_repeated_passages),
    ("near_duplicates", one_of_each_group),
    ("mixing", mixed_to_targets),
    ("packing", packed),
]

# Trained weights, hashes of lines and tokens are beyond SQL; tests/llm/test_pipeline.py checks each
# stage on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of `sf_dir`, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
