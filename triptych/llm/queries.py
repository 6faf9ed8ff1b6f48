"""The corpus operators over whole tables with production parameters, and SQL with the same result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from triptych.llm import (
    embeddings,
    exact_dedup,
    licences,
    line_dedup,
    minhash,
    mixing,
    packing,
    quality,
    secrets,
    substring_dedup,
    vector_codes,
    warc,
    whitening,
)
from triptych.llm.text import table

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.minhash_dedup(table(spark, folder, "documents"))


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(table(spark, folder, "documents")).select(
        "doc.doc_id", "source", "lang", "topic", "tokens", F.round("probability", 6).alias("probability"), "kept"
    )


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), TOKENIZER)


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.line_report(table(spark, folder, "documents"), line_dedup.passage_removals)


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, folder, "documents")).drop("bucket")


def op6_substrings(spark: SparkSession, folder: str) -> DataFrame:
    cut = substring_dedup.substring_dedup(table(spark, folder, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    scored = quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.select("doc.doc_id", "p_content", "p_metadata", "p_quality", "p_toxic", "kept")


def op8_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.embedding_dedup(table(spark, folder, "embeddings"))


def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.span_digest(secrets.scan(table(spark, folder, "documents")))


def op10_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(table(spark, folder, "documents"))


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    whitened = whitening.whiten(table(spark, folder, "embeddings"))
    parts = F.arrays_zip("whitened", "explained")
    return whitened.select(
        "vec_id", "n", F.col("deviation").cast("bigint").alias("deviation"), "identity_error", F.posexplode(parts).alias("at", "part")
    ).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "part.whitened", "part.explained", "identity_error"
    )


def op12_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = warc.write_archives(table(spark, folder, "pages"))
    return warc.read_archives(archives, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    codes, codebooks = vector_codes.compress(table(spark, folder, "embeddings"), keep=("label",))
    digest = F.sha2(F.lit(vector_codes.codebook_text(codebooks)), 256)
    return vector_codes.with_label_error(codes, "label").select(
        "vec_id",
        F.lower(F.hex("code")).alias("code"),
        "error",
        F.col("label_error").cast("bigint").alias("label_error"),
        digest.alias("codebooks_sha256"),
    )


QUERIES: dict[str, Query] = {
    "op1_minhash": op1_minhash,
    "op2_mixing": op2_mixing,
    "op3_packing": op3_packing,
    "op4_line_dedup": op4_line_dedup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_substrings": op6_substrings,
    "op7_quality": op7_quality,
    "op8_embeddings": op8_embeddings,
    "op9_secrets": op9_secrets,
    "op10_licences": op10_licences,
    "op11_whitening": op11_whitening,
    "op12_warc": op12_warc,
    "op13_vector_codes": op13_vector_codes,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op2_mixing": mixing.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op8_embeddings": embeddings.ORACLE,
    "op9_secrets": secrets.ORACLE,
    "op12_warc": warc.ORACLE,
    "op13_vector_codes": vector_codes.ORACLE,
}
