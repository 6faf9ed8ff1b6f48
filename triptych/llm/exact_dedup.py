"""Exact deduplication over an extendible-hash index on shared files.

The keys of the index are 64-bit hashes of the normalised texts. A directory maps the leading bits
of a key to a bucket; while a bucket holds more keys than it may, the directory is doubled and the
bucket split. The index is written in key order, so that each file has the keys of the buckets that
one owner task processed. Texts with equal keys are chained: every text is compared byte by byte
with the head of its chain, and those that differ form the next chain until none is left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triptych.llm.text import lower_ascii, whole
from triptych.staging import drop_staged, new_path, staged

# Bits that the directory may look at: at most 65,536 entries, however large the index gets.
DIRECTORY_BITS = 16
BUCKET_KEYS = 65_536
KEY_BITS = 64


def exact_dedup(
    documents: DataFrame,
    bucket_keys: int = BUCKET_KEYS,
    directory_bits: int = DIRECTORY_BITS,
    key_bits: int = KEY_BITS,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, bucket.

    Texts are equal when their bytes are, after lower-casing A-Z; the row with the largest doc_id
    stays. `key_bits` shortens the keys, so that tests can make chains of different texts.

    A null text is an empty one; empty texts are equal to each other. A null doc_id is smaller than
    any other; rows whose doc_id is that of the row that stays are all marked as kept, so repeated
    rows are not told apart. Other columns are not read. An empty table gives an empty result.
    """
    texts = documents.select("doc_id", lower_ascii(whole("text")).alias("norm")).withColumn("key", _key(key_bits))
    entries = staged(texts.select("doc_id", "key", F.sha2("norm", 256).alias("text_sha256")), "dedup-entries")
    index = extendible_index(entries.select("key", "doc_id"), bucket_keys, directory_bits)
    chained = index.where("rows > 1").select("key", "bucket", "head")
    pending = staged(texts.join(chained, "key"), "dedup-chain")
    settled = []
    while True:
        compared = staged(_compare_with_heads(pending, len(settled)), "dedup-compared")
        settled.append(compared.where("same").drop("norm", "same"))
        rest = compared.where("not same").select("doc_id", "norm", "key", "bucket")
        drop_staged(pending)
        if rest.isEmpty():
            break
        heads = rest.groupBy("key").agg(F.max("doc_id").alias("head"))
        pending = staged(rest.join(heads, "key"), "dedup-chain")
    copies = reduce(DataFrame.unionByName, settled)
    sizes = staged(copies.groupBy("key", "link").agg(F.count("*").alias("group_size")), "dedup-sizes")
    single = entries.join(index.where("rows = 1").select("key", "bucket"), "key").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), "text_sha256", "bucket"
    )
    grouped = copies.join(sizes, ["key", "link"]).select(
        "doc_id", F.col("head").alias("keep_id"), "group_size", "text_sha256", "bucket"
    )
    return single.unionByName(grouped).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
        "bucket",
    )


def extendible_index(entries: DataFrame, bucket_keys: int, directory_bits: int) -> DataFrame:
    """The written index of (key, doc_id): key, rows, head (the largest doc_id), bucket, depth.

    Entries of a key are counted before they are shuffled, so a key with most of the rows is one
    entry of the index.
    """
    spark = entries.sparkSession
    keys = staged(entries.groupBy("key").agg(F.count("*").alias("rows"), F.max("doc_id").alias("head")), "dedup-keys")
    directory = _directory(keys, bucket_keys, directory_bits)
    # At most 2 ** directory_bits rows of three numbers.
    placed = keys.withColumn("slot", _slot(directory_bits)).join(F.broadcast(directory), "slot").drop("slot")
    path = new_path(spark, "dedup-index")
    placed.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key").write.parquet(path)
    return spark.read.schema(placed.schema).parquet(path)


def _key(bits: int) -> Column:
    return F.xxhash64("norm") if bits == 64 else F.shiftleft(F.xxhash64("norm"), 64 - bits)


def _slot(bits: int) -> Column:
    return F.shiftrightunsigned("key", 64 - bits)


def _directory(keys: DataFrame, bucket_keys: int, bits: int) -> DataFrame:
    """slot, bucket, depth: a bucket is named by its first slot and owns 2 ** (bits - depth) slots."""
    slots = keys.groupBy(_slot(bits).alias("slot")).agg(F.count("*").alias("keys"))
    state = staged(
        slots.select("slot", "keys", F.lit(0).cast("bigint").alias("bucket"), F.lit(0).alias("depth")), "dedup-directory"
    )
    for depth in range(1, bits + 1):
        held = state.groupBy("bucket").agg(F.sum("keys").alias("held"))
        overfull = held.where(F.col("held") > bucket_keys).select("bucket", F.lit(True).alias("split"))
        if overfull.isEmpty():
            break
        # Doubling: buckets that are overfull look at one more bit, the others stay as they are.
        width = 1 << (bits - depth)
        split = F.col("split")
        doubled = state.join(F.broadcast(overfull), "bucket", "left").select(
            "slot",
            "keys",
            F.when(split, F.col("slot") - F.pmod("slot", F.lit(width))).otherwise(F.col("bucket")).alias("bucket"),
            F.when(split, F.lit(depth)).otherwise(F.col("depth")).alias("depth"),
        )
        state = staged(doubled, "dedup-directory")
    return state.select("slot", "bucket", "depth")


def _compare_with_heads(pending: DataFrame, link: int) -> DataFrame:
    """Every text beside the head of its chain; texts that differ keep their bytes for the next."""
    heads = staged(  # written, so that the join below can split a hot key
        pending.where(F.col("doc_id").eqNullSafe(F.col("head")))
        .groupBy("key")
        .agg(F.max("norm").alias("head_norm")),
        "dedup-heads",
    )
    same = F.col("norm") == F.col("head_norm")
    return pending.join(heads, "key").select(
        "doc_id",
        "key",
        "bucket",
        "head",
        F.lit(link).alias("link"),
        F.sha2("norm", 256).alias("text_sha256"),
        same.alias("same"),
        F.when(~same, F.col("norm")).alias("norm"),
    )


ORACLE = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
      FROM documents)
WINDOW same AS (PARTITION BY norm)"""
