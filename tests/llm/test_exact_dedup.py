import hashlib

import pytest

from triptych.llm.exact_dedup import exact_dedup, extendible_index

SCHEMA = "doc_id bigint, text string, key string, bucket int"


def expected(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        norm = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        groups.setdefault(norm, []).append(doc_id)
    out = []
    for norm, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(norm.encode()).hexdigest()
        out += [(i, keep, len(ids), i == keep, digest) for i in ids]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


ROWS = [
    (1, "Same Text", "x", 0),
    (2, "same text", None, 1),
    (3, "same text ", "x", 1),
    (4, None, "x", 1),
    (5, "", "x", 1),
    (6, "ÄB", "x", 1),
    (7, "äb", "x", 1),
    (8, "z" * 200_000, "x", 1),
    (9, "Z" * 200_000, "x", 1),
    (10, "twice", "x", 1),
    (10, "twice", "x", 1),
    (None, "no key", "x", 1),
    (None, "NO KEY", "x", 1),
    (None, "alone", "x", 1),
]


@pytest.mark.parametrize("bits", [64, 1])
def test_edge_rows_and_chains(spark, bits):
    """With keys of one bit all texts fall into two chains and are told apart by their bytes."""
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert got(exact_dedup(df, key_bits=bits)) == expected(ROWS)


def test_empty_table(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_hot_group(spark):
    rows = [(i, "hot" if i % 3 else f"text {i % 50}", None, None) for i in range(600)]
    assert got(exact_dedup(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_directory_doubles(spark):
    df = spark.range(3000).selectExpr("xxhash64(id) key", "id doc_id")
    index = extendible_index(df, bucket_keys=100, directory_bits=10)
    held = {r.bucket: (r.depth, r.n) for r in index.groupBy("bucket").agg({"depth": "max", "key": "count"}).toDF("bucket", "depth", "n").collect()}
    assert sum(n for _, n in held.values()) == 3000
    assert max(n for _, n in held.values()) <= 100
    assert min(depth for depth, _ in held.values()) >= 4
    for first, (depth, _) in held.items():
        assert first % (1 << (10 - depth)) == 0
