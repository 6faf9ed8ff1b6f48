import random
import re

import numpy as np
import pytest

from triptych.llm import hashing
from triptych.llm.components import components
from triptych.llm.minhash import minhash_dedup

SCHEMA = "doc_id bigint, text string, class string, node int"


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def expected(rows):
    ids = {r[0] for r in rows if r[0] is not None}
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    sets = [(r[0], shingles(r[1])) for r in rows if r[0] is not None]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    out = []
    for i, text, *_ in rows:
        component = None if i is None else top(i)
        out.append((i, len(shingles(text)), component, i == component))
    return sorted(out, key=str)


def check(spark, rows):
    got = minhash_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows)


def test_against_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for group in range(25):
        words = rng.choices(vocabulary, k=rng.randint(3, 120))
        for _ in range(rng.choice([1, 2, 8])):
            copy = [w if rng.random() > rng.choice([0, 0.02, 0.04, 0.06]) else "X" + w for w in words]
            rows.append((len(rows), " ".join(copy), "", 1))
    check(spark, rows)


def test_edge_rows(spark):
    long = "word after word " * 60_000
    check(
        spark,
        [
            (9, None, None, None),
            (8, "", "", 1),
            (7, " \t\n ", "", 1),
            (6, "One two", "", 1),
            (5, "one\ttwo ", "", 1),
            (4, "one two three four five", "", 1),
            (4, "one two three four five", "", 1),
            (3, "ONE two three four five", "", 1),
            (12, "a b c d e f", "", 1),
            (12, "q r s t u v", "", 1),
            (13, "Q R S T U V", "", 1),
            (11, "a b c d e f", "", 1),
            (None, "a b c d e f", "", 1),
            (20, long + "end", "", 1),
            (21, long + "fin", "", 1),
            (22, "x" * 600_000 + " a b c d", "", 1),
            (23, "X" * 600_000 + " a b c d", "", 1),
            (24, "É b c d e", "", 1),
            (25, "é b c d e", "", 1),
        ],
    )


def test_empty_table(spark):
    assert minhash_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_chain_whose_ends_are_apart(spark):
    """Each text is close to the next only: the link of the last two is found in the second round."""
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[6 * i : 6 * i + 80]), "", 0) for i in range(12)]
    check(spark, rows)


@pytest.mark.parametrize("text", ["one two  three", "a" * 700_000, ("word " * 200_000), "b " * 3 + "c" * 600_000 + " d e"])
def test_blocks_hash_like_one(text):
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    words, _ = hashing.word_hashes(data, np.array([0, len(data)]))
    single = [
        hashing.word_hashes(np.frombuffer(w.encode(), dtype=np.uint8), np.array([0, len(w)]))[0][0] for w in set(text.split())
    ]
    assert len(words) == len(text.split())
    assert set(words.tolist()) == {int(x) for x in single}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 300), (7, 7), (300, 150)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 1 for i in range(2, 61)}, 150: 100, 200: 100, 300: 100}
