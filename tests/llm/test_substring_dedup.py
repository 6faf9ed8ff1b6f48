import random

import numpy as np
import pytest

from triptych.llm import substring_dedup as module
from triptych.llm.substring_dedup import substring_dedup
from triptych.llm.suffixes import BlindTrie, equal_strings

SCHEMA = "doc_id bigint, text string, unit int, kept string"


def expected(rows):
    first = {}
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    for doc_id, t in texts:
        if doc_id is not None:
            for i in range(len(t) - 49):
                s = t[i : i + 50]
                first[s] = min(first.get(s, doc_id), doc_id)
    out = []
    for doc_id, t in texts:
        gone = np.zeros(len(t) + 1, dtype=bool)
        if doc_id is not None:
            for i in range(len(t) - 49):
                if first[t[i : i + 50]] < doc_id:
                    gone[i : i + 50] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-1]])[:-1]).sum())
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((doc_id, len(t), int(gone.sum()), spans, kept))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in substring_dedup(df).collect()), key=str)
    assert got == expected(rows)


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:  # many units and ranges
        monkeypatch.setattr(module, "RANGE", 3000)
        monkeypatch.setattr(module, "UNIT", 2000)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abé ") for _ in range(rng.randint(1, 9)))
    passages = ["".join(word() for _ in range(30)) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p))
            parts += [word(), p[a : a + rng.randint(10, 120)]]
            if rng.random() < 0.3:
                k = rng.randint(0, max(len(parts[-1]) - 1, 0))
                parts[-1] = parts[-1][:k] + "X" + parts[-1][k + 1 :]
        rows.append((rng.randint(0, 150), "".join(parts), i, "x"))
    check(spark, rows)


def test_edge_rows(spark):
    text = "".join(chr(97 + (i * i) % 23) for i in range(120))
    rows = [
        (5, text, 1, None),
        (5, text, 1, None),
        (3, text[:49], 1, None),
        (4, text[10:60], None, "x"),
        (9, "intro " + text + text, 1, None),
        (None, text, 1, None),
        (6, None, 1, None),
        (7, "", 1, None),
        (8, "a" * 3000, 1, None),
        (10, "a" * 60 + "b", 1, None),
        (11, "é" * 40 + text[:55], 1, None),
        (12, text[:70] + "z" * 700_000 + text[60:], 1, None),
    ]
    check(spark, rows)


def test_empty_table(spark):
    assert substring_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_equal_strings():
    rng = np.random.default_rng(2)
    for n in (0, 1, 50, 9000):
        strings = rng.integers(0, 2, size=(n, 50), dtype=np.uint8)
        strings[:, :44] = strings[:1, :44] if n else 0
        lead = rng.integers(0, 3, n)
        got = equal_strings(lead, strings)
        keys = [(int(a), s.tobytes()) for a, s in zip(lead, strings)]
        rank = {k: i for i, k in enumerate(sorted(set(keys)))}
        assert got.tolist() == [rank[k] for k in keys]


def test_blind_trie():
    rng = random.Random(4)
    strings = ["".join(rng.choice("ab") for _ in range(7)).encode() for _ in range(60)]
    order = sorted(set(strings))
    assert BlindTrie(strings).ranks() == [order.index(s) for s in strings]
