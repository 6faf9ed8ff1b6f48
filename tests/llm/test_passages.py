import random

import pytest

from triptych.llm.line_dedup import line_dedup, line_report, passage_removals

SCHEMA = "doc_id bigint, text string, first int, cuts string, version int"


def expected(rows):
    """The lines left of each text, and how many were cut, by trying all runs of lines of all texts."""
    seen, out = {}, {}
    texts = sorted({(r[0] is not None, r[0] or 0, r[1]) for r in rows}, key=lambda r: (r[0], r[1], r[2] or ""))
    for known, doc_id, text in texts:
        lines = (text or "").split("\n")
        filled = [i for i, line in enumerate(lines) if line.strip()]
        cut = set()
        for k, first in enumerate(filled):
            for last in filled[k + 1 :]:
                here = (known, doc_id, text, first)
                if seen.setdefault(tuple(lines[first : last + 1]), here) != here:
                    cut.update(range(first, last + 1))
        kept = "\n".join(line for i, line in enumerate(lines) if i not in cut)
        out[doc_id if known else None, text] = (None if text is None else kept, len(cut))
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    want = expected(rows)
    result = line_dedup(df, passage_removals)
    assert result.columns == df.columns
    got = sorted((tuple(r) for r in result.collect()), key=str)
    assert got == sorted(((r[0], want[r[0], r[1]][0], *r[2:]) for r in rows), key=str)
    removed = sorted(((r.doc_id, r.n_removed) for r in line_report(df, passage_removals).collect()), key=str)
    assert removed == sorted(((r[0], want[r[0], r[1]][1]) for r in rows), key=str)


@pytest.mark.parametrize("length", [2, 3, 4, 9])
def test_every_repeat_goes_whatever_its_length(spark, length):
    rows = []
    for i in range(40):
        passage = [f"shared {i // 2} {k}" for k in range(length)]
        rows.append((i, "\n".join([f"before {i}", *passage, f"after {i}"]), i, "x", None))
    check(spark, rows)
    report = line_report(spark.createDataFrame(rows, SCHEMA), passage_removals).collect()
    assert all((r.n_removed, r.n_chunks) == ((length, 1) if r.doc_id % 2 else (0, 0)) for r in report)


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(80):
        lines = [rng.choice(["a", "b", "c d", "", " ", "e", f"own {i}", f"{i % 9} more"]) for _ in range(rng.randint(0, 14))]
        rows.append((i, "\n".join(lines), i, "x", None))
    check(spark, rows)


def test_edge_rows(spark):
    body = "\n".join(f"line {i}" for i in range(12))
    check(
        spark,
        [
            (1, None, 1, None, None),
            (2, "", 1, None, None),
            (3, "\n\n\n", 1, None, None),
            (4, "\n\n\n", 1, None, None),
            (5, body, 1, None, None),
            (6, body, 1, None, None),
            (6, body, 1, None, None),
            (6, body + "\nmore", 1, None, None),
            (None, "intro\n" + body, 1, None, None),
            (7, "same\n" * 100, 1, None, None),
            (8, "y" * 300_000 + "\n" + body, 1, None, None),
            (9, "p\n\nq", 1, None, None),
            (10, "p\n \nq", 1, None, None),
            (11, "x\n\n\np\n\nq\n\ny", 1, None, None),
        ],
    )


def test_different_passages_under_one_hash(spark, monkeypatch):
    """All pairs share one hash, so that only the bytes tell them apart."""
    import numpy as np

    from triptych.llm import line_dedup as module

    pairs = module.line_pairs
    monkeypatch.setattr(module, "line_pairs", lambda lines: (pairs(lines)[0], np.zeros_like(pairs(lines)[1])))
    rows = [(i, "\n".join([f"a {i}", f"b {i % 3}", f"c {i % 3}", f"d {i}"]), 1, None, None) for i in range(9)]
    # Functions of the module are pickled by name where workers import it; a copy by value holds the change.
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(module)
    try:
        check(spark, rows)
    finally:
        cloudpickle.unregister_pickle_by_value(module)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert line_dedup(df, passage_removals).collect() == [] and line_report(df, passage_removals).collect() == []
