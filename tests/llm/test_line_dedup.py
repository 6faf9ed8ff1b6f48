import hashlib
import random

from triptych.llm.line_dedup import line_chunks, line_dedup, line_report

SCHEMA = "doc_id bigint, text string, first int, cuts string, version int"


def expected(rows):
    """The rows' texts, chunk by chunk in order of doc_id."""
    seen, out = {}, {}
    key = lambda r: (r[0] is not None, r[0] or 0)
    for doc_id, text, *_ in sorted(set(rows), key=key):
        lines, kept = (text or "").split("\n"), []
        for first, end in line_chunks(lines):
            chunk = tuple(lines[first:end])
            multi = sum(bool(line.strip()) for line in chunk) >= 2
            if not multi or seen.setdefault(chunk, (doc_id, first)) == (doc_id, first):
                kept += chunk
        out[doc_id, text] = None if text is None else "\n".join(kept)
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    want = expected(rows)
    result = line_dedup(df)
    assert result.columns == df.columns
    got = sorted((tuple(r) for r in result.collect()), key=str)
    assert got == sorted(((r[0], want[r[0], r[1]], *r[2:]) for r in rows), key=str)
    reported = sorted(((r.doc_id, r.n_lines, r.n_lines - r.n_removed, r.kept_sha256) for r in line_report(df).collect()), key=str)
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    count = lambda t: len(t.split("\n")) if t else 0
    assert [(a, b, d) for a, b, _, d in reported] == sorted(
        ((r[0], count(r[1]), digest(want[r[0], r[1]])) for r in rows), key=str
    )


def test_against_brute_force(spark):
    rng = random.Random(3)
    passage = [f"shared line {i}" for i in range(30)]
    rows = []
    for i in range(60):
        lines = [f"own line {i} {k}" for k in range(rng.randint(0, 6))]
        at = rng.randint(0, 20)
        lines += passage[at : at + rng.randint(0, 10)] + [f"end {i} {k}" for k in range(rng.randint(0, 4))]
        rows.append((i, "\n".join(lines), i, "x", None))
    check(spark, rows)
    want = expected(rows)
    assert sum(len(t) for t in want.values()) < 0.9 * sum(len(r[1]) for r in rows)


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
            (7, "same\n" * 5000, 1, None, None),
            (8, "y" * 300_000 + "\n" + body, 1, None, None),
        ],
    )


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert line_dedup(df).collect() == [] and line_report(df).collect() == []


def test_chunks_do_not_shift():
    lines = [f"line {i}" for i in range(400)]
    ends = {lines[end - 1] for _, end in line_chunks(lines)}
    moved = {lines[end - 1 + 7] for _, end in line_chunks(lines[7:])}
    assert len(ends - moved) <= 4 and moved <= ends
