import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from triptych.llm.vector_codes import compress, codebook_text, decode, nearest, sequency_order, transformed, with_label_error

SCHEMA = "vec_id bigint, embedding array<float>, label int, error string, code int, x int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "e", 1, 2) for r in rows], SCHEMA)


def brute_force(rows, parts, entries, rounds):
    """Plain loops over whole numbers."""
    width = len(rows[0][1])
    size = width // parts
    x = [[math.floor(256 * float(np.float32(c))) for c in v] for _, v, _ in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, x[i]))
    piece = lambda i, p: tuple(x[i][p * size : (p + 1) * size])
    far = lambda a, b: sum((v - w) ** 2 for v, w in zip(a, b))
    books = [[piece(i, p) for i in order[:entries]] for p in range(parts)]
    assign = lambda: [[min(range(len(books[p])), key=lambda e: (far(piece(i, p), books[p][e]), e)) for p in range(parts)] for i in range(len(x))]
    for _ in range(rounds):
        at = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [piece(i, p) for i in range(len(x)) if at[i][p] == e]
                if mine:
                    books[p][e] = tuple(sum(c) // len(mine) for c in zip(*mine))
    at = assign()
    out = []
    for i, (vec_id, _, label) in enumerate(rows):
        out.append((vec_id, bytes(at[i]), sum(far(piece(i, p), books[p][at[i][p]]) for p in range(parts)), label))
    sums = {}
    for *_, error, label in out:
        sums[label] = sums.get(label, 0) + error
    return sorted([(*r, sums[r[3]]) for r in out], key=str), books


@pytest.mark.parametrize("width, parts, entries, rounds", [(12, 4, 8, 2), (10, 2, 5, 3), (6, 6, 64, 1), (8, 1, 4, 0)])
def test_against_brute_force(spark, width, parts, entries, rounds):
    rng = np.random.default_rng(width)
    rows = [(int(k), (rng.integers(-3, 4, width) / 8 + 0.001).tolist(), [None, 1, 2][k % 3]) for k in rng.permutation(40)]
    rows += [(100 + k, rows[3][1], 7) for k in range(30)] + [(2, rows[4][1], None), (None, rows[5][1], 1), (None, rows[6][1], 1)]
    codes, books = compress(frame(spark, rows), keep=("label",), parts=parts, entries=entries, rounds=rounds)
    got = with_label_error(codes, "label").select("vec_id", "code", "error", "label", F.col("label_error").cast("bigint"))
    want, wanted_books = brute_force(rows, parts, entries, rounds)
    assert [[tuple(e) for e in b.tolist()] for b in books] == wanted_books
    assert sorted(((a, bytes(b), *rest) for a, b, *rest in got.collect()), key=str) == want
    assert codebook_text(books) == ",".join(str(v) for b in wanted_books for e in b for v in e)


def test_unusable_vectors_are_left_out(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, 1.0], 1), (4, [-0.5, 2.0], 1)]
    bad = [(0, None, 1), (2, [], 1), (3, [None, 1.0], 1), (5, [nan, 1.0], 2), (6, [1.0, -inf], 2), (7, [1.0, 1.0, 1.0], 1), (8, [1e6, 0.0], 1)]
    codes, books = compress(frame(spark, good + bad), parts=2, entries=4)
    assert sorted((r.vec_id, bytes(r.code), r.error) for r in codes.collect()) == [(1, b"\0\0", 0), (4, b"\1\1", 0)]
    assert [b.tolist() for b in books] == [[[128], [-128]], [[256], [512]]]


def test_empty_table_and_misfits(spark):
    codes, books = compress(frame(spark, []), keep=("label",))
    assert codes.collect() == [] and books == [] and codes.columns == ["vec_id", "label", "code", "error"]
    assert with_label_error(codes, "label").collect() == []
    with pytest.raises(ValueError):
        compress(frame(spark, [(1, [1.0, 2.0, 3.0], 1)]), parts=2)
    with pytest.raises(ValueError):
        compress(frame(spark, []), entries=257)


def test_decoded_vectors_are_as_far_as_the_error_says(spark):
    rng = np.random.default_rng(2)
    rows = [(k, (rng.integers(-100, 100, 8) / 256).tolist(), 1) for k in range(60)]
    codes, books = compress(frame(spark, rows), parts=4, entries=16)
    errors = {r.vec_id: r.error for r in codes.collect()}
    for r in decode(codes, books).collect():
        away = (np.array(r.vector, dtype=float) - np.array(rows[r.vec_id][1])) * 256
        assert round(float(away @ away)) == errors[r.vec_id]


@settings(max_examples=150, deadline=None)
@given(st.data(), st.integers(1, 9), st.integers(1, 12), st.sampled_from([1, 5, 1 << 25]))
def test_nearest_is_exact(data, width, entries, size):
    numbers = lambda n: np.array(data.draw(st.lists(st.lists(st.integers(-size, size), min_size=width, max_size=width), min_size=n, max_size=n)))
    parts, book = numbers(7), numbers(entries)
    at, distance = nearest(transformed(parts), transformed(book))
    far = ((parts[:, None].astype(object) - book) ** 2).sum(axis=2)
    assert at.tolist() == [row.tolist().index(min(row)) for row in far]
    assert distance.tolist() == far.min(axis=1).tolist()


@pytest.mark.parametrize("size", [1, 2, 4, 8, 16, 64])
def test_rows_are_in_order_of_their_sign_changes(size):
    lines = transformed(np.eye(size, dtype=np.int64))
    assert np.count_nonzero(np.diff(lines, axis=1), axis=1).tolist() == list(range(size))
    assert (lines @ lines.T == size * np.eye(size)).all()
    assert sorted(sequency_order(size)) == list(range(size))
