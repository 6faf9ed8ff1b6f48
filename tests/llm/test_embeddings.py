import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from triptych.llm import embeddings
from triptych.llm.embeddings import embedding_dedup, fit_quantiser

SCHEMA = "vec_id bigint, embedding array<float>, label int, id int, vector string"


def expected(rows):
    vectors = {}
    for k, (vec_id, v, label, *_) in enumerate(rows):
        x = None if v is None or None in v else np.array(v, dtype=np.float32).astype(float)
        usable = x is not None and len(x) and np.isfinite(x).all() and x.any() and label is not None and vec_id is not None
        if usable:
            vectors[k] = (x, label)
    up = {r[0]: r[0] for r in rows}
    links = dict.fromkeys(range(len(rows)), 0)

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    keys = list(vectors)
    for n, i in enumerate(keys):
        for j in keys[:n]:
            (x, a), (y, b) = vectors[i], vectors[j]
            if a == b and len(x) == len(y) and (x @ y) / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= 0.98:
                links[i] += 1
                links[j] += 1
                p, q = sorted((top(rows[i][0]), top(rows[j][0])))
                up[q] = p
    out = []
    for k, r in enumerate(rows):
        component = None if r[0] is None else top(r[0])
        out.append((r[0], links[k], component, r[0] == component))
    return sorted(out, key=str)


def check(spark, rows):
    got = embedding_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "LIST_ROWS", 40)
    rng = np.random.default_rng(5)
    rows = []
    for group in range(60):
        centre = rng.normal(size=16)
        for _ in range(rng.integers(1, 15)):
            noise = rng.choice([0, 0.05, 0.1, 0.2])
            rows.append((len(rows), (centre + noise * rng.normal(size=16)).tolist(), int(rng.integers(0, 3)), 1, "x"))
    check(spark, rows)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1),
        (2, [2.0, 0.0], 1),
        (3, [1.0, 0.0], None),
        (4, [1.0, 0.0, 0.0], 1),
        (5, None, 1),
        (6, [0.0, 0.0], 1),
        (7, [nan, 1.0], 1),
        (8, [inf, 1.0], 1),
        (9, [1.0, None], 1),
        (10, [], 1),
        (11, [1e30, 0.0], 1),
        (12, [1.0, 0.0], 2),
        (13, [1.0, 0.0], 1),
        (None, [1.0, 0.0], 1),
        (14, [-1.0, -0.0], 1),
    ]
    check(spark, [(*r, None, "x") for r in rows])


def test_empty_table(spark):
    assert embedding_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("radius", [0.05, 0.2])
def test_probes_and_lookups_lose_nothing(radius):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + radius * 0.99 * (d := rng.normal(size=x.shape)) / np.linalg.norm(d, axis=1, keepdims=True)
    q = fit_quantiser(x, 20)
    at = q.nearest(x)[1]
    square, own = q.nearest(y)
    probed = q.probed(square, own, radius)
    assert probed[np.arange(len(x)), at].all() and probed.mean() < 0.9
    code, error = q.encode(x, at)
    for i in range(0, 600, 7):
        assert q.distances(y[i : i + 1], at[i], code[i : i + 1])[0, 0] <= radius + error[i] + 1e-9


def test_executors_need_no_copy_of_the_package(tmp_path):
    """From another folder, with the package only on the driver's path."""
    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[2])!r})
from triptych.llm.embeddings import embedding_dedup
from triptych.llm.vector_codes import compress
from triptych.llm.whitening import whiten
from triptych.session import local_session
spark = local_session("elsewhere", 2, memory="1g")
df = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.999, 0.001], 0), (3, [0.0, 1.0], 0)], "vec_id bigint, embedding array<float>, label int")
print("found", sorted(r.n_links for r in embedding_dedup(df).collect()), whiten(df).count(), compress(df, parts=2)[0].count())
"""
    clean = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME")}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=clean, capture_output=True, text=True, timeout=300)
    assert "found [0, 1, 1] 3 3" in done.stdout, done.stderr[-2000:]
