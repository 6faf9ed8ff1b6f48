import numpy as np
import pyarrow as pa
import pytest

from triptych.llm import quality
from triptych.llm.quality import FEATURES, _packed, _unpacked, classify, content_features, fit_dense
from triptych.llm.text import table

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, doc int, scores string"
LABELS = "doc_id bigint, quality int, toxic int"


def test_accuracy_on_labels_held_out(spark, folder):
    """Labels of every third document are withheld from training."""
    folder = folder.replace("sf0.001", "sf0.01")
    labels = table(spark, folder, "labels")
    scored = classify(table(spark, folder, "documents"), labels.where("doc_id % 3 != 0"))
    rows = scored.selectExpr("doc.doc_id", "p_quality", "kept").join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    good = [r for r in rows if r.quality and not r.toxic]
    low = [r for r in rows if not r.quality]
    assert np.mean([(r.p_quality >= 0.5) == bool(r.quality) for r in rows]) > 0.95
    assert np.mean([r.kept for r in good]) > 0.95
    assert np.mean([not r.kept for r in low]) > 0.85


ROWS = [
    (None, None, None, None, None, 1, "x"),
    (1, "", "en", "s", 0, 1, "x"),
    (2, "!!! ### $$$", "en", "s", 11, None, None),
    (2, "!!! ### $$$", "en", "s", 11, None, None),
    (3, "word " * 80_000, None, "s", None, 1, None),
    (4, "A plain sentence, as they are.", "en", None, 30, 1, None),
]


def test_edge_rows(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    labels = spark.createDataFrame([(1, 0, None), (2, 0, 0), (4, 1, 0), (4, 1, 1), (3, 1, 0), (None, 1, 1), (9, None, 1)], LABELS)
    out = classify(docs, labels).collect()
    assert len(out) == len(ROWS)
    assert all(0 <= r.p_quality <= 1 and 0 <= r.p_toxic <= 1 for r in out)
    assert {r.doc.scores for r in out} == {"x", None}


@pytest.mark.parametrize("rows", [[], [(4, 1, 0)]])
def test_without_both_classes_nothing_is_rejected(spark, rows):
    out = classify(spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame(rows, LABELS)).collect()
    assert all(r.kept and r.p_quality is None for r in out) and len(out) == len(ROWS)


def test_empty_table(spark):
    assert classify(spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, 1, 0)], LABELS)).collect() == []


def test_features_do_not_depend_on_neighbours():
    texts = [b"one two!!", b"", b" three", b"four "]
    data, starts = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    features, text = content_features(data, starts)
    for i, t in enumerate(texts):
        own, _ = content_features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert sorted(features[text == i]) == sorted(own)
    for some in (np.arange(5), np.arange(0, FEATURES, 7)):
        assert _unpacked(_packed(some)).tolist() == some.tolist()


def test_dense_fit():
    x = np.linspace(-3, 3, 400)
    rng = np.random.default_rng(0)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * x + 1)))).astype(float)
    assert fit_dense(x[:, None], y, [1.0, 0.0]) == pytest.approx([2, 1], abs=0.6)
    assert fit_dense(np.zeros((0, 1)), np.zeros(0), [1.0, 0.0]).tolist() == [1, 0]


def test_counts_of_taught_documents(spark, folder):
    """Against a loop over all documents."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    inputs = docs.select(*quality._inputs(docs))
    models = quality.train(docs, labels)
    telling = models["quality"].content.weights != 0
    got = quality.taught(inputs, models, telling)
    for name, model in models.items():
        want = [quality.Counts(np.zeros(size), np.zeros(size)) for size in (FEATURES, quality.METADATA)]
        for row in inputs.collect():
            columns = [pa.array([v]) for v in row]
            for data, starts, numbers, codes, *_ in quality._pieces(columns):
                pair = quality.telling_pairs(data, starts, telling)
                binned = quality.binned_metadata(numbers, codes, model.edges)
                content, metadata = (float(quality.sigmoid(v)[0]) for v in model.views(pair, binned))
            for learner, p, features in ((0, metadata, pair % FEATURES), (1, content, binned.ravel())):
                if p >= quality.SURE:
                    want[learner].up[features] += 1
                    want[learner].ups += 1
                elif p <= 1 - quality.SURE:
                    want[learner].down[features] += 1
                    want[learner].downs += 1
        for a, b in zip(got[name], want):
            assert (a.up == b.up).all() and (a.down == b.down).all() and (a.ups, a.downs) == (b.ups, b.downs)


def test_unlabelled_documents_teach(spark):
    """Words that no labelled document holds do not count, those that only some do gain weight from the others."""
    prior = np.zeros(FEATURES)
    prior[3] = 4.0
    label = np.array([1.0, 0.0] * 30)
    text = np.arange(60)
    plain = quality.fit_view(np.where(label > 0, 1, 2), text, FEATURES, label, np.zeros(FEATURES))
    with_prior = quality.fit_view(np.where(label > 0, 3, 2), text, FEATURES, label, prior)
    assert plain.weights[1] > 0 > plain.weights[2] and plain.weights[3] == 0
    assert with_prior.weights[3] > plain.weights[1]
