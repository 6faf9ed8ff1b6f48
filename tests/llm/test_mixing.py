import pytest

from triptych.llm.mixing import calibrated, mix_sources, rake

SCHEMA = "doc_id bigint, text string, lang string, source string, topic string, doc int"
ROWS = [
    (i, "word " * (5 + i % 40) + ("licensed under x" if i % 7 == 0 else ""), ["en", "de", None][i // 11 % 3], f"s{min(i % 5, 2)}", "x", i)
    for i in range(900)
]


def shares(rows, key, weight):
    out = {}
    for r in rows:
        out[key(r)] = out.get(key(r), 0.0) + weight(r)
    total = sum(out.values())
    return {k: v / total for k, v in out.items()}


def test_marginals_and_budget(spark):
    targets = {"source": 0.5, "lang": {"en": 0.5, "de": 0.3, "": 0.2}, "topic": {"general": 0.6, "legal": 0.4}}
    rows = mix_sources(spark.createDataFrame(ROWS, SCHEMA), targets, token_share=0.2).collect()
    assert len(rows) == 900 and max(r.probability for r in rows) < 1
    expected = lambda r: r.probability * r.tokens
    total = sum(r.tokens for r in rows)
    assert sum(map(expected, rows)) == pytest.approx(0.2 * total)
    for name in ("lang", "topic"):
        assert shares(rows, lambda r: r[name], expected) == pytest.approx(targets[name])
    present = shares(rows, lambda r: r.source, lambda r: r.tokens)
    power = {k: v**0.5 for k, v in present.items()}
    assert shares(rows, lambda r: r.source, expected) == pytest.approx({k: v / sum(power.values()) for k, v in power.items()})
    kept = sum(r.tokens for r in rows if r.kept)
    assert kept == pytest.approx(0.2 * total, rel=0.3)
    assert rows[0].doc.topic == "x" and rows[0].doc.doc == rows[0].doc.doc_id


def test_probabilities_stop_at_one(spark):
    cells = spark.createDataFrame([("a", "", "", 10, 0.9), ("b", "", "", 90, 0.1)], "source string, lang string, topic string, tokens bigint, weight double")
    p = {r.source: r.probability for r in calibrated(cells, 0.5).collect()}
    assert p == pytest.approx({"a": 1.0, "b": 40 / 90})
    assert [r.probability for r in calibrated(cells, 1.0).collect()] == pytest.approx([1.0, 1.0])


def test_edge_rows(spark):
    rows = [(None, None, None, None, None, 1), (1, "", "en", "s", None, 1), (2, "x y", None, "s", None, None), (2, "x y", None, "s", None, None)]
    rows += [(3, "w" * 400_000, "en", None, None, 2), (None, "no key", "en", "s", None, 2)]
    out = mix_sources(spark.createDataFrame(rows, SCHEMA), token_share=1.0).collect()
    assert len(out) == len(rows)
    assert all(r.probability == pytest.approx(1.0) and r.kept for r in out)


def test_empty_table(spark):
    assert mix_sources(spark.createDataFrame([], SCHEMA)).collect() == []


def test_rake_stops(spark):
    weights = spark.createDataFrame(
        [("a", "x", "t", 5, 5.0, 0.5, 0.4, 1.0), ("a", "y", "t", 1, 1.0, 0.5, 0.6, 1.0), ("b", "x", "t", 3, 3.0, 0.5, 0.4, 1.0), ("b", "y", "t", 9, 9.0, 0.5, 0.6, 1.0)],
        "source string, lang string, topic string, tokens bigint, weight double, to_source double, to_lang double, to_topic double",
    )
    from triptych.staging import staged

    rows = rake(staged(weights, "test")).collect()
    assert shares(rows, lambda r: r.source, lambda r: r.weight) == pytest.approx({"a": 0.5, "b": 0.5})
    assert shares(rows, lambda r: r.lang, lambda r: r.weight) == pytest.approx({"x": 0.4, "y": 0.6})
