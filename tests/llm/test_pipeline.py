"""Every stage on its own written input, against a plain version of the stage."""

import duckdb
import pytest

import corpus_pipeline
import test_line_dedup
import test_minhash
from triptych.llm import mixing
from triptych.llm.text import table


@pytest.fixture(scope="module")
def written(spark, folder, tmp_path_factory):
    root, tables = tmp_path_factory.mktemp("pipeline"), [table(spark, folder, "documents")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], folder).write.parquet(f"{root}/{k}")
        tables.append(spark.read.parquet(f"{root}/{k}"))
    return root, tables


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_columns_are_those_of_documents(written):
    _, tables = written
    assert all(t.columns == tables[0].columns for t in tables[1:-1])


def test_quality_keeps_good_documents(spark, folder, written):
    labels = {r.doc_id: r for r in table(spark, folder, "labels").collect()}
    before, after = (rows(t) for t in written[1][:2])
    kept = {r[0] for r in after}
    assert set(after) <= set(before)
    good = [r[0] for r in before if r[0] in labels and labels[r[0]].quality and not labels[r[0]].toxic]
    low = [r[0] for r in before if r[0] in labels and not labels[r[0]].quality]
    assert sum(i in kept for i in good) >= 0.95 * len(good)
    assert sum(i in kept for i in low) <= 0.2 * len(low)


def test_lines_against_brute_force(written):
    before, after = (rows(t) for t in written[1][1:3])
    want = test_line_dedup.expected(before)
    assert after == sorted(((r[0], want[r[0], r[1]], *r[2:4], len(want[r[0], r[1]])) for r in before), key=str)


def test_near_duplicates_against_brute_force(written):
    before, after = (rows(t) for t in written[1][2:4])
    kept = {i for i, _, _, k in test_minhash.expected([(r[0], r[1], "", 0) for r in before]) if k}
    assert after == [r for r in before if r[0] in kept]


def test_mixing_against_sql(written):
    root, tables = written
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{root}/2/*.parquet'")
    column = [d[0] for d in connection.execute(mixing.ORACLE).description].index("kept")
    kept = sorted(r[0] for r in connection.execute(mixing.ORACLE).fetchall() if r[column])
    assert sorted(r.doc_id for r in tables[4].collect()) == kept


def test_packing_holds_all_documents(written):
    docs, pieces = written[1][4].collect(), written[1][5].collect()
    assert {p.doc_id for p in pieces} == {d.doc_id for d in docs}
    tokens = {p.doc_id: p.doc_tokens for p in pieces}
    assert sum(p.length for p in pieces) == sum(tokens.values())


def test_run(spark, folder, written):
    assert rows(corpus_pipeline.run(spark, folder).drop("sequence_id", "offset")) == rows(written[1][5].drop("sequence_id", "offset"))


EDGE = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, doc struct<a: int>, component_id string"
EDGE_ROWS = [
    (None, "no id here, but some words all the same", "en", "s", 39, True, (1,), "x"),
    (1, None, "en", "s", None, False, None, None),
    (2, "", None, None, 0, True, (1,), "x"),
    (3, "one line\nanother line\nand a third line of words", "en", "s", 48, None, (1,), None),
    (3, "one line\nanother line\nand a third line of words", "en", "s", 48, None, (1,), None),
    (4, "word " * 30_000, "en", "t", 150_000, True, (2,), "y"),
]


@pytest.mark.parametrize("rows", [EDGE_ROWS, []])
def test_stages_with_odd_rows(spark, tmp_path, rows):
    """Null ids and texts, repeated rows, a very long text, clashing columns, and an empty table."""
    docs = spark.createDataFrame(rows, EDGE)
    spark.createDataFrame([(3, 1, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        if name != "mixing":  # which draws
            texts = {(r.doc_id, r.text or "") for r in out.collect()}
            assert texts <= {(r[0], r[1] or "") for r in rows} | {(3, "")}, name
            assert {i for i, _ in texts} == {r[0] for r in rows}, name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert (sum(r.start == 0 for r in last)) == len(rows)
