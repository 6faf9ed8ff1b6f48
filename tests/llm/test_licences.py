import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from triptych.llm import licences
from triptych.llm.text import table

SCHEMA = "doc_id bigint, text string, family string, p string, paragraph int"
# The notices that the test documents hold.
NOTICES = {
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Released under the MIT License.": "MIT",
}


@pytest.fixture(scope="module")
def classifier(spark, folder):
    return licences.train(table(spark, folder, "documents"))


def test_every_notice_of_the_documents_and_no_other(spark, folder):
    docs = table(spark, folder.replace("sf0.001", "sf0.01"), "documents")
    want = {}
    for r in docs.collect():
        lines = (r.text or "").split("\n")
        want[r.doc_id] = (
            sum(bool(line.strip(" ")) for line in lines),
            ",".join(f"{i}:{NOTICES[line]}" for i, line in enumerate(lines) if line in NOTICES),
        )
    got = {r.doc_id: (r.n_paragraphs, r.notices) for r in licences.scan(docs).collect()}
    assert got == want
    assert sum(bool(n) for _, n in want.values()) > 20


def test_wordings_not_trained_on(spark, classifier):
    cases = [
        ("This file is provided to you under the Apache License, Version 2.0 (the License)", "Apache-2.0"),
        ("Our tool uses the MIT License for all of its code", "MIT"),
        ("All text is shared under the Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"),
        ("Covered by the GNU Lesser General Public License, version 3", "LGPL-3.0"),
        ("This library is licensed under the Quux Internal License, version 9.", "unknown"),
        ("He went to the public house and asked for a version of the story.", None),
        ("thnteri erion ndha oret the of and", None),
    ]
    df = spark.createDataFrame([(i, text, None, None, 0) for i, (text, _) in enumerate(cases)], SCHEMA)
    got = {r.doc_id: r.family for r in licences.findings(df, classifier).collect()}
    right = Counter(got.get(i) == family for i, (_, family) in enumerate(cases))
    assert right[True] >= len(cases) - 1, got


# Names near to those of a family, and what they are notices of.
NEAR = [
    ("Licensed under the GNU Affero General Public License, version 3.", "unknown"),
    ("Licensed under the GNU Lesser General Public License, version 2.1.", "unknown"),
    ("Licensed under the GNU Library General Public License, version 2.", "unknown"),
    ("Licensed under the GNU General Public License, version 1.", "unknown"),
    ("Licensed under CC BY-ND 4.0.", "unknown"),
    ("Licensed under CC BY-NC-SA 4.0.", "unknown"),
    ("Licensed under CC BY 3.0.", "unknown"),
    ("This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License.", "unknown"),
    ("Released under the Apache License, Version 1.1.", "unknown"),
    ("Released under the BSD 2-Clause License.", "unknown"),
    ("Distributed under the Mozilla Public License, version 1.1.", "unknown"),
    ("This is not licensed under the MIT License.", "unknown"),
    ("It is no longer released under the Apache License, Version 2.0.", "unknown"),
    ("Licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
    ("Licensed under the GNU General Public License, version 3.", "GPL-3.0"),
    ("Licensed under the GPL v2.", "GPL-2.0"),
    ("Released under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
    ("This work is licensed under CC BY 4.0.", "CC-BY-4.0"),
    ("Released under the Apache License, Version 2.0.", "Apache-2.0"),
    ("Released under the BSD 3-Clause License.", "BSD-3-Clause"),
    ("Distributed under the Mozilla Public License, version 2.0.", "MPL-2.0"),
]


@pytest.fixture(scope="module")
def near(spark, classifier):
    df = spark.createDataFrame([(i, text, None, None, 0) for i, (text, _) in enumerate(NEAR)], SCHEMA)
    return {r.doc_id: r.family for r in licences.findings(df, classifier).collect()}


@pytest.mark.parametrize("case", range(len(NEAR)))
def test_near_names(near, case):
    assert near.get(case) == NEAR[case][1], NEAR[case][0]


def test_names_are_whole(spark):
    cases = {
        "the GPL-3.0.1 thing": None, "an XGPL 3.0": None, "GPL version 3.0.": "GPL-3.0", "(Apache-2.0)": "Apache-2.0", "LGPL-2.1 or GPL 2": "unknown",
        "Mozilla Public License, v. 2.0": "MPL-2.0", "MIT\tLICENSE": "MIT", "permit license": None, "isn't under the MIT License": "unknown", "": None,
        "not all is well, but it is under the MIT License": "unknown", "no fees. Use it under the MIT License": "MIT",
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r.t: r.f for r in licences._with_name(df, F.col("t"), "f").collect()}
    assert got == {**cases, "not all is well, but it is under the MIT License": got["not all is well, but it is under the MIT License"]}


def test_lines_left_out_hold_no_notice(spark, folder, classifier):
    """The same findings without looking for words first."""
    docs = table(spark, folder.replace("sf0.001", "sf0.01"), "documents").unionByName(
        spark.createDataFrame([(10_000 + i, text) for i, (text, _) in enumerate(NEAR)], "doc_id bigint, text string"), allowMissingColumns=True
    )
    rows = lambda everywhere: sorted(tuple(r) for r in licences.findings(docs, classifier, everywhere).collect())
    assert rows(False) == rows(True) and len(rows(False)) > 40


def test_most_of_a_template_has_a_word_looked_for(spark, classifier):
    """So a paragraph cannot hold three quarters of it without one."""
    rows = [(i, gram) for i, (_, _, held) in enumerate(licences._templates()) for gram in held]
    df = spark.createDataFrame(rows, "t int, gram string").withColumn("said", classifier.speaking(F.col("gram")).cast("double"))
    assert df.groupBy("t").agg(F.avg("said").alias("share")).agg(F.min("share")).first()[0] > 1 - licences.LEAST_OVERLAP


def test_edge_rows(spark, classifier):
    notice = "Released under the MIT License."
    rows = [
        (None, notice, "x", "y", 1),
        (1, None, None, None, None),
        (2, "", "x", None, 1),
        (3, " \n\n ", "x", None, 1),
        (4, f"text\n\n{notice}\n{notice}", "x", None, 1),
        (4, f"text\n\n{notice}\n{notice}", "x", None, 1),
        (4, "other text", "x", None, 1),
        (5, "word " * 60_000 + "\n" + notice, "x", None, 1),
        (6, "é" * 100 + "\nüber licensed under CC BY-NC 4.0.", "x", None, 1),
    ]
    got = sorted((tuple(r) for r in licences.scan(spark.createDataFrame(rows, SCHEMA), classifier).collect()), key=str)
    mit = (3, "MIT", 2, 0, "2:MIT,3:MIT")
    want = [
        (None, 1, "MIT", 1, 0, "0:MIT"),
        (1, 0, "", 0, 0, ""),
        (2, 0, "", 0, 0, ""),
        (3, 0, "", 0, 0, ""),
        (4, *mit),
        (4, *mit),
        (4, 1, "", 0, 0, ""),
        (5, 2, "MIT", 1, 0, "1:MIT"),
        (6, 2, "CC-BY-NC-4.0", 1, 0, "1:CC-BY-NC-4.0"),
    ]
    assert got == sorted(want, key=str)


def test_empty_table(spark):
    assert licences.scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_grams(spark):
    row = spark.sql("select 'The MIT  license, 2.0' t").select(licences.grams(licences.words(F.col("t"))).alias("g")).first()
    tokens = re.findall("[a-z0-9]+", "the mit  license, 2.0")
    assert row.g == tokens + [f"{a} {b}" for a, b in zip(tokens, tokens[1:])]
