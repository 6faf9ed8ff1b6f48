"""Column functions against plain Python."""

from urllib.parse import quote

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from triptych.functions import cleaning, describing
from triptych.functions.text import bigrams, tokens
from triptych.sources.tables import coerce_numeric, ensure_columns, fill_missing, rename_if_absent

TEXTS = st.lists(
    st.text(st.sampled_from("ab Zé\t\n  '-ß1_/~*+&😀"), max_size=30), min_size=1, max_size=40
)
SLOW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def apply(spark, values, make, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}").select("i", make(F.col("v")).alias("out"))
    return [r.out for r in df.orderBy("i").collect()]


@SLOW
@given(values=TEXTS)
def test_text_functions_equal_python(spark, values):
    assert apply(spark, values, cleaning.strip) == [v.strip() for v in values]
    assert apply(spark, values, cleaning.word_count) == [len(v.split()) for v in values]
    assert apply(spark, values, cleaning.collapse_spaces) == [" ".join(v.split()) for v in values]
    assert apply(spark, values, describing.code_point_bucket) == [sum(map(ord, v)) % 1000 for v in values]
    assert apply(spark, values, describing.percent_encoded) == [quote(v) for v in values]


def test_title_case_after_any_non_letter(spark):
    values = ["saint-denis", "o'brien", "são paulo", "x2y NEW york", ""]
    assert apply(spark, values, cleaning.title_case) == [v.title() for v in values]


def test_numbers_are_whole_texts_or_missing(spark):
    values = ["12", " 1.5e3 ", "+.5", "-7.", "abc", "1,000", "12d", "12f", "NaN", "", None, "inf", "1e", "0x1"]
    expected = [12.0, 1500.0, 0.5, -7.0, None, None, None, None, None, None, None, float("inf"), None, None]
    assert apply(spark, values, cleaning.to_number) == expected


def test_nan_is_missing_and_absent_columns_are_skipped(spark):
    df = spark.createDataFrame([(1.0, "x"), (float("nan"), "2")], "a double, b string")
    assert coerce_numeric(df, ["a", "b", "c"]).collect() == [(1.0, None), (None, 2.0)]


def test_true_words(spark):
    values = ["TRUE", "true", "1", "t", "Yes", "no", "0", "", None, " true"]
    assert apply(spark, values, cleaning.is_true_text) == [True] * 5 + [False] * 5


def test_missing_never_becomes_the_text_nan(spark):
    """Deviation: missing parts are left out, where text conversion would write "nan"."""
    df = spark.createDataFrame([("Title", None, "Drama"), (None, None, None)], "a string, b string, c string")
    out = df.select(describing.text_representation(F.col("a"), F.col("b"), F.col("c")).alias("t"))
    assert [r.t for r in out.collect()] == ["Title. Drama", ""]


def test_place_descriptions_at_the_limits(spark):
    people = [None, 0.0, 100_000.0, 100_001.0, 500_000.0, 1_000_000.0, 1_250_000.9]
    make = lambda c: describing.describe_place(F.lit("A"), F.lit("NA"), c, F.lit(" "))
    assert apply(spark, people, make, "double") == [
        "A is a city in NA. charming town.",
        "A is a city in NA. charming town.",
        "A is a city in NA. charming town. population 100,000.",
        "A is a city in NA. medium-sized city. population 100,001.",
        "A is a city in NA. medium-sized city. population 500,000.",
        "A is a city in NA. large city. population 1,000,000.",
        "A is a city in NA. major metropolitan area. population 1,250,000.",
    ]
    assert apply(spark, people, describing.population_badge, "double") == [
        "",
        "",
        "🏘️ Medium city (100,000 people)",
        "🏘️ Medium city (100,001 people)",
        "🌆 Large city (500,000 people)",
        "🏙️ Major city (1.0M people)",
        "🏙️ Major city (1.3M people)",
    ]


def test_place_sentences(spark):
    df = spark.createDataFrame([(-33.9, 18.4), (0.0, -1.0), (None, 3.0)], "lat double, lng double")
    text = describing.describe_place_sentences(
        F.lit("A"), F.lit("B"), F.lit(1234.0), F.lit("C"), F.col("lat"), F.col("lng")
    )
    start = "A is a city in B. It has an estimated population of about 1,234 people. It is located in region C."
    assert [r[0] for r in df.select(text).collect()] == [
        f"{start} The city lies in the southern and eastern hemispheres.",
        f"{start} The city lies in the northern and western hemispheres.",
        start,
    ]


def test_audio_words(spark):
    df = spark.createDataFrame([("T", "A", None, 0.71, 0.29, 0.7), ("T", None, "pop", 0.3, 0.8, 0.8)], "n string, a string, g string, e double, v double, d double")
    out = df.select(describing.describe_audio(*[F.col(c) for c in "nagevd"]).alias("t"))
    assert [r.t for r in out.collect()] == [
        "T. by A. high energy. melancholic sad",
        "T. pop genre. joyful upbeat. danceable",
    ]


def test_excerpt_limits(spark):
    values = ["x" * 50, "x" * 51, "x" * 300, "x" * 301, None]
    assert apply(spark, values, describing.excerpt) == [None, "x" * 51, "x" * 300, "x" * 297 + "...", None]


def test_tokens_and_pairs(spark):
    values = ["The Wörld of a_b x, the end of THE world", "one", "", None]
    assert apply(spark, values, lambda c: tokens(c, ["the", "of"])) == [
        ["wörld", "a_b", "end", "world"], ["one"], [], None
    ]
    assert apply(spark, values, lambda c: bigrams(tokens(c, ["the", "of"]))) == [
        ["wörld a_b", "a_b end", "end world"], [], [], None
    ]


def test_columns_may_be_absent(spark):
    df = spark.createDataFrame([(1, None)], "id int, title string")
    wide = ensure_columns(df, {"title": "string", "popularity": "double", "genres": "string"}, {"popularity": 0})
    assert wide.collect() == [(1, None, 0.0, None)]
    assert rename_if_absent(df, "id", "book_id").columns == ["book_id", "title"]
    assert rename_if_absent(wide, "id", "title").columns == wide.columns
    assert fill_missing(wide, {"genres": "none"}, {"title": "genres"}).first().title is None
