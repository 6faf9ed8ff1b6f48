"""Licence scans: a trained paragraph classifier, with template comparison confirming its findings.

A multinomial logistic regression over hashed word n-grams is trained on notices of each family, on
notices of unknown licences (licences with names near to a family's among them), and on a bounded
sample of paragraphs without a notice. Its probabilities are calibrated on notices held out. A
paragraph is of a family when the calibrated probability is high enough and a template confirms it:
the longest licence name in it, whole and in order, is one of that family, or it holds most of a
header or paragraph of that family and of no other licence more; identifiers are compared whole. Any
other notice that has wording of one is of an unknown licence. Lines of unknown ones that are next
to each other are compared with the templates together, as a notice may be wrapped.

Only lines with a word that every finding has are looked at closely.
"""

from __future__ import annotations

import math
import re
import textwrap
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triptych.llm.licence_names import DENIALS, DENIED, NAME, NAMES, OTHERS
from triptych.llm.licence_texts import IDENTIFIERS, OTHER_IDENTIFIERS, OTHER_TEXTS, SPDX, TEXTS
from triptych.llm.text import lower_ascii, whole
from triptych.staging import staged

# Names under which licences are granted, by family.
FAMILIES = {
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache 2.0 license", "the Apache License 2.0"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the 3-clause BSD license", "the New BSD License"),
    "CC-BY-4.0": ("CC BY 4.0", "the Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC0-1.0": ("CC0 1.0", "the CC0 1.0 Universal Public Domain Dedication"),
    "GPL-2.0": ("the GNU General Public License, version 2", "the GPL version 2", "the GNU GPL v2"),
    "GPL-3.0": ("the GNU General Public License, version 3", "the GPL version 3", "the GNU GPL v3"),
    "LGPL-3.0": ("the GNU Lesser General Public License, version 3", "the LGPL version 3", "the GNU LGPL v3"),
    "MIT": ("the MIT License", "the MIT license terms", "the Expat MIT License"),
    "MPL-2.0": ("the Mozilla Public License, version 2.0", "the MPL 2.0"),
}
UNKNOWN = "unknown"
NONE = "none"
CLASSES = (*FAMILIES, UNKNOWN, NONE)
OTHER_NAMES = (
    "the Example Source License",
    "the Acme Community License, version 1",
    "the terms of its own license",
    "a commercial license",
    "the Foo Public License 7",
    "a proprietary license agreement",
)
GRANTS = (
    "Licensed under {}.",
    "Released under {}.",
    "Distributed under {}.",
    "Published under {}",
    "This work is licensed under {}.",
    "This project is available under {}.",
    "This software is released under {}; see the file LICENSE.",
    "Permission to use this file is granted under {}.",
    "Code in this repository is covered by {}.",
    "You may use this material under the terms of {}.",
)
# A notice of an unknown licence holds one of these words, or so many word pairs of notices.
CUES = ("license", "licence", "licensed", "licenced", "licensing", "copyright", "copyrighted")
LEAST_TELLING = 3
# Forms in which headers and paragraphs are trained, and widths at which they are wrapped.
FORMS = ("/* {} */", "# {}")
WIDTHS = (60, 78)
LEAST_WORDS = 4  # of a wrapped line that is trained
# Paragraphs without a notice that are gathered for training, and documents they are taken from.
PLAIN_ROWS = 2_000
PLAIN_DOCUMENTS = 1_000
FEATURES = 1 << 14
LEAST_PROBABILITY = 0.5
# Margin, in units of the temperature, from which a class has over half of the probability.
ODDS = math.log(len(CLASSES))
# Share of the word pairs of a template that a paragraph must hold.
LEAST_OVERLAP = 0.75
# Word pairs that tell of a notice have a word of so many letters.
LONG_WORD = 6
# What else every finding has: words of notices, and of names without them.
SAID = r"licen[sc]|copyright|\bcc[^a-z0-9]+by|\bcc0|creative|gpl|mpl|apache|bsd|mozilla|\bmit\b|affero|spdx"
TEMPERATURES = tuple(2 ** (k / 4) for k in range(-8, 13))


@dataclass(frozen=True)
class Classifier:
    model: LogisticRegressionModel
    temperature: float
    telling: tuple[str, ...]  # word pairs of notices, with a long word, that no plain paragraph of the training holds

    def speaking(self, text: Column) -> Column:
        """Whether the text has a word that every finding has one of."""
        words = sorted({w for pair in self.telling for w in pair.split(" ") if len(w) >= LONG_WORD})
        starts: dict[str, list[str]] = {}
        for word in words:
            starts.setdefault(word[:2], []).append(word[2:])
        listed = "|".join(f"{start}(?:{'|'.join(rest)})" for start, rest in starts.items())
        return text.rlike(f"(?i){SAID}" + (f"|\\b(?:{listed})\\b" if listed else ""))

    def margins(self, rows: DataFrame) -> DataFrame:
        """`rows` (with grams) and margin: one number for each of CLASSES."""
        model = self.model.copy().setProbabilityCol("").setPredictionCol("")
        scored = model.transform(_hashed(rows))
        return scored.withColumn("margin", vector_to_array("rawPrediction")).drop("features", "rawPrediction")


def words(text: Column) -> Column:
    """Runs of letters and digits of a-z, after lower-casing A-Z."""
    return F.filter(F.split(lower_ascii(text), "[^a-z0-9]+", -1), lambda w: w != "")


def grams(tokens: Column) -> Column:
    """Distinct words and pairs of neighbouring words."""
    pairs = F.zip_with(tokens, F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(tokens, F.filter(pairs, lambda pair: pair.contains(" "))))


def _with_grams(rows: DataFrame) -> DataFrame:
    """`rows` with the grams of their text; its words are found once, in a column of their own."""
    return rows.withColumn("tokens", words(F.col("text"))).withColumn("grams", grams(F.col("tokens"))).drop("tokens")


def paragraphs(documents: DataFrame) -> DataFrame:
    """doc_id, version (a hash of the text), paragraph (from 0), text, before, after of all lines that hold something."""
    lines = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.xxhash64(whole("text")).alias("version"),
        F.split(whole("text"), "\n", -1).alias("text"),
    )
    outside, others = F.array(F.lit("")), F.size("text") - 1
    zipped = F.arrays_zip(
        "text",
        F.concat(outside, F.slice("text", F.lit(1), others)).alias("before"),
        F.concat(F.slice("text", F.lit(2), others), outside).alias("after"),
    )
    return (
        lines.select("doc_id", "version", F.posexplode(zipped).alias("paragraph", "line"))
        .select("doc_id", "version", "paragraph", "line.*")
        .where(F.trim("text") != "")
    )


def train(documents: DataFrame) -> Classifier:
    """The classifier, from notices and a bounded sample of paragraphs of `documents`.

    Sampled paragraphs that hold a template or speak of a licence are not taken as plain ones.
    """
    spark = documents.sparkSession
    ids = documents.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("id"))
    some = ids.orderBy(F.xxhash64("id"), "id").limit(PLAIN_DOCUMENTS).distinct()
    # At most PLAIN_DOCUMENTS numbers.
    sampled = paragraphs(documents.join(F.broadcast(some), F.col("doc_id") == F.col("id"), "left_semi"))
    plain = (
        sampled.where(~lower_ascii(F.col("text")).rlike("licen[sc]|copyright|public domain|hereby granted|redistribut|warrant|free software"))
        .orderBy(F.xxhash64("text"), "text")
        .limit(PLAIN_ROWS)
        .select("text")
    )
    plain = staged(plain.withColumn("n", F.monotonically_increasing_id() % F.lit(64)), "licence-plain")
    notices = _notices(spark)
    # Notices also stand among other words: each joins one plain paragraph in 64, if there are any.
    among = notices.join(plain.dropDuplicates(["n"]), "n").select(
        "label", F.concat_ws(" ", plain["text"], notices["text"]).alias("text")
    )
    rows = (
        notices.select("label", "text")
        .unionByName(among)
        .unionByName(plain.select(F.lit(CLASSES.index(NONE)).alias("label"), "text"))
        .unionByName(_built_in_plain(spark))
    )
    examples = staged(
        _with_grams(rows).select(F.col("label").cast("double"), "grams", (F.pmod(F.xxhash64("text"), F.lit(4)) == 0).alias("held")),
        "licence-examples",
    )
    hashed = _hashed(examples)
    model = LogisticRegression(maxIter=25, regParam=1e-3, family="multinomial", labelCol="label").fit(
        hashed.where("not held").coalesce(1)
    )
    said = _with_grams(notices.select("text")).select(F.explode("grams").alias("gram"))
    found = said.where(F.col("gram").rlike(f"[a-z0-9]{{{LONG_WORD},}}") & F.col("gram").contains(" ")).distinct()
    seen = examples.where(F.col("label") == CLASSES.index(NONE)).select(F.explode("grams").alias("gram")).distinct()
    # At most the word pairs of the notices above.
    telling = tuple(sorted(r.gram for r in found.join(seen, "gram", "left_anti").collect()))
    return Classifier(model, _temperature(model, hashed.where("held")), telling)


def _hashed(rows: DataFrame) -> DataFrame:
    return HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True).transform(rows)


def _notices(spark: SparkSession) -> DataFrame:
    """label, text, n: every grant of every name, and all texts and identifiers; n is null for parts and other forms of them."""
    names = [(CLASSES.index(f), name) for f, named in FAMILIES.items() for name in named]
    names += [(CLASSES.index(UNKNOWN), name) for name in OTHER_NAMES]
    names += [(CLASSES.index(UNKNOWN), f"the {name}") for name in OTHERS]
    whole_ones = [(label, grant.format(name)) for label, name in names for grant in GRANTS]
    denied = [name.removeprefix("the ") for named in FAMILIES.values() for name in named]
    whole_ones += [(CLASSES.index(UNKNOWN), denial.format(name)) for name in denied for denial in DENIALS]
    others = []
    for family, text in _texts() + _identifiers():
        label = CLASSES.index(family)
        whole_ones.append((label, text))
        others += [(label, form.format(text)) for form in FORMS]
    for family, text in _texts():
        lines = {line for width in WIDTHS for line in textwrap.wrap(text, width) if len(line.split()) >= LEAST_WORDS}
        others += [(CLASSES.index(family), line) for line in sorted(lines)]
    joined = _literal(spark, whole_ones).withColumn("n", F.pmod(F.xxhash64("text"), F.lit(64)))
    return joined.unionByName(_literal(spark, others).withColumn("n", F.lit(None).cast("bigint")))


def _texts() -> list[tuple[str, str]]:
    """Headers and paragraphs with their family."""
    return [(f, text) for f, texts in TEXTS.items() for text in texts] + [(UNKNOWN, text) for text in OTHER_TEXTS]


def _identifiers() -> list[tuple[str, str]]:
    named = [(f, name) for f, names in IDENTIFIERS.items() for name in names] + [(UNKNOWN, name) for name in OTHER_IDENTIFIERS]
    return [(family, SPDX.format(name)) for family, name in named]


def _built_in_plain(spark: SparkSession) -> DataFrame:
    """A few plain sentences, so that there is training without any documents."""
    texts = (
        "The work is done under the terms agreed.",
        "A version of the text was released.",
        "It is available to the public.",
        "She asked for permission to use the room, and it was granted.",
        "Any person may obtain a copy of the book from the library.",
        "The software is provided by the school for the use of all students.",
        "This program is shown on Monday, in the hope that many will see it.",
        "You can find the file in the source of the page.",
        "He went to the house of the author to see the work and the general conditions there.",
        "The following list of names is in the documentation, with the source of each.",
        "A number of other people have worked on this, without any fee.",
    )
    return _literal(spark, [(CLASSES.index(NONE), t) for t in texts])


def _literal(spark: SparkSession, rows: list[tuple[int, str]]) -> DataFrame:
    structs = [F.struct(F.lit(label).alias("label"), F.lit(text).alias("text")) for label, text in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def _softmax(margin: Column, temperature: Column) -> Column:
    """Probabilities from an array of margins, whose sizes and sum are each found once."""
    with_top = F.transform(F.array(F.struct(margin.alias("m"), F.array_max(margin).alias("top"))), lambda z: F.transform(z["m"], lambda m: F.exp((m - z["top"]) / temperature)))
    powers = F.element_at(with_top, 1)
    with_sum = F.transform(
        F.array(powers), lambda x: F.struct(x.alias("x"), F.aggregate(x, F.lit(0.0), lambda a, y: a + y).alias("sum"))
    )
    return F.element_at(F.transform(with_sum, lambda z: F.transform(z["x"], lambda y: y / z["sum"])), 1)


def _temperature(model: LogisticRegressionModel, held: DataFrame) -> float:
    """The temperature under which the notices held out are most likely."""
    margins = model.transform(held).select("label", vector_to_array("rawPrediction").alias("margin"))
    tried = margins.select("label", "margin", F.explode(F.array(*[F.lit(t) for t in TEMPERATURES])).alias("t"))
    right = F.element_at(_softmax(F.col("margin"), F.col("t")), F.col("label").cast("int") + 1)
    best = tried.groupBy("t").agg(F.avg(-F.log(F.greatest(right, F.lit(1e-12)))).alias("loss")).orderBy("loss", "t").first()
    return best.t if best else 1.0


def findings(documents: DataFrame, classifier: Classifier, everywhere: bool = False) -> DataFrame:
    """doc_id, version, paragraph, family, p, overlap of all paragraphs that hold a notice; a wrapped one stands at its first line.

    With `everywhere` lines without a word that every finding has are looked at too, which finds the same.
    """
    kept = ["grams", "text", "before", "after"]
    key = ["doc_id", "version", "paragraph"]
    some = documents if everywhere else documents.where(classifier.speaking(whole("text")))
    lines = paragraphs(some) if everywhere else paragraphs(some).where(classifier.speaking(F.col("text")))
    rows = _with_grams(lines)
    margin = F.col("margin")
    # A class with more than half of the probability has the largest margin.
    plain = F.element_at(margin, CLASSES.index(NONE) + 1) > F.array_max(F.slice(margin, 1, CLASSES.index(NONE))) + ODDS * classifier.temperature
    maybe = classifier.margins(rows).where(~plain).dropDuplicates(key)
    scored = maybe.select("*", _softmax(margin, F.lit(classifier.temperature)).alias("p")).drop("margin")
    scored = staged(scored.withColumn("n", F.monotonically_increasing_id()), "licence-scored")
    p_none = F.element_at("p", CLASSES.index(NONE) + 1)
    known = F.slice("p", 1, len(FAMILIES))
    best = F.array_max(known)
    at = F.array_position(known, best).cast("int")
    notices = scored.where(p_none < 0.5).select(
        *key, *kept, "n", best.alias("p"), F.element_at(F.array(*map(F.lit, FAMILIES)), at).alias("likely")
    )
    compared = _with_name(_compared(notices, "n").withColumn("top", F.array_max("shares")), F.col("text"))
    own = F.array_max(F.filter("shares", lambda t: t["family"] == F.col("likely")))
    compared = compared.withColumn("own", own).withColumn("overlap", F.coalesce("own.share", F.lit(0.0)))
    # Of templates that are held alike the longest counts.
    rank = lambda t: F.struct(F.col(t)["share"], F.col(t)["size"])
    probable = F.col("p") >= LEAST_PROBABILITY
    by_name = probable & (F.col("name") == F.col("likely"))
    by_text = probable & (F.col("overlap") >= LEAST_OVERLAP) & (rank("own") >= rank("top")) & ~_tied()
    by_identifier = F.col("top.whole") & (F.col("top.share") == 1)
    family = F.when(by_identifier, F.col("top.family")).when(by_name, F.col("likely"))
    family = family.when(by_text & F.col("name").isNull(), F.col("likely")).otherwise(UNKNOWN)
    overlap = F.when(by_identifier, F.col("top.share")).when(by_name, 1.0).otherwise(F.col("overlap"))
    # Words of plain paragraphs that notices stood among in the training can look like a notice too.
    told = F.size(F.array_intersect("grams", F.split(F.lit("|".join(classifier.telling)), "[|]")))
    speaks = F.arrays_overlap("grams", F.array(*map(F.lit, CUES))) | (told >= LEAST_TELLING)
    alone = staged(
        compared.select(*key, family.alias("family"), "p", overlap.alias("overlap"), *kept)
        .where((F.col("family") != UNKNOWN) | speaks | F.col("name").isNotNull()),
        "licence-alone",
    )
    return _wrapped(documents, alone)


def _with_name(rows: DataFrame, text: Column, out: str = "name") -> DataFrame:
    """`rows` with the family of the longest licence name in the text, `UNKNOWN` of another licence or where it is denied.

    Null without a name. Each step is a column of its own, so that none is part of the next one many times.
    """
    signs = F.regexp_replace(lower_ascii(text), "[^a-z0-9.]+", " ")
    plain = F.regexp_replace(F.regexp_replace(signs, r"\.(?![0-9])|(?<![0-9])\.", " "), " +", " ")
    found = F.regexp_extract_all(F.col("_plain"), F.lit(f"({NAME})"), F.lit(1))
    rows = rows.withColumn("_plain", plain).withColumn("_found", found)
    longest = F.element_at(F.array_sort("_found", lambda a, b: F.length(b) - F.length(a)), 1)
    rows = rows.withColumn("_name", F.when(F.size("_found") > 0, longest))
    before = F.substr("_plain", F.lit(1), F.instr("_plain", F.col("_name")) - 1)
    families = F.map_from_arrays(F.split(F.lit("|".join(NAMES)), "[|]"), F.split(F.lit("|".join(NAMES.values())), "[|]"))
    family = F.when(before.rlike(DENIED), F.lit(UNKNOWN)).otherwise(F.try_element_at(families, F.col("_name")))
    return rows.withColumn(out, F.when(F.col("_name").isNotNull(), family)).drop("_plain", "_found", "_name")


def _templates() -> list[tuple[str, bool, list[str]]]:
    """Family, whether all of it must be there, words and word pairs."""
    texts = [(f, False, text) for f, text in _texts()] + [(f, True, text) for f, text in _identifiers()]
    out = []
    for family, all_of_it, text in texts:
        tokens = re.findall("[a-z0-9]+", text.lower())
        out.append((family, all_of_it, list(dict.fromkeys(tokens + [f"{a} {b}" for a, b in zip(tokens, tokens[1:])]))))
    return out


def _family_grams() -> Column:
    """For each family the words and word pairs of its names and templates."""
    held: dict[str, list[str]] = {}
    names = [(f, re.findall("[a-z0-9]+", name.lower())) for f, named in FAMILIES.items() for name in named]
    for family, grams_ in [(f, t + [f"{a} {b}" for a, b in zip(t, t[1:])]) for f, t in names] + [(f, g) for f, _, g in _templates()]:
        held.setdefault(family, []).extend(grams_)
    return F.array(
        *[F.struct(F.lit(f).alias("family"), F.split(F.lit("|".join(dict.fromkeys(g))), "[|]").alias("grams")) for f, g in held.items()]
    )


def _compared(rows: DataFrame, key: str) -> DataFrame:
    """`rows` (with grams and a unique key) and shares: share, size, whole, family of each template that they hold some of.

    The share is that of the words and word pairs of the template. These, some thousands, are
    broadcast; the rows' own meet them by a join.
    """
    templates = _templates()
    grams_of = [(gram, i) for i, (_, _, held) in enumerate(templates) for gram in held]
    kinds = [(i, family, all_of_it, len(held)) for i, (family, all_of_it, held) in enumerate(templates)]
    spark = rows.sparkSession
    by_gram = F.broadcast(spark.createDataFrame(grams_of, "gram string, template int"))
    by_template = F.broadcast(spark.createDataFrame(kinds, "template int, family string, whole boolean, size int"))
    met = rows.select(key, F.explode("grams").alias("gram")).join(by_gram, "gram").groupBy(key, "template").agg(F.count("*").alias("held"))
    part = F.col("held") / F.col("size")
    share = F.struct(F.when(F.col("whole") & (part < 1), 0.0).otherwise(part).alias("share"), "size", "whole", "family")
    shares = met.join(by_template, "template").groupBy(key).agg(F.collect_list(share).alias("shares"))
    none = F.array().cast("array<struct<share: double, size: int, whole: boolean, family: string>>")
    return rows.join(shares, key, "left").withColumn("shares", F.coalesce("shares", none))


def _wrapped(documents: DataFrame, alone: DataFrame) -> DataFrame:
    """`alone` with lines of unknown licences taken together where that gives a family.

    Taken together are lines of unknown licences that are next to each other or have one line between
    them, and the lines around, up to lines that hold nothing or are of a family. The notice then
    stands at the first line of an unknown licence; the other ones of it that are mostly of texts of
    the family are parts of it.
    """
    result = ["doc_id", "version", "paragraph", "family", "p", "overlap"]
    is_unknown, empty = F.col("family") == UNKNOWN, F.lit("")
    in_order = Window.partitionBy("doc_id", "version").orderBy("paragraph")

    def beside(step: Column, text: str) -> Column:
        """The line beside, empty where it is of a family."""
        away = F.lag if text == "before" else F.lead
        named = (away("paragraph").over(in_order) == F.col("paragraph") + step) & (away("family").over(in_order) != UNKNOWN)
        return F.struct((F.col("paragraph") + step).alias("at"), F.when(named, empty).otherwise(F.col(text)).alias("text"))

    gap = F.col("paragraph") - F.lag("paragraph").over(in_order)
    joins = (F.lag("family").over(in_order) == UNKNOWN) & ((gap == 1) | ((gap == 2) & (F.trim("before") != "")))
    here = F.struct(F.col("paragraph").alias("at"), "text")
    placed = alone.withColumn("lines", F.array(beside(F.lit(-1), "before"), here, beside(F.lit(1), "after"))).withColumn(
        "starts", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)
    )
    placed = placed.withColumn("block", F.sum("starts").over(in_order)).where(is_unknown)
    blocks = placed.groupBy("doc_id", "version", "block").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("lines"),
        F.array_sort(F.collect_list(F.struct("paragraph", "p", "overlap", "grams"))).alias("members"),
    )
    text = F.array_join(F.transform(F.filter("lines", lambda x: F.trim(x["text"]) != ""), lambda x: x["text"]), " ")
    blocks = _with_name(blocks, text).withColumn("tokens", words(text)).withColumn("grams", grams(F.col("tokens")))
    blocks = staged(blocks.drop("tokens", "lines").withColumn("n", F.monotonically_increasing_id()), "licence-blocks")
    blocks = _compared(blocks, "n").drop("n", "grams").withColumn("top", F.array_max("shares")).withColumn("tied", _tied()).drop("shares")
    by_text = (F.col("top.share") >= LEAST_OVERLAP) & (F.col("top.family") != UNKNOWN) & ~F.col("tied") & F.col("name").isNull()
    blocks = blocks.withColumn("family", F.when(F.col("name") != UNKNOWN, F.col("name")).when(by_text, F.col("top.family")))
    of_family = F.flatten(F.transform(F.filter(_family_grams(), lambda t: t["family"] == F.col("family")), lambda t: t["grams"]))
    blocks = blocks.withColumn("texts", F.when(F.col("family").isNotNull(), of_family).otherwise(F.array().cast("array<string>")))
    parts = F.filter("members", lambda m: 2 * F.size(F.array_intersect(m["grams"], F.col("texts"))) >= F.size(m["grams"]))
    rows = blocks.withColumn("parts", F.transform(parts, lambda m: m["paragraph"])).select(
        "doc_id", "version", F.col("family").alias("whole_family"), F.coalesce("top.share", F.lit(0.0)).alias("held"), "parts", F.explode("members").alias("member")
    )
    at = F.col("member.paragraph")
    first = F.coalesce(at == F.array_min("parts"), F.lit(False))
    rows = rows.where(first | ~F.array_contains("parts", at)).select(
        "doc_id", "version", at.alias("paragraph"), F.when(first, F.col("whole_family")).otherwise(UNKNOWN).alias("family"),
        F.col("member.p").alias("p"), F.when(first, F.col("held")).otherwise(F.col("member.overlap")).alias("overlap"),
    )
    return alone.where(~is_unknown).select(result).unionByName(rows)


def _tied() -> Column:
    """Whether templates of several families are held alike, so that the text does not tell them apart."""
    best = F.filter("shares", lambda t: (t["share"] == F.col("top.share")) & (t["size"] == F.col("top.size")))
    return F.size(F.array_distinct(F.transform(best, lambda t: t["family"]))) > 1


def scan(documents: DataFrame, classifier: Classifier | None = None) -> DataFrame:
    """One row per document: doc_id, n_paragraphs, families, n_confirmed, n_unknown, notices.

    `families` are the confirmed ones, in order and joined by commas; `notices` are
    paragraph:family of all notices, unknown ones too. Paragraphs are the lines of a text that hold
    something.

    A null or empty text has no paragraphs. Rows with a null doc_id and rows that repeat a doc_id
    with another text have findings of their own, rows that repeat both have the same. Other columns
    are not read. An empty table gives an empty result.
    """
    classifier = classifier or train(documents)
    found = findings(documents, classifier)
    by_text = staged(
        found.groupBy(F.col("doc_id").alias("d"), F.col("version").alias("v")).agg(
            F.array_sort(F.collect_set(F.struct("paragraph", "family"))).alias("found")
        ),
        "licence-found",
    )
    texts = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.xxhash64(whole("text")).alias("version"),
        F.size(F.filter(F.split(whole("text"), "\n", -1), lambda line: F.trim(line) != "")).cast("bigint").alias("n_paragraphs"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v"))
    found = F.coalesce("found", F.array().cast("array<struct<paragraph: int, family: string>>"))
    joined = texts.join(by_text, same, "left").withColumn("found", found)
    confirmed = F.filter("found", lambda n: n["family"] != UNKNOWN)
    families = F.array_sort(F.array_distinct(F.transform(confirmed, lambda n: n["family"])))
    return joined.select(
        "doc_id",
        "n_paragraphs",
        F.array_join(families, ",").alias("families"),
        F.size(confirmed).cast("bigint").alias("n_confirmed"),
        (F.size("found") - F.size(confirmed)).cast("bigint").alias("n_unknown"),
        F.array_join(F.transform("found", lambda n: F.concat_ws(":", n["paragraph"], n["family"])), ",").alias("notices"),
    )
