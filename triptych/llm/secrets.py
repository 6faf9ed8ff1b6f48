"""Secret scans over an incremental ledger of blobs.

Every version of a text is addressed by its content. The ledger records which versions of which
rules have been run on a blob and what they found; a scan reads the texts of those blobs only that
lack a rule version, once per blob, appends what it finds, and joins the findings back to all paths
that hold the blob.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triptych.llm.text import whole
from triptych.staging import new_path, staged

SPAN = "struct<start: int, kind: string, tag: string, end: int>"
LEDGER_FIELDS = ("blob string", "scanned array<string>", f"spans array<{SPAN}>")
LEDGER = ", ".join(LEDGER_FIELDS)
FOUND = "struct<start: int, place: bigint, kind: string, end: int>"
# Matches of a text are added up in blocks of this size.
BLOCK = 256


@dataclass(frozen=True)
class Rule:
    """Leftmost matches of `pattern` that do not overlap; `group` must have `least` characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def tag(self) -> str:
        return f"{self.kind}@{self.version}"


BASE = (
    Rule(
        "assign",
        1,
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=12,
    ),
    # A maximal run is found whole or not at all, so the least length can stand in the pattern.
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
)
MORE = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE


def scan(documents: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id, blob, found (spans in order of start, then of the rules).

    `ledger` is the folder of a ledger kept between runs; without one a new ledger is made.

    A null text is an empty one, in which nothing is found. Repeated rows, rows with a null doc_id
    and equal texts each give a row with the findings of their blob. Other columns are not read. An
    empty table gives an empty result.
    """
    spark = documents.sparkSession
    ledger = ledger or new_path(spark, "secrets-ledger")
    empty = [f"cast(null as {kind}) {name}" for name, kind in (f.split(" ", 1) for f in LEDGER_FIELDS)]
    spark.range(0).selectExpr(*empty).write.mode("append").parquet(ledger)
    texts = documents.select("doc_id", whole("text").alias("text")).withColumn("blob", F.sha2("text", 256))
    paths = staged(texts.select("doc_id", "blob"), "secrets-paths")
    blobs = paths.groupBy("blob").agg(F.min("doc_id").alias("first"))
    known = spark.read.schema(LEDGER).parquet(ledger)
    seen = known.groupBy("blob").agg(F.flatten(F.collect_set("scanned")).alias("seen"))
    every = F.array(*[F.lit(rule.tag) for rule in rules])
    lacking = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
    unseen = blobs.join(seen, "blob", "left").select("blob", "first", lacking.alias("todo")).where(F.size("todo") > 0)
    new = texts.join(
        unseen.withColumnRenamed("blob", "b"),
        (F.col("blob") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("first")),
    )
    found = _found(new.select("blob", "text", "todo"), rules).dropDuplicates(["blob"])
    found.write.mode("append").parquet(ledger)
    current = spark.read.schema(LEDGER).parquet(ledger)
    of_these = F.filter(F.array_distinct(F.flatten(F.collect_list("spans"))), lambda s: F.array_contains(every, s["tag"]))
    placed = F.transform(
        of_these,
        lambda s: F.struct(s["start"], F.array_position(every, s["tag"]).alias("place"), s["kind"], s["end"]),
    )
    findings = staged(  # written, so that the join below can split a blob that many paths hold
        current.where(F.size("spans") > 0).groupBy("blob").agg(F.array_sort(placed).alias("found")), "secrets-findings"
    )
    nothing = F.array().cast(f"array<{FOUND}>")
    return paths.join(findings, "blob", "left").select("doc_id", "blob", F.coalesce("found", nothing).alias("found"))


def _found(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """What the rules that a blob lacks find in it, as rows of the ledger."""
    hits = blobs.select(
        "blob", "todo", "text", *[c for i, rule in enumerate(rules) for c in _matches(rule, i)]
    )
    cut = hits.select(
        "*",
        *[
            F.when(F.size(f"m{i}") > 0, F.split("text", rule.pattern, -1)).alias(f"s{i}")
            for i, rule in enumerate(rules)
        ],
    )
    ends = cut.select("*", *[_ends(i).alias(f"e{i}") for i in range(len(rules))])
    spans = [_spans(rule, i) for i, rule in enumerate(rules)]
    return ends.select("blob", F.col("todo").alias("scanned"), reduce(F.concat, spans).alias("spans"))


def _matches(rule: Rule, i: int) -> list[Column]:
    """All matches of a rule, and the group whose length counts."""
    due = F.array_contains("todo", rule.tag)
    whole_match = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
    columns = [F.coalesce(F.when(due, whole_match), F.array().cast("array<string>")).alias(f"m{i}")]
    if rule.group:
        columns.append(F.when(due, F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group))).alias(f"v{i}"))
    return columns


def _ends(i: int) -> Column:
    """Where each match ends: the pieces between matches and the matches added up."""
    lengths = F.zip_with(F.slice(f"s{i}", F.lit(1), F.size(f"m{i}")), f"m{i}", lambda s, m: F.length(s) + F.length(m))
    return F.when(F.size(f"m{i}") > 0, running_sum(lengths))


def running_sum(numbers: Column) -> Column:
    """Sums up to each element. Appending copies, so elements are added up in blocks first."""
    no_numbers = F.array().cast("array<int>")
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / BLOCK).cast("int")),
        lambda k: F.slice(numbers, k * BLOCK + 1, F.lit(BLOCK)),
    )
    in_block = lambda block: F.aggregate(
        block, no_numbers, lambda sums, x: F.concat(sums, F.array(F.coalesce(F.try_element_at(sums, F.lit(-1)), F.lit(0)) + x))
    )
    return F.aggregate(
        blocks,
        no_numbers,
        lambda sums, block: F.concat(
            sums, F.transform(in_block(block), lambda x: x + F.coalesce(F.try_element_at(sums, F.lit(-1)), F.lit(0)))
        ),
    )


def _spans(rule: Rule, i: int) -> Column:
    start = lambda end, match: F.struct(
        (end - F.length(match)).alias("start"), F.lit(rule.kind).alias("kind"), F.lit(rule.tag).alias("tag"), end.alias("end")
    )
    spans = F.zip_with(f"e{i}", f"m{i}", start)
    if rule.group:
        long_enough = F.transform(f"v{i}", lambda v: F.length(v) >= rule.least)
        spans = F.transform(
            F.filter(F.arrays_zip(spans.alias("span"), long_enough.alias("fits")), lambda z: z["fits"]),
            lambda z: z["span"],
        )
    return F.coalesce(spans, F.array().cast(f"array<{SPAN}>"))


def span_digest(found: DataFrame, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """The findings as counts and text: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    kinds = [rule.kind for rule in base]

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(kind) for kind in kinds]
    in_base = F.filter("found", lambda s: s["kind"].isin(kinds))
    return found.select(
        "doc_id", *counts, F.sha2(_joined(in_base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans")
    )


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


_WORD = "(" + "|".join(
    ["[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]", "[Pp][Aa][Ss][Ss][Ww][Dd]", "[Ss][Ee][Cc][Rr][Ee][Tt]",
     "[Tt][Oo][Kk][Ee][Nn]", "[Aa][Pp][Ii]_?[Kk][Ee][Yy]"]
) + ")"
_SQL_PATTERNS = (
    ("assign", _WORD + """["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", 0, 1),
)
ORACLE = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ("
    + " UNION ALL ".join(
        f"SELECT doc_id, {i} AS place, '{kind}' AS kind, {least} AS least, regexp_extract_all(t, '{p}') AS m, "
        f"regexp_extract_all(t, '{p}', {group}) AS v, string_split_regex(t, '{p}') AS s FROM d"
        for i, (kind, p, group, least) in enumerate(_SQL_PATTERNS)
    )
    + """),
each AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m),
spans AS (
  SELECT doc_id, place, kind, e - length(m[i]) AS b, e FROM (
    SELECT *, list_sum(list_transform(s[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) AS e
    FROM each WHERE length(v[i]) >= least)),
joined AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || CAST(b AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY b, place) FILTER (place < 3) AS base,
         string_agg(kind || ':' || CAST(b AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY b, place) AS spans
  FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN joined USING (doc_id)"""
)
