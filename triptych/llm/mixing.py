"""Mixing of sources to target weights by iterative proportional fitting.

Tokens are counted by cells of source, language and topic. The weights of the cells are raked until
their marginals are the targets; the probability of a document is that of its cell, scaled so that
the expected tokens of the sample are the budget.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triptych.llm.text import whole
from triptych.staging import drop_staged, staged

# Words that place a text in a topic; the first that is found counts.
TOPICS = (
    ("legal", "[Ll]icensed under|[Rr]eleased under|[Cc]opyright"),
    ("contact", "[A-Za-z0-9]@[A-Za-z0-9-]+[.][a-z]"),
    ("table", " [|] [^|\n]* [|] "),
    ("list", "(^|\n)[-*] "),
)
OTHER_TOPIC = "general"
DIMENSIONS = ("source", "lang", "topic")
# A target share in proportion to the present share to this power: below 1, small values gain.
TARGETS: Mapping[str, float | Mapping[str, float]] = {"source": 0.7, "lang": 0.8, "topic": 0.9}
# Expected share of all tokens in the sample.
TOKEN_SHARE = 0.8
SWEEPS = 50
TOLERANCE = 1e-9
WORD = "[^\\x20\\x09-\\x0D]+"
SEED = "mix"


def topic(text: Column) -> Column:
    """The topic of a text by its first cue."""
    chosen = F.lit(OTHER_TOPIC)
    for name, cue in reversed(TOPICS):
        chosen = F.when(text.rlike(cue), name).otherwise(chosen)
    return chosen


def mix_sources(
    documents: DataFrame,
    targets: Mapping[str, float | Mapping[str, float]] = TARGETS,
    token_share: float = TOKEN_SHARE,
    seed: str = SEED,
) -> DataFrame:
    """doc, source, lang, topic, tokens, probability, kept: `doc` is the row of `documents`.

    A target is either a power of the present token share, or the shares by value; values that are
    left out then have none. The draw depends on doc_id and `seed` alone.

    A null source or language counts as an empty one, a null text as empty. Texts without words
    weigh nothing and have the probability of their cell; a cell without words has probability 1.
    A row with a null doc_id is drawn by its text; repeated rows are drawn together. Other columns
    are only handed on. An empty table gives an empty result.
    """
    rows = _placed(documents)
    cells = staged(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "mix-cells")
    fitted = rake(_with_targets(cells, targets))
    probability = staged(calibrated(fitted, token_share), "mix-probability")
    key = F.coalesce(F.col("doc.doc_id").cast("string"), F.md5(whole("doc.text")))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), key)), 1, 8), 16, 10).cast("double") / 2**32
    chance = F.coalesce("probability", F.lit(1.0))
    return rows.join(probability, list(DIMENSIONS), "left").select(
        "doc", *DIMENSIONS, "tokens", chance.alias("probability"), (draw < chance).alias("kept")
    )


def _placed(documents: DataFrame) -> DataFrame:
    text = whole("doc.text")
    return documents.select(F.struct("*").alias("doc")).select(
        "doc",
        whole("doc.source").alias("source"),
        whole("doc.lang").alias("lang"),
        topic(text).alias("topic"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("tokens"),
    )


def _with_targets(cells: DataFrame, targets: Mapping[str, float | Mapping[str, float]]) -> DataFrame:
    """The cells with a weight, their tokens, and the target share of each of their values."""
    weighted = cells.where("tokens > 0").withColumn("weight", F.col("tokens").cast("double"))
    for name in DIMENSIONS:
        present = cells.where("tokens > 0").groupBy(name).agg(F.sum("tokens").cast("double").alias("present"))
        wanted = targets[name]
        if isinstance(wanted, Mapping):
            shares = F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair]) if wanted else F.lit(None)
            share = F.coalesce(F.try_element_at(shares, F.col(name)), F.lit(0.0)) if wanted else F.lit(0.0)
        else:
            share = F.pow("present", F.lit(float(wanted)))
        sized = staged(present.select(name, share.alias(f"to_{name}")), "mix-targets")
        total = sized.agg(F.sum(f"to_{name}")).first()[0] or 1.0
        weighted = weighted.join(sized.withColumn(f"to_{name}", F.col(f"to_{name}") / F.lit(total)), name)
    return staged(weighted, "mix-weights")


def rake(weights: DataFrame, sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """`weights` scaled to shares whose marginals are the targets.

    A sweep fits one dimension after the other; it is the last one when the marginals that it found
    were the targets already.
    """
    state = weights
    for _ in range(sweeps):
        before, swept = state, state
        for name in DIMENSIONS:
            held = F.sum("weight").over(Window.partitionBy(name))
            factor = F.when(held > 0, F.col(f"to_{name}") / held).otherwise(0.0)
            off = F.when(held > 0, F.abs(held - F.col(f"to_{name}"))).otherwise(0.0)
            swept = swept.withColumn(f"off_{name}", off).withColumn("weight", F.col("weight") * factor)
        state = staged(swept, "mix-weights")
        worst = state.agg(F.max(F.greatest(*[f"off_{name}" for name in DIMENSIONS]))).first()[0]
        state = state.drop(*[f"off_{name}" for name in DIMENSIONS])
        drop_staged(before)
        if worst is None or worst < tolerance:
            break
    return state


def calibrated(weights: DataFrame, token_share: float) -> DataFrame:
    """The cells with the probability of their documents, at most 1.

    The scale is found by setting cells that would be drawn more than once to probability 1 and
    sharing the rest of the budget among the others, until no more cells reach 1.
    """
    total = weights.agg(F.sum("tokens")).first()[0] or 0
    budget, scale = token_share * total, None
    while True:
        full = F.lit(False) if scale is None else F.col("weight") * scale >= F.col("tokens")
        row = weights.agg(
            F.sum(F.when(full, F.col("tokens"))).alias("tokens"), F.sum(F.when(~full, F.col("weight"))).alias("weight")
        ).first()
        before, scale = scale, (budget - (row.tokens or 0)) / row.weight if row.weight else scale or 0.0
        if scale == before:
            break
    probability = F.least(F.lit(1.0), F.col("weight") * F.lit(scale) / F.col("tokens"))
    return weights.select(*DIMENSIONS, probability.alias("probability"))


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    cues = " ".join(f"WHEN regexp_matches(t, {q(cue)}) THEN {q(name)}" for name, cue in TOPICS)
    parts = [
        f"""d AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, CASE {cues} ELSE 'general' END AS topic,
         len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS tokens
  FROM (SELECT *, coalesce(text, '') AS t FROM documents)),
cells AS (SELECT source, lang, topic, CAST(sum(tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL HAVING sum(tokens) > 0)"""
    ]
    for name in DIMENSIONS:
        parts.append(
            f"to_{name} AS (SELECT {name}, p / sum(p) OVER () AS to_{name} FROM ("
            f"SELECT {name}, pow(sum(tokens), {TARGETS[name]}) AS p FROM cells GROUP BY {name}))"
        )
    parts.append(
        "w0 AS (SELECT *, CAST(tokens AS DOUBLE) AS w FROM cells JOIN to_source USING (source) "
        "JOIN to_lang USING (lang) JOIN to_topic USING (topic))"
    )
    step = 0
    for _ in range(15):
        for name in DIMENSIONS:
            parts.append(
                f"w{step + 1} AS MATERIALIZED (SELECT * REPLACE (w * to_{name} / sum(w) OVER (PARTITION BY {name}) AS w) FROM w{step})"
            )
            step += 1
    parts.append(f"""scale AS (
  SELECT 0 AS n, {TOKEN_SHARE} * sum(tokens) / sum(w) AS k FROM w{step}
  UNION ALL
  SELECT n + 1, (SELECT ({TOKEN_SHARE} * sum(tokens) - coalesce(sum(tokens) FILTER (w * k >= tokens), 0))
                        / sum(w) FILTER (w * k < tokens) FROM w{step}) FROM scale WHERE n < 20),
p AS (SELECT source, lang, topic, least(1.0, w * (SELECT k FROM scale WHERE n = 20) / tokens) AS p FROM w{step})""")
    return f"""WITH RECURSIVE {", ".join(parts)}
SELECT doc_id, source, lang, topic, tokens, round(coalesce(p, 1.0), 6) AS probability,
       CAST('0x' || substr(md5('{SEED}:' || doc_id), 1, 8) AS BIGINT) / 4294967296.0 < coalesce(p, 1.0) AS kept
FROM d LEFT JOIN p USING (source, lang, topic)"""


ORACLE = _sql()
