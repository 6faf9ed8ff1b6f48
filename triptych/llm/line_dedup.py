"""Removal of repeated passages, by pairs of lines or by content-defined chunks.

`passage_removals` finds every repeat of two lines or more. A hash is rolled over each line that
holds something and the next such line. Pairs whose hashes occur more than once are compared byte by
byte, and those that are not the first of their kind are joined to maximal runs of lines, which are
cut out.

`removals` only finds whole chunks. A rolling hash over the hashes of the last lines decides after
which line a chunk ends, so that the chunks of a passage are mostly the same wherever it stands.
Chunks of several lines that occur more than once are compared byte by byte, and all but the first
occurrence are cut out. What a repeat has outside of such chunks stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triptych.llm.hashing import PLACE, U64, mix
from triptych.llm.text import whole
from triptych.staging import staged

# Lines whose hashes are rolled together, and the mean lines of a chunk.
ROLLED = 2
MEAN_LINES = 3
# Lines that hold something, in a chunk that may be removed.
LEAST_LINES = 2
# Passages are handed over in batches of about so many characters.
BATCH_CHARS = 1 << 22

CHUNKS = "doc_id bigint, version bigint, place int, chunk bigint, first int, lines int"
OCCURRENCES = "doc_id bigint, version bigint, place int, chunk bigint, passage string, first int, lines int"
PAIRS = "doc_id bigint, version bigint, keys array<bigint>"
PAIR_OCCURRENCES = "doc_id bigint, version bigint, place int, key bigint, passage string, lines int"
CUTS = "doc_id bigint, v bigint, cuts array<struct<first: int, lines: int>>"


def line_chunks(lines: list[str]) -> list[tuple[int, int]]:
    """Where each chunk of a text begins and ends, in lines."""
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(line) for line in lines), dtype=U64, count=len(lines))
    rolled = np.zeros(len(lines), dtype=U64)
    for back in range(ROLLED):
        rolled[back:] += hashes[: len(lines) - back] * PLACE[back]
    ends = np.flatnonzero(mix(rolled) % U64(MEAN_LINES) == 0) + 1
    ends = ends[(ends >= ROLLED) & (ends < len(lines))].tolist() + [len(lines)]
    return list(zip([0, *ends], ends))


def line_pairs(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The lines that hold something, and a hash of the lines from each to the next."""
    filled = np.fromiter((bool(line.strip()) for line in lines), dtype=bool, count=len(lines))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(line) for line in lines), dtype=U64, count=len(lines))
    at = np.flatnonzero(filled)
    # Sums over the lines between, which hold nothing.
    between = np.cumsum(np.where(filled, U64(0), mix(hashes)), dtype=U64)[at]
    rolled = hashes[at[:-1]] * PLACE[1] + hashes[at[1:]] * PLACE[0] + np.diff(between) * PLACE[2]
    return at, mix(rolled + np.diff(at).astype(U64) * PLACE[3])


def line_dedup(documents: DataFrame, find: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """`documents` with the repeated passages cut out of `text`; all other columns are as they were.

    `find` is `removals` unless given, or `passage_removals`. Of equal chunks the one of the smallest doc_id stays, the first in its text. Chunks of fewer
    than two lines that hold something are never cut.

    A null text stays null, an empty one empty. Rows with a null doc_id come before all others.
    Rows that repeat a doc_id with another text are told apart; rows that repeat both are one
    document, and each of them has its result. An empty table gives an empty result.
    """
    removed = (find or removals)(documents)
    kept = F.struct("*")
    rows = documents.select(kept.alias("row"), F.col("doc_id").cast("bigint").alias("id"), _version().alias("version"))
    cut = rows.join(removed.hint("merge"), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("version") == F.col("v")), "left")
    text = F.when(F.col("cuts").isNull(), F.col("row.text")).otherwise(without_lines("row.text", "cuts"))
    return cut.select(F.col("row").withField("text", text).alias("row")).select("row.*")


def line_report(documents: DataFrame, find: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """doc_id, n_lines, n_removed, n_chunks (removed; runs with `passage_removals`), kept_sha256 of every document."""
    removed = (find or removals)(documents)
    rows = documents.select(F.col("doc_id").cast("bigint").alias("id"), whole("text").alias("text"), _version().alias("version"))
    cut = rows.join(removed.hint("merge"), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("version") == F.col("v")), "left")
    kept = F.when(F.col("cuts").isNull(), F.col("text")).otherwise(without_lines("text", "cuts"))
    lengths = F.transform("cuts", lambda c: c["lines"])
    total = F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, n: a + n)
    count = F.length("text") - F.length(F.translate("text", "\n", "")) + 1
    return cut.select(
        F.col("id").alias("doc_id"),
        F.when(F.col("text") == "", 0).otherwise(count).cast("bigint").alias("n_lines"),
        F.coalesce(total, F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce(F.size("cuts"), F.lit(0)).cast("bigint").alias("n_chunks"),
        F.sha2(kept, 256).alias("kept_sha256"),
    )


def removals(documents: DataFrame) -> DataFrame:
    """doc_id, v (hash of the text), cuts: the lines to cut out of each document that has any."""
    texts = documents.select(F.col("doc_id").cast("bigint"), whole("text").alias("text"), _version().alias("version"))
    chunks = staged(texts.mapInArrow(_chunks, CHUNKS), "line-chunks")
    counted = chunks.groupBy("chunk").agg(F.count("*").alias("n"))
    repeated = staged(counted.where("n > 1").select("chunk"), "line-repeated")
    planned = staged(
        chunks.join(repeated, "chunk")
        .groupBy(F.col("doc_id").alias("d"), F.col("version").alias("v"))
        .agg(F.collect_set(F.struct("place", "chunk", "first", "lines")).alias("chunks")),
        "line-planned",
    )
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v"))
    occurrences = staged(
        texts.join(planned.hint("merge"), same).select("doc_id", "version", "text", "chunks").mapInArrow(_passages, OCCURRENCES),
        "line-occurrences",
    )
    # Grouping and joining on the passage itself compares the bytes.
    this = F.struct("doc_id", "version", "place")
    firsts = staged(occurrences.groupBy("chunk", "passage").agg(F.min(this).alias("kept")), "line-firsts")
    return staged(
        occurrences.join(firsts, ["chunk", "passage"])
        .where(this != F.col("kept"))
        .groupBy("doc_id", F.col("version").alias("v"))
        .agg(F.array_sort(F.collect_set(F.struct("first", "lines"))).alias("cuts")),
        "line-cuts",
    )


def passage_removals(documents: DataFrame) -> DataFrame:
    """doc_id, v (hash of the text), cuts: the lines of each document that repeat earlier passages.

    A passage is a run of lines, the first and last of which hold something, and are not the same
    line. A line is cut if it is in a passage that begins earlier too: in a document that comes
    before in order of doc_id (nulls first, then by the hash of the text), or earlier in its own.
    The first occurrence of a line always stays. Cuts are maximal and in order.
    """
    texts = documents.select(F.col("doc_id").cast("bigint"), whole("text").alias("text"), _version().alias("version"))
    pairs = staged(texts.mapInArrow(_pairs, PAIRS), "line-pairs")
    counted = pairs.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    repeated = staged(counted.where("n > 1").select("key"), "line-pairs-repeated")
    planned = staged(
        pairs.select("doc_id", "version", F.posexplode("keys").alias("place", "key"))
        .join(repeated, "key")
        .groupBy(F.col("doc_id").alias("d"), F.col("version").alias("v"))
        .agg(F.collect_set(F.struct("place", "key")).alias("pairs")),
        "line-pairs-planned",
    )
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v"))
    occurrences = staged(
        texts.join(planned.hint("merge"), same).select("doc_id", "version", "text", "pairs").mapInArrow(_pair_passages, PAIR_OCCURRENCES),
        "line-pairs-occurrences",
    )
    # Grouping on the passage itself compares the bytes.
    this = F.struct("doc_id", "version", "place")
    firsts = staged(occurrences.groupBy("key", "passage").agg(F.min(this).alias("kept")), "line-pairs-firsts")
    by_key = staged(firsts.groupBy("key").agg(F.count("*").alias("n"), F.min("kept").alias("kept")), "line-pairs-keys")
    columns = ["doc_id", "version", "place", "lines"]
    later = occurrences.drop("passage").join(by_key, "key").where((F.col("n") == 1) & (this != F.col("kept"))).select(columns)
    # Different passages under one hash: only these are told apart by their text again.
    shared = by_key.where("n > 1").select("key")
    if not shared.isEmpty():
        apart = firsts.join(shared, "key")
        later = later.unionByName(occurrences.join(apart, ["key", "passage"]).where(this != F.col("kept")).select(columns))
    spans = later.groupBy("doc_id", F.col("version").alias("v")).agg(F.collect_set(F.struct("place", "lines")).alias("spans"))
    return staged(spans.mapInArrow(_runs, CUTS), "line-pairs-cuts")


def _version() -> Column:
    return F.xxhash64(whole("text"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            columns = [[] for _ in range(6)]
            for doc_id, text, version in zip(*[c.to_pylist() for c in part.columns]):
                lines = text.split("\n")
                for place, (first, end) in enumerate(line_chunks(lines)):
                    mine = lines[first:end]
                    if end - first >= LEAST_LINES and sum(map(bool, map(str.strip, mine))) >= LEAST_LINES:
                        chunk = xxhash.xxh3_64_intdigest("\n".join(mine)) - (1 << 63)
                        for column, value in zip(columns, (doc_id, version, place, chunk, first, end - first)):
                            column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
            names = ["doc_id", "version", "place", "chunk", "first", "lines"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            columns = [[] for _ in range(7)]
            for doc_id, version, text, chunks in zip(*[c.to_pylist() for c in part.columns]):
                lines = text.split("\n")
                for c in chunks:
                    passage = "\n".join(lines[c["first"] : c["first"] + c["lines"]])
                    row = (doc_id, version, c["place"], c["chunk"], passage, c["first"], c["lines"])
                    for column, value in zip(columns, row):
                        column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int32()]
            names = ["doc_id", "version", "place", "chunk", "passage", "first", "lines"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            doc_id, text, version = batch.slice(at, 512).columns
            keys = [line_pairs(t.split("\n"))[1].view(np.int64) for t in text.to_pylist()]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays([doc_id, version, lists], ["doc_id", "version", "keys"])


def _pair_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int32()]
    names = ["doc_id", "version", "place", "key", "passage", "lines"]
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            columns, size = [[] for _ in names], 0
            for doc_id, version, text, pairs in zip(*[c.to_pylist() for c in batch.slice(at, 512).columns]):
                lines = text.split("\n")
                filled = [k for k, line in enumerate(lines) if line.strip()]
                for pair in pairs:
                    first, last = filled[pair["place"]], filled[pair["place"] + 1]
                    passage = "\n".join(lines[first : last + 1])
                    row = (doc_id, version, first, pair["key"], passage, last + 1 - first)
                    for column, value in zip(columns, row):
                        column.append(value)
                    size += len(passage)
                    if size > BATCH_CHARS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
                        columns, size = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans that overlap or meet, joined."""
    for batch in batches:
        doc_id, version, spans = batch.columns
        cuts = []
        for mine in spans.to_pylist():
            runs = []
            for first, end in sorted((s["place"], s["place"] + s["lines"]) for s in mine):
                if runs and first <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], end)
                else:
                    runs.append([first, end])
            cuts.append([{"first": first, "lines": end - first} for first, end in runs])
        kind = pa.list_(pa.struct([("first", pa.int32()), ("lines", pa.int32())]))
        yield pa.RecordBatch.from_arrays([doc_id, version, pa.array(cuts, kind)], ["doc_id", "v", "cuts"])


def without_lines(text: str, cuts: str) -> Column:
    """The text without the lines of `cuts` (first, lines)."""

    @F.arrow_udf("string")
    def cut(text: pa.Array, cuts: pa.Array) -> pa.Array:
        out = []
        for t, spans in zip(text, cuts):
            lines, kept, at = (t.as_py() or "").split("\n"), [], 0
            for span in spans.as_py() or []:
                kept += lines[at : span["first"]]
                at = span["first"] + span["lines"]
            out.append("\n".join(kept + lines[at:]))
        return pa.array(out, pa.string())

    return cut(F.col(text), F.col(cuts))
