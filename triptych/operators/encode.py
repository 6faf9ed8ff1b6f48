"""Texts to unit vectors with a pluggable encoder."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[Sequence[str]], np.ndarray]

# Fixed value: texts handed to the encoder at a time.
BATCH = 32
# Texts of the hashing encoder's batches, and words that it remembers.
HASHED_TOGETHER = 512
REMEMBERED_WORDS = 1_000_000


def embed_texts(
    df: DataFrame, key: str, text: str, make_encoder: Callable[[], Encoder], batch: int = BATCH
) -> DataFrame:
    """`key` and the unit vector of the text of every row; a missing text counts as empty.

    `make_encoder` runs once per task, so that a model is loaded once and not per row or batch. An
    encoder with an attribute `batch` gets as many texts at a time, others `batch` of them.
    """
    if text not in df.columns:
        raise ValueError(f"the column {text} is required")
    source = df.select(F.col(key), F.coalesce(text, F.lit("")).alias("text"))
    kind = source.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make_encoder()
        step = getattr(encoder, "batch", batch)
        for rows in batches:
            texts = rows.column("text").to_pylist()
            if not texts:
                continue
            parts = [
                unit_rows(np.asarray(encoder(texts[at : at + step]), dtype=np.float64))
                for at in range(0, len(texts), step)
            ]
            vectors = np.concatenate(parts).astype(np.float32)
            offsets = np.arange(0, vectors.size + 1, vectors.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [rows.column(key), pa.ListArray.from_arrays(offsets, vectors.ravel())], [key, "embedding"]
            )

    return source.mapInArrow(encode, f"`{key}` {kind}, embedding array<float>")


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def word_numbers(codes: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit number for each word, from its characters and their places in it."""
    size = end - first
    word = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
    letter = codes[first[word] + place].astype(np.uint64)
    mixed = (letter + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.add.reduceat(mixed ^ (mixed >> np.uint64(31)), np.cumsum(size) - size)


def hashing_encoder(dim: int = 384) -> Callable[[], Encoder]:
    """Stand-in for a sentence model where none is installed: signed word counts, hashed to `dim`.

    Word and sign come from the MD5 of the word, so vectors are the same in every engine. All texts
    of a batch are one array of code points: words, their texts and sums are found in array
    operations, and only words not seen before are looked at one by one.
    """

    def make() -> Encoder:
        is_word = np.fromiter((c.isalnum() or c == "_" for c in map(chr, range(sys.maxunicode + 1))), dtype=bool)
        known: dict[int, int] = {}

        def places(joined: str, hashes: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
            """For each word twice the element that it counts in, and one more for a minus."""
            if len(known) > REMEMBERED_WORDS:
                known.clear()
            for h, at, n in zip(hashes.tolist(), first.tolist(), size.tolist()):
                if h not in known:
                    digest = hashlib.md5(joined[at : at + n].encode("utf-8", "surrogatepass")).hexdigest()
                    known[h] = int(digest[:8], 16) % dim * 2 + int(digest[8], 16) % 2
            return np.array([known[h] for h in hashes.tolist()], dtype=np.int64)

        def encode(texts: Sequence[str]) -> np.ndarray:
            joined = "\0".join(texts).lower()
            if joined.count("\0") >= len(texts):  # some text holds the mark between texts
                joined = "\0".join([t.replace("\0", " ") for t in texts]).lower()
            codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            edges = np.flatnonzero(np.diff(is_word[codes].astype(np.int8), prepend=0, append=0))
            first, end = edges[::2], edges[1::2]
            long = end - first >= 2
            first, end = first[long], end[long]
            if not len(first):
                return np.zeros((len(texts), dim))
            hashes = word_numbers(codes, first, end)
            unique, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            place = places(joined, unique, first[where], (end - first)[where])[inverse]
            text = np.searchsorted(np.flatnonzero(codes == 0), first)
            signs = 1.0 - 2.0 * (place & 1)
            return np.bincount(text * dim + (place >> 1), signs, len(texts) * dim).reshape(len(texts), dim)

        encode.batch = HASHED_TOGETHER
        return encode

    return make
