"""Packing of tokenised documents into training sequences by minimum bin slack.

A document is cut into full windows and one remainder. Remainders are dealt into buckets of bounded
size; in a bucket only the lengths matter. Each window takes the longest remaining piece, and a
subset-sum dynamic programme over bitsets finds the multiset of other lengths that fills the window
closest to its capacity, with counts found by walking back through the bitsets.
"""

from __future__ import annotations

import re
import string
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from triptych.llm.text import whole
from triptych.staging import staged

WINDOW = 4096
# Id that closes each document.
CLOSING_ID = 2
# Pieces that meet in one task; one bucket leaves about one window half filled.
BUCKET_PIECES = 20_000
# Words whose ids a worker remembers.
REMEMBERED_WORDS = 800_000
LONGEST_REMEMBERED = 64
# Words of small letters up to U+00FF, which the tokenizer's normalisation leaves as they are.
PLAIN_LETTERS = [c for c in map(chr, range(0x100)) if c.isalpha() and c == c.lower() and c not in "\xaa\xb5\xba"]
PLAIN_WORD = re.compile(f"[{''.join(PLAIN_LETTERS)}]+").fullmatch
TEXT_BLOCK = 1 << 20

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
PACKED = PIECES + ", sequence_id bigint, offset bigint"


class WordEncoder:
    """Ids of texts by a tokenizer that never joins characters across white space.

    Ids of words are remembered, up to a bound. Lower-casing ASCII letters, and cutting a run of
    punctuation off a word that ends in a letter before it once normalised, give the same ids for
    this tokenizer, which makes most words known ones. Unknown words of small Latin letters go to its model alone.
    """

    def __init__(self, file: str, remembered: int = REMEMBERED_WORDS):
        self.tokenizer = Tokenizer.from_file(file)
        # Characters that words end in, and whether they stay letters.
        self.letters: dict[str, bool] = {}
        self.remembered = remembered
        self.known: dict[str, bytes] = {}
        # The model sees the bytes of a word, each as a character.
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.bytes_of = str.maketrans({letter: split(letter)[0][0] for letter in PLAIN_LETTERS})

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids of the whole text."""
        return b"".join(self._words(block) for block in _blocks(text))

    def _words(self, text: str) -> bytes:
        words = text.replace("\n", " ").split(" ")
        found = list(map(self.known.get, words))
        if None in found:
            fresh = self._learn({word for word, ids in zip(words, found) if ids is None})
            found = [fresh[word] if ids is None else ids for word, ids in zip(words, found)]
        return b"".join(found)

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        plain = set(filter(PLAIN_WORD, words))
        parts = {word: self._parts(word) for word in words - plain}
        unknown = {part for some in parts.values() for part in some if part not in self.known}
        plain.update(filter(PLAIN_WORD, unknown))
        # To the tokenizer such a word is one word that normalisation leaves as it is, so its model is enough.
        tokenize, table = self.tokenizer.model.tokenize, self.bytes_of
        fresh = {}
        for word in plain:
            ids = [token.id for token in tokenize(word.translate(table))]
            fresh[word] = struct.pack(f"<{len(ids)}I", *ids)
        for part in unknown - plain:
            fresh[part] = self._encode(part)
        for word, some in parts.items():
            if word not in fresh:
                fresh[word] = b"".join([fresh[p] if p in fresh else self.known[p] for p in some])
        if len(self.known) + len(fresh) > self.remembered:
            self.known.clear()
        self.known.update((word, ids) for word, ids in fresh.items() if len(word) <= LONGEST_REMEMBERED)
        return fresh

    def _encode(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _parts(self, word: str) -> list[str]:
        """Parts of a word whose ids follow each other."""
        if "|>" in word:  # it may hold a special token
            return [word]
        core = word.rstrip(string.punctuation)
        rest = []
        if len(core) < len(word) and self._ends_in_letter(core):
            rest, word = [word[len(core) :]], core
        return [word.lower() if word.isascii() else word, *rest]

    def _ends_in_letter(self, core: str) -> bool:
        """Whether the core still ends in a letter once normalised: some letters end in a mark then,
        which the tokenizer joins to the punctuation that follows."""
        last = core[-1:]
        if last not in self.letters:
            self.letters[last] = last.isalpha() and self.tokenizer.normalizer.normalize_str(last)[-1:].isalpha()
        return self.letters[last]


def _blocks(text: str) -> Iterator[str]:
    """The text cut at spaces, so that a very long one is not split into words at once."""
    start = 0
    while len(text) - start > TEXT_BLOCK:
        end = text.find(" ", start + TEXT_BLOCK)
        if end < 0:
            break
        yield text[start:end]
        start = end + 1
    yield text[start:] if start else text


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(file: str) -> WordEncoder:
    """The encoder of this worker."""
    if file not in _ENCODERS:
        _ENCODERS[file] = WordEncoder(file)
    return _ENCODERS[file]


def cut_documents(documents: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """Full windows and one remainder of each document: doc_id, start, length, ids_crc32, doc_tokens."""
    closing = np.array([CLOSING_ID], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).ids
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                rows = [[] for _ in range(5)]
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = encode(text) + closing
                    tokens = len(ids) // 4
                    for start in range(0, tokens, window):
                        piece = ids[4 * start : 4 * (start + window)]
                        for column, value in zip(rows, (doc_id, start, len(piece) // 4, zlib.crc32(piece), tokens)):
                            column.append(value)
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names)

    return documents.select(F.col("doc_id").cast("bigint"), whole("text")).mapInArrow(cut, PIECES)


def pack(
    documents: DataFrame, tokenizer: str, window: int = WINDOW, bucket_pieces: int = BUCKET_PIECES
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every document is in exactly one piece, and the pieces of a sequence follow each
    other from 0 without gaps and have at most `window` ids together.

    A null or empty text is the closing id alone. Rows with a null doc_id and repeated rows are
    documents of their own. Other columns are not read. An empty table gives an empty result.
    """
    pieces = staged(
        cut_documents(documents, tokenizer, window).withColumn("row", F.monotonically_increasing_id()), "pack-pieces"
    )
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    full = pieces.where(F.col("length") == window).select(
        *columns, (F.col("row") * 2).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    rest = pieces.where(F.col("length") < window)
    buckets = max(1, -(-rest.count() // bucket_pieces))
    dealt = rest.select(*columns, "row", F.pmod(F.xxhash64("row"), F.lit(buckets)).alias("bucket"))

    def fill(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        piece, sequence, offset = _fill(table.column("length").to_numpy(), window)
        taken = table.select(columns).take(pa.array(piece))
        sequence_id = ((key[0].as_py() << 32) + sequence) * 2 + 1
        return taken.append_column("sequence_id", pa.array(sequence_id)).append_column("offset", pa.array(offset))

    return full.unionByName(dealt.groupBy("bucket").applyInArrow(fill, PACKED))


def _fill(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces in the order of their sequences, with sequence and offset."""
    order = np.argsort(lengths, kind="stable")
    values, firsts, counts = np.unique(lengths[order], return_index=True, return_counts=True)
    held = dict(zip(values.tolist(), counts.tolist()))
    pieces = {value: order[first : first + count] for value, first, count in zip(values.tolist(), firsts, counts)}
    out_piece, out_sequence, out_offset = [], [], []
    for sequence, chosen in enumerate(fill_windows(held, window)):
        offset = 0
        for length, count in chosen:
            mine, pieces[length] = pieces[length][:count], pieces[length][count:]
            out_piece.extend(mine.tolist())
            out_sequence.extend([sequence] * count)
            out_offset.extend(range(offset, offset + length * count, length))
            offset += length * count
    return tuple(np.array(column, dtype=np.int64) for column in (out_piece, out_sequence, out_offset))


def fill_windows(held: dict[int, int], window: int) -> Iterator[list[tuple[int, int]]]:
    """Lengths and counts of one window after the other, until no piece is left."""
    held = dict(held)
    lengths = sorted(held, reverse=True)
    while lengths:
        longest = lengths[0]
        held[longest] -= 1
        chosen = [(longest, 1), *closest_sum(lengths, held, window - longest)]
        for length, count in chosen[1:]:
            held[length] -= count
        if any(not held[length] for length, _ in chosen):
            lengths = [length for length in lengths if held[length]]
        yield chosen


def closest_sum(lengths: list[int], held: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """The multiset of held lengths with the largest sum up to `capacity`.

    Bit s of a bitset says that sum s can be reached; lengths come longest first, until the whole
    capacity is reached or none is left.
    """
    within, goal = (1 << (capacity + 1)) - 1, 1 << capacity
    steps, reach = [], 1
    for length in lengths:
        if length > capacity or not held[length]:
            continue
        steps.append((length, reach))
        left, chunk = min(held[length], capacity // length), 1
        while left:
            taken = min(chunk, left)
            reach |= (reach << (length * taken)) & within
            left, chunk = left - taken, chunk * 2
        if reach & goal:
            break
    total, chosen = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        count = 0
        while not (before >> total) & 1:
            total, count = total - length, count + 1
        if count:
            chosen.append((length, count))
    return chosen
