"""Hashes of words, shingles and byte strings of whole text columns, in NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
# Texts are hashed together up to this many bytes; a longer one is hashed in blocks of this size.
CHUNK = 1 << 18
_RANDOM = np.random.default_rng(20240229)
BYTE = _RANDOM.integers(0, 1 << 64, 256, dtype=U64)
PLACE = _RANDOM.integers(0, 1 << 64, 8, dtype=U64) | U64(1)
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, count: int) -> np.ndarray:
    steps = np.full(count, base, dtype=U64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


POWERS = _powers(BASE, CHUNK + 1)
INVERSE_POWERS = _powers(BASE_INVERSE, CHUNK + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Each number well mixed (the finaliser of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column without nulls, and where each text begins (one more than texts)."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    bytes_ = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return bytes_, offsets


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most `size` bytes; a longer text is a run of its own."""
    first, last = 0, len(offsets) - 1
    while first < last:
        after = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        after = min(max(after, first + 1), last)
        yield first, after
        first = after


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z in lower case, and how many words begin before each text start.

    `starts` are the offsets of the texts in `data` and its end.
    """
    if len(data) <= CHUNK:
        return _word_hashes(data, starts)
    # One long text, cut where a word ends.
    assert len(starts) == 2
    parts, first = [], 0
    while len(data) - first > CHUNK:
        cut = first + CHUNK
        gaps = np.flatnonzero(SEPARATOR[data[first:cut]])
        if not len(gaps):  # one word of more than a block
            gaps = np.flatnonzero(SEPARATOR[data[cut:]])
            end = cut + int(gaps[0]) if len(gaps) else len(data)
            parts.append(_long_word(data[first:end]))
        else:
            end = first + int(gaps[-1])
            parts.append(_word_hashes(data[first:end], np.array([0, end - first]))[0])
        first = end + 1
    if first < len(data):
        parts.append(_word_hashes(data[first:], np.array([0, len(data) - first]))[0])
    words = np.concatenate(parts)
    return words, np.array([0, len(words)])


def _long_word(data: np.ndarray) -> np.ndarray:
    lead = int(np.argmin(SEPARATOR[data])) if len(data) else 0
    word, total = LOWER[data[lead:]], U64(0)
    with np.errstate(over="ignore"):
        for block in range(0, len(word), CHUNK):
            part = BYTE[word[block : block + CHUNK]] * POWERS[: len(word[block : block + CHUNK])]
            total += part.sum(dtype=U64) * U64(pow(BASE, block, 1 << 64))
        return mix(np.array([total], dtype=U64) + U64(len(word)) * PLACE[7])


def _word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = ~SEPARATOR[data]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[starts[:-1][starts[:-1] < len(data)]] = False
    begin = np.flatnonzero(inside & ~before)
    # A word ends before a separator, before the next text, and at the end.
    gap = np.flatnonzero(~inside)
    limits = np.union1d(gap, starts)
    end = limits[np.searchsorted(limits, begin, side="right")]
    sums = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(BYTE[LOWER[data]] * POWERS[: len(data)], out=sums[1:])
    words = (sums[end] - sums[begin]) * INVERSE_POWERS[begin]
    return mix(words + (end - begin).astype(U64) * PLACE[7]), np.searchsorted(begin, starts)


def shingle_sets(data: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text in ascending order, one after the other, and where each begins.

    A text of fewer words than `width` is one shingle, a text without words has none.
    """
    words, first = word_hashes(data, starts)
    texts = len(starts) - 1
    count = np.diff(first)
    made = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(made)])
    # Word at which each shingle begins.
    text = np.repeat(np.arange(texts), made)
    at = first[:-1][text] + (np.arange(begin[-1]) - begin[:-1][text])
    shingles = np.zeros(len(at), dtype=U64)
    length = np.minimum(count, width)[text]
    padded = np.concatenate([words, np.zeros(width, dtype=U64)])
    short = bool((length < width).any())
    for k in range(width):
        part = padded[at + k] * PLACE[k]
        shingles += np.where(k < length, part, U64(0)) if short else part
    shingles = mix(shingles + length.astype(U64) * PLACE[6])
    for i in range(texts):
        shingles[begin[i] : begin[i + 1]].sort()
    fresh = np.ones(len(shingles), dtype=bool)
    fresh[1:] = shingles[1:] != shingles[:-1]
    fresh[begin[:-1][made > 0]] = True
    kept = np.concatenate([[0], np.cumsum(fresh)])
    return shingles[fresh], kept[begin]
