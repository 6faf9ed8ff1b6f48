import itertools
import sys
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from triptych.llm.packing import WordEncoder, closest_sum, fill_windows, pack

FILE = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(FILE)
ENCODER = WordEncoder(FILE, remembered=50)
FRESH = WordEncoder(FILE)
SCHEMA = "doc_id bigint, text string, start int, bucket string"
PARTS = ["The", "word,", "ÉTÉ", "don't", "a's.", "...", "!!", " ", "  ", "\n", "\t", " ", "\x1c", "́", "ΣΑΣ.", "x<|endoftext|>", "42", "İ", "_", "'s", "A1.", "»"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS) | st.text(max_size=6), max_size=12))
def test_ids_are_those_of_the_tokenizer(parts):
    text = "".join(parts)
    got = np.frombuffer(ENCODER.ids(text), "<u4").tolist()
    assert got == PLAIN.encode(text, add_special_tokens=False).ids


def test_ids_of_every_letter_beside_punctuation():
    letters = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isalpha()]
    for shape in ("{}.", "a{}?!", "{0}\u0301.{0},"):
        words = [shape.format(c) for c in letters]
        for first in range(0, len(words), 20_000):
            part = words[first : first + 20_000]
            want = PLAIN.encode_batch(part, add_special_tokens=False)
            wrong = [w for w, e in zip(part, want) if np.frombuffer(FRESH.ids(w), "<u4").tolist() != e.ids]
            assert wrong == []


def test_ids_of_whole_documents(folder):
    texts = pq.read_table(f"{folder}/documents.parquet", columns=["text"]).column(0).to_pylist()
    for text in filter(None, texts):
        assert np.frombuffer(FRESH.ids(text), "<u4").tolist() == PLAIN.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["বড়়. বড়", "क़, ख़!", "שּׁ.", "İ... İstanbul'da.", "ড়।"])
def test_digest_of_letters_that_end_in_marks(spark, text):
    row = pack(spark.createDataFrame([(1, text, 0, "")], SCHEMA), FILE).first()
    ids = [*PLAIN.encode(text, add_special_tokens=False).ids, 2]
    assert (row.length, row.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), min_size=1, max_size=4), st.integers(0, 60))
def test_closest_sum_is_the_best(held, capacity):
    chosen = closest_sum(sorted(held, reverse=True), held, capacity)
    assert all(0 < count <= held[length] for length, count in chosen)
    options = itertools.product(*[[length * k for k in range(count + 1)] for length, count in held.items()])
    assert sum(a * b for a, b in chosen) == max(sum(o) for o in options if sum(o) <= capacity)


def test_windows_take_every_piece():
    held = {7: 5, 3: 4, 10: 1, 2: 1}
    used = defaultdict(int)
    for window in fill_windows(held, 10):
        assert sum(a * b for a, b in window) <= 10
        for length, count in window:
            used[length] += count
    assert used == held


@pytest.mark.parametrize("window", [16, 4096])
def test_round_trip(spark, window):
    texts = ["", None, "one two three", "word " * 9000, "Mixed, CASE! words." * 30, "z" * 70_000] + [
        "some words here " * (i % 40) for i in range(300)
    ]
    rows = [(i, t, 0, "") for i, t in enumerate(texts)] + [(None, "no key", 0, ""), (2, "one two three", 0, None)]
    out = pack(spark.createDataFrame(rows, SCHEMA), FILE, window=window, bucket_pieces=200).collect()
    want = defaultdict(list)
    for doc_id, text, *_ in rows:
        want[doc_id].append([*PLAIN.encode(text or "", add_special_tokens=False).ids, 2])
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for held in sequences.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= window
    assert set(pieces) == set(want)
    for doc_id, docs in want.items():
        expected = [
            (s, len(ids[s : s + window]), zlib.crc32(np.array(ids[s : s + window], "<u4").tobytes()), len(ids))
            for ids in docs
            for s in range(0, len(ids), window)
        ]
        assert sorted(pieces[doc_id]) == sorted(expected)
    tokens = sum(r.length for r in out)
    assert len(sequences) <= tokens / window * 1.1 + 3


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], SCHEMA), FILE).collect() == []
