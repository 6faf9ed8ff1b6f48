"""Removal of repeated byte strings, by deep-shallow sorting of the suffixes around shared anchors.

Each string of 50 bytes is represented by the anchor in it, the substring of 24 bytes with the
smallest hash; equal strings have the same anchor at the same place. Documents are held in units of
some megabytes. First, ranges of anchors find which of them stand in several documents. Then the
texts around shared anchors meet by ranges again: equal ones are merged, and where texts around one
anchor differ, their suffixes are sorted, so that each string of 50 bytes gets the smallest document
that holds it. The units take the answers and cut their documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triptych.llm.hashing import BASE, BASE_INVERSE, BYTE, PLACE, U64, _powers, chunks, mix, text_buffer
from triptych.llm.suffixes import equal_strings
from triptych.llm.text import whole
from triptych.staging import drop_staged, staged

LENGTH = 50
ANCHOR = 24
REACH = LENGTH - ANCHOR  # places of an anchor in a string, less one
WIDTH = 80  # of the longest text around an anchor, 76 bytes, in whole words
UNIT = 4 << 20
# Text whose anchors meet in one task.
RANGE = 8 << 20
BLOCK = 1 << 19
KEY_BITS = 40
KEY_MASK = U64((1 << KEY_BITS) - 1)
PLACE_MASK = U64((1 << 20) - 1)

_POWERS = _powers(BASE, BLOCK + LENGTH + 1)
_INVERSE = _powers(BASE_INVERSE, BLOCK + LENGTH + 1)

UNITS = "unit bigint, size bigint, ids binary, starts binary, data binary"


@dataclass
class Unit:
    """Texts one after the other, with where they start and whose they are."""

    ids: np.ndarray
    known: np.ndarray
    starts: np.ndarray
    data: np.ndarray

    @staticmethod
    def read(ids: bytes, starts: bytes, data: bytes) -> Unit:
        pair = np.frombuffer(ids, dtype=np.int64).reshape(2, -1)
        raw = zstandard.ZstdDecompressor().decompress(data)
        return Unit(pair[0], pair[1].astype(bool), np.frombuffer(starts, dtype=np.int64), np.frombuffer(raw, dtype=np.uint8))

    def owner(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, place, side="right") - 1


@dataclass
class Anchors:
    """Anchors of a unit: range and key, place, and the first and last string that each stands for."""

    code: np.ndarray
    place: np.ndarray
    first: np.ndarray
    last: np.ndarray


def find_anchors(unit: Unit, ranges: int) -> Anchors:
    end = np.repeat(np.where(unit.known, unit.starts[1:], 0), np.diff(unit.starts))
    parts = [_block_anchors(unit.data, end, s) for s in range(0, max(len(unit.data) - LENGTH + 1, 0), BLOCK)]
    if not parts:
        none = np.zeros(0, dtype=np.int64)
        return Anchors(none, none, none, none)
    hashed, place, first, last = (np.concatenate(c) for c in zip(*parts))
    code = ((hashed >> U64(KEY_BITS)) % U64(ranges)) << U64(KEY_BITS) | (hashed & KEY_MASK)
    return Anchors(code.astype(np.int64), place, first, last)


def _block_anchors(data: np.ndarray, end: np.ndarray, at: int) -> tuple[np.ndarray, ...]:
    """Anchors of the strings that start in one block of the data."""
    part = data[at : at + BLOCK + LENGTH - 1]
    sums = np.zeros(len(part) + 1, dtype=U64)
    np.cumsum(BYTE[part] * _POWERS[: len(part)], out=sums[1:])
    hashed = mix((sums[ANCHOR:] - sums[:-ANCHOR]) * _INVERSE[: len(part) - ANCHOR + 1])
    least = (hashed & ~PLACE_MASK) | np.arange(len(hashed), dtype=U64)
    width = 1
    while 2 * width <= REACH + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = REACH + 1 - width
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    start = np.arange(at, at + len(least))
    start = start[end[at : at + len(least)] >= start + LENGTH]
    anchor = (least[start - at] & PLACE_MASK).astype(np.int64)
    fresh = np.ones(len(start), dtype=bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(start)) - 1 if len(first) else first
    return mix(hashed[anchor[first]] + U64(1)), anchor[first] + at, start[first], start[last]


@dataclass
class Contexts:
    """Texts around anchors: rows of bytes with their length, and the place of the anchor in them."""

    code: np.ndarray
    length: np.ndarray
    offset: np.ndarray
    rows: np.ndarray

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """First member and group of each context; members are equal in every byte."""
        words = self.rows.view(np.uint64)
        digest = self.code.astype(U64) * PLACE[0] + self.length.astype(U64) * PLACE[1] + self.offset.astype(U64) * PLACE[2]
        digest = mix(digest)
        for k in range(words.shape[1]):
            digest = mix(digest + words[:, k] * PLACE[k % 8] + U64(k))
        _, first, group = np.unique(digest, return_index=True, return_inverse=True)
        head = first[group]
        same = (self.code == self.code[head]) & (self.length == self.length[head]) & (self.offset == self.offset[head])
        odd = np.flatnonzero(~(same & (words == words[head]).all(axis=1)))
        if len(odd):  # equal digests of different texts: each on its own
            group = group.copy()
            group[odd] = len(first) + np.arange(len(odd))
            first = np.append(first, odd)
        return first, group

    def take(self, rows: np.ndarray) -> Contexts:
        return Contexts(self.code[rows], self.length[rows], self.offset[rows], self.rows[rows])


def contexts(unit: Unit, anchors: Anchors, chosen: np.ndarray) -> Contexts:
    first, last = anchors.first[chosen], anchors.last[chosen]
    length = last - first + LENGTH
    column = np.arange(WIDTH)
    rows = unit.data[np.minimum(first[:, None] + column, len(unit.data) - 1)]
    rows[column >= length[:, None]] = 0
    return Contexts(anchors.code[chosen], length, anchors.place[chosen] - first, rows)


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unpack(data: bytes, *kinds: tuple[str, int]) -> list[np.ndarray]:
    """Arrays of equal length; a kind is a type and the numbers in a row."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    count = len(raw) // sum(np.dtype(t).itemsize * k for t, k in kinds)
    out, at = [], 0
    for t, k in kinds:
        size = np.dtype(t).itemsize * k * count
        array = np.frombuffer(raw[at : at + size], dtype=t)
        out.append(array.reshape(count, k) if k > 1 else array)
        at += size
    return out


def units(documents: DataFrame) -> DataFrame:
    """The documents in units of about UNIT bytes; a longer text is a unit of its own."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            ids = batch.column(0)
            known = ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
            ids = ids.fill_null(0).to_numpy()
            for first, after in chunks(offsets, UNIT):
                starts = offsets[first : after + 1] - offsets[first]
                pair = np.stack([ids[first:after], known[first:after]])
                packed = zstandard.ZstdCompressor(level=3).compress(data[offsets[first] : offsets[after]].tobytes())
                columns = [[count], [int(starts[-1])], [pair.tobytes()], [starts.tobytes()], [packed]]
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["unit", "size", "ids", "starts", "data"])
                count += 1

    return documents.select(F.col("doc_id").cast("bigint"), whole("text")).mapInArrow(gather, UNITS)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """unit, Unit and the further columns of each row."""
    for batch in batches:
        for row in range(batch.num_rows):
            values = [batch.column(k)[row].as_py() for k in range(batch.num_columns)]
            yield values[0], Unit.read(*values[1:4]), *values[4:]


def _by_range(code: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of one range in ascending codes."""
    of = code >> KEY_BITS
    cuts = np.flatnonzero(np.diff(of)) + 1 if len(of) else []
    for first, after in zip([0, *cuts], [*cuts, len(of)]):
        if after > first:
            yield int(of[first]), slice(first, after)


def substring_dedup(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that remain).

    Every byte is removed that is covered by a string of 50 bytes which also starts in a document
    with a smaller doc_id, as the documents are given; n_spans counts maximal removed runs.

    A null text is an empty one; texts of fewer than 50 bytes stay whole. Rows with a null doc_id
    are neither cut nor a reason to cut. Rows that repeat a doc_id are not smaller than each other.
    Other columns are not read. An empty table gives an empty result.
    """
    held = staged(units(documents), "substring-units")
    ranges = max(1, -(-(held.agg(F.sum("size")).first()[0] or 0) // RANGE))

    def send_keys(batches):
        for unit, u in _rows(batches):
            anchors = find_anchors(u, ranges)
            code, first, group = np.unique(anchors.code, return_index=True, return_inverse=True)
            ids = u.ids[u.owner(anchors.first)]
            several = np.zeros(len(code), dtype=bool)
            several[group[ids != ids[first][group]]] = True
            out = [(r, unit, _bytes5(code[s]), np.packbits(several[s]).tobytes()) for r, s in _by_range(code)]
            yield _batch(out, ["part", "unit", "keys", "several"], [pa.int32(), pa.int64(), pa.binary(), pa.binary()])

    plain = held.select("unit", "ids", "starts", "data")
    keys = plain.mapInArrow(send_keys, "part int, unit bigint, keys binary, several binary")
    shared = staged(keys.groupBy("part").applyInArrow(_shared, "unit bigint, part int, shared binary"), "substring-shared")

    def send_contexts(batches):
        for unit, u, parts in _rows(batches):
            anchors = find_anchors(u, ranges)
            code, group = np.unique(anchors.code, return_inverse=True)
            flags = {p["part"]: p["shared"] for p in parts}
            on = np.zeros(len(code), dtype=bool)
            for r, s in _by_range(code):
                if r in flags:
                    on[s] = np.unpackbits(np.frombuffer(flags[r], dtype=np.uint8), count=s.stop - s.start).astype(bool)
            chosen = np.flatnonzero(on[group])
            if not len(chosen):
                continue
            around = contexts(u, anchors, chosen)
            first, of = around.groups()
            ids = u.ids[u.owner(anchors.first[chosen])]
            least, most = _extremes(ids, of, len(first))
            order = np.argsort(around.code[first], kind="stable")
            mine = around.take(first[order])
            out = []
            for r, s in _by_range(mine.code):
                payload = _pack(
                    mine.code[s], chosen[first[order[s]]].astype(np.int64), least[order[s]], most[order[s]],
                    mine.length[s].astype(np.uint8), mine.offset[s].astype(np.uint8), mine.rows[s],
                )
                out.append((r, unit, payload))
            yield _batch(out, ["part", "unit", "contexts"], [pa.int32(), pa.int64(), pa.binary()])

    flags = shared.groupBy("unit").agg(F.collect_list(F.struct("part", "shared")).alias("parts"))
    sent = plain.join(flags.hint("merge"), "unit").mapInArrow(send_contexts, "part int, unit bigint, contexts binary")
    answers = staged(sent.groupBy("part").applyInArrow(_answers, "unit bigint, answers binary"), "substring-answers")

    def cut(batches):
        for _, u, parts in _rows(batches):
            removed = _removed(u, parts or [], ranges)
            begin, end = u.starts[:-1], u.starts[1:]
            before = np.concatenate([[0], np.cumsum(removed)])
            edge = removed.copy()
            edge[1:] &= ~removed[:-1]
            inner = begin[(begin < len(removed)) & (begin < end)]
            edge[inner] = removed[inner]
            spans = np.concatenate([[0], np.cumsum(edge)])
            kept = [u.data[b:e][~removed[b:e]].tobytes() for b, e in zip(begin, end)]
            columns = [
                pa.array(u.ids, pa.int64(), mask=~u.known),
                pa.array(end - begin, pa.int64()),
                pa.array(before[end] - before[begin], pa.int64()),
                pa.array(spans[end] - spans[begin], pa.int64()),
                pa.array(kept, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    by_unit = answers.groupBy("unit").agg(F.collect_list("answers").alias("parts"))
    result = plain.join(by_unit.hint("merge"), "unit", "left").mapInArrow(
        cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    )
    drop_staged(shared)
    return result


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)


def _bytes5(code: np.ndarray) -> bytes:
    return np.ascontiguousarray(code.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _extremes(values: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((values, group))
    cuts = np.searchsorted(group[order], np.arange(groups))
    last = np.append(cuts[1:], len(order)) - 1
    return values[order][cuts], values[order][last]


def _shared(table):
    """Which keys of each unit stand in several documents."""
    blobs = table.column("keys").to_pylist()
    count = np.array([len(b) // 5 for b in blobs])
    raw = np.zeros((count.sum(), 8), dtype=np.uint8)
    raw[:, :5] = np.frombuffer(b"".join(blobs), dtype=np.uint8).reshape(-1, 5)
    keys = raw.view("<u8").ravel()
    flags = [np.unpackbits(np.frombuffer(b, dtype=np.uint8), count=n) for b, n in zip(table.column("several").to_pylist(), count)]
    _, group, units_of = np.unique(keys, return_inverse=True, return_counts=True)
    on = (units_of[group] > 1) | np.concatenate(flags).astype(bool)
    # A key that is several documents' in one unit is shared in all.
    anywhere = np.zeros(len(units_of), dtype=bool)
    anywhere[group[on]] = True
    on = anywhere[group]
    cuts = np.concatenate([[0], np.cumsum(count)])
    packed = [np.packbits(on[a:b]).tobytes() for a, b in zip(cuts, cuts[1:])]
    return pa.table({"unit": table.column("unit"), "part": table.column("part"), "shared": pa.array(packed, pa.binary())})


CONTEXT = (("<i8", 1), ("<i8", 1), ("<i8", 1), ("<i8", 1), ("u1", 1), ("u1", 1), ("u1", WIDTH))
ANSWER = (("<i8", 1), ("<i8", 1), ("u1", 1), ("u1", 1))


def _answers(table):
    """For the strings around each anchor of a unit, the smallest document that holds them, where some document must go."""
    blobs = [_unpack(b, *CONTEXT) for b in table.column("contexts").to_pylist()]
    code, anchor, least, most, length, offset, rows = (np.concatenate(c) for c in zip(*blobs))
    sender = np.repeat(np.arange(len(blobs)), [len(b[0]) for b in blobs])
    every = Contexts(code, length.astype(np.int64), offset.astype(np.int64), np.ascontiguousarray(rows))
    first, group = every.groups()
    smallest, _ = _extremes(least, group, len(first))
    one = every.take(first)
    _, key, held = np.unique(one.code, return_inverse=True, return_counts=True)
    alone = held[key] == 1
    strings = one.length - LENGTH + 1
    # Smallest documents of all strings, context after context.
    begin = np.concatenate([[0], np.cumsum(strings)])
    of = np.repeat(np.arange(len(first)), strings)
    at = np.arange(begin[-1]) - begin[:-1][of]
    document = smallest[of]
    differ = np.flatnonzero(~alone[of])
    if len(differ):
        c, j = of[differ], at[differ]
        lead = key[c] * (2 * LENGTH) + (j - one.offset[c] + LENGTH)
        found = equal_strings(lead, one.rows[c[:, None], j[:, None] + np.arange(LENGTH)])
        document[differ] = _extremes(smallest[c], found, int(found.max()) + 1)[0][found]
    # Runs of strings with the same document.
    fresh = np.ones(len(of), dtype=bool)
    fresh[1:] = (of[1:] != of[:-1]) | (document[1:] != document[:-1])
    run = np.flatnonzero(fresh)
    to = at[np.append(run[1:], len(of)) - 1]
    runs = np.bincount(of[run], minlength=len(first))
    run_begin = np.concatenate([[0], np.cumsum(runs)])
    entry = np.repeat(np.arange(len(group)), runs[group])
    mine = run_begin[:-1][group[entry]] + np.arange(len(entry)) - np.concatenate([[0], np.cumsum(runs[group])])[:-1][entry]
    due = document[run[mine]] < most[entry]
    entry, mine = entry[due], mine[due]
    units_, out = table.column("unit").to_pylist(), []
    for k in np.unique(sender[entry]):
        its = sender[entry] == k
        e, m = entry[its], mine[its]
        out.append((units_[k], _pack(anchor[e], document[run[m]], at[run[m]].astype(np.uint8), to[m].astype(np.uint8))))
    return pa.Table.from_batches([_batch(out, ["unit", "answers"], [pa.int64(), pa.binary()])])


def _removed(unit: Unit, answers: list[bytes], ranges: int) -> np.ndarray:
    """Which bytes of the unit go."""
    change = np.zeros(len(unit.data) + 1, dtype=np.int32)
    if answers:
        anchor, document, start, to = (np.concatenate(c) for c in zip(*[_unpack(a, *ANSWER) for a in answers]))
        anchors = find_anchors(unit, ranges)
        chosen = np.flatnonzero(np.isin(anchors.code, anchors.code[anchor]))
        _, group = contexts(unit, anchors, chosen).groups()
        own = anchors.first[chosen]
        ids = unit.ids[unit.owner(own)]
        # Each answer holds for all anchors with the same text around them.
        order = np.argsort(group, kind="stable")
        cuts = np.searchsorted(group[order], np.arange(group.max() + 2))
        asked = group[np.searchsorted(chosen, anchor)]
        count = cuts[asked + 1] - cuts[asked]
        answer = np.repeat(np.arange(len(anchor)), count)
        member = order[cuts[asked][answer] + np.arange(len(answer)) - np.repeat(np.cumsum(count) - count, count)]
        goes = ids[member] > document[answer]
        member, answer = member[goes], answer[goes]
        np.add.at(change, own[member] + start[answer], 1)
        np.add.at(change, own[member] + to[answer].astype(np.int64) + LENGTH, -1)
    return np.cumsum(change[:-1]) > 0
