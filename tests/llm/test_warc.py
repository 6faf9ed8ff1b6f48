import hashlib
import struct
from pathlib import Path

import pytest
import zstandard
from pyarrow import fs

from triptych.llm import warc

SCHEMA = "page_id bigint, url string, html string, path string, payload int"
DATE = "2024-05-06T07:08:09Z"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


def round_trip(spark, tmp_path, rows, **options):
    archives = warc.write_archives(frame(spark, rows), str(tmp_path / "a"), DATE, **options)
    return archives, warc.read_archives(archives)


def expected(rows):
    most = {}
    for page_id, _, html in rows:
        if html is not None and len(html.encode()) >= 1000 and page_id is not None:
            most[html] = max(most.get(html, page_id), page_id)
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        kept = most.get(html)
        refers = kept if kept is not None and kept != page_id else None
        out.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


LONG = "é" * 500
ROWS = [
    (1, "http://a/", "x" * 1000), (2, "http://b/", "x" * 1000), (7, "http://c/", "x" * 1000),
    (3, "http://d/", "x" * 999), (4, "http://e/", "x" * 999), (5, None, None), (6, "http://f/?q=a b\r\nWARC-Type: x", ""),
    (8, "http://ü/", LONG), (9, "http://g/", LONG), (9, "http://g/", LONG), (None, "http://h/", LONG), (None, None, "alone" * 300),
    (10, "http://i/", "\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n" * 40), (11, "http://j/", "line\n" * 300_000),
]


def test_round_trip(spark, tmp_path):
    _, records = round_trip(spark, tmp_path, ROWS)
    got = records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == expected(ROWS)
    whole = warc.with_payloads(records).select("page_id", "url", "payload", "date").collect()
    texts = {(r[0], r[2]) for r in ROWS if r[2]}
    assert {(r.page_id, bytes(r.payload).decode()) for r in whole if r.payload} == texts
    assert {r.date for r in whole} == {DATE}
    urls = {r.page_id: r.url for r in whole if r.page_id}
    assert urls[6] == "http://f/?q=a%20b%0D%0AWARC-Type:%20x" and urls[8] == "http://ü/" and urls[5] is None
    responses = {r.record_id for r in records.where("record_type = 'response'").collect()}
    assert len(responses) == records.where("record_type = 'response'").dropDuplicates(["page_id", "payload_digest"]).count()


def test_archives_are_of_bounded_size_and_hold_their_dictionary(spark, tmp_path):
    text = "<html><body><p>some words that every page has in common, page {} of {}</p></body></html>\n"
    rows = [(i, f"http://x/{i}", "".join(text.format(i * k % 1009, k) for k in range(30))) for i in range(600)]
    archives, records = round_trip(spark, tmp_path, rows, archive_bytes=300_000)
    listed = archives.collect()
    assert sum(r.records for r in listed) == 600 and sum(r.payload_bytes for r in listed) == sum(len(r[2]) for r in rows)
    assert len(listed) >= 5 and all(r.payload_bytes < 310_000 for r in listed)
    assert sorted(r.page_id for r in records.collect()) == list(range(600))
    for r in listed:
        data = Path(r.path).read_bytes()
        assert len(data) == r.file_bytes and data[:4] == warc.DICTIONARY_FRAME
        size = struct.unpack("<I", data[4:8])[0]
        # A plain decompressor skips the leading frame; the dictionary in it opens the next one.
        opened = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).decompressobj()
        assert opened.decompress(data[8 + size :]).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
    plain = sum(len(zstandard.compress(r[2].encode(), 3)) for r in rows)
    assert sum(r.file_bytes for r in listed) - sum(warc.DICTIONARY_BYTES for _ in listed) < plain


def test_files_of_lost_tasks_belong_to_no_result(spark, tmp_path):
    archives, records = round_trip(spark, tmp_path, ROWS[:3])
    warc.write_archive(str(tmp_path / "a"), [warc.page_record(99, "http://lost/", b"half", None, DATE)], DATE)
    assert records.count() == 3


def test_empty_table(spark, tmp_path):
    archives, records = round_trip(spark, tmp_path, [])
    assert archives.count() == 0 and records.count() == 0 and warc.with_payloads(records).count() == 0


def read(path):
    system, inside = fs.FileSystem.from_uri(str(path))
    with system.open_input_stream(inside, compression=None) as stream:
        return [warc.parsed(frame) for frame in warc.frames(stream)]


def test_other_archives(tmp_path):
    records = [warc.page_record(i, f"http://x/{i}", b"some text %d " % i * 200, None, DATE) for i in range(300)]
    dictionary = warc.trained(records)
    inside = zstandard.compress(dictionary.as_bytes())
    compress = zstandard.ZstdCompressor(dict_data=dictionary).compress
    head = warc.DICTIONARY_FRAME + struct.pack("<I", len(inside)) + inside
    (tmp_path / "packed").write_bytes(head + b"".join(map(compress, records)))
    assert [r["page_id"] for r in read(tmp_path / "packed")] == list(range(300))
    (tmp_path / "plain").write_bytes(b"".join(map(zstandard.compress, records)))
    assert len(read(tmp_path / "plain")) == 300
    (tmp_path / "cut").write_bytes(b"".join(map(zstandard.compress, records))[:-5])
    with pytest.raises(ValueError):
        read(tmp_path / "cut")
    assert read(tmp_path / "plain")[3]["payload"] == b"some text 3 " * 200
    damaged = records[0].replace(b"some text 0", b"some text 1", 1)
    with pytest.raises(ValueError):
        warc.parsed(damaged)


def test_few_records_have_no_dictionary(tmp_path):
    path, _ = warc.write_archive(str(tmp_path), [warc.page_record(1, "http://x/", b"a", None, DATE)], DATE)
    assert Path(path).read_bytes()[:4] == warc.ZSTANDARD_FRAME and len(read(path)) == 2
