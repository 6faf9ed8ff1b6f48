"""WARC archives of pages, compressed record by record with a dictionary of their own records.

Each archive (.warc.zst) begins with a skippable frame that holds its Zstandard dictionary, trained
on records of that archive; every record after it is a frame of its own. Payloads that occur more
than once are stored once, the other pages revisit them.

Tasks write archives with new names into a shared folder and hand out their paths, so the files of a
task that was lost or ran twice belong to no result.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triptych.llm.text import whole
from triptych.staging import new_path, staged

# Payloads of fewer bytes are never revisits; marks of the file format.
LEAST_REVISITED = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DICTIONARY_FRAME = b"\x5d\x2a\x4d\x18"
ZSTANDARD_FRAME = b"\x28\xb5\x2f\xfd"
# Bytes of records that make up an archive; a task holds as much at a time.
ARCHIVE_BYTES = 64 << 20
# Bytes of a dictionary and of the records it is trained on, evenly spaced in the archive; the
# trainer reads at most so many bytes of one record.
DICTIONARY_BYTES = 110 << 10
SAMPLE_BYTES = 8 << 20
SAMPLE_RECORD = 128 << 10
LEVEL = 3
READ_BYTES = 1 << 20
FRAME_BYTES = 1 << 14

ARCHIVES = "path string, records bigint, payload_bytes bigint, file_bytes bigint"
RECORDS = (
    "path string, record_type string, record_id string, page_id bigint, url string, date string, "
    "payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"
)


def write_archives(
    pages: DataFrame, folder: str | None = None, date: str | None = None, archive_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """Write a record per page and return the written archives: path, records, payload_bytes, file_bytes.

    The payload is `html` in UTF-8, empty where it is null. Of pages with equal payloads of at least
    1000 bytes the one with the largest page_id is the response, the others revisit it; rows that
    repeat its page_id are responses too, and a row without page_id revisits any that has one.
    Shorter payloads are all responses. A null page_id or url has no field; white space and control
    characters of a url are percent-encoded. Other columns are not read. An empty table writes no
    archive.

    The archives lie in `folder`, by default a new one in the shared folder. An archive of too few
    records to train on has no dictionary.
    """
    spark = pages.sparkSession
    folder = re.sub("^file:/+", "file:///", folder or new_path(spark, "warc"))
    date = date or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = whole("html")
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        payload.alias("payload"),
        F.unhex(F.sha2(payload, 256)).alias("key"),
    )
    # Only keys, and of those only repeated ones, take part in the search for equal payloads.
    repeated = staged(
        rows.where(F.octet_length("payload") >= LEAST_REVISITED)
        .groupBy("key")
        .agg(F.max("page_id").alias("kept_id"), F.count("*").alias("n"))
        .where("n > 1")
        .select("key", "kept_id"),
        "warc-repeated",
    )
    marked = rows.join(repeated, "key", "left").select(
        "page_id",
        "url",
        F.col("payload").cast("binary").alias("payload"),
        F.when(F.col("kept_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept_id")), F.col("kept_id")).alias("refers_to"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, size, payloads = [], 0, 0
        for batch in batches:
            for page_id, url, data, refers_to in zip(*(batch.column(i) for i in range(4))):
                data = data.as_py()
                record = page_record(page_id.as_py(), url.as_py(), data, refers_to.as_py(), date)
                records.append(record)
                size, payloads = size + len(record), payloads + len(data)
                if size >= archive_bytes:
                    yield _described(*write_archive(folder, records, date), len(records), payloads)
                    records, size, payloads = [], 0, 0
        if records:
            yield _described(*write_archive(folder, records, date), len(records), payloads)

    return staged(marked.mapInArrow(write, ARCHIVES), "warc-archives")


def _described(path: str, file_bytes: int, records: int, payloads: int) -> pa.RecordBatch:
    columns = {"path": [path], "records": [records], "payload_bytes": [payloads], "file_bytes": [file_bytes]}
    return pa.RecordBatch.from_pydict(columns)


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives at `path`, without the descriptions that begin them.

    One row per record: path, record_type, record_id, page_id, url, date, payload_bytes,
    payload_digest (SHA-1 in lower-case hex), refers_to, payload. Size and digest of a response are
    those of the bytes read, which must be those that the record states; of a revisit those of the
    whole payload that it stands for, and `payload` is null. With `payloads` off it always is.

    Archives without a dictionary, and dictionaries that are compressed themselves, are read too. A
    truncated archive is an error.
    """
    some = archives.select("path").repartition(
        max(1, min(archives.count(), 8 * archives.sparkSession.sparkContext.defaultParallelism))
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [(n, pa.int64() if k == "bigint" else pa.binary() if k == "binary" else pa.string()) for n, k in map(str.split, RECORDS.split(", "))]
        )
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                system, inside = fs.FileSystem.from_uri(path)
                with system.open_input_stream(inside, compression=None) as stream:
                    for frame in frames(stream):
                        row = parsed(frame)
                        if row["record_type"] == "warcinfo":
                            continue
                        row |= {"path": path, "payload": row["payload"] if payloads else None}
                        rows.append(row)
                        size += len(row["payload"] or b"")
                        if len(rows) >= 4096 or size >= READ_BYTES * 16:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return some.mapInArrow(read, RECORDS)


def with_payloads(records: DataFrame) -> DataFrame:
    """Records with the payloads of revisits filled in from the responses that they refer to."""
    rows = staged(records, "warc-records")
    revisited = rows.where("record_type = 'revisit'").select(F.col("payload_digest").alias("d"), F.col("refers_to").alias("r")).distinct()
    stored = (
        rows.where("record_type = 'response'")
        .join(revisited, (F.col("payload_digest") == F.col("d")) & (F.col("page_id") == F.col("r")), "left_semi")
        .dropDuplicates(["page_id", "payload_digest"])
        .select(F.col("payload_digest").alias("d"), F.col("page_id").alias("r"), F.col("payload").alias("stored"))
    )
    found = rows.join(staged(stored, "warc-stored"), (F.col("payload_digest") == F.col("d")) & (F.col("refers_to") == F.col("r")), "left")
    return found.withColumn("payload", F.coalesce("payload", "stored")).drop("d", "r", "stored")


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response with its payload, or a revisit that only has the head of the answer."""
    digest = hashlib.sha1(payload).digest()
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id, digest, refers_to is None),
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(digest).decode(),
        "X-Page-ID": page_id,
        "Content-Type": "application/http;msgtype=response",
    }
    if refers_to is not None:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to, digest, True), "X-Refers-To-Page-ID": refers_to}
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return record(fields, head + (payload if refers_to is None else b""))


def record_id(page_id: int | None, digest: bytes, response: bool) -> str:
    """The same id for the same page, payload and type, so that a revisit can name its response."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest.hex()} {response}')}>"


def record(fields: dict[str, object], block: bytes) -> bytes:
    lines = [f"{name}: {value}\r\n" for name, value in fields.items() if value is not None]
    return b"".join([b"WARC/1.1\r\n", "".join(lines).encode(), b"Content-Length: %d\r\n\r\n" % len(block), block, b"\r\n\r\n"])


def write_archive(folder: str, records: list[bytes], date: str) -> tuple[str, int]:
    """Path and size of a new archive of these records."""
    path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
    system, inside = fs.FileSystem.from_uri(path)
    system.create_dir(inside.rsplit("/", 1)[0], recursive=True)
    dictionary = trained(records)
    description = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": date, "Content-Type": "application/warc-fields"}
    options = {"level": LEVEL, "write_checksum": True, "write_content_size": True}
    if dictionary:
        options["dict_data"] = dictionary
    compress = zstandard.ZstdCompressor(**options).compress
    size = 0
    with system.open_output_stream(inside, compression=None) as out:
        if dictionary:
            data = dictionary.as_bytes()
            size += out.write(DICTIONARY_FRAME + struct.pack("<I", len(data)) + data)
        size += out.write(compress(record(description, b"format: WARC File Format 1.1\r\n")))
        for each in records:
            size += out.write(compress(each))
    return path, size


def trained(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from evenly spaced records, none where there is too little to train on."""
    total = sum(min(len(r), SAMPLE_RECORD) for r in records)
    sample = [r[:SAMPLE_RECORD] for r in records[:: -(-total // SAMPLE_BYTES)]]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, sample)) // 8), sample, k=200, d=8, level=LEVEL)
    except zstandard.ZstdError:
        return None


def frames(stream: pa.NativeFile) -> Iterator[bytes]:
    """The content of each frame, with the dictionary that a leading skippable frame holds."""
    head, options = stream.read(8), {}
    if head[:4] == DICTIONARY_FRAME:
        data = stream.read(struct.unpack("<I", head[4:])[0])
        if data[:4] == ZSTANDARD_FRAME:
            data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
        head, options = b"", {"dict_data": zstandard.ZstdCompressionDict(data)}
    decompressor = zstandard.ZstdDecompressor(**options)
    waiting, frame, begun, parts = memoryview(head), decompressor.decompressobj(), False, []
    while True:
        if not waiting:
            waiting = memoryview(stream.read(READ_BYTES))
            if not waiting:
                break
        # What lies after the end of a frame is copied, so little is offered at a time.
        piece = waiting[:FRAME_BYTES]
        parts.append(frame.decompress(piece))
        begun = True
        if frame.eof:
            waiting = waiting[len(piece) - len(frame.unused_data) :]
            yield b"".join(parts)
            frame, begun, parts = decompressor.decompressobj(), False, []
        else:
            waiting = waiting[len(piece) :]
    if begun:
        raise ValueError("the archive ends within a record")


def parsed(data: bytes) -> dict[str, object]:
    """The row of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
    block = rest[: int(fields["content-length"])]
    row: dict[str, object] = {
        "record_type": fields["warc-type"],
        "record_id": fields["warc-record-id"],
        "date": fields.get("warc-date"),
        "url": fields.get("warc-target-uri"),
        "page_id": int(fields["x-page-id"]) if "x-page-id" in fields else None,
        "refers_to": int(fields["x-refers-to-page-id"]) if "x-refers-to-page-id" in fields else None,
    }
    if row["record_type"] == "warcinfo":
        return row
    answer, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)^content-length: *(\d+)", answer, re.MULTILINE)[1])
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    if row["record_type"] == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
        raise ValueError(f"{row['record_id']} does not hold the payload that it states")
    whole_payload = payload if row["record_type"] == "response" else None
    return row | {"payload_bytes": size, "payload_digest": digest, "payload": whole_payload}


ORACLE = """
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN strlen(payload) >= 1000 AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(payload) >= 1000 AND page_id <> kept THEN kept END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS payload, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS kept FROM pages)"""
