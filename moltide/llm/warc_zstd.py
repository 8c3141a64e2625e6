"""WARC archives in Zstandard: a dictionary in a leading skippable frame, then one frame for each record.

Archives are made in the tasks, each of at most about ARCHIVE_BYTES of records, and held as rows (name, content) of a
Parquet table in the shared folder, so that any executor can read any of them; export_archives() makes files of them,
and read_archives() takes rows of either kind. The reader loads the dictionary, decodes frame after frame, and checks
frame bounds, checksums, header syntax, Content-Length of record and of HTTP block, and the payload's digest.

Of equal payloads of at least `revisit_bytes` the one with the largest id is a response, the others are revisits of it
without a payload. Repeated rows with that same id are responses each. A null id counts as smallest. A null payload is
empty. An empty table gives no archives. Only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, slices, table

SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
ARCHIVE_BYTES = 8 << 20
#: The dictionary's bytes, and the first records of an archive from which it is trained.
DICTIONARY_BYTES, TRAINED_ON = 16 << 10, 100
DATE = "2024-01-01T00:00:00Z"
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


class WarcError(ValueError):
    pass


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit has the HTTP header of the full payload, and no payload."""
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(page_id))}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", *[f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(refers_to))}>", f"X-Refers-To-Page: {refers_to}"] * (refers_to is not None)]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """The archive of the records."""
    import zstandard

    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, records[:TRAINED_ON]).as_bytes()
    except zstandard.ZstdError:  # too few or too small records to train on
        trained = b"".join(records)[:DICTIONARY_BYTES]
    packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(trained), write_checksum=True, write_content_size=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(trained)), trained, *map(packer.compress, records)])


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at `at` ends."""
    import zstandard

    try:
        header = data[at : at + 18]
        pos = at + zstandard.frame_header_size(header)
        checksum = zstandard.get_frame_parameters(header).has_checksum
    except zstandard.ZstdError as e:
        raise WarcError(f"no frame at byte {at}: {e}") from e
    while True:
        if pos + 3 > len(data):
            raise WarcError(f"the frame at byte {at} is cut off")
        head = int.from_bytes(data[pos : pos + 3], "little")
        kind, size = head >> 1 & 3, head >> 3
        if kind == 3:
            raise WarcError(f"the frame at byte {at} has a block of a reserved kind")
        pos += 3 + (1 if kind == 1 else size)
        if head & 1:
            break
    pos += 4 * checksum
    if pos > len(data):
        raise WarcError(f"the frame at byte {at} is cut off")
    return pos


def records_of(content: bytes) -> Iterator[bytes]:
    """Records of an archive. Other skippable frames between records are passed over."""
    import zstandard

    data, at, unpacker = memoryview(content), 0, zstandard.ZstdDecompressor()
    while at < len(data):
        magic = int.from_bytes(data[at : at + 4], "little")
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if at + 8 > len(data) or (end := at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")) > len(data):
                raise WarcError("a skippable frame is cut off")
            if not at and magic == SKIPPABLE:
                found = bytes(data[8:end])
                if found[:4] == struct.pack("<I", FRAME):  # the dictionary itself may be compressed
                    found = zstandard.ZstdDecompressor().decompress(found)
                unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(found))
        elif magic == FRAME:
            end = frame_end(data, at)
            try:
                yield unpacker.decompress(data[at:end])
            except zstandard.ZstdError as e:
                raise WarcError(f"the frame at byte {at} can't be decoded: {e}") from e
        else:
            raise WarcError(f"no frame at byte {at}")
        at = end


def fields_of(head: bytes, first: bytes) -> dict[str, str]:
    lines = head.split(b"\r\n")
    if not lines[0].startswith(first):
        raise WarcError(f"a header begins with {lines[0][:20]!r}")
    out = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"not a header line: {line[:40]!r}")
        out[name.lower()] = value.strip()
    return out


def number(fields: dict[str, str], name: str) -> int:
    value = fields.get(name, "")
    if not value.isdecimal():
        raise WarcError(f"{name} is {value!r}")
    return int(value)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (with payload-length) and payload of a record, all lengths and the digest checked."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    fields = fields_of(head, b"WARC/1.")
    n = number(fields, "content-length")
    if not blank or len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"the record has {len(rest) - 4} bytes, its header says {n}")
    http, blank, payload = rest[:n].partition(b"\r\n\r\n")
    fields["payload-length"] = str(size := number(fields_of(http, b"HTTP/"), "content-length"))
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit") or "warc-record-id" not in fields or "warc-date" not in fields:
        raise WarcError(f"a record of type {kind!r} lacks fields")
    if kind == "response" and (len(payload) != size or fields.get("warc-payload-digest") != f"sha1:{digest(payload)}"):
        raise WarcError("the payload does not match its length or digest")
    if kind == "revisit" and payload:
        raise WarcError("a revisit holds a payload")
    return fields, payload


def write_archives(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = 0) -> DataFrame:
    """Archives (name, content) with a record for each row, as a table in the shared folder."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("sha1", F.unhex(F.sha1("payload")))
    # the join below reads both sides from plain exchanges: a hot payload is split
    newest = materialise(rows.groupBy("sha1").agg(F.max("page_id").alias("newest")), "newest")
    revisit = (F.octet_length("payload") >= revisit_bytes) & F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest"))
    rows = rows.join(newest, "sha1").select("page_id", "url", "payload", "newest", revisit.alias("revisit"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        held, size, made = [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, made
            out = pa.RecordBatch.from_arrays([pa.array([f"part-{TaskContext.get().partitionId():06d}-{made:05d}.warc.zst"]), pa.array([archive(held)], pa.binary())], ["name", "content"])
            held, size, made = [], 0, made + 1
            return out

        for batch in slices(batches, 2):
            for p, u, x, n, r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(record(p, u, x, n if r else None, r))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
        if held:
            yield flush()

    return materialise(rows.mapInArrow(run, "name string, content binary"), "warc")


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record of the archives (column content)."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for content in batch.column(0):
                rows = []
                for data in records_of(content.as_py()):
                    f, _ = parse(data)
                    page, to = f.get("x-page-id"), f.get("x-refers-to-page")
                    rows.append((None if page is None else int(page), int(f["payload-length"]), f["warc-payload-digest"].removeprefix("sha1:"), f["warc-type"], None if to is None else int(to)))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return archives.select("content").mapInArrow(run, SCHEMA)


def export_archives(archives: DataFrame, folder: str) -> None:
    """Files of the archives in a folder that all executors share."""

    def run(row) -> None:  # noqa: ANN001
        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/.{row.name}", "wb") as f:
            f.write(row.content)
        os.replace(f"{folder}/.{row.name}", f"{folder}/{row.name}")

    archives.foreach(run)


def open_archives(spark: SparkSession, path: str) -> DataFrame:
    """Archive files as rows (name, content) for read_archives()."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("name"), "content")


def op8_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(table(spark, sf_dir, "pages")))
