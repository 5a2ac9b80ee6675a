"""Web archives of Zstandard frames: one dictionary in the leading skippable frame, one
frame per record.

Writing: pages with equal payloads become one response and revisits of it. Every task packs
its records into archives of bounded size, trains a dictionary on each archive's own records
and compresses every record as a frame of its own. An archive is one row; Spark's text
writer puts each into a file, so its commit protocol covers retried tasks and any store
that Spark can write will do. The line separator is an empty skippable frame, which every
Zstandard reader skips.

Reading: the dictionary is loaded from the leading skippable frame (stored plainly or as a
frame itself), frames are walked by their block headers, and headers, lengths and digests of
each record are validated.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from plantgauge.llm.common import ship_package, stored, whole_text
from plantgauge.operators.bounds import small_side

# plain bytes of the records of one archive; a larger record is an archive of its own
ARCHIVE_BYTES = 64 << 20
# a dictionary of this size is trained on so many pieces of an archive's records
DICTIONARY_BYTES = 48 << 10
SAMPLES, SAMPLE_BYTES = 400, 8 << 10
LEVEL = 3
# payloads below this are never revisited
LEAST_REVISIT = 100

# fixed values of the formats
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
DICTIONARY_FRAME = 0x184D2A5D
FRAME = 0xFD2FB528
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
VERSION = b"WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-record-id", "warc-type", "warc-date", "content-length")

FIELDS = (
    "archive string, page_id long, url string, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, payload binary, fault string"
)
# rows of one batch out of the reader, by bytes of payload
BATCH_BYTES = 8 << 20


def record_kinds(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload, digest and ``refers_to`` (null for a response).

    A page whose payload of at least ``least`` bytes also stands under a smaller page_id
    refers to the smallest. Only ids and digests are grouped, pre-aggregated per task; the
    payloads move by (page_id, digest), and only if there are too many revisits to broadcast.
    """
    payload = whole_text("html").cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    narrow = rows.where(F.octet_length("payload") >= least).select("page_id", "digest")
    first = (
        narrow.groupBy("digest")
        .agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies"))
        .where((F.col("copies") > 1) & F.col("refers_to").isNotNull())
    )
    later = F.col("page_id").isNull() | (F.col("page_id") > F.col("refers_to"))
    revisits = stored(
        narrow.join(first, "digest").where(later)
        .select(F.col("page_id").alias("r_page_id"), F.col("digest").alias("r_digest"), "refers_to").distinct(),
        "revisits",
    )
    on = (F.col("digest") == F.col("r_digest")) & F.col("page_id").eqNullSafe(F.col("r_page_id"))
    return rows.join(small_side(revisits), on, "left").drop("r_page_id", "r_digest")


def record_id(page_id, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def header_value(url: str) -> str:
    """A URL fit for a header line: control characters and edge blanks percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f-\x9f]|^ +| +$", lambda m: quote(m[0]), url)


def web_record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One record, header and block; a revisit keeps the protocol header of its page, not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        safe = header_value(url)
        lines.append(f"WARC-Target-URI: {safe}")
        if safe != url:  # the reader gives back the URL as it was
            lines.append(f"Source-URI-Hex: {url.encode().hex()}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Profile: {IDENTICAL}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info_record(date: str) -> bytes:
    body = b"format: WARC File Format 1.1\r\n"
    digest = hashlib.sha256(body).hexdigest()
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:sha256:{digest}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def trained(records: list[bytes], size: int) -> bytes:
    """A dictionary from evenly spread records, none if they are too few or too much alike."""
    step = max(1, len(records) // SAMPLES)
    pieces = [r[:SAMPLE_BYTES] for r in records[::step]]
    if len(pieces) < 16 or sum(map(len, pieces)) < 4 * size:
        return b""
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:
        return b""


def packed(records: list[bytes], date: str, size: int = DICTIONARY_BYTES) -> bytes:
    """One archive: the dictionary in a skippable frame, then a frame per record."""
    raw = trained(records, size)
    out = []
    if raw:
        body = zstandard.ZstdCompressor(level=LEVEL).compress(raw)
        out.append(DICTIONARY_FRAME.to_bytes(4, "little") + len(body).to_bytes(4, "little") + body)
    known = zstandard.ZstdCompressionDict(raw) if raw else None
    if known:
        known.precompute_compress(level=LEVEL)
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True)
    out += [press.compress(r) for r in [info_record(date), *records]]
    return b"".join(out)


def write_archives(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """One record per row of ``pages`` (page_id, url, html) into archives below ``path``.

    A null html is an empty payload, a null url leaves its header out, a null page_id sorts
    after all others. Rows that repeat the smallest page_id of a payload are all responses.
    Other columns are not archived. An empty table leaves archives without records.
    """
    ship_package(pages.sparkSession)

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(records):
            # the bytes of a binary column, seen as a string column: nothing is decoded
            return pa.RecordBatch.from_arrays([pa.array([packed(records, date)], pa.binary()).view(pa.string())], ["value"])

        held, size = [], 0
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")]
            for values in zip(*columns):
                record = web_record(*[v.as_py() for v in values], date)
                if held and size + len(record) > archive_bytes:
                    yield row(held)
                    held, size = [], 0
                held.append(record)
                size += len(record)
        if held:
            yield row(held)

    rows = record_kinds(pages).select("page_id", "url", "payload", "digest", "refers_to")
    rows.mapInArrow(archives, "value string").write.options(lineSep=EMPTY_FRAME, maxRecordsPerFile=1, compression="none").text(path)


class Fault(ValueError):
    """What is wrong with a frame or record."""


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame at ``at`` ends, by its header and block headers."""
    try:
        head = data[at : at + 18]
        place = at + zstandard.frame_header_size(head)
        checked = zstandard.get_frame_parameters(head).has_checksum
    except zstandard.ZstdError as e:
        raise Fault(f"frame header: {e}") from None
    last = False
    while not last:
        if place + 3 > len(data):
            raise Fault("truncated frame")
        block = int.from_bytes(data[place : place + 3], "little")
        last, kind, size = block & 1, block >> 1 & 3, block >> 3
        if kind == 3:
            raise Fault("reserved block type")
        place += 3 + (1 if kind == 1 else size)
    place += 4 if checked else 0
    if place > len(data):
        raise Fault("truncated frame")
    return place


def records_of(archive: bytes) -> Iterator[tuple[bytes | None, str | None]]:
    """(record, fault) of every frame. A frame that does not decode is a fault of its own;
    one whose end cannot be found ends the archive."""
    data, at = memoryview(archive), 0
    reader = zstandard.ZstdDecompressor()
    while at < len(data):
        magic = int.from_bytes(data[at : at + 4], "little")
        if magic in SKIPPABLE:
            end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
            if at + 8 > len(data) or end > len(data):
                yield None, "truncated skippable frame"
                return
            if at == 0 and magic == DICTIONARY_FRAME:
                try:
                    raw = bytes(data[8:end])
                    if raw[:4] == FRAME.to_bytes(4, "little"):
                        raw = zstandard.ZstdDecompressor().decompress(raw)
                    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
                except zstandard.ZstdError as e:
                    yield None, f"dictionary: {e}"
                    return
            at = end
            continue
        if magic != FRAME:
            yield None, "not a frame"
            return
        try:
            end = frame_end(data, at)
        except Fault as e:
            yield None, str(e)
            return
        try:
            yield reader.decompressobj().decompress(data[at:end]), None
        except zstandard.ZstdError as e:
            yield None, f"frame: {e}"
        at = end


def headers(text: bytes) -> dict[str, str]:
    out = {}
    for line in text.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise Fault("header line without a name")
        try:
            out[name.strip().decode("ascii").lower()] = value.strip().decode("utf-8")
        except UnicodeDecodeError:
            raise Fault("header is not UTF-8") from None
    return out


def number(text: str, what: str) -> int:
    if not re.fullmatch("[0-9]+", text):
        raise Fault(f"{what} is not a number")
    return int(text)


def named(urn: str) -> tuple[int | None, str]:
    found = re.fullmatch(r"<urn:page:(-?[0-9]*):([0-9a-f]{64})>", urn)
    if not found:
        raise Fault("record id of another kind")
    return int(found[1]) if found[1] else None, found[2]


def parsed(record: bytes) -> dict | None:
    """The fields of a response or revisit, None for other types; raises Fault."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not gap or version != VERSION:
        raise Fault("no record header")
    known = headers(lines)
    missing = [n for n in REQUIRED if n not in known]
    if missing:
        raise Fault(f"no {missing[0]}")
    length = number(known["content-length"], "content-length")
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise Fault("block length differs from content-length")
    kind = known["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    top, gap, payload = rest[:length].partition(b"\r\n\r\n")
    status, _, lines = top.partition(b"\r\n")
    if not gap or not status.startswith(b"HTTP/"):
        raise Fault("no protocol header")
    size = number(headers(lines).get("content-length", ""), "payload length")
    digest = known.get("warc-payload-digest", "").removeprefix("sha256:")
    page_id, own = named(known["warc-record-id"])
    refers_to = None
    if own != digest:
        raise Fault("digest differs from record id")
    if kind == "response":
        if len(payload) != size:
            raise Fault("payload length differs")
        if hashlib.sha256(payload).hexdigest() != digest:
            raise Fault("payload digest differs")
    else:
        refers_to, other = named(known.get("warc-refers-to", ""))
        if other != digest or payload or known.get("warc-profile") != IDENTICAL:
            raise Fault("not a revisit of an identical payload")
    url = known.get("warc-target-uri")
    if "source-uri-hex" in known:
        try:
            url = bytes.fromhex(known["source-uri-hex"]).decode()
        except ValueError:
            raise Fault("source uri") from None
    return {
        "page_id": page_id, "url": url, "record_type": kind, "refers_to": refers_to, "payload_bytes": size,
        "payload_digest": digest, "payload": payload if kind == "response" else None,
    }


def read_archives(spark: SparkSession, path: str, payloads: bool = True, strict: bool = False) -> DataFrame:
    """The responses and revisits of all archives below ``path``, columns ``FIELDS``.

    What does not validate is a row with ``fault`` and nulls, and the next frame is read; with
    ``strict`` it ends the job. ``payloads`` false leaves the payload column null. A revisit
    has no payload of its own. Other record types are skipped; a folder without archives
    gives no row.
    """
    ship_package(spark)
    schema = pa.schema([
        ("archive", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
        ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("payload", pa.binary()), ("fault", pa.string()),
    ])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                rows, size = [], 0
                for record, fault in records_of(content.as_buffer() if content.is_valid else b""):
                    row = None
                    if fault is None:
                        try:
                            row = parsed(record)
                            if row is None:
                                continue
                        except Fault as e:
                            fault = str(e)
                    if fault and strict:
                        raise Fault(f"{name.as_py()}: {fault}")
                    row = row or {}
                    if not payloads:
                        row["payload"] = None
                    rows.append({**row, "archive": name.as_py(), "fault": fault})
                    size += len(row.get("payload") or b"") + 256
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(read, FIELDS)
