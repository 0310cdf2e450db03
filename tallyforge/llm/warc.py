"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

The writer makes one gzip member per record and lets Spark's text writer put the members into files, so archives go to any file
system that Spark writes. The text writer needs a separator after each row; an empty gzip member serves as one.

The salvage reader checks each member or record (gzip CRC, version line, header, length, block end, payload digest). After a
failed check it searches for the next place where a valid member or version line begins, goes on there, and logs the bytes
between as a quarantined gap. What a member with a failed check holds of sound records is kept.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Records of equal payloads of at least so many bytes are stored once.
LEAST_BYTES = 100
#: An empty gzip member (fixed value): header with no name and no time, an empty block, CRC and length 0.
EMPTY_MEMBER = bytes([31, 139, 8, 0, 0, 0, 0, 0, 0, 3, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
_MAGIC, _VERSION, _STEP = b"\x1f\x8b\x08", b"WARC/1.", 1 << 16
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")

RECORD_SCHEMA = "archive string, start long, stop long, kind string, reason string, record_id string, record_type string, refers_to string, target_uri string, payload_bytes long, payload_digest string, payload binary"


# ---------------------------------------------------------------- writing


def plan_records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``id, url, payload, digest, first_id``: first_id is the smallest id with the same payload, null for small payloads.

    The smallest id per digest is taken before the shuffle in each task, and the join that brings it back splits hot digests (AQE), so
    a payload that a third of the pages share stays cheap.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= least_bytes
    firsts = rows.where(large).groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    small = rows.where(~large).withColumn("first_id", F.lit(None).cast("long"))
    return rows.where(large).join(firsts, "digest", "left").select("id", "url", "payload", "digest", "first_id").unionByName(small.select("id", "url", "payload", "digest", "first_id"))


def make_record(page_id: int | None, url: str, payload: bytes, digest: str, first_id: int | None, date: str) -> bytes:
    """One record, uncompressed. A revisit keeps the HTTP header, with the full length, and leaves the payload out."""
    revisit = first_id is not None and page_id != first_id
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    name = "null" if page_id is None else str(page_id)
    uri = "".join(c if c.isprintable() and c != " " else "%{:02X}".format(ord(c)) for c in url)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{first_id}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_warc(planned: DataFrame, path: str, *, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 20000) -> None:
    """Write what ``plan_records`` gives to a new folder of ``.gz`` archives with one member per record."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page_id, url, payload, digest, first_id in zip(*(batch.column(k) for k in range(5))):
                out.append(gzip_member(make_record(page_id.as_py(), url.as_py(), payload.as_py().encode(), digest.as_py(), first_id.as_py(), date)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    rows = planned.select("id", "url", "payload", "digest", "first_id").mapInArrow(members, "member binary")
    # The text writer passes the bytes of a string on as they are.
    rows.select(F.col("member").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("maxRecordsPerFile", records_per_file).text(path)


# ---------------------------------------------------------------- reading


class Damaged(ValueError):
    """A failed check of a member or a record."""


@dataclass
class Record:
    """A parsed record, and where it begins and ends in its archive."""

    start: int
    stop: int
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""


def _member(data: memoryview, at: int) -> tuple[bytes, int]:
    """The content of the gzip member at ``at``, and where it ends."""
    unpacker, out, pos = zlib.decompressobj(31), [], at
    try:
        while not unpacker.eof:
            piece = data[pos : pos + _STEP]
            if not len(piece):
                raise Damaged("member cut short")
            out.append(unpacker.decompress(piece))
            pos += len(piece)
    except zlib.error as e:
        raise Damaged(f"member: {e}") from None
    return b"".join(out), pos - len(unpacker.unused_data)


def _readable(data: memoryview, at: int) -> bytes:
    """What can be unpacked of the damaged member at ``at``, to the byte before which it fails."""
    unpacker, out, pos, step = zlib.decompressobj(31), [], at, _STEP
    while pos < len(data) and not unpacker.eof:
        before = unpacker.copy() if step > 1 else None
        try:
            out.append(unpacker.decompress(data[pos : pos + step]))
            pos += step
        except zlib.error:
            if before is None:
                break
            unpacker, step = before, 1
    return b"".join(out)


def _inside(inner: bytes) -> tuple[list[tuple[dict[str, str], bytes]], str | None]:
    """The sound records of a member's content, and the first failed check; after one, the search goes on at the next version line."""
    sound, why, place = [], None, 0
    while 0 <= place < len(inner):
        try:
            headers, block, place = _record(inner, place)
            sound.append((headers, block))
        except Damaged as e:
            why = why or str(e)
            place = inner.find(_VERSION, place + 1)
    return sound, why


def _record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the uncompressed record at ``at``; raises ``Damaged``."""
    version = _VERSION_LINE.match(data, at)
    if not version:
        raise Damaged("no version line")
    headers, pos = {}, version.end()
    while (over := data.find(b"\r\n", pos)) != pos:  # line by line, so that a header of any length is read, and a false one is left early
        if over < 0:
            raise Damaged("header without end")
        name, colon, value = data[pos:over].partition(b":")
        if not colon:
            raise Damaged("header line without colon")
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
        pos = over + 2
    if not headers.get("content-length", "").isdigit():
        raise Damaged("no content length")
    first = pos + 2
    last = first + int(headers["content-length"])
    if data[last : last + 4] != b"\r\n\r\n":
        raise Damaged("block without end")
    block = data[first:last]
    wanted = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") == "response" and wanted.startswith("sha256:") and hashlib.sha256(payload_of(block)).hexdigest() != wanted[7:].lower():
        raise Damaged("payload digest differs")
    return headers, block, last + 4


def payload_of(block: bytes) -> bytes:
    """What follows the HTTP header of a block."""
    return block.partition(b"\r\n\r\n")[2]


def read_archive(content: bytes) -> Iterator[Record | tuple[int, int, str]]:
    """Records, and gaps as (start, stop, reason), in the order of the file; no byte is in both.

    The bytes of a member with a failed check are a gap's; the sound records in it are given all the same, with an empty place at its start.
    """
    data, at, gap, why, end = memoryview(content), 0, None, "", len(content)
    saved: list[tuple[dict[str, str], bytes]] = []
    while at < end:
        found: list[Record] = []
        sound, stop = [], None
        try:
            if content[at : at + 3] == _MAGIC:
                try:
                    inner, stop = _member(data, at)
                except Damaged:
                    sound = _inside(_readable(data, at))[0]
                    raise
                sound, bad = _inside(inner)  # a member may hold several records
                if bad is not None:
                    raise Damaged(bad)
                found += [Record(at, stop, *x) for x in sound]
            else:
                headers, block, stop = _record(content, at)
                if (headers, block) in saved:  # stored as it is in a damaged member that has been read
                    at = stop
                    continue
                found.append(Record(at, stop, headers, block))
        except Damaged as e:
            if gap is None:
                gap, why = at, str(e)
            saved += sound
            yield from (Record(at, at, *x) for x in sound)
            if stop is not None and sound:
                at = stop
                continue
            places = [p for p in (content.find(_MAGIC, at + 1), content.find(_VERSION, at + 1)) if p >= 0]
            at = min(places, default=end)
            continue
        if gap is not None:
            yield gap, at, why
            gap, saved = None, []
        yield from found
        at = stop
    if gap is not None:
        yield gap, end, why


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ``RECORD_SCHEMA``: kind is ``record`` or ``gap``.

    Of a record: its ids (``refers_to`` of revisits), URI, the length, SHA-256 and bytes of its payload; a revisit has length
    and digest from its header, and no bytes. Of a gap: its bytes' place and the failed check. An empty file gives no rows. Files that are
    no archives are one gap each.
    """
    schema = pa.schema([("archive", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.string()), ("reason", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def rows_of(name: str, content: bytes) -> Iterator[tuple]:
        for x in read_archive(content):
            if isinstance(x, tuple):
                yield (name, x[0], x[1], "gap", x[2], *[None] * 7)
                continue
            h, kind = x.headers, x.headers.get("warc-type")
            if kind == "revisit":
                length = re.search(rb"(?im)^content-length:[ \t]*(\d+)", x.block)
                payload, size, digest = None, int(length[1]) if length else None, h.get("warc-payload-digest", "").rpartition(":")[2].lower() or None
            else:
                payload = payload_of(x.block) if h.get("content-type", "").startswith("application/http") else x.block
                size, digest = len(payload), hashlib.sha256(payload).hexdigest()
            yield name, x.start, x.stop, "record", None, h.get("warc-record-id"), kind, h.get("warc-refers-to"), h.get("warc-target-uri"), size, digest, payload

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                held, size = [], 0
                for row in rows_of(name.as_py(), content.as_py()):
                    held.append(row)
                    size += len(row[-1] or b"")
                    if size >= 1 << 23 or len(held) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(read, RECORD_SCHEMA)


def round_trip(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write a record per page to ``path`` and read the archives back.

    Per page: ``id_col, payload_bytes, payload_digest, record_type, refers_to``. Null payloads and URLs are empty. Rows with the same
    smallest id are responses, all of them. A null id takes no part in the choice of the smallest; such a row is a revisit where
    another page has its payload and an id. An empty table gives an empty result; other columns are ignored.
    """
    spark = pages.sparkSession
    write_warc(plan_records(pages, id_col=id_col, url_col=url_col, payload_col=payload_col, least_bytes=least_bytes), path)
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    return read_warc(spark, path).where("kind = 'record'").select(page("record_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
