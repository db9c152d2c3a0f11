"""Web archives: ARC files, their conversion to WARC, and the reading of both.

An ARC file opens with a version block that names the fields of its record lines; version 1 has five,
version 2 ten. A record is such a line, then as many bytes as the line declares, then a line feed. The
converter parses the lines by the file's own version and cuts by declared lengths alone, then synthesises what
WARC asks for: an identifier, a time stamp, a type and digests for each record.

Blocks are bytes: pages in old character sets, images, redirects and errors keep their HTTP head and their body as
they came. Each record is a gzip member of its own, so that readers can seek. Spark's text writer writes the files, a row
of it being a whole archive of bounded size, whose bytes it does not look at; an archive is read whole, so that bound
is also what a reader holds.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import new_path, small_batches, written

#: The field lists of ARC record lines by version.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
CRLF = b"\r\n"
#: Fields of version 2 that a WARC record keeps under these names.
_ARC_MORE = {"result": "X-Arc-Result-Code", "checksum": "X-Arc-Checksum", "location": "X-Arc-Location"}
#: Bytes of an archive before it is closed, and of records in one batch of a reader.
ARCHIVE_BYTES = 8 << 20
BATCH_BYTES = 4 << 20
#: A payload must have so many bytes to be revisited.
REVISIT_BYTES = 100

_ARC = "record_no bigint, place string, version int, http int, url string, ip string, date string, media string, result string, checksum string, location string, page_id bigint, head binary, payload binary, payload_bytes bigint, payload_digest string, error string"
_WARC = "warc_type string, record_id string, refers_id string, date string, uri string, page_id bigint, refers_to bigint, payload_digest string, payload_bytes bigint, head binary, payload binary, error string"


class ArcRecord(NamedTuple):
    """A record of an ARC file: the fields of its line, and the bytes that it declares."""

    version: int
    fields: dict[str, str]
    block: bytes
    error: str | None


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file after its version block.

    A line whose fields do not fit the version, or whose length is no number, ends the file: its record has
    an error and the rest of the bytes. So has a record that is cut short.
    """
    names, at = [], 0
    version = 0
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line = data[at:end].decode("utf-8", "replace")
        values = line.split(" ")
        opening = line.startswith("filedesc://")
        expected = ARC_FIELDS[1].split(" ") if opening else names
        if len(values) != len(expected) or not values[-1].isdigit():
            yield ArcRecord(version, {}, data[end + 1 :], f"bad record line: {line[:80]}")
            return
        length = int(values[-1])
        block = data[end + 1 : end + 1 + length]
        at = end + 1 + length
        if opening:
            head, _, listed = block.decode("utf-8", "replace").partition("\n")
            version = int(head.split(" ")[0]) if head[:1].isdigit() else 0
            names = listed.partition("\n")[0].split(" ")
            if version not in ARC_FIELDS or names != ARC_FIELDS[version].split(" "):
                yield ArcRecord(version, {}, block, f"unknown version: {head[:80]}")
                return
            continue
        yield ArcRecord(version, dict(zip(names, values, strict=True)), block, None if len(block) == length else "cut short")


def _version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 trialframe\n{ARC_FIELDS[version]}\n".encode()
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {len(body)}\n".encode() + body


_JOB = r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}-?"


def _place(path: str, record: int) -> str:
    """Where a record is among archives that were written together, whatever the writer's job was called."""
    folder, _, name = path.rpartition("/")
    return f"{folder.rpartition('/')[2]}/{re.sub(_JOB, '', name)}/{record}"


def _file(path: str) -> Column:
    """The places of a file's records, without their numbers."""
    named = F.substring_index(path, "/", -2)
    return F.concat_ws("/", F.substring_index(named, "/", 1), F.regexp_replace(F.substring_index(named, "/", -1), _JOB, ""))


_HEAD_END = re.compile(rb"\r?\n\r?\n")


def _http(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """The header fields, in lower case, the head with its empty line, and the body of an HTTP message."""
    end = _HEAD_END.search(block)
    at = end.end() if end else len(block)
    fields = (x.partition(":") for x in block[:at].decode("latin-1").splitlines()[1:])
    return {k.strip().lower(): v.strip() for k, _, v in fields}, block[:at], block[at:]


def _field(text: str | None) -> str:
    """A value that holds no white space, for a record line."""
    return quote(text, safe="%:/?#[]@!$&'()*+,;=~") if text else "-"


def _member(record: bytes) -> bytes:
    return gzip.compress(record, mtime=0)


#: Bytes that are given to a member at once; what it leaves of them is copied.
_PIECE = 2048


def _unzipped(data: bytes) -> bytes:
    """The content of all gzip members of ``data``, each byte of which is read about once however many they are."""
    parts, at, view = [], 0, memoryview(data)
    while at < len(data):
        member = zlib.decompressobj(wbits=31)
        while not member.eof:
            if at >= len(data):
                raise EOFError("the archive ends inside a gzip member")
            piece = view[at : at + _PIECE]
            parts.append(member.decompress(piece))
            at += len(piece) - len(member.unused_data)
        while data[at : at + 1] == b"\0":  # padding
            at += 1
    return b"".join(parts)


def _closed(members: list[bytes]) -> bytes:
    """An archive without its last byte, which is 0 and which the writer adds: the highest byte of the last member's size."""
    if members[-1][-1:] != b"\0":  # a record of 16 MB or more; a member without content ends in 0
        members.append(_member(b""))
    return b"".join(members)[:-1]


def _archives(records: Iterator[bytes], opening: bytes) -> Iterator[pa.RecordBatch]:
    """Rows of the writer: archives of about ARCHIVE_BYTES of records, each with its opening."""
    held, size = [_member(opening)], 0
    for record in records:
        held.append(_member(record))
        size += len(record)
        if size >= ARCHIVE_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array([_closed(held)], pa.binary())], names=["value"])
            held, size = [_member(opening)], 0
    if len(held) > 1:
        yield pa.RecordBatch.from_arrays([pa.array([_closed(held)], pa.binary())], names=["value"])


def _write(rows: DataFrame, path: str) -> None:
    # bytes pass the text writer as they are; its separator is the last byte of an archive
    rows.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def write_arc(pages: DataFrame, path: str, version: int, date: str = "20240101000000") -> None:
    """Writes (page_id, url, html) as ARC files of ``version``, each record an HTTP response with the page's id."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                body = (html or "").encode("utf-8", "replace")
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if page_id is None else page_id}\r\n\r\n"
                block = head.encode() + body
                line = [_field(url), "0.0.0.0", date, "text/html"]
                if version == 2:
                    line += ["200", hashlib.md5(block).hexdigest(), "-", "0", "-"]
                yield " ".join([*line, str(len(block))]).encode() + b"\n" + block + b"\n"

    opening = _version_block(version, "pages.arc", date) + b"\n"
    columns = (F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    _write(pages.select(*columns).mapInArrow(lambda batches: _archives(records(batches), opening), "value binary"), path)


def _read(files: DataFrame, parse, schema: str) -> DataFrame:
    """Rows that ``parse`` makes of each file's bytes and what else ``files`` tells of it, in batches of bounded size."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for path, content, *more in zip(*files.columns, strict=True):
                data = content.as_py()
                rows, size = [], 0
                for row in parse(_unzipped(data) if data[:2] == b"\x1f\x8b" else data, path.as_py(), *(x.as_py() for x in more)):
                    rows.append(row)
                    size += 200 + sum(len(x) for x in row if isinstance(x, bytes))
                    if size >= BATCH_BYTES:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    return files.mapInArrow(run, schema)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_arc(spark: SparkSession, path: str, revisits: DataFrame | None = None) -> DataFrame:
    """The records of ARC files of either version, gzipped or not.

    (record_no, place, version, http, url, ip, date, media, result, checksum, location, page_id, head, payload, payload_bytes,
    payload_digest, error): the payload is the body of the HTTP message, or all of a block that is none (http 0), such as a
    DNS answer; its digest is the bare SHA-256. ``head`` is the message's own head, byte for byte. Result, checksum and
    location are fields of version 2, null where a line has none. ``place`` names the record's file and number. Malformed records have an error.

    ``revisits`` (place, refers_to, refers_place, refers_date) of some records become columns of theirs. They meet whole
    files as they are stored, so that no payload is moved.
    """

    def parse(data: bytes, path: str, *refers: list[dict] | None) -> Iterator[tuple]:
        told = {x["place"]: (x["refers_to"], x["refers_place"], x["refers_date"]) for found in refers for x in found or ()}
        for i, x in enumerate(parse_arc(data)):
            http = x.block.startswith(b"HTTP/")
            header, head, body = _http(x.block) if http else ({}, b"", x.block)
            number = header.get("x-page-id", "")
            given = {k: v for k, v in x.fields.items() if v != "-"}
            yield (i, _place(path, i), x.version, int(http), given.get("URL"), *(x.fields.get(k) for k in ("IP-address", "Archive-date", "Content-type")), *(given.get(k) for k in ("Result-code", "Checksum", "Location")), int(number) if number.lstrip("-").isdigit() else None, head, body, len(body), hashlib.sha256(body).hexdigest(), x.error, *(told.get(_place(path, i), (None, None, None)) if refers else ()))

    files = _files(spark, path)
    if revisits is None:
        return _read(files, parse, _ARC)
    of_file = revisits.groupBy(F.regexp_replace("place", "/[0-9]+$", "").alias("file")).agg(F.collect_list(F.struct("place", "refers_to", "refers_place", "refers_date")).alias("refers"))
    files = files.join(of_file, _file("path") == F.col("file"), "left").select("path", "content", "refers")
    return _read(files, parse, f"{_ARC}, refers_to bigint, refers_place string, refers_date string")


def with_revisits(records: DataFrame) -> DataFrame:
    """``records`` with ``refers_to``: the smallest page_id of those with an equal payload, if another's.

    ``refers_place`` and ``refers_date`` are those of that page's first record.
    Payloads under REVISIT_BYTES refer to nothing, nor does a record without a page_id if none has one. Only
    digests are grouped; payloads stay with their records unless the join has to move them.
    """
    long = F.col("payload_bytes") >= REVISIT_BYTES
    first = (
        records.filter(long & F.col("error").isNull())
        .groupBy(F.col("payload_digest").alias("digest"), F.col("payload_bytes").alias("bytes"))
        .agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "place", "date"))).alias("first"), F.count("*").alias("copies"))
        .filter("copies > 1")
    )
    joined = records.join(first, (F.col("payload_digest") == F.col("digest")) & (F.col("payload_bytes") == F.col("bytes")), "left")
    other = F.col("first").isNotNull() & ~F.col("first.page_id").eqNullSafe(F.col("page_id"))
    refers = {f"refers_{name}": F.when(other, F.col(f"first.{c}")) for name, c in (("to", "page_id"), ("place", "place"), ("date", "date"))}
    return joined.withColumns(refers).drop("digest", "bytes", "first", "copies")


def _record_id(page_id: int | None, digest: str, date: str | None, place: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}/{date}/{place}')}>"


def _iso(date: str | None) -> str:
    """A time stamp from up to 14 digits; of what is left out, the first month, day or second."""
    d = re.sub(r"\D", "", date or "")[:14]
    d += "00010101000000"[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + CRLF + block + CRLF + CRLF


def write_warc(records: DataFrame, path: str) -> None:
    """Writes rows of ``read_arc`` with ``refers_to`` as WARC files; malformed rows are left out.

    A response has the HTTP message as its block, as it came, whatever its status and character set; a revisit has only
    the head of that message, and the digest and size of the full payload. A block that was no HTTP message is a
    resource. What a version 2 line says of result, checksum and location is kept in fields of their own.
    """

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        names = ("url", "date", "media", "page_id", "head", "payload", "payload_digest", "payload_bytes", "refers_to", "refers_place", "refers_date", "place", "http", *_ARC_MORE)
        for batch in batches:
            for url, date, media, page_id, head, payload, digest, size, refers, refers_place, refers_date, place, http, *more in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                block = head if refers is not None else head + payload
                kind = "revisit" if refers is not None else "response" if http else "resource"
                fields = [("WARC-Type", kind), ("WARC-Record-ID", _record_id(page_id, digest, date, place)), ("WARC-Date", _iso(date))]
                if url:
                    fields.append(("WARC-Target-URI", url))
                fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("X-Payload-Bytes", str(size))]
                fields += [(name, value) for name, value in zip(_ARC_MORE.values(), more, strict=True) if value is not None]
                if page_id is not None:
                    fields.append(("X-Page-Id", str(page_id)))
                if refers is not None:
                    fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(refers, digest, refers_date, refers_place)), ("WARC-Refers-To-Date", _iso(refers_date)), ("X-Refers-To-Page", str(refers))]
                yield _warc_record([*fields, ("Content-Type", "application/http; msgtype=response" if http else media or "application/octet-stream")], block)

    body = b"software: trialframe\r\nformat: WARC File Format 1.1\r\n"
    opening = _warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(None, hashlib.sha256(body).hexdigest(), "", "")), ("WARC-Date", "2024-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], body)
    _write(records.filter("error is null").mapInArrow(lambda batches: _archives(lines(batches), opening), "value binary"), path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """The header fields, in lower case, and block of each record of a WARC file, by declared lengths."""
    at = 0
    while at < len(data):
        if data[at : at + 1] in (b"\r", b"\n"):
            at += 1
            continue
        end = data.find(CRLF + CRLF, at)
        lines = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = fields.get("content-length", "")
        if end < 0 or not lines[0].startswith("WARC/") or not length.isdigit():
            yield fields, data[at:], "bad record header"
            return
        block = data[end + 4 : end + 4 + int(length)]
        at = end + 4 + int(length)
        yield fields, block, None if len(block) == int(length) else "cut short"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The response, resource and revisit records of WARC files, gzipped or not, each with its payload.

    (warc_type, record_id, refers_id, date, uri, page_id, refers_to, payload_digest, payload_bytes, head, payload, error): a
    revisit has no payload; its digest and bytes are those of the full one. A response whose payload does
    not have the digest that it declares has an error.
    """

    def parse(data: bytes, _: str) -> Iterator[tuple]:
        for fields, block, error in parse_warc(data):
            kind = fields.get("warc-type")
            if kind not in ("response", "resource", "revisit") and error is None:
                continue
            number = lambda k: int(fields[k]) if fields.get(k, "").lstrip("-").isdigit() else None  # noqa: B023, E731
            digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
            payload, size = None, number("x-payload-bytes")
            head = _http(block)[1] if kind in ("response", "revisit") else b""
            if kind in ("response", "resource"):
                payload = block[len(head) :]
                size = len(payload)
                if error is None and hashlib.sha256(payload).hexdigest() != digest:
                    error = "digest differs"
            yield kind, fields.get("warc-record-id"), fields.get("warc-refers-to"), fields.get("warc-date"), fields.get("warc-target-uri"), number("x-page-id"), number("x-refers-to-page"), digest, size, head, payload, error

    return _read(_files(spark, path), parse, _WARC)


def archive_pages(pages: DataFrame) -> DataFrame:
    """The records of WARC archives made of all ``pages`` (page_id, url, html) by way of ARC files, as read back.

    Pages with an even id are taken from version 1 files, all others from version 2. Null html is an empty
    payload. Of pages with equal payloads of 100 bytes or more, that with the smallest page_id is a
    response and the others revisit it; rows that repeat that page_id are all responses. Pages without an id
    revisit one that has an id, and are responses if there is none. Other columns are not read.
    """
    spark = pages.sparkSession
    small_batches(spark)
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    even = F.coalesce(F.pmod("page_id", F.lit(2)) == 0, F.lit(False))
    write_arc(pages.filter(even), f"{arc}/v1", 1)
    write_arc(pages.filter(~even), f"{arc}/v2", 2)
    records = read_arc(spark, f"{arc}/*").select("place", "page_id", "payload_digest", "payload_bytes", "date", "error")
    revisits = written(with_revisits(records).filter("refers_to is not null").select("place", "refers_to", "refers_place", "refers_date"), "revisits")
    write_warc(read_arc(spark, f"{arc}/*", revisits), warc)
    return read_warc(spark, warc)


def bare(digest: Column) -> Column:
    """A digest without the name of its algorithm."""
    return F.regexp_replace(digest, "^sha256:", "")
