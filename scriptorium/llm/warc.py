"""Legacy web archives: ARC records in, WARC records out, and back.

An ARC file opens with a ``filedesc:`` record whose body names the version and the
fields of each record's header line; version 1 has five fields, version 2 ten. A
header line ends with the declared length, the body follows. The converter reads
either version and synthesises for each record what WARC asks for and ARC lacks:
a record id (a name-based UUID), an ISO timestamp from the 14 digits (or fewer), a
record type from the scheme and body, and SHA-256 digests of payload and block.

Records whose payload another record already holds become ``revisit`` records:
their HTTP head, with the length of the whole payload, and its digest, but no
payload. Which ones is settled beforehand in Spark over digests, not texts.

WARC files hold one gzip member a record, as usual, so any record can be read alone.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import settle, text_bytes
from scriptorium.llm.files import fresh_name, make_folder, resolve
from scriptorium.session import new_path

# The header fields of the two ARC versions, and WARC's names.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REVISIT_BYTES = 100
FILE_BYTES = 256 << 20
PIECE_BYTES = 4 << 20
DATE = "20000101000000"
READ_BYTES = 1 << 20


# --- ARC ------------------------------------------------------------------------


@dataclass
class ArcRecord:
    """A record's named header fields and its body; ``problem`` says what is wrong with it."""

    version: int
    fields: dict[str, str]
    body: bytes
    offset: int
    problem: str = ""
    first: bool = False  # of its file

    @property
    def is_filedesc(self) -> bool:
        """Whether this is the file's description of itself; such an address further on is a page like any other."""
        return self.first and self.fields.get("URL", "").startswith("filedesc:")


def arc_file(records: Iterable[tuple[str, str, str, str, bytes]], version: int = 1, name: str = "made.arc") -> bytes:
    """An ARC file of (url, ip, date, content type, body) records."""
    head = f"{version} 0 scriptorium\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    parts, at = [], 0
    for url, ip, date, kind, body in [(f"filedesc://{name}", "0.0.0.0", DATE, "text/plain", head), *records]:
        values = {"URL": re.sub(r"\s", "%20", url) or "-", "IP-address": ip, "Archive-date": date, "Content-type": kind,
                  "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": str(at), "Filename": name,
                  "Archive-length": str(len(body))}
        record = " ".join(values[f] for f in ARC_FIELDS[version]).encode() + b"\n" + body + b"\n"
        parts.append(record)
        at += len(record)
    return b"".join(parts)


def arc_records(data: bytes) -> Iterator[ArcRecord]:
    """All records of an ARC file, its ``filedesc:`` record first.

    A record cut short by the end of the file is given with what is there and the
    problem ``truncated``. A line that is no header is given as a record with the
    problem ``header`` and an empty body, and reading goes on behind it.
    """
    at, version, first = 0, 0, True
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):  # separators between records
            at += 1
            continue
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        values = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        if not version:  # the first header line tells by its number of fields, its body by name
            version = 2 if len(values) >= 10 else 1
            told = re.match(rb"([12]) \S+ ", data[end + 1 : end + 80])
            described = int(told[1]) if told else version
        names = ARC_FIELDS[version]
        if len(values) > len(names):  # blanks inside the address belong to it
            extra = len(values) - len(names)
            values = [" ".join(values[: extra + 1]), *values[extra + 1 :]]
        if len(values) < len(names) or not values[-1].isdigit():
            yield ArcRecord(version, {"URL": " ".join(values)}, b"", at, "header", first)
            at, first = end + 1, False
            continue
        size = int(values[-1])
        body = data[end + 1 : end + 1 + size]
        record = ArcRecord(version, dict(zip(names, values, strict=True)), body, at, "" if len(body) == size else "truncated", first)
        yield record
        if record.is_filedesc:
            version = described
        first = False
        at = end + 1 + size


# --- WARC -----------------------------------------------------------------------


@dataclass
class WarcRecord:
    headers: dict[str, str]
    block: bytes = b""
    extra: dict[str, str] = field(default_factory=dict)

    def to_bytes(self) -> bytes:
        named = self.headers | self.extra | {"Content-Length": str(len(self.block))}
        lines = "".join(f"{k}: {v}\r\n" for k, v in named.items())
        return f"WARC/1.1\r\n{lines}\r\n".encode() + self.block + b"\r\n\r\n"


def warc_date(arc_date: str) -> str:
    """ISO form of up to 14 digits; missing parts are their smallest value."""
    digits = re.sub(r"\D", "", arc_date)[:14]
    full = digits + "00000101000000"[len(digits) :] if len(digits) < 14 else digits
    y, mo, d, h, mi, s = (int(x) for x in (full[:4], full[4:6], full[6:8], full[8:10], full[10:12], full[12:14]))
    mo, d = min(max(mo, 1), 12), min(max(d, 1), 31)
    return f"{y:04d}-{mo:02d}-{d:02d}T{min(h, 23):02d}:{min(mi, 59):02d}:{min(s, 59):02d}Z"


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """HTTP head with its blank line, and payload; all is payload if there is no head."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    end = body.find(b"\r\n\r\n")
    return (body, b"") if end < 0 else (body[: end + 4], body[end + 4 :])


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(parts))}>"


def convert(record: ArcRecord, key: str = "", refers_to: str | None = None, extra: dict[str, str] | None = None) -> WarcRecord:
    """The WARC record of an ARC record.

    ``key`` names the record (by default its address, date and offset), so the same
    name gives the same id everywhere. With ``refers_to``, the key of the record
    that holds the payload, it becomes a revisit.
    """
    url, date = record.fields.get("URL", ""), record.fields.get("Archive-date", "")
    head, payload = split_http(record.body)
    headers = {
        "WARC-Type": "response", "WARC-Record-ID": record_id(key or f"{url} {date} {record.offset}"), "WARC-Date": warc_date(date),
        "WARC-Target-URI": url, "Content-Type": "application/http; msgtype=response",
    }
    if re.fullmatch(r"[0-9A-Fa-f.:]+", ip := record.fields.get("IP-address", "")) and ip != "0.0.0.0":
        headers["WARC-IP-Address"] = ip
    if record.is_filedesc:
        headers |= {"WARC-Type": "warcinfo", "Content-Type": "application/warc-fields"}
        del headers["WARC-Target-URI"]
        body = f"software: scriptorium\r\nformat: WARC File Format 1.1\r\nconverted-from: ARC version {record.version}\r\n"
        return WarcRecord(headers, body.encode(), extra or {})
    if not head:
        headers |= {"WARC-Type": "resource", "Content-Type": record.fields.get("Content-type", "application/octet-stream")}
    if record.problem == "truncated":
        headers["WARC-Truncated"] = "length"
    headers["WARC-Payload-Digest"] = f"sha256:{hashlib.sha256(payload).hexdigest()}"
    block = record.body
    if refers_to is not None and head:
        headers |= {"WARC-Type": "revisit", "WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(refers_to)}
        block = head
    headers["WARC-Block-Digest"] = f"sha256:{hashlib.sha256(block).hexdigest()}"
    return WarcRecord(headers, block, extra or {})


def gzip_member(data: bytes, level: int = 4) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def members(source) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    left = b""
    while True:
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            chunk = left or source.read(READ_BYTES)
            left = b""
            if not chunk:
                if parts:
                    raise ValueError("the last record is cut short")
                return
            parts.append(unpack.decompress(chunk))
        left = unpack.unused_data
        yield b"".join(parts)


def parse_warc(data: bytes) -> WarcRecord:
    end = data.find(b"\r\n\r\n")
    first, *lines = data[:end].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    return WarcRecord(headers, data[end + 4 : end + 4 + int(headers["Content-Length"])])


# --- pages ----------------------------------------------------------------------


def revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(digest, first_id) of payloads of ``least`` bytes or more that several pages have."""
    sized = pages.select("page_id", F.sha2(text_bytes("html"), 256).alias("digest"), F.octet_length(text_bytes("html")).alias("n"))
    groups = sized.where(F.col("n") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    return groups.where("n > 1 and first_id is not null").select("digest", "first_id")


def _page_arc(rows: list[tuple], version: int) -> bytes:
    """Pages as an ARC file: each body is an HTTP response that carries the page's id."""
    records = []
    for page_id, url, payload, _ in rows:
        known = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{known}Content-Length: {len(payload)}\r\n\r\n"
        records.append((url or "-", "0.0.0.0", DATE, "text/html", head.encode() + payload))
    return arc_file(records, version)


def write_warc(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a WARC record for each page by way of ARC records; gives (file, n_records).

    Of pages with equal payloads of 100 bytes or more, that with the smallest id is
    the response and the others revisit it; pages that share this id too are
    responses. A null html is an empty payload; a null url is ``-``; a page without
    id revisits like any other, but is never revisited. ARC batches alternate between
    the two versions.
    """
    make_folder(folder)

    def run(batches):
        part, rows, sink, size = TaskContext.get().partitionId(), [], None, 0
        system, base = resolve(folder)
        batch_no = 0
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for piece in _by_bytes(list(zip(*columns, strict=True))):
                version, batch_no = 1 + batch_no % 2, batch_no + 1
                described, *records = arc_records(_page_arc(piece, version))
                if sink is None or size >= file_bytes:
                    if sink:
                        sink.close()
                    name, size = fresh_name(part, len(rows), ".warc.gz"), 0
                    sink = system.open_output_stream(f"{base}/{name}", compression=None)
                    rows.append({"file": f"{folder}/{name}", "n_records": 0})
                    size += sink.write(gzip_member(convert(described, name).to_bytes())) or 0
                for (page_id, _, _, first), record in zip(piece, records, strict=True):
                    extra = {} if page_id is None else {"WARC-X-Page-ID": str(page_id)}
                    again = first is not None and first != page_id
                    if again:
                        extra["WARC-X-Refers-To-Page-ID"] = str(first)
                    made = convert(record, f"page:{page_id}", f"page:{first}" if again else None, extra)
                    data = gzip_member(made.to_bytes())
                    sink.write(data)
                    size += len(data)
                    rows[-1]["n_records"] += 1
        if sink:
            sink.close()
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("file", pa.string()), ("n_records", pa.int64())]))

    known = settle(revisits(pages), "warc-revisits")
    payload = text_bytes("html")
    matched = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest")).join(known, "digest", "left")
    written = matched.select("page_id", "url", "payload", "first_id").mapInArrow(run, "file string, n_records bigint")
    return settle(written, "warc-files")


def _by_bytes(rows: list[tuple]) -> Iterator[list[tuple]]:
    """Runs of rows of about ``PIECE_BYTES`` of payload."""
    piece, size = [], 0
    for row in rows:
        if piece and size + len(row[2]) > PIECE_BYTES:
            yield piece
            piece, size = [], 0
        piece.append(row)
        size += len(row[2])
    if piece:
        yield piece


def read_warc(files: DataFrame) -> DataFrame:
    """One row for each page record of the written files, from what the files say.

    Digests and lengths of responses are taken from the stored payload, and must
    agree with their headers; those of revisits are in their headers.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def row(record: WarcRecord) -> tuple:
        h = record.headers
        head, payload = split_http(record.block)
        digest, kind = h["WARC-Payload-Digest"].removeprefix("sha256:"), h["WARC-Type"]
        size = int(re.search(rb"(?i)\r\ncontent-length: (\d+)", head)[1])
        if kind == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
            raise ValueError(f"payload of {h['WARC-Record-ID']} does not match its headers")
        number = lambda k: int(h[k]) if k in h else None
        return number("WARC-X-Page-ID"), size, digest, kind, number("WARC-X-Refers-To-Page-ID")

    def run(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                system, path = resolve(file)
                rows = []
                with system.open_input_stream(path, compression=None) as source:
                    for data in members(source):
                        record = parse_warc(data)
                        if record.headers["WARC-Type"] != "warcinfo":
                            rows.append(row(record))
                        if len(rows) == 10_000:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    def _batch(rows):
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    tasks = max(1, min(files.count(), 10_000))
    return files.select("file").repartition(tasks).mapInArrow(
        run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    )


def convert_arc_files(spark, folder: str, target: str) -> DataFrame:
    """Convert every ``.arc`` and ``.arc.gz`` file below a folder; gives (source, file, n_records, n_problems).

    One file is one task's work; a record with a broken header is counted and left out.
    """
    make_folder(target)

    def run(batches):
        system, base = resolve(target)
        for batch in batches:
            for k, (path, data) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if data[:2] == b"\x1f\x8b":
                    data = b"".join(members(pa.BufferReader(data)))
                name, done, bad = fresh_name(TaskContext.get().partitionId(), k, ".warc.gz"), 0, 0
                with system.open_output_stream(f"{base}/{name}", compression=None) as sink:
                    for record in arc_records(data):
                        if record.problem == "header":
                            bad += 1
                            continue
                        key = f"{path} {record.offset}"
                        sink.write(gzip_member(convert(record, key).to_bytes()))
                        done, bad = done + 1, bad + bool(record.problem)
                yield pa.RecordBatch.from_pylist(
                    [{"source": path, "file": f"{target}/{name}", "n_records": done, "n_problems": bad}],
                    schema=pa.schema([("source", pa.string()), ("file", pa.string()), ("n_records", pa.int64()), ("n_problems", pa.int64())]),
                )

    read = spark.read.format("binaryFile").option("pathGlobFilter", "*.{arc,arc.gz}").option("recursiveFileLookup", "true")
    files = read.load(folder).select("path", "content")
    return settle(files.mapInArrow(run, "source string, file string, n_records bigint, n_problems bigint"), "warc-converted")


def page_archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archive all pages and describe each from its record."""
    return read_warc(write_warc(pages.select("page_id", "url", "html"), folder or new_path(pages.sparkSession, "warc")))
