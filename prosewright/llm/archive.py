"""Converts legacy ARC archives (versions 1 and 2) to WARC 1.1 and reads both.

ARC: a file starts with a filedesc record whose body names the version and the fields of the header lines. Each
record is a header line, as many bytes as the line declares, and a line feed. The converter gives each a WARC record
identifier (a name-based UUID), WARC-Date, type, target URI, payload and block digests. Of records with equal
payloads of at least REVISIT_BYTES the one with the least id is a response and the others revisit it.

Every record is a gzip member of its own. Spark's text writer writes the files, so they land in any store that Spark
can write and lost tasks are written again: a row is a segment of whole members of some SEGMENT bytes without its last
byte, which is zero and is what the writer puts after each row. FILE_SEGMENTS segments make a file, so files are bounded
by bytes. Readers inflate a file by and by and follow declared lengths, so payloads may contain anything and a worker
holds a file as it is stored and one record of it.

The converter reads the ARC files twice. First ids and digests alone move, and give the place (file and number) of each
record that revisits, with what it refers to. Then each file's records meet the places by broadcast, within a checked
size: where there are more, files and places are cut into slices by the files' names, one after the other. Payloads
never shuffle.

Defined results: a null payload is empty; a null url is written as "urn:null"; white space and controls in urls are
percent-encoded in header lines; a date that names less than a second, or an impossible month, day or time, keeps what
is valid of it, as WARC 1.1 allows; an archive without records gives none; a truncated or malformed record, or a date
without a year, raises an error that names the place; rows that share an id each get a record of the same type; a row
without an id is always a response and is never referred to; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosewright.llm.common import BROADCAST_BYTES, Scratch, join_groups, lean, small_batches

REVISIT_BYTES, SEGMENT, FILE_SEGMENTS, ARC_DATE = 100, 4 << 20, 8, "20200102030405"
#: Fixed field lists of the two header versions.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
CRLF = b"\r\n"


class ArcRecord(NamedTuple):
    fields: dict[str, str]
    block: bytes


class WarcRecord(NamedTuple):
    headers: dict[str, str]
    block: bytes


def safe(url: str | None) -> str:
    """A url fit for a header line of fields parted by blanks."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "urn:null")


# ARC


def arc_header(version: int, url: str | None, date: str, kind: str, length: int, code: int = 200, ip: str = "0.0.0.0") -> bytes:
    if version == 1:
        return f"{safe(url)} {ip} {date} {kind} {length}\n".encode()
    return f"{safe(url)} {ip} {date} {kind} {code} - - 0 - {length}\n".encode()


def arc_filedesc(version: int, name: str = "converted", date: str = ARC_DATE) -> bytes:
    body = f"{version} 0 prosewright\n{FIELDS[version]}\n".encode()
    return arc_header(version, f"filedesc://{name}.arc", date, "text/plain", len(body)) + body


def http_block(payload: bytes, page_id: int | None) -> bytes:
    """The HTTP response as archived, with the row's id in a header of its own."""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if page_id is None else page_id}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload


class Source:
    """Bytes that come by and by, with a cursor."""

    def __init__(self, data: bytes | Iterable[bytes]):
        self.more, self.held, self.at, self.gone = iter([data] if isinstance(data, bytes) else data), bytearray(), 0, 0

    def fill(self) -> bool:
        part = next(self.more, None)
        if part is None:
            return False
        if self.at > 1 << 16:
            self.gone += self.at
            del self.held[: self.at]
            self.at = 0
        self.held += part
        return True

    def place(self) -> int:
        return self.gone + self.at

    def ended(self) -> bool:
        while self.at >= len(self.held):
            if not self.fill():
                return True
        return False

    def peek(self, n: int) -> bytes:
        while len(self.held) - self.at < n and self.fill():
            pass
        return bytes(self.held[self.at : self.at + n])

    def take(self, n: int) -> bytes | None:
        """The next n bytes, or None if there are fewer."""
        out = self.peek(n)
        if len(out) < n:
            return None
        self.at += n
        return out

    def upto(self, mark: bytes) -> bytes | None:
        """What comes before the mark, which is passed; None if it doesn't come."""
        seen = 0
        while (end := self.held.find(mark, self.at + seen)) < 0:
            seen = max(0, len(self.held) - self.at - len(mark) + 1)
            if not self.fill():
                return None
        out = bytes(self.held[self.at : end])
        self.at = end + len(mark)
        return out


def arc_records(data: bytes | Iterable[bytes], name: str = "") -> Iterator[ArcRecord]:
    """The records of an archive. A new filedesc may change the version of what follows."""
    source, fields = Source(data), None
    while not source.ended():
        if source.peek(1) == b"\n":  # the line feed between records
            source.take(1)
            continue
        at = source.place()
        line = (source.upto(b"\n") or b"").decode("utf-8", "surrogateescape").rstrip("\r")
        parts = line.split(" ")
        if line.startswith("filedesc://"):
            fields = FIELDS[1 if len(parts) == 5 else 2].split(" ")
        if fields is None or len(parts) != len(fields) or not parts[-1].isdigit():
            raise ValueError(f"{name}: no ARC header line at byte {at}: {line[:80]!r}")
        block = source.take(int(parts[-1]))
        if block is None:
            raise ValueError(f"{name}: the record at byte {at} ends after the file")
        if line.startswith("filedesc://"):
            said = block.split(b"\n")
            version = int(said[0].split(b" ")[0])
            if version not in FIELDS:
                raise ValueError(f"{name}: ARC version {version}")
            fields = said[1].decode().split(" ") if len(said) > 1 and said[1] else FIELDS[version].split(" ")
        else:
            yield ArcRecord(dict(zip(fields, parts, strict=True)), block)


def http_parts(block: bytes) -> tuple[dict[str, str], bytes]:
    """Headers in lower case, and the payload; a block that isn't HTTP is all payload."""
    if not block.startswith(b"HTTP/"):
        return {}, block
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = (x.partition(b":") for x in head.split(CRLF)[1:])
    return {k.decode("latin-1").strip().lower(): v.decode("latin-1").strip() for k, _, v in lines}, payload


# WARC


def warc_date(arc_date: str) -> str:
    """As much of a date as is valid, in one of the precisions that WARC 1.1 has."""
    for n, read, shown in ((14, "%Y%m%d%H%M%S", 19), (12, "%Y%m%d%H%M", 16), (8, "%Y%m%d", 10), (6, "%Y%m", 7), (4, "%Y", 4)):
        if arc_date[:n].isdigit() and len(arc_date) >= n:
            try:
                return datetime.strptime(arc_date[:n], read).isoformat()[:shown] + ("Z" if n > 8 else "")
            except ValueError:
                continue
    raise ValueError(f"no date: {arc_date!r}")


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(31).join(map(str, parts)))}>"


class Referred(NamedTuple):
    """The response that a revisit refers to."""

    page: int
    url: str
    date: str


def headed(headers: list[tuple[str, str]], block: bytes) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode("utf-8", "surrogateescape") + CRLF + block


def warc_record(arc: ArcRecord, refers: Referred | None) -> bytes:
    """The WARC record of an ARC record: a response, or with refers a revisit of that response."""
    http, payload = http_parts(arc.block)
    url, date, digest = arc.fields["URL"], warc_date(arc.fields["Archive-date"]), hashlib.sha256(payload).hexdigest()
    page = http.get("x-page-id", "")
    block = arc.block[: len(arc.block) - len(payload)] if refers else arc.block
    headers = [
        ("WARC-Type", "revisit" if refers else "response" if http else "resource"),
        ("WARC-Record-ID", record_id(url, date, digest, page)),
        ("WARC-Date", date),
        ("WARC-Target-URI", url),
        ("WARC-IP-Address", arc.fields["IP-address"]),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("X-Payload-Length", str(len(payload))),
        ("X-Page-Id", page),
    ]
    if refers:
        then = warc_date(refers.date)
        headers += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(refers.url, then, digest, refers.page)),
            ("WARC-Refers-To-Target-URI", refers.url),
            ("WARC-Refers-To-Date", then),
            ("X-Refers-To-Page-Id", str(refers.page)),
        ]
    headers += [("Content-Type", "application/http; msgtype=response" if http else arc.fields["Content-type"]), ("Content-Length", str(len(block)))]
    return headed(headers, block)


def warc_info(*name: object) -> bytes:
    """The record that a file starts with."""
    block = b"software: prosewright\r\nformat: WARC File Format 1.1\r\n"
    now = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    return headed([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("warcinfo", now, *name)), ("WARC-Date", now), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block)))], block)


def warc_records(data: bytes | Iterable[bytes], name: str = "") -> Iterator[WarcRecord]:
    source = Source(data)
    while not source.ended():
        at = source.place()
        head = source.upto(b"\r\n\r\n") if source.peek(7) == b"WARC/1." else None
        if head is None:
            raise ValueError(f"{name}: no WARC record at byte {at}")
        lines = (x.partition(": ") for x in head.decode("utf-8", "surrogateescape").split("\r\n")[1:])
        headers = {k: v for k, _, v in lines}
        block = source.take(int(headers["Content-Length"]))
        if block is None or source.take(4) != b"\r\n\r\n":
            raise ValueError(f"{name}: the record at byte {at} doesn't end where it says")
        yield WarcRecord(headers, block)


# gzip members


def member(data: bytes) -> bytes:
    """data as a gzip member that ends in a zero byte; the top byte of its length is not zero from 16 MB on, and then an
    empty member follows."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = z.compress(data) + z.flush()
    return out if out[-1] == 0 else out + member(b"")


def inflated(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, by and by, or data itself."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    while at < len(view):
        z = zlib.decompressobj(31)
        while not z.eof and at < len(view):
            part = view[at : at + step]
            out = z.decompress(part)
            at += len(part) - len(z.unused_data)
            if out:
                yield out
        if not z.eof:
            raise ValueError("the last gzip member is cut off")


def segments(records: Iterable[bytes], head) -> Iterator[bytes]:
    """Rows for the text writer: members of whole records; head(k) is the first record of the k-th file."""
    parts, size, k = [], 0, 0
    for record in records:
        if not parts and k % FILE_SEGMENTS == 0:
            parts.append(member(head(k)))
        parts.append(member(record))
        size += len(parts[-1])
        if size >= SEGMENT:
            yield b"".join(parts)[:-1]
            parts, size, k = [], 0, k + 1
    if parts:
        yield b"".join(parts)[:-1]


# Spark


def write_records(rows: DataFrame, records, head, path: str) -> None:
    """Writes records(batch) of all batches as files of gzip members."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for row in segments(itertools.chain.from_iterable(map(records, batches)), lambda k: head(path, task, k)):
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.binary())], ["record"])

    out = rows.mapInArrow(lean(run), "record binary").select(F.col("record").cast("string"))
    out.write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", FILE_SEGMENTS).text(path)


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(list(paths)).select("path", "content")


def by_file(files: DataFrame, read, schema: str) -> DataFrame:
    """Applies read(bytes, path) -> rows to each file, in batches of some megabytes."""
    kinds = [(f.name, pa.binary() if f.dataType.simpleString() == "binary" else pa.int64() if f.dataType.simpleString() == "bigint" else pa.string()) for f in files.sparkSession.createDataFrame([], schema).schema]

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], [n for n, _ in kinds])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows, size = [], 0
                for row in read(inflated(content.as_py()), path.as_py()):
                    rows.append(row)
                    size += 200 + sum(len(x) for x in row if isinstance(x, bytes))
                    if size > 4 << 20:
                        yield pack(rows)
                        rows, size = [], 0
                if rows:
                    yield pack(rows)

    return files.mapInArrow(lean(run), schema)


def write_arc(pages: DataFrame, path: str, version: int = 1) -> None:
    """Writes pages (page_id, url, html) as ARC files; every file starts with its filedesc record."""
    small_batches(pages.sparkSession)

    def records(batch: pa.RecordBatch) -> Iterator[bytes]:
        for page, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
            block = http_block((html or "").encode("utf-8", "surrogatepass"), page)
            yield arc_header(version, url, ARC_DATE, "text/html", len(block)) + block + b"\n"

    write_records(pages.select("page_id", "url", "html"), records, lambda *_: arc_filedesc(version) + b"\n", path)


def page_of(http: dict[str, str]) -> int | None:
    return int(http["x-page-id"]) if http.get("x-page-id") else None


def read_arc(files: DataFrame, whole: bool = True) -> DataFrame:
    """Of each ARC record: path and place (file, and number in it), page_id, url, date, digest, payload_bytes and, if
    whole, fields (the header line) and block."""

    def read(data: Iterator[bytes], name: str) -> Iterator[tuple]:
        for k, arc in enumerate(arc_records(data, name)):
            http, payload = http_parts(arc.block)
            found = (name, k, page_of(http), arc.fields["URL"], arc.fields["Archive-date"], hashlib.sha256(payload).hexdigest(), len(payload))
            yield (*found, " ".join(f"{k}={v}" for k, v in arc.fields.items()), arc.block) if whole else found

    schema = "path string, place bigint, page_id bigint, url string, date string, digest string, payload_bytes bigint"
    return by_file(files, read, schema + (", fields string, block binary" if whole else ""))


def revisits(found: DataFrame, scratch: Scratch) -> DataFrame:
    """(path, place, refers) of the records whose payload, of REVISIT_BYTES or more, a row of a lesser id has."""
    found = scratch.table(found.filter((F.col("payload_bytes") >= REVISIT_BYTES) & F.col("page_id").isNotNull()).select("path", "place", "page_id", "url", "date", "digest"), "found")
    first = F.min(F.struct(F.col("page_id").alias("page"), "url", "date")).alias("refers")
    firsts = scratch.table(found.groupBy("digest").agg(first, F.count("*").alias("copies")).filter("copies > 1"), "firsts")
    total = firsts.agg(F.sum("copies")).first()[0] or 0
    met = join_groups(found.select("path", "place", "page_id", "digest"), firsts, ["digest"], "copies", total, width=F.octet_length("refers.url") + 200)
    return scratch.table(met.filter("page_id > refers.page").select("path", "place", "refers"), "revisits")


def convert(spark: SparkSession, arc_path: str, warc_path: str) -> None:
    """Reads the ARC files twice: for the digests, and to write each record as WARC."""
    scratch = Scratch(spark, "convert")
    again = revisits(read_arc(read_files(spark, arc_path), whole=False), scratch)
    size = again.agg(F.sum(F.octet_length("path") + F.octet_length("refers.url") + 64)).first()[0] or 0

    def records(batch: pa.RecordBatch) -> Iterator[bytes]:
        for fields, block, to in zip(*(batch.column(c).to_pylist() for c in ("fields", "block", "refers")), strict=True):
            arc = ArcRecord(dict(x.split("=", 1) for x in fields.split(" ")), block)
            yield warc_record(arc, Referred(**to) if to else None) + b"\r\n\r\n"

    slices = max(1, -(-size // BROADCAST_BYTES))
    part_of = F.pmod(F.xxhash64("path"), F.lit(slices))
    for k in range(slices):
        paths = [arc_path] if slices == 1 else [r.path for r in read_files(spark, arc_path).filter(part_of == k).select("path").toLocalIterator()]
        if paths:
            rows = read_arc(read_files(spark, *paths)).select("path", "place", "fields", "block")
            met = rows.join(F.broadcast(again.filter(part_of == k)), ["path", "place"], "left").select("fields", "block", "refers")
            write_records(met, records, lambda *name: warc_info(*name) + CRLF + CRLF, warc_path if slices == 1 else f"{warc_path}/slice={k}")
    scratch.drop(scratch.root)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row a record: ids, type, digests, url, date and the payload; digests of full payloads are checked."""

    def read(data: Iterator[bytes], name: str) -> Iterator[tuple]:
        for r in warc_records(data, name):
            h = r.headers
            if h["WARC-Type"] == "warcinfo":
                continue
            digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
            payload = http_parts(r.block)[1]
            if h["WARC-Type"] != "revisit" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(h["X-Payload-Length"])):
                raise ValueError(f"{name}: {h['WARC-Record-ID']} has another payload than its digest says")
            yield int(h["X-Page-Id"]) if h["X-Page-Id"] else None, int(h["X-Payload-Length"]), digest, h["WARC-Type"], int(h["X-Refers-To-Page-Id"]) if "X-Refers-To-Page-Id" in h else None, h["WARC-Record-ID"], h["WARC-Date"], h["WARC-Target-URI"], payload

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path).select("path", "content")
    return by_file(files, read, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, record_id string, date string, url string, payload binary")


def archive_pages(spark: SparkSession, pages: DataFrame, version: int = 1) -> DataFrame:
    """Pages through ARC files and the converter into WARC files, read back."""
    scratch = Scratch(spark, "archive")
    arc, warc = scratch.path("arc"), scratch.path("warc")
    write_arc(pages, arc, version)
    convert(spark, arc, warc)
    scratch.drop(arc)
    return read_warc(spark, warc)


def op6_warc_from_arc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(spark, spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH t AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM t)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""
