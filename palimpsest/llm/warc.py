"""Legacy archive converter: ARC files (versions 1 and 2) to WARC 1.1.

An ARC file opens with a version block that says which fields its URL records have; each record's header line
declares the length of its body. The converter parses both, then makes up what WARC needs and ARC lacks: record
identifiers (UUIDs from the record's key, so the same input gives the same output), W3C timestamps, record types
and SHA-1 digests. A body that starts with an HTTP status line becomes a ``response`` whose payload follows the HTTP
head; any other body becomes a ``resource``. Of responses with equal payloads of ``min_bytes`` or more, the one with
the largest source id stays a response and the others become ``revisit`` records that keep their HTTP head only and name the
identifier, target and date of the record they refer to. Each WARC file opens with a ``warcinfo`` record; a file is one gzip member.

Archives are written through Spark to the shared folder, one row being one whole file of bounded size, and read
back as binary files, record by record by declared lengths; a payload may hold anything, record headers included.

Defined cases: a null html is an empty payload; a null page_id ranks below all others and is written as ``-``; a null
url is written as ``-``; white space in URLs is percent-encoded. Rows that repeat both the largest page_id and its
payload are all responses, and a revisit refers to the first of them by URL and date; very long payloads are a file of their own. An empty table gives empty archives and an empty result. Further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path

#: Fixed values of the formats: the version blocks' field lists, and WARC's names.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"
#: Bytes of records in one archive file.
FILE_BYTES = 8 << 20
#: Payloads below this many bytes are never revisits.
MIN_BYTES = 1000
CRAWL_DATE = "20000101000000"


def _token(value: str | None) -> str:
    """A header field: white space percent-encoded, nothing written as ``-``."""
    return "".join(f"%{b:02X}" if (b := ord(c)) <= 32 or b == 127 else c for c in value) if value else "-"


# ---------------------------------------------------------------- ARC


def arc_head(version: int, name: str) -> bytes:
    lines = f"{version} 0 palimpsest\n{ARC_FIELDS[version]}\n\n".encode()
    extra = " 200 - - 0 " + name if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {CRAWL_DATE} text/plain{extra} {len(lines)}\n".encode() + lines


def arc_record(version: int, name: str, offset: int, url: str | None, location: str, mime: str, body: bytes, ip: str = "0.0.0.0", date: str = CRAWL_DATE) -> bytes:
    extra = f" 200 - {location} {offset} {name}" if version == 2 else ""
    return f"{_token(url)} {ip} {date} {mime}{extra} {len(body)}\n".encode() + body + b"\n"


def parse_arc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and body of each URL record; the version block says how header lines read."""
    fields: list[str] | None = None
    at = 0
    while at < len(content):
        if content[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = content.index(b"\n", at)
        parts = content[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        length = int(parts[-1])
        body = content[end + 1 : end + 1 + length]
        if len(body) < length:
            raise ValueError(f"ARC record at {at} declares {length} bytes, {len(body)} are left")
        at = end + 1 + length
        if parts[0].startswith("filedesc://"):
            lines = body.decode("utf-8", "replace").splitlines()
            fields = lines[1].split(" ")
            if fields not in [x.split(" ") for x in ARC_FIELDS.values()]:
                raise ValueError(f"unknown ARC fields {lines[1]!r}")
            continue
        if fields is None:
            raise ValueError("ARC file without a version block")
        if len(parts) < len(fields):
            raise ValueError(f"ARC header with {len(parts)} of {len(fields)} fields")
        # A URL may hold raw spaces in old files: all other fields are counted from the end.
        split = len(parts) - len(fields) + 1
        yield dict(zip(fields, [" ".join(parts[:split]), *parts[split:]], strict=True)), body


def split_http(body: bytes) -> tuple[bytes, bytes] | None:
    """HTTP head (with its blank line) and payload, or None for a body that is not an HTTP response."""
    if not body.startswith(b"HTTP/"):
        return None
    end = body.find(b"\r\n\r\n")
    return (body[: end + 4], body[end + 4 :]) if end >= 0 else (body, b"")


# ---------------------------------------------------------------- WARC


def timestamp(date: str) -> str:
    """A 14-digit ARC date (or its first digits) as W3C time."""
    digits = (date + "00000101000000"[len(date) :])[:14]
    return datetime.strptime(digits, "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}>"


def sha1_label(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record but for the two line ends that close it."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(content):
        if content[at : at + 1] in (b"\r", b"\n"):
            at += 1
            continue
        end = content.index(b"\r\n\r\n", at)
        version, *lines = content[at:end].decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        length = int(headers["content-length"])
        block = content[end + 4 : end + 4 + length]
        if len(block) < length:
            raise ValueError(f"WARC record at {at} declares {length} bytes, {len(block)} are left")
        at = end + 4 + length
        yield headers, block


# ---------------------------------------------------------------- Spark


def _write_files(files: DataFrame, path: str, line_end: str) -> None:
    """Each row's ``content`` becomes one file; the writer closes it with ``line_end``. The cast keeps bytes as they are."""
    files.select(F.col("content").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", line_end).option(
        "zlib.compress.level", "BEST_SPEED"
    ).text(path, compression="gzip")


def _read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def _unzip(content: bytes) -> bytes:
    import gzip

    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def _files(records: Iterator[bytes], head: bytes = b"") -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in records:
        if held and size + len(r) > FILE_BYTES:
            yield pa.RecordBatch.from_pydict({"content": pa.array([head + b"".join(held)], pa.binary())})
            held, size = [], 0
        held.append(r)
        size += len(r)
    if held:
        yield pa.RecordBatch.from_pydict({"content": pa.array([head + b"".join(held)], pa.binary())})


def write_arc(pages: DataFrame, path: str, version: int = 2) -> None:
    """Pages (page_id, url, html) as ARC files with an HTTP response each; the Location field keeps the page_id."""

    def run(batches):
        name = "pages.arc"

        def records():
            for batch in batches:
                ids, urls, bodies = (batch.column(c).to_pylist() for c in ("page_id", "url", "html"))
                for i, url, html in zip(ids, urls, bodies, strict=True):
                    html = html or b""
                    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode() + html
                    yield arc_record(version, name, 0, url, "-" if i is None else f"page:{i}", "text/html", body)

        yield from _files(records(), arc_head(version, name))

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string").cast("binary").alias("html"))
    _write_files(rows.mapInArrow(run, "content binary"), path, "\n")


RECORD = "source_id long, url string, ip string, date string, mime string, head binary, payload binary, digest binary, length long"
BRIEF = "source_id long, url string, date string, digest binary, length long"


def read_arc(spark: SparkSession, path: str, brief: bool = False, packed: bool = False) -> DataFrame:
    """The URL records of the ARC files in ``path``; brief: without heads and payloads; packed: payloads deflated, to be shuffled.

    head is null unless the body is HTTP.
    """
    names = [f.split()[0] for f in (BRIEF if brief else RECORD).split(", ")]

    def run(batches):
        schema = {"source_id": pa.int64(), "length": pa.int64(), "head": pa.binary(), "payload": pa.binary(), "digest": pa.binary()}
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for fields, body in parse_arc(_unzip(content.as_py())):
                    http = split_http(body)
                    head, payload = http or (None, body)
                    location = fields.get("Location", "-")
                    source = int(location[5:]) if location.startswith("page:") else None
                    digest = hashlib.sha1(payload).digest()
                    rows.append(
                        (source, fields["URL"], fields["Archive-date"], digest, len(payload)) if brief
                        else (source, fields["URL"], fields["IP-address"], fields["Archive-date"], fields["Content-type"], head, zlib.compress(payload, 1) if packed else payload, digest, len(payload))
                    )
                    size += len(payload)
                    if size > FILE_BYTES or len(rows) >= 10_000:
                        yield _batch(rows, names, schema)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, names, schema)

    return _read_files(spark, path).mapInArrow(run, BRIEF if brief else RECORD)


def _batch(rows: list[tuple], names: list[str], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*rows, strict=True), strict=True)})


def convert(spark: SparkSession, arc_path: str, warc_path: str, min_bytes: int = MIN_BYTES) -> None:
    """ARC files to WARC files, with revisit records for repeated payloads."""
    brief = read_arc(spark, arc_path, brief=True).where(F.col("length") >= min_bytes)
    firsts = (
        brief.groupBy("digest", "length")
        .agg(F.max("source_id").alias("first_id"), F.count("*").alias("copies"), F.min_by(F.struct("url", "date"), F.struct(F.col("source_id").isNull(), -F.col("source_id"), "url", "date")).alias("first"))
        .where("copies > 1 and first_id is not null")
    )
    records = read_arc(spark, arc_path, packed=True)
    again = F.coalesce(F.col("source_id") < F.col("first_id"), F.col("first_id").isNotNull())
    marked = records.join(firsts.select("digest", "length", "first_id", "first"), ["digest", "length"], "left").select(
        *records.columns, F.when(again, F.col("first_id")).alias("refers_to"), F.when(again, F.col("first.url")).alias("first_url"), F.when(again, F.col("first.date")).alias("first_date")
    )

    def run(batches):
        def records():
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    for r in batch.slice(lo, 256).to_pylist():
                        yield _converted(r | {"payload": zlib.decompress(r["payload"])}) + CRLF + CRLF

        for batch in _files(records()):  # the writer itself puts the last record's end
            body = batch.column(0)[0].as_py()
            yield pa.RecordBatch.from_pydict({"content": pa.array([_info(body) + CRLF + CRLF + body[:-4]], pa.binary())})

    _write_files(marked.mapInArrow(run, "content binary"), warc_path, "\r\n\r\n")


def _info(body: bytes) -> bytes:
    """The record that opens a file of the records in ``body``."""
    text = b"software: palimpsest\r\nformat: WARC File Format 1.1\r\n"
    return warc_record(
        [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("warcinfo " + hashlib.sha1(body).hexdigest())), ("WARC-Date", timestamp(CRAWL_DATE)), ("Content-Type", "application/warc-fields")], text
    )


def _key(url: str, date: str, source: int | None, digest: bytes) -> str:
    return f"{url} {date} {source} {digest.hex()}"


def _converted(r: dict) -> bytes:
    key = _key(r["url"], r["date"], r["source_id"], r["digest"])
    kind = "resource" if r["head"] is None else "response" if r["refers_to"] is None else "revisit"
    block = r["payload"] if kind == "resource" else r["head"] if kind == "revisit" else r["head"] + r["payload"]
    headers = [
        ("WARC-Type", kind), ("WARC-Record-ID", record_id(key)), ("WARC-Date", timestamp(r["date"])), ("WARC-Target-URI", r["url"]),
        ("WARC-IP-Address", r["ip"]), ("WARC-Payload-Digest", sha1_label(r["digest"])), ("WARC-Block-Digest", sha1_label(hashlib.sha1(block).digest())),
        ("Content-Type", r["mime"] if kind == "resource" else "application/http; msgtype=response"), ("Source-Id", "-" if r["source_id"] is None else str(r["source_id"])),
    ]
    if kind == "revisit":
        headers += [
            ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(_key(r["first_url"], r["first_date"], r["refers_to"], r["digest"]))), ("WARC-Refers-To-Target-URI", r["first_url"]),
            ("WARC-Refers-To-Date", timestamp(r["first_date"])), ("Refers-To-Source-Id", str(r["refers_to"])), ("Payload-Length", str(r["length"])),
        ]
    return warc_record(headers, block)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files: source_id, record_type, record_id, date, url, payload (null for revisits), its digest, length, refers_to."""
    fields = "source_id long, record_type string, record_id string, date string, url string, payload binary, payload_digest string, payload_bytes long, refers_to long"
    names = [f.split()[0] for f in fields.split(", ")]
    kinds = {"source_id": pa.int64(), "payload": pa.binary(), "payload_bytes": pa.int64(), "refers_to": pa.int64()}

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for h, block in parse_warc(_unzip(content.as_py())):
                    kind = h["warc-type"]
                    if kind == "warcinfo":
                        continue
                    declared = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:"))
                    if kind == "revisit":
                        payload, length = None, int(h["payload-length"])
                    else:
                        payload = split_http(block)[1] if kind == "response" else block
                        length = len(payload)
                        if hashlib.sha1(payload).digest() != declared:
                            raise ValueError(f"{h['warc-record-id']}: the payload does not match its digest")
                    source, first = h["source-id"], h.get("refers-to-source-id")
                    rows.append((None if source == "-" else int(source), kind, h["warc-record-id"], h["warc-date"], h["warc-target-uri"], payload, declared.hex(), length, int(first) if first else None))
                if rows:
                    yield _batch(rows, names, kinds)

    return _read_files(spark, path).mapInArrow(run, fields)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``pages`` through ARC files, the converter and WARC files, as read back from the latter."""
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(spark.read.parquet(f"{sf_dir}/pages.parquet"), arc)
    convert(spark, arc, warc)
    return read_warc(spark, warc).select(F.col("source_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
     f AS (SELECT payload_digest, max(page_id) AS first_id FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN f.first_id > d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id > d.page_id THEN f.first_id END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND d.payload_bytes >= 1000
"""
