"""Conversion of legacy web archives to WARC.

An ARC file begins with a version block whose second line says how the header lines of its records are
laid out: five fields in version 1, ten in version 2. Content is taken by its declared length. For each record
an equivalent WARC record is made: an identifier from URL, date and digest, an ISO timestamp, a type and the digests of block
and payload. Of records with equal payloads the one with the smallest page id is a response, and the others
revisit it without repeating the payload.

Archives are written by Spark's text writer, so they go wherever Spark can write; the line feed that ends a WARC
record is the writer's line separator. Files are bounded by a number of records.

Nulls: a null payload is an empty one; a null URL is written as "unknown:"; a null page id has no header and is read
back as null, and is the smallest only among nulls. Rows with equal ids and payloads are all responses, or all
revisits. Without rows, no record is written and none is read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transitloom.llm.text import as_bytes, sliced

ARC_RECORDS = 256
WARC_RECORDS = 2000
ROWS = 256
LEAST_REVISITED = 0
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the one for URLs
LAYOUTS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ---- ARC ---------------------------------------------------------------------------------------------
def arc_version_block(name: str, version: int, date: str) -> bytes:
    body = f"{version} 0 transitloom\n{LAYOUTS[version]}\n".encode()
    tail = f"200 - - 0 {name} " if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {tail}{len(body)}\n".encode() + body + b"\n"


def arc_record(url: str, date: str, content: bytes, name: str, offset: int, version: int) -> bytes:
    tail = f"200 {hashlib.md5(content).hexdigest()} - {offset} {name} " if version == 2 else ""
    return f"{url} 0.0.0.0 {date} text/html {tail}{len(content)}\n".encode() + content + b"\n"


def http_response(page_id: int | None, payload: bytes) -> bytes:
    own = f"X-Page-Id: {page_id}\r\n" if page_id is not None else ""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def read_arc(data: bytes) -> Iterator[dict]:
    """The records of one ARC file. A header line has a fixed number of fields after the URL, whatever the URL holds."""
    line, rest = data.split(b"\n", 1)
    length = int(line.rsplit(b" ", 1)[1])
    version, layout = rest[:length].split(b"\n")[:2]
    fields = layout.decode().split(" ")
    if fields != LAYOUTS.get(int(version.split(b" ")[0]), "").split(" "):
        raise ValueError(f"no ARC layout: {layout[:200]!r}")
    at = len(line) + 1 + length + 1
    while at < len(data):
        end = data.index(b"\n", at)
        values = data[at:end].decode().rsplit(" ", len(fields) - 1)
        head = dict(zip(fields, values, strict=True))
        size = int(head["Archive-length"])
        content = data[end + 1:end + 1 + size]
        if len(content) != size:
            raise ValueError(f"an ARC record of {size} bytes has {len(content)}")
        yield {"url": head["URL"], "date": head["Archive-date"], "type": head["Content-type"], "content": content}
        at = end + 1 + size + 1


ARCS = "name string, content binary"


def legacy_archives(pages: DataFrame) -> DataFrame:
    """Pages as ARC files of up to ARC_RECORDS records, in turn of version 1 and 2, one row for each file.

    The table has no dates; a record's date is its page id in seconds after the start of 2020.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, batch in enumerate(sliced(batches, ARC_RECORDS)):
            ids, urls = (batch.column(i).to_pylist() for i in (0, 1))
            version, name = n % 2 + 1, f"pages-{ids[0]}-{n}.arc"
            out = [arc_version_block(name, version, "20200101000000")]
            size = len(out[0])
            for page_id, url, html in zip(ids, urls, as_bytes(batch, "html"), strict=True):
                at = datetime.fromtimestamp(1577836800 + (page_id or 0) % 10**9, UTC).strftime("%Y%m%d%H%M%S")
                out.append(arc_record(re.sub(r"[\r\n]", "", url or "unknown:"), at, http_response(page_id, html or b""), name, size, version))
                size += len(out[-1])
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(out)], pa.binary())], names=["name", "content"])

    return pages.select("page_id", "url", "html").mapInArrow(run, ARCS)


RECORDS = "page_id bigint, url string, date string, record_id string, head binary, payload binary, payload_digest string"


def arc_records(archives: DataFrame) -> DataFrame:
    """The records of ARC files (rows with their whole content), with the identifiers and digests a WARC record has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in as_bytes(batch, "content"):
                rows = []
                for r in read_arc(data):
                    head, payload = r["content"].split(b"\r\n\r\n", 1)
                    own = re.search(rb"\r\nX-Page-Id: (-?\d+)", head)
                    page = int(own[1]) if own else None
                    told = digest(payload)
                    when = datetime.strptime(r["date"], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
                    made = uuid.uuid5(NAMESPACE, f"{r['url']} {when} {page} {told}").urn
                    rows.append((page, r["url"], when, made, head, payload, told))
                if rows:
                    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                                     names=[x.split()[0] for x in RECORDS.split(", ")])

    return archives.mapInArrow(run, RECORDS)


# ---- WARC --------------------------------------------------------------------------------------------
def with_types(records: DataFrame, least: int = LEAST_REVISITED) -> DataFrame:
    """Add the page and record that a record revisits, null for a response.

    The first page of each payload is an aggregate without payloads; only payloads held more than once are looked up.
    """
    held = records.where(F.octet_length("payload") >= least).groupBy("payload_digest").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "record_id"))).alias("first"))
    first = held.where("n > 1 AND first IS NOT NULL").select(F.col("payload_digest").alias("same"), "first")
    again = (F.octet_length("payload") >= least) & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return records.join(first, F.col("payload_digest") == F.col("same"), "left").withColumns({
        "refers_to": F.when(again, F.col("first.page_id")), "refers_to_record": F.when(again, F.col("first.record_id"))}).drop("same", "first")


def warc_record(r: dict) -> bytes:
    """One record; a revisit keeps the response's headers, with the length of its payload, and no payload."""
    revisit = r["refers_to_record"] is not None
    block = r["head"] + b"\r\n\r\n" + (b"" if revisit else r["payload"])
    lines = [
        "WARC/1.0", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{r['record_id']}>", f"WARC-Date: {r['date']}",
        f"WARC-Target-URI: {r['url']}", "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{r['payload_digest']}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <{r['refers_to_record']}>", f"X-Refers-To-Page: {r['refers_to']}"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def write_warc(records: DataFrame, path: str) -> None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, ROWS):
            made = [warc_record(r)[:-1] for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["record"])

    records.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value")).write.option(
        "lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", WARC_RECORDS).text(path)


def unzipped(data: bytes, piece: int = 1 << 20) -> Iterator[bytes]:
    """The content of a gzip file, of one member or several, in bounded pieces."""
    while data:
        z = zlib.decompressobj(31)
        while not z.eof and (data or z.unconsumed_tail):
            out = z.decompress(data, piece)
            data = z.unconsumed_tail
            if out:
                yield out
            elif not data:
                break
        data = z.unused_data


def read_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a WARC file that comes in pieces."""
    held = b""

    def more() -> bool:
        nonlocal held
        piece = next(pieces, None)
        held += piece or b""
        return piece is not None

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("a WARC file ends within a header")
                return
        lines = held[:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:100]!r}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        stop = end + 4 + int(head["Content-Length"]) + 4
        parts, have = [held], len(held)
        while have < stop and (piece := next(pieces, None)) is not None:
            parts.append(piece)
            have += len(piece)
        held = b"".join(parts)
        if have < stop:
            raise ValueError("a WARC file ends within a record")
        block, held = held[end + 4:stop - 4], held[stop:]
        yield head, block


PAGES = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives below a path. A response's digest is computed anew and must be right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in as_bytes(batch, "content"):
                rows = []
                for head, block in read_records(unzipped(data)):
                    http, payload = block.split(b"\r\n\r\n", 1)
                    own = re.search(rb"\r\nX-Page-Id: (-?\d+)", http)
                    told = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
                    if head["WARC-Type"] == "response" and (digest(payload) != told or len(payload) != size):
                        raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
                    refers = head.get("X-Refers-To-Page")
                    rows.append((int(own[1]) if own else None, size, told, head["WARC-Type"], int(refers) if refers else None))
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                                     names=[x.split()[0] for x in PAGES.split(", ")])

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, PAGES)


def convert(archives: DataFrame, path: str) -> None:
    """ARC files (rows with their whole content) to WARC files below a path."""
    write_warc(with_types(arc_records(archives)), path)
