"""Operator 2: WARC archives, written with an index and read back by byte ranges.

Each task writes its records, one gzip member each, to archive files in the shared folder and
returns the index: file, offset, length, URL and payload digest of every record. The index is
kept first; selected records are then read in order of file and offset, neighbouring ones
coalesced to one range read, in groups of bounded bytes. Of records with equal payloads of at
least ``REVISIT_BYTES`` bytes, the one with the largest page_id is the response and the others
are revisits of it (their HTTP header tells the full payload's length).

A file's name is its task attempt's own: a retried task writes another file, and only files of
attempts that ended are in the index.

Defined cases: a null html is an empty payload; a null url is written as ``urn:none``; a null
page_id is always a response that nothing refers to; rows that repeat the largest page_id of a
payload are all responses; a payload of any length is one record;
an empty table makes an empty index; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut, pick, shared_dir

REVISIT_BYTES = 1000
#: An archive file is closed when it is so large.
FILE_BYTES = 1 << 30
#: Records of so many bytes of a file are read by one task; gaps up to GAP_BYTES are read over.
RANGE_BYTES, GAP_BYTES = 32 << 20, 64 << 10
#: All records tell one date: archives don't depend on the clock.
DATE = "2024-01-01T00:00:00Z"
INDEX = "page_id long, url string, file string, offset long, length long, payload_digest string, record_type string"


def _open(where: str) -> tuple[FileSystem, str]:
    if where.startswith("file:/") and not where.startswith("file://"):
        where = "file://" + where[5:]
    return FileSystem.from_uri(where)


def _record(page_id, url: str | None, payload: bytes, size: int, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit (refers_to isn't None) has no payload."""
    name = lambda x: f"<urn:page:{'none' if x is None else x}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url, safe='%/:?#[]@!$&()*+,;=~-._') if url is not None else 'urn:none'}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse_record(data: bytes) -> dict:
    """Headers of one uncompressed record, by lower-case name, and its HTTP header's length and payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode().split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    sizes = [x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    return fields | {"payload_bytes": int(sizes[0]), "payload": payload}


def _id(name: str | None) -> int | None:
    value = (name or "<urn:page:none>")[10:-1]
    return None if value == "none" else int(value)


def plan_records(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Every page with its payload_digest, payload_bytes and, for revisits, refers_to (html null there)."""
    pages = pick(pages, page_id="long", url="string", html="string")
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    pages = pages.select("*", F.sha1(payload).alias("payload_digest"), F.sha2(payload, 256).alias("same"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    known = pages.filter((F.col("payload_bytes") >= revisit_bytes) & F.col("page_id").isNotNull())
    response = known.groupBy("same").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    response = response.select(F.substring("same", 1, 64).alias("key"), "response")  # another key: both sides are exchanged, hot ones can be split
    joined = pages.join(response, F.col("same") == F.col("key"), "left")
    refers_to = F.when((F.col("payload_bytes") >= revisit_bytes) & (F.col("page_id") != F.col("response")), F.col("response"))
    return joined.select("page_id", "url", "payload_bytes", "payload_digest", refers_to.alias("refers_to"), "html").withColumn("html", F.when(F.col("refers_to").isNull(), F.col("html")))


def write_archives(pages: DataFrame, where: str, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Writes ``*.warc.gz`` files to the shared folder ``where``; returns their index, already kept."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _open(where)
        fs.create_dir(folder, recursive=True)
        out = None
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(posixpath.join(folder, name), compression=None)
                data = _member(_record(r["page_id"], r["url"], (r["html"] or "").encode(), r["payload_bytes"], r["payload_digest"], r["refers_to"]))
                out.write(data)
                rows.append((r["page_id"], r["url"], name, at, len(data), r["payload_digest"], "response" if r["refers_to"] is None else "revisit"))
                at += len(data)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], ["page_id", "url", "file", "offset", "length", "payload_digest", "record_type"])
        if out is not None:
            out.close()

    return cut(plan_records(pages, revisit_bytes).mapInArrow(write, INDEX))


def read_records(index: DataFrame, where: str, payloads: bool = False) -> DataFrame:
    """The records that ``index`` lists, read from their archives: page_id, url, payload_bytes,
    payload_digest (of the bytes read; a revisit's as its header tells), record_type, refers_to,
    and html if asked for."""

    def read(table: pa.Table) -> pa.Table:
        fs, folder = _open(where)
        rows = sorted(zip(table["offset"].to_pylist(), table["length"].to_pylist(), table["url"].to_pylist()), key=lambda r: r[:2])
        out, k = [], 0
        with fs.open_input_file(posixpath.join(folder, table["file"][0].as_py())) as f:
            while k < len(rows):
                start, end, first = rows[k][0], rows[k][0] + rows[k][1], k
                while k < len(rows) and rows[k][0] <= end + GAP_BYTES:
                    end, k = max(end, rows[k][0] + rows[k][1]), k + 1
                data = f.read_at(end - start, start)
                for at, size, url in rows[first:k]:
                    r = parse_record(zlib.decompress(data[at - start : at - start + size], 31))
                    told = base64.b32decode(r["warc-payload-digest"].removeprefix("sha1:")).hex()
                    is_response = r["warc-type"] == "response"
                    digest = hashlib.sha1(r["payload"]).hexdigest() if is_response else told
                    if digest != told or is_response and len(r["payload"]) != r["payload_bytes"]:
                        raise ValueError(f"damaged record at {at} of {table['file'][0]}")
                    out.append((_id(r["warc-record-id"]), url, r["payload_bytes"], digest, r["warc-type"], _id(r.get("warc-refers-to")), r["payload"].decode() if payloads and is_response else None))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out), kinds)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"])

    near = index.withColumn("part", F.floor(F.col("offset") / RANGE_BYTES))
    records = near.groupBy("file", "part").applyInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string")
    return records if payloads else records.drop("html")


def round_trip(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Writes all pages to fresh archives in the session's shared folder and reads them back."""
    where = posixpath.join(shared_dir(pages.sparkSession), f"warc-{uuid.uuid4().hex}")
    return read_records(write_archives(pages, where, revisit_bytes), where).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
