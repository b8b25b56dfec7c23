"""WARC archives: a writer of monolithic gzip files, a normaliser to one member per record with an offset index, a reader.

Archives are rows (archive, content): Spark writes and reads them, so no executor needs a local or mounted folder. A
writer task closes an archive at ARCHIVE_BYTES of records, so every later step holds one bounded archive at a time (or one
record, if that is longer).

A response record holds an HTTP head and the payload. A payload that another response has already is written as a revisit
record: the HTTP head alone, whose Content-Length is the full payload's, its digest, and the response it refers to. Record
ids are <urn:page:ID> for responses and <urn:page:ID:PART-NUMBER> for all others and for pages without an id.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from susceptra.storage import free_name, materialise

ARCHIVE_BYTES = 4 << 20
LEVEL = 1
_DATE = "2020-01-01T00:00:00Z"
#: Fixed value: the profile of revisits by equal payloads.
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Up to so many shared payloads (some 60 bytes each) are broadcast to the writers; beyond, they are joined by a shuffle.
BROADCAST_HEADS = 200_000


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, mark: str = "") -> bytes:
    """One WARC/1.0 record, a revisit if it refers to a page; control characters, spaces and non-ASCII in the url are percent-encoded."""
    target = "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {len(payload)}\r\n\r\n".encode("ascii")
    own = "" if page_id is None else str(page_id)
    revisit = refers_to is not None
    name = f"{own}:{mark}" if revisit or page_id is None else own
    more = f"WARC-Refers-To: <urn:page:{refers_to}>\r\nWARC-Profile: {_PROFILE}\r\n" if revisit else ""
    block = http if revisit else http + payload
    head = f"WARC/1.0\r\nWARC-Type: {'revisit' if revisit else 'response'}\r\nWARC-Record-ID: <urn:page:{name}>\r\nWARC-Target-URI: {target}\r\nWARC-Date: {_DATE}\r\nWARC-Payload-Digest: sha1:{base32_sha1(payload)}\r\n{more}Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode("ascii") + block + b"\r\n\r\n"


def unwrap(block: bytes) -> tuple[dict[str, str], bytes]:
    """The headers and the body of an HTTP message."""
    split = block.find(b"\r\n\r\n")
    if split < 0 or not block.startswith(b"HTTP/"):
        raise ValueError("no HTTP message")
    lines = block[:split].decode("ascii").split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}, block[split + 4 :]


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """The record at an offset: its headers, payload and end. Raises on anything that is not a whole record."""
    split = data.find(b"\r\n\r\n", at)
    lines = data[at:split].decode("ascii").split("\r\n") if split >= 0 else []
    if not lines or not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record at byte {at}")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    start = split + 4
    end = start + int(headers["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at byte {at} does not end where it says")
    return headers, data[start:end], end + 4


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """pages (page_id, url, html, refers_to) -> (archive, content): each content is one gzip stream over many records.

    Null html is empty; rows whose refers_to is not null are revisits, and without such a column none are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, number = TaskContext.get().partitionId(), 0, 0
        packer, out, held = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), [], 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{count:06d}.warc.gz"]), pa.array([b"".join([*out, packer.flush()])], pa.binary())], ["archive", "content"])

        for b in batches:
            for page_id, url, html, refers_to in zip(*[b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")], strict=True):
                raw = record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to, f"{part:06d}-{number}")
                number += 1
                out.append(packer.compress(raw))
                held += len(raw)
                if held >= archive_bytes:
                    yield close()
                    packer, out, held, count = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), [], 0, count + 1
        if held:
            yield close()

    refers = F.col("refers_to").cast("long") if "refers_to" in pages.columns else F.lit(None).cast("long")
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), refers.alias("refers_to"))
    return slim.mapInArrow(run, "archive string, content binary")


def split_stream(content: bytes) -> Iterator[bytes]:
    """The raw records of a gzip file of any number of members, inflated once in bounded steps."""
    inflate, buffer, rest = zlib.decompressobj(31), bytearray(), content
    while rest or not inflate.eof:
        if inflate.eof:
            inflate = zlib.decompressobj(31)
        made = inflate.decompress(rest, 1 << 20)
        rest = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
        if not made and not inflate.eof and not rest:
            raise ValueError("the gzip stream is cut short")
        buffer += made
        at = 0
        while (split := buffer.find(b"\r\n\r\n", at)) >= 0:
            head = bytes(buffer[at:split]).lower()
            mark = head.find(b"\r\ncontent-length:")
            if mark < 0:
                raise ValueError("a record without a length")
            end = split + 8 + int(head[mark + 17 :].split(b"\r\n", 1)[0])
            if end > len(buffer):
                break
            yield bytes(buffer[at:end])
            at = end
        del buffer[:at]
        if inflate.eof and not rest:
            break
    if buffer:
        raise ValueError("bytes after the last record")


def normalise(archives: DataFrame) -> DataFrame:
    """(archive, content) -> (archive, content, index): each record a gzip member of its own; index holds an (offset, length) pair of 64-bit numbers per record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("archive").to_pylist(), b.column("content").to_pylist(), strict=True):
                members, index, at = [], bytearray(), 0
                for raw in split_stream(content):
                    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    member = packer.compress(raw) + packer.flush()
                    members.append(member)
                    index += struct.pack("<QQ", at, len(member))
                    at += len(member)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(members)], pa.binary()), pa.array([bytes(index)], pa.binary())], ["archive", "content", "index"])

    return archives.select("archive", "content").mapInArrow(run, "archive string, content binary, index binary")


def read_member(content: bytes, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its index entry, nothing else being inflated."""
    headers, payload, _ = parse(zlib.decompress(content[offset : offset + length], 31))
    return headers, payload


def read_records(archives: DataFrame) -> DataFrame:
    """Normalised archives -> (archive, offset, page_id, url, record_type, refers_to, payload, payload_bytes, digest), each record read by its offset.

    Payload is null in revisits; payload_bytes and digest are the full payload's. A response's digest is verified.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["archive", "offset", "page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "digest"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
        page_of = lambda name: name.removeprefix("<urn:page:").removesuffix(">").split(":")[0]
        for b in batches:
            for name, content, index in zip(b.column("archive").to_pylist(), b.column("content").to_pylist(), b.column("index").to_pylist(), strict=True):
                rows = []
                for offset, length in struct.iter_unpack("<QQ", index):
                    headers, block = read_member(content, offset, length)
                    http, payload = unwrap(block)
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    again = headers["warc-type"] == "revisit"
                    if not again and (digest != base32_sha1(payload) or int(http["content-length"]) != len(payload)):
                        raise ValueError(f"{name}: the payload at {offset} does not have its digest or length")
                    page, refers = page_of(headers["warc-record-id"]), int(page_of(headers["warc-refers-to"])) if again else None
                    rows.append((name, offset, int(page) if page else None, headers["warc-target-uri"], headers["warc-type"], refers, None if again else payload, int(http["content-length"]), digest))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], names)

    return archives.select("archive", "content", "index").mapInArrow(run, "archive string, offset long, page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, digest string")


def revisits(pages: DataFrame, at_least: int = 0) -> DataFrame:
    """(page_id, html, ...) -> plus refers_to, in the place of a column so called: the page whose response has the same payload, null in responses.

    Of rows with equal payloads of at_least bytes, those with the smallest page_id are responses, the others revisit it.
    Null ids are never the smallest; a group of null ids only is all responses. Payloads are counted before they are
    joined, so one that half the pages share is one row on its side, and pages travel only where the shared payloads are
    too many to broadcast.
    """
    size, digest, page = free_name(pages, "__size"), free_name(pages, "__digest"), free_name(pages, "__page")
    first, n = free_name(pages, "__first"), free_name(pages, "__n")
    raw = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    keyed = pages.withColumn(size, F.octet_length(raw)).withColumn(digest, F.sha1(raw)).withColumn(page, F.col("page_id").cast("long"))
    heads = keyed.filter(F.col(size) >= at_least).groupBy(size, digest).agg(F.min(page).alias(first), F.count(F.lit(1)).alias(n))
    heads = materialise(heads.filter((F.col(n) > 1) & F.col(first).isNotNull()).drop(n), "shared-payloads")
    joined = keyed.join(F.broadcast(heads) if heads.count() <= BROADCAST_HEADS else heads, [size, digest], "left")
    refers = F.when(~F.col(page).eqNullSafe(F.col(first)), F.col(first))
    return joined.withColumn("refers_to", refers).select(*[c for c in pages.columns if c != "refers_to"], "refers_to")


def archive_pages(pages: DataFrame, at_least: int = 0) -> DataFrame:
    """Write, normalise and read back every page; archives and normalised archives are tables in the shared folder.

    Null html is an empty payload, null ids and urls are kept, repeated rows give repeated records, other columns are not
    stored, and no pages give no archives.
    """
    raw = materialise(write_archives(revisits(pages.select("page_id", "url", "html"), at_least)), "warc")
    whole = materialise(normalise(raw), "warc-members")
    read = read_records(whole).select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")
    return materialise(read, "warc-records")
