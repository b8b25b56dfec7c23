"""DQ8: checks of uploaded sequence files, as rows of Spark's binaryFile source, without ever unpacking more than is allowed."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions that may be uploaded, and the statuses of refusals.
EXTENSIONS, PACKED = ("fasta", "fa", "fna"), "gz"
STATUS = {"extension": 415, "too_large": 413, "unpacked_too_large": 413, "bad_gzip": 422, "not_fasta": 422}
CHUNK = 1 << 20


def named(path: Column) -> tuple[Column, Column]:
    """Whether a file's name has one of the extensions (dots in front are none), and whether it is a packed one."""
    name = F.lower(F.substring_index(path, "/", -1))
    return F.rlike(name, F.lit(rf"^\.*[^.].*\.({'|'.join(EXTENSIONS)})(\.{PACKED})?$")), F.endswith(name, F.lit(f".{PACKED}"))


class _Head:
    """The size of a stream of chunks, and whether its first line that is not blank starts with '>'."""

    def __init__(self) -> None:
        self.size, self.line, self.found = 0, b"", None

    def take(self, chunk: bytes) -> None:
        self.size += len(chunk)
        if self.found is None:
            # white space in front of a line's first sign only tells that the line does not start with it
            lines = (self.line + chunk).split(b"\n")
            self.found = next((x.startswith(b">") for x in lines if x.strip()), None)
            self.line = b" " if lines[-1] else b""


def unpacked(content: bytes, most: int) -> tuple[int, bool | None, str | None]:
    """Size, whether it is FASTA, and the reason of refusal of a gzip file's content; stops one chunk beyond `most`."""
    head, at = _Head(), 0
    while at < len(content):
        inflate = zlib.decompressobj(31)
        waiting = content[at:]
        try:
            while not inflate.eof:
                chunk = inflate.decompress(waiting, CHUNK)
                waiting = inflate.unconsumed_tail
                head.take(chunk)
                if head.size > most:
                    return head.size, head.found, "unpacked_too_large"
                if not chunk and not waiting and not inflate.eof:
                    return head.size, head.found, "bad_gzip"
        except zlib.error:
            return head.size, head.found, "bad_gzip"
        at = len(content) - len(inflate.unused_data)
        while at < len(content) and content[at] == 0:  # members may be followed by zeros
            at += 1
    return head.size, head.found, None


def upload_checks(files: DataFrame, most: int) -> DataFrame:
    """files (path, length, content) -> path, status, reason, packed and size (of what is plain) for each.

    Checks come in order: the name's extension (415), the length (413), then for packed files the archive and the length of
    what is in it (422, 413), then that the first line that is not blank starts with '>' (422). Accepted files have status
    200. Content is read of files only that pass name and length.
    """
    fits, packed = named(F.col("path"))
    reason = F.when(~fits, "extension").when(F.col("length") > most, "too_large")
    judged = files.withColumn("packed", packed).withColumn("reason", reason)
    refused = judged.filter("reason IS NOT NULL").select("path", "packed", F.col("length").alias("size"), "reason")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, reasons = [], []
            for content, is_packed in zip(b.column("content"), b.column("packed").to_pylist(), strict=True):
                raw = content.as_py() or b""
                if is_packed:
                    size, found, why = unpacked(raw, most)
                else:
                    head = _Head()
                    for at in range(0, len(raw), CHUNK):
                        head.take(raw[at : at + CHUNK])
                    size, found, why = len(raw), head.found, None
                sizes.append(size)
                reasons.append(why or (None if found else "not_fasta"))
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("packed"), pa.array(sizes, pa.int64()), pa.array(reasons, pa.string())], ["path", "packed", "size", "reason"])

    read = judged.filter("reason IS NULL").select("path", "packed", "content").mapInArrow(run, "path string, packed boolean, size long, reason string")
    status = F.lit(200)
    for why, code in STATUS.items():
        status = F.when(F.col("reason") == why, code).otherwise(status)
    return refused.unionByName(read).select("path", status.alias("status"), "reason", "packed", "size")


def check_uploads(spark: SparkSession, folder: str, most: int) -> DataFrame:
    """upload_checks of all files in a folder. Spark leaves out the content of files that are too long."""
    return upload_checks(spark.read.format("binaryFile").load(folder).select("path", "length", "content"), most)
