"""WARC archives: written with one gzip member for each record, and read by a sequential reader.

The reader inflates piece by piece, frames records by their content length, and checks the digests of block and payload; it holds one
piece and one header of what it is given, and Spark gives it an archive at a time, about 8 MB. Archives are written by Spark's own writer, so that its commit protocol covers
retries and any file system that Spark knows will do; the zero bytes that end a file are padding, which gzip readers skip.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semforge.llm.common import arrow_map, new_path

#: Payloads smaller than this are always written in full.
LEAST_SHARED = 100
#: Compressed bytes of an archive, about; pieces in which a reader takes it.
ARCHIVE_BYTES, PIECE = 8 << 20, 1 << 16
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_DATE = "1970-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive that isn't as its headers say."""


def _member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(head.encode() + block + b"\r\n\r\n") + deflate.flush()


def _one_line(x: str) -> str:
    return x.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, row: str = "") -> bytes:
    """The gzip member of one page: a response with its payload, or a revisit that names the response. Without a page_id ``row`` names it."""
    name = f"<urn:row:{row}>" if page_id is None else f"<urn:page:{page_id}>"
    block = _HTTP + payload if refers_to is None else _HTTP
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name), ("WARC-Date", _DATE), ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        fields.append(("WARC-Target-URI", _one_line(url)))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("X-Payload-Length", str(len(payload)))]
    return _member(fields, block)


def _inflated(stream: BinaryIO) -> Iterator[tuple[bytes, bool]]:
    """Pieces of inflated bytes, and whether a gzip member ends with the piece."""
    inflate, raw, fresh = zlib.decompressobj(31), b"", True
    while True:
        if not raw:
            raw = stream.read(PIECE)
        if fresh:
            while raw and not raw.strip(b"\0"):
                raw = stream.read(PIECE)
            raw = raw.lstrip(b"\0")
        if not raw:
            if not fresh:
                raise WarcError("the archive ends within a record")
            return
        try:
            out = inflate.decompress(raw, PIECE)
        except zlib.error as e:
            raise WarcError(str(e)) from e
        fresh = inflate.eof
        raw = inflate.unused_data if fresh else inflate.unconsumed_tail
        if fresh:
            inflate = zlib.decompressobj(31)
        yield out, fresh


def read_archive(stream: BinaryIO, keep_payload: bool = False) -> Iterator[dict]:
    """The records of an archive, one by one: headers, payload length and digest as read, and the payload where asked for."""
    pieces = _inflated(stream)
    for first, ended in pieces:
        held = first

        def more() -> bytes:
            nonlocal ended
            if ended:
                raise WarcError("a record is longer than its gzip member")
            out, ended = next(pieces)
            return out

        while b"\r\n\r\n" not in held:
            if len(held) > 1 << 20:
                raise WarcError("a record's header doesn't end")
            held += more()
        head, _, held = held.partition(b"\r\n\r\n")
        lines = head.decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise WarcError("not a WARC record")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        left = int(fields["Content-Length"])
        block, payload, size, http, kept = hashlib.sha256(), hashlib.sha256(), 0, b"", []
        in_payload = not fields.get("Content-Type", "").startswith("application/http")
        while left:
            if not held:
                held = more()
                continue
            piece, held = held[:left], held[left:]
            left -= len(piece)
            block.update(piece)
            if not in_payload:
                http += piece
                if b"\r\n\r\n" not in http:
                    continue
                piece = http.partition(b"\r\n\r\n")[2]
                in_payload = True
            payload.update(piece)
            size += len(piece)
            if keep_payload:
                kept.append(piece)
        while len(held) < 4 or not ended:
            if ended:
                raise WarcError("a record's end is missing")
            held += more()
        if held != b"\r\n\r\n":
            raise WarcError("a record is longer than its content length")
        if "WARC-Block-Digest" in fields and fields["WARC-Block-Digest"] != f"sha256:{block.hexdigest()}":
            raise WarcError(f"{fields['WARC-Record-ID']}: block digest differs")
        if fields["WARC-Type"] == "response" and fields.get("WARC-Payload-Digest", "") != f"sha256:{payload.hexdigest()}":
            raise WarcError(f"{fields['WARC-Record-ID']}: payload digest differs")
        yield {"fields": fields, "bytes": size, "digest": payload.hexdigest(), "payload": b"".join(kept)}


def _number(name: str | None) -> int | None:
    return int(name.removeprefix("<urn:page:").removesuffix(">")) if name and name.startswith("<urn:page:") else None


def marked(pages: DataFrame) -> DataFrame:
    """Adds digest and refers_to: the smallest page_id among equal payloads of at least 100 bytes, on all its other pages."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"), F.sha2(payload.cast("binary"), 256).alias("digest"))
    shared = rows.filter(F.octet_length("html") >= LEAST_SHARED).groupBy(F.col("digest").alias("d")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL").select("d", "first")
    # A payload that very many pages share is a skewed key on the pages' side only, which Spark splits.
    joined = rows.join(shared, F.col("digest") == F.col("d"), "left")
    return joined.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("d", "first")


def write_archives(pages: DataFrame, path: str) -> None:
    """Writes a record for each row (page_id, url, html) to archives of about 8 MB under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        number = 0
        info = _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:archive:{task}-0>"), ("WARC-Date", _DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
        held, size = [info], len(info)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"archive": pa.array([b"".join(held)], pa.binary())})

        for batch in batches:
            for row in batch.to_pylist():
                number += 1
                held.append(record(row["page_id"], row["url"], row["html"].encode(), row["digest"], row["refers_to"], f"{task}-{number}"))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield out()
                    held, size = [info], len(info)
        if len(held) > 1:
            yield out()

    # The text writer writes a string's bytes as they are. Each archive is a file of its own.
    archives = arrow_map(marked(pages), run, "archive binary").select(F.col("archive").cast("string").alias("value"))
    archives.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each record under ``path``, checked; warcinfo left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for r in read_archive(io.BytesIO(content.as_buffer())):
                    f = r["fields"]
                    if f["WARC-Type"] != "warcinfo":
                        full = f["WARC-Type"] == "response"
                        rows.append((_number(f["WARC-Record-ID"]), r["bytes"] if full else int(f["X-Payload-Length"]), r["digest"] if full else f["WARC-Payload-Digest"].removeprefix("sha256:"), f["WARC-Type"], _number(f.get("WARC-Refers-To"))))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return arrow_map(files, run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes archives of all pages to the shared folder and reads them back.

    Null html is an empty payload. Rows without a page_id are written too, and refer to a page of equal payload that has one; where
    none has, all are responses. Repeated rows of one page_id are all responses. An empty table makes no archive and no rows.
    """
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
