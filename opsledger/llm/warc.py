"""WARC archives: write, normalise a whole-file gzip stream to one member a record, read by a sidecar offset index."""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import Any, BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsledger.llm.common import cut, freeing, remove, scratch, small
from opsledger.llm.files import attempt_name, opened

#: Payloads shorter than this are never revisits.
LEAST_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes inflated at once, read at once (small, as what follows a member's end is copied), and of a record's head.
CHUNK, STEP, MOST_HEAD = 1 << 20, 16 << 10, 1 << 20
FILES = "path string, index_path string, records long, bytes long"
EMPTY = {"path": pa.string(), "index_path": pa.string(), "records": pa.int64(), "bytes": pa.int64()}


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, digest: str) -> bytes:
    """A response or revisit record; a revisit keeps the HTTP head, with the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields(head: bytes) -> dict[str, str]:
    """The named fields of a header block, names in lower case."""
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}


class Inflated:
    """Bytes of a gzip stream in one pass, of one member or of many, in bounded memory; a stream cut short is told."""

    def __init__(self, source: BinaryIO):
        self.source, self.buffer, self.inflater, self.begun = source, bytearray(), zlib.decompressobj(31), False

    def more(self) -> bool:
        """Inflate up to CHUNK bytes more; False at the end of the stream, which must be a member's."""
        while True:
            data = self.inflater.unconsumed_tail
            if self.inflater.eof:
                data, self.inflater, self.begun = self.inflater.unused_data, zlib.decompressobj(31), False
            data = data or self.source.read(STEP)
            if not data:
                if self.begun:
                    raise EOFError("the stream ends within a gzip member")
                return False
            self.begun = True
            out = self.inflater.decompress(data, CHUNK)
            if out:
                self.buffer += out
                return True

    def until(self, mark: bytes, most: int = MOST_HEAD) -> bytes | None:
        """All up to a mark and the mark; None at the stream's end."""
        at, seen = -1, 0
        while (at := self.buffer.find(mark, seen)) < 0:
            seen = max(0, len(self.buffer) - len(mark))
            if seen > most:
                raise ValueError(f"no record head within {most} bytes")
            if not self.more():
                if self.buffer:
                    raise EOFError("the stream ends within a record's head")
                return None
        return self.take(at + len(mark))

    def take(self, n: int) -> bytes:
        return b"".join(self.pieces(n))

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next n bytes, a piece at a time."""
        while n:
            if not self.buffer and not self.more():
                raise EOFError("the stream ends within a record")
            out = bytes(memoryview(self.buffer)[:n])
            del self.buffer[: len(out)]
            n -= len(out)
            yield out


def records(source: BinaryIO) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
    """(fields, all bytes in pieces) of the records of a compressed WARC stream, one after another.

    A record's pieces must be taken before the next record; a stream that ends anywhere but after a record raises
    EOFError, a head without a length ValueError.
    """
    stream = Inflated(source)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        found = fields(head)
        if not found.get("content-length", "").isdecimal():
            raise ValueError("a record's head has no content length")
        yield found, chain([head], stream.pieces(int(found["content-length"]) + 4))


def _write(folder: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, where = opened(folder)
        store.create_dir(where, recursive=True)
        name = attempt_name("whole", ".warc.gz")
        count, size, out, deflater = 0, 0, None, zlib.compressobj(level, zlib.DEFLATED, 31)
        for batch in batches:
            for row in zip(*(c for c in batch.columns)):
                page_id, url, html, kind, refers_to, digest = (x.as_py() for x in row)
                out = out or store.open_output_stream(f"{where}/{name}", compression=None)
                data = deflater.compress(record(page_id, url, (html or "").encode(), kind, refers_to, digest))
                out.write(data)
                count, size = count + 1, size + len(data)
        if out:
            out.write(data := deflater.flush())
            out.close()
            yield pa.record_batch([pa.array(x) for x in ([f"{folder}/{name}"], [""], [count], [size + len(data)])], names=list(EMPTY))

    return run


def _normalise(folder: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, where = opened(folder)
        target.create_dir(where, recursive=True)
        at = 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                name = attempt_name(f"records-{at:04d}", ".warc.gz")
                source, there = opened(path)
                offset = count = 0
                with source.open_input_stream(there, compression=None) as read, target.open_output_stream(f"{where}/{name}", compression=None) as out, target.open_output_stream(f"{where}/{name}.idx", compression=None) as index:
                    for found, pieces in records(read):
                        deflater, length = zlib.compressobj(level, zlib.DEFLATED, 31), 0
                        for piece in pieces:
                            length += out.write(deflater.compress(piece))
                        length += out.write(deflater.flush())
                        index.write(json.dumps([offset, length, found["warc-type"], found["warc-record-id"], found.get("warc-target-uri")]).encode() + b"\n")
                        offset, count = offset + length, count + 1
                at += 1
                yield pa.record_batch([pa.array(x) for x in ([f"{folder}/{name}"], [f"{folder}/{name}.idx"], [count], [offset])], names=list(EMPTY))

    return run


def _number(uri: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(found[1]) if found else None


def read_record(data: bytes) -> dict[str, Any]:
    """What one member holds: page_id, url, record_type, refers_to, payload (None for a revisit), payload_bytes, payload_digest."""
    head, _, rest = zlib.decompress(data, 31).partition(b"\r\n\r\n")
    found = fields(head)
    block = rest[: int(found["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = found["warc-type"]
    return {
        "page_id": _number(found["warc-record-id"]), "url": found.get("warc-target-uri"), "record_type": kind, "refers_to": _number(found.get("warc-refers-to")),
        "payload": payload if kind == "response" else None, "payload_bytes": int(fields(http)["content-length"]),
        "payload_digest": base64.b32decode(found["warc-payload-digest"].removeprefix("sha1:")).hex(),
    }


def indexed(index_path: str) -> Iterator[list]:
    """The entries of a sidecar index: offset, length, type, record id, address."""
    store, where = opened(index_path)
    with store.open_input_stream(where, compression=None) as f:
        left = b""
        while data := f.read(CHUNK):
            *lines, left = (left + data).split(b"\n")
            yield from map(json.loads, lines)
    if left:
        raise EOFError(f"{index_path} ends within an entry")


def read_at(path: str, offset: int, length: int) -> dict[str, Any]:
    """One record of a normalised archive, by its index entry."""
    store, where = opened(path)
    with store.open_input_file(where) as f:
        return read_record(f.read_at(length, offset))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from hashlib import sha1

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        for path, index_path, count in zip(*(batch.column(c).to_pylist() for c in ("path", "index_path", "records"))):
            store, where = opened(path)
            rows: list[list] = [[] for _ in names]
            seen = 0
            with store.open_input_file(where) as f:
                for offset, length, *_ in indexed(index_path):
                    seen += 1
                    found = read_record(f.read_at(length, offset))
                    if found["payload"] is not None and (len(found["payload"]) != found["payload_bytes"] or sha1(found["payload"]).hexdigest() != found["payload_digest"]):
                        raise ValueError(f"{path} is damaged at {offset}")
                    for to, name in zip(rows, names):
                        to.append(found[name])
                    if len(rows[0]) >= 10_000:
                        yield pa.record_batch([pa.array(x, k) for x, k in zip(rows, kinds)], names=names)
                        rows = [[] for _ in names]
            if seen != count:
                raise ValueError(f"{index_path} has {seen} entries, not {count}")
            if rows[0]:
                yield pa.record_batch([pa.array(x, k) for x, k in zip(rows, kinds)], names=names)


def with_record_types(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, url, html, record_type, refers_to, digest) of each page.

    Of pages with equal payloads of `least` bytes or more, that with the largest id is a response and the others
    revisit it; rows that also tie in that largest id are responses all. A null html is an empty payload, a null url
    stays without address, a null id never is the largest unless all are. Payload groups are counted before their
    shuffle; where the repeated ones are few they are broadcast and no html is shuffled.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    long_ones = rows.where(F.octet_length("html") >= least)
    repeated = cut(long_ones.groupBy("digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("same"), "largest"))
    joined = rows.join(small(repeated, 200), F.col("digest") == F.col("same"), "left")
    revisit = F.col("same").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    return joined.select("page_id", "url", "html", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("largest")).alias("refers_to"), "digest")


def write_whole(typed: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Archives of one gzip stream each, one per partition; the files that were committed."""
    return cut(typed.select("page_id", "url", "html", "record_type", "refers_to", "digest").mapInArrow(freeing(_write(folder, level)), FILES))


def normalise(archives: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Normalise archives (column path), whatever their members: (path, index_path, records, bytes) of the new ones.

    Each archive's stream is inflated once, front to back, CHUNK bytes at a time whatever it holds; every record becomes
    a member of its own in the new file, and a line of the sidecar index: offset, length, type, id, address. A file is
    one task's work; a retried task writes under another name, and only committed files are listed. An archive cut
    short raises EOFError: within a head, a block, or a gzip member whose records are whole. A head of more than
    MOST_HEAD bytes raises ValueError.
    """
    return cut(archives.mapInArrow(freeing(_normalise(folder, level)), FILES))


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, by the sidecar index.

    An index that ends within an entry, or has not as many as the archive has records, raises an error. Payloads are checked against their digests; a revisit tells its payload's length and digest from its own headers.
    """
    return archives.mapInArrow(freeing(_read), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages as whole-stream archives, normalise them below folder, and list the normalised files.

    Without a folder, one below the session's shared folder is used. The whole-stream files go once all are normalised.
    Empty tables give no file.
    """
    spark = pages.sparkSession
    whole = scratch(spark, "whole")
    out = normalise(write_whole(with_record_types(pages), whole), folder or scratch(spark, "warc"))
    remove(spark, whole)
    return out
