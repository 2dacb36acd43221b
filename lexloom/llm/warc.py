"""WARC archives through a chunked record table.

Writing: a page's payload becomes rows (record, chunk number, bytes) of bounded size, with the digest that the
JVM computes; each task streams those rows into one gzip-per-record archive in the shared folder, with a running
digest of its own. A manifest, written with Spark's commit protocol, names the archives of successful tasks only,
so files of lost attempts are never read. Reading: archives stream back as rows (record, chunk number), with the
digest carried along and given on a record's last chunk; no record is ever held whole.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import map_batches, shared_dir, stash

#: Bytes of a payload in one chunk row; bytes that the reader asks a file for.
CHUNK, READ = 1 << 20, 1 << 18
#: Parts over which rows of one digest are dealt when they learn who is their response.
PARTS = 64
#: The record types, and the profile of a revisit by equal payload digest.
RESPONSE, REVISIT = "response", "revisit"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The store and the path in it, by the names that Hadoop's connectors have too."""
    scheme, found, rest = uri.partition(":/")
    if not found:
        return fs.FileSystem.from_uri(f"file://{uri}")
    if scheme in ("s3a", "s3n"):
        uri = f"s3:/{rest}"
    elif scheme == "dbfs":  # mounted on every node
        uri = f"file:///dbfs/{rest.lstrip('/')}"
    elif scheme == "file":
        uri = f"file:///{rest.lstrip('/')}"
    return fs.FileSystem.from_uri(uri)


def digest_text(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _head(kind: str, record: int | None, target: str, digest: str, size: int, block: int, refers: int | None) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if record is None else record}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [f"WARC-Target-URI: {target}"] if target else []
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response"]
    lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers}>"] if kind == REVISIT else []
    return ("\r\n".join([*lines, f"Content-Length: {block}"]) + "\r\n\r\n").encode()


class RecordWriter:
    """One record as a gzip member of its own, from chunks that come one by one; nothing but a chunk is held."""

    def __init__(self, out, kind: str, record: int | None, target: str | None, size: int, digest: str, refers: int | None):
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
        target = "".join(c for c in target or "" if c not in "\r\n")
        self.out, self.kind, self.record, self.digest, self.left = out, kind, record, digest, size if kind == RESPONSE else 0
        self.hash, self.pack = hashlib.sha1(), zlib.compressobj(6, wbits=31)
        self.out.write(self.pack.compress(_head(kind, record, target, digest, size, len(http) + self.left, refers) + http))

    def add(self, chunk: bytes) -> None:
        self.hash.update(chunk)
        self.left -= len(chunk)
        self.out.write(self.pack.compress(chunk))

    def close(self) -> None:
        """Ends the record; its chunks must have been all, and those of the digest in its header."""
        if self.left or self.kind == RESPONSE and digest_text(self.hash.digest()) != self.digest:
            raise ValueError(f"record {self.record}: its chunks don't agree with its size and digest")
        self.out.write(self.pack.compress(b"\r\n\r\n") + self.pack.flush())


def _unpacked(source, read: int) -> Iterator[bytes]:
    """Plain bytes of a file of gzip members."""
    unpack, rest = None, b""
    while True:
        data = rest or source.read(read)
        if not data:
            return
        unpack = unpack or zlib.decompressobj(31)
        yield unpack.decompress(data, CHUNK) or b""
        rest = unpack.unconsumed_tail
        if unpack.eof:
            rest, unpack = unpack.unused_data, None


class _Stream:
    """A forward reader over pieces of bytes."""

    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.have = parts, bytearray()

    def _more(self) -> bool:
        for p in self.parts:
            if p:
                self.have += p
                return True
        return False

    def head(self) -> dict[str, str] | None:
        """Header lines up to the empty one; none at the end of the file."""
        while (end := self.have.find(b"\r\n\r\n")) < 0:
            if not self._more():
                if self.have.strip():
                    raise ValueError("a record ends within its header")
                return None
        lines = bytes(self.have[:end]).decode().split("\r\n")
        del self.have[: end + 4]
        return {"": lines[0]} | {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}

    def take(self, n: int, piece: int) -> Iterator[bytes]:
        """The next n bytes in pieces."""
        while n:
            while len(self.have) < min(n, piece):
                if not self._more():
                    raise ValueError("a record ends too early")
            got = bytes(self.have[: min(n, piece)])
            del self.have[: len(got)]
            n -= len(got)
            yield got


def read_records(source, chunk: int = CHUNK, read: int = READ) -> Iterator[dict]:
    """Chunk rows of an archive: record, type, chunk number, bytes, payload bytes so far; digest on the last one.

    A revisit has one empty chunk, with the digest and length that its header states. A response's payload is
    hashed as it passes and must agree with its header.
    """
    stream = _Stream(_unpacked(source, read))
    while (head := stream.head()) is not None:
        block = int(head["content-length"])
        ident = head["warc-record-id"].removeprefix("<urn:page:").removesuffix(">")
        row = {"id": int(ident) if ident else None, "type": head["warc-type"], "refers_to": int(head["warc-refers-to"].removeprefix("<urn:page:").removesuffix(">")) if "warc-refers-to" in head else None}
        http = _http_size(stream)
        digest, size = head["warc-payload-digest"].removeprefix("sha1:"), int(head["x-payload-length"])
        h, seen, number = hashlib.sha1(), 0, 0
        if row["type"] == RESPONSE:
            left = block - http
            for piece in stream.take(left, chunk):
                h.update(piece)
                seen += len(piece)
                last = seen == left
                yield row | {"chunk": number, "bytes": piece, "so_far": seen, "digest": digest_text(h.digest()) if last else None}
                number += 1
            if not left:
                yield row | {"chunk": 0, "bytes": b"", "so_far": 0, "digest": digest_text(h.digest())}
            if digest_text(h.digest()) != digest or seen != size:
                raise ValueError(f"record {row['id']}: the payload doesn't agree with its digest")
        else:
            yield row | {"chunk": 0, "bytes": b"", "so_far": size, "digest": digest}
        for end in stream.take(4, 4):
            if end != b"\r\n\r\n":
                raise ValueError(f"record {row['id']}: no end where its length has it")


def _http_size(stream: _Stream) -> int:
    """Takes the HTTP header of a block; gives its size."""
    while (end := stream.have.find(b"\r\n\r\n")) < 0:
        if not stream._more():
            raise ValueError("a block ends within its header")
    del stream.have[: end + 4]
    return end + 4


def with_types(pages: DataFrame, *, page_id: str, html: str, url: str | None, least: int) -> DataFrame:
    """(id, url, html, type, refers_to): of equal payloads of at least `least` bytes, the largest id is the response.

    Digests alone travel for that: their groups are summed before the shuffle, and a hot digest's rows are dealt
    over PARTS. The html moves once, by page, only where a table has equal payloads at all.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("id"), (F.col(url).cast("string") if url else F.lit(None).cast("string")).alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    keys = rows.select("id", F.sha2("html", 256).alias("key"), F.octet_length("html").alias("size"))
    groups = keys.where(F.col("size") >= least).groupBy("key", "size").agg(F.max("id").alias("response"), F.count("*").alias("n")).where("n > 1 AND response IS NOT NULL")
    parts = groups.select("key", "size", "response", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    again = keys.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")).join(parts, ["key", "size", "part"])
    refers = again.where(~F.col("id").eqNullSafe(F.col("response"))).select("id", F.col("response").alias("refers_to"), "key").distinct()
    rows = rows.withColumn("key", F.sha2("html", 256))
    typed = rows.join(refers.withColumnRenamed("id", "rid").withColumnRenamed("key", "rkey"), F.col("id").eqNullSafe(F.col("rid")) & (F.col("key") == F.col("rkey")), "left")
    return typed.select("id", "url", "html", F.when(F.col("refers_to").isNull(), RESPONSE).otherwise(REVISIT).alias("type"), "refers_to")


def chunk_rows(typed: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(id, url, type, refers_to, size, digest, number, chunks, bytes): the payloads of `with_types` in rows of bounded size.

    A record's rows follow each other in order of their numbers; a revisit, or an empty payload, has one row
    without bytes. digest is the payload's SHA-1 (binary).
    """
    raw = typed.select("id", "url", "type", "refers_to", F.encode("html", "UTF-8").alias("raw"))
    sized = raw.select("*", F.length("raw").cast("long").alias("size"), F.unhex(F.sha1("raw")).alias("digest"))
    sized = sized.withColumn("chunks", F.when(F.col("type") == RESPONSE, F.greatest(F.ceil(F.col("size") / chunk), F.lit(1))).otherwise(1).cast("int"))
    rows = sized.withColumn("number", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    piece = F.when(F.col("type") == RESPONSE, F.substring("raw", F.col("number") * chunk + 1, F.lit(chunk)))
    return rows.select("id", "url", "type", "refers_to", "size", "digest", "number", "chunks", piece.alias("bytes"))


def write_archives(pages: DataFrame, folder: str, *, page_id: str = "page_id", html: str = "html", url: str | None = "url", least: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Write all pages as WARC records below `folder`; gives the manifest (path, records, bytes) as a table.

    Null html counts as empty. Null urls: no target. Null ids: records without a number. Rows that repeat an id
    with an equal payload are responses (or revisits) alike; rows that repeat it with another payload are records
    of their own. An empty table: no archive.
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        path, out, record, n = f"{folder}/archives/part-{uuid.uuid4().hex}.warc.gz", None, None, 0
        for b in batches:
            told = (b[c].to_pylist() for c in ("id", "url", "type", "refers_to", "size", "digest", "number", "chunks"))
            for i, u, kind, refers, size, digest, number, chunks, data in zip(*told, b["bytes"], strict=True):
                if out is None:
                    store, name = _open_fs(path)
                    store.create_dir(name.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(name)
                if not number:
                    record = RecordWriter(out, kind, i, u, size, digest_text(digest), refers)
                if data.is_valid:
                    record.add(data.as_buffer())
                if number + 1 == chunks:
                    record.close()
                    n += 1
        if out is not None:
            size = out.tell()
            out.close()
            yield {"path": [path], "records": [n], "bytes": [size]}

    typed = with_types(pages, page_id=page_id, html=html, url=url, least=least)
    return stash(map_batches(chunk_rows(typed, chunk), run, "path string, records long, bytes long"), folder, "manifest")


def read_archives(spark: SparkSession, manifest: DataFrame, *, chunk: int = CHUNK, with_bytes: bool = True) -> DataFrame:
    """The chunk table of the archives in a manifest: (id, type, refers_to, chunk, so_far, digest[, bytes])."""
    columns = ["id", "type", "refers_to", "chunk", "so_far", "digest", *["bytes"] * with_bytes]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for path in b["path"].to_pylist():
                store, name = _open_fs(path)
                with store.open_input_stream(name) as source:
                    held: dict[str, list] = {c: [] for c in columns}
                    size = 0
                    for row in read_records(source, chunk):
                        for c in columns:
                            held[c].append(row[c])
                        size += len(row["bytes"]) if with_bytes else 4096
                        if size >= 4 * CHUNK:
                            yield held
                            held, size = {c: [] for c in columns}, 0
                    yield held

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return map_batches(manifest.select("path").repartition(n, "path"), run, "id long, type string, refers_to long, chunk int, so_far long, digest string" + ", bytes binary" * with_bytes)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """(id, payload_bytes, digest, type, refers_to) per page row, from archives written and read again.

    Null html: an empty payload; equal payloads, empty ones too, are one group. Null ids stay null, and only a
    group without any id has no response but them. Repeated rows: each its own record. Payloads of any size pass
    in chunks. Empty table: no rows.
    """
    spark = pages.sparkSession
    manifest = write_archives(pages, folder or shared_dir(spark))
    last = read_archives(spark, manifest, with_bytes=False).where(F.col("digest").isNotNull())
    return last.select("id", F.col("so_far").alias("payload_bytes"), "digest", "type", "refers_to")
