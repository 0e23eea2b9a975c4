"""WARC archives as a chunked record table.

``write_archives`` writes one record per page into gzip-member archives below a shared folder and returns the manifest;
``read_archives`` streams the archives back as rows (record, chunk number, bytes, running digest).  Payloads are
compressed, written, read and digested chunk by chunk; no step on the archive allocates a whole record.

Of pages with equal payloads of at least ``revisit_from`` bytes, that with the largest page_id is a response and the
others are revisits that refer to it and carry no payload; smaller payloads are always responses.

Defined cases: a null html is an empty payload; a null url is written as an empty target; null page_ids are kept (as
the smallest id, so they are responses only among themselves); repeated page_ids with equal payloads give one response
for each row that has the largest id; an empty table gives no archives and no rows.  Other columns are ignored.

A task that is run again writes files of new names; only the files named in the committed manifest are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import run_dir

CHUNK = 64 << 10
#: An archive is closed and the next begun beyond this many bytes.
ARCHIVE_BYTES = 64 << 20

MANIFEST = "archive string, records bigint, bytes bigint"
CHUNKS = ("archive string, record_no bigint, page_id bigint, record_type string, refers_to bigint, chunk_no int, "
          "chunk binary, last boolean, chunk_bytes bigint, payload_bytes bigint, payload_digest string")


def opened(uri: str):
    """The file system of a URI or plain path, and the path in it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def record_type(pages: DataFrame, revisit_from: int) -> DataFrame:
    """Adds the response's page_id to each page, and whether the page itself is a revisit."""
    pages = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("size", F.octet_length("html").cast("long")).withColumn("digest", F.sha2("html", 256))
    newest = pages.where(F.col("size") >= revisit_from).groupBy(F.col("digest").alias("of_digest")) \
        .agg(F.max("page_id").alias("response"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    typed = pages.join(newest, F.col("digest") == F.col("of_digest"), "left")
    older = F.col("response").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("response")))
    return typed.select("page_id", "url", "html", F.when(older, F.col("response")).alias("refers_to"))


class Archive:
    """One archive being written: every record is a gzip member of its own, compressed piece by piece."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        files, path = opened(self.uri)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        self.stream, self.records, self.bytes = files.open_output_stream(path), 0, 0

    def add(self, page_id, url, html: memoryview, refers_to) -> None:
        digest = hashlib.sha1()
        for at in range(0, len(html), CHUNK):
            digest.update(html[at:at + CHUNK])
        kept = len(html) if refers_to is None else 0
        lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
                 "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {' '.join((url or '').split())}",
                 f"WARC-Payload-Digest: sha1:{base32(digest.digest())}", f"X-Payload-Length: {len(html)}"]
        lines += [] if page_id is None else [f"X-Page-ID: {page_id}"]
        lines += [] if refers_to is None else [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
        lines += ["Content-Type: text/html", f"Content-Length: {kept}", "", ""]
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        self.put(packer.compress("\r\n".join(lines).encode("utf-8", "replace")))
        for at in range(0, kept, CHUNK):
            self.put(packer.compress(html[at:at + CHUNK]))
        self.put(packer.compress(b"\r\n\r\n"))
        self.put(packer.flush())
        self.records += 1

    def put(self, data: bytes) -> None:
        if data:
            self.stream.write(data)
            self.bytes += len(data)

    def close(self) -> pa.RecordBatch:
        self.stream.close()
        return pa.RecordBatch.from_pydict({"archive": [self.uri], "records": [self.records], "bytes": [self.bytes]})


def archive_writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to"))):
                archive = archive or Archive(folder)
                archive.add(page_id.as_py(), url.as_py(), memoryview(html.as_buffer()), refers_to.as_py())
                if archive.bytes >= ARCHIVE_BYTES:
                    yield archive.close()
                    archive = None
        if archive:
            yield archive.close()

    return write


def write_archives(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """Writes the pages' records and returns the manifest of the archives, itself written and reread."""
    spark = pages.sparkSession
    folder = run_dir(spark, "warc")
    record_type(pages, revisit_from).mapInArrow(archive_writer(f"{folder}/archives"), MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


class Members:
    """The unpacked bytes of an archive's records, read in pieces."""

    def __init__(self, stream):
        self.stream, self.packed, self.clear, self.unpack, self.over = stream, b"", bytearray(), None, False

    def more(self) -> bool:
        """Unpacks a little more of the present record; false at its end."""
        if self.over:
            return False
        if not self.packed:
            self.packed = self.stream.read(CHUNK)
        self.clear += self.unpack.decompress(self.packed, CHUNK)
        self.packed = self.unpack.unconsumed_tail or self.unpack.unused_data
        self.over = self.unpack.eof
        if not self.over and not self.packed and not (more := self.stream.read(CHUNK)):
            raise EOFError("the archive ends inside a record")
        elif not self.over and not self.packed:
            self.packed = more
        return True

    def following(self) -> bool:
        """Goes to the next record, if there is one."""
        if not self.packed and not (more := self.stream.read(CHUNK)):
            return False
        self.packed = self.packed or more
        self.unpack, self.over, self.clear = zlib.decompressobj(31), False, bytearray()
        return True

    def head(self) -> dict[str, str]:
        while (end := self.clear.find(b"\r\n\r\n")) < 0 and self.more():
            pass
        lines = bytes(self.clear[:end]).decode("utf-8").split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError("not a record")
        del self.clear[:end + 4]
        return dict(line.split(": ", 1) for line in lines[1:])

    def body(self, length: int) -> Iterator[bytes]:
        while length:
            while len(self.clear) < min(CHUNK, length) and self.more():
                pass
            piece = bytes(self.clear[:min(CHUNK, length)])
            if not piece:
                raise EOFError("the record is shorter than it says")
            del self.clear[:len(piece)]
            length -= len(piece)
            yield piece
        while self.more():
            self.clear.clear()


def chunk_rows(archive: str) -> Iterator[dict]:
    """The rows of one archive: a record's bytes in chunks with the digest up to each; a record without a body has one
    row with an empty chunk."""
    files, path = opened(archive)
    with files.open_input_stream(path) as stream:
        members, number = Members(stream), 0
        while members.following():
            head = members.head()
            length, digest, seen = int(head["Content-Length"]), hashlib.sha1(), 0
            revisit = head["WARC-Type"] == "revisit"
            own = {"archive": archive, "record_no": number, "record_type": head["WARC-Type"],
                   "page_id": int(head["X-Page-ID"]) if "X-Page-ID" in head else None,
                   "refers_to": int(head["X-Refers-To-Page"]) if revisit else None}
            for n, piece in enumerate(members.body(length)):
                digest.update(piece)
                seen += len(piece)
                yield own | {"chunk_no": n, "chunk": piece, "last": seen == length, "chunk_bytes": len(piece),
                             "payload_bytes": seen, "payload_digest": base32(digest.digest())}
            if not length:
                yield own | {"chunk_no": 0, "chunk": b"", "last": True, "chunk_bytes": 0,
                             "payload_bytes": int(head["X-Payload-Length"]) if revisit else 0,
                             "payload_digest": head["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else base32(digest.digest())}
            number += 1


def read_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("archive", pa.string()), ("record_no", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()),
                        ("refers_to", pa.int64()), ("chunk_no", pa.int32()), ("chunk", pa.binary()), ("last", pa.bool_()),
                        ("chunk_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
    held, size = [], 0
    for batch in batches:
        for archive in batch.column("archive").to_pylist():
            for row in chunk_rows(archive):
                held.append(row)
                size += len(row["chunk"]) + 200
                if size >= 4 << 20:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def read_archives(manifest: DataFrame) -> DataFrame:
    """The chunk table of the archives.  One archive is one row of the manifest, and each is read by a task of its own: the
    manifest is tiny, so its partitions would otherwise be put together."""
    return manifest.select("archive").repartition(max(1, manifest.count())).mapInArrow(read_chunks, CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record from its last chunk, whose running count and digest cover the whole payload."""
    return chunks.where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
