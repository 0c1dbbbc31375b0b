"""WARC archives as a chunked record table.

An archive is a table of chunks: archive, number (of the record in its archive, from 0), record (the page's id), chunk
(from 0), chunks (of the record), data, prefix_sha1. Ids may repeat or be null, numbers don't. The data of an archive's
chunks in the order of (number, chunk) is a valid WARC 1.1 file; export_warc()
streams it into one. A record's first chunk begins with its WARC header; no chunk holds more than `chunk_bytes` of
payload. The writer takes the chunks from the row's own buffer and hands them on as soon as a few megabytes are
together, so neither writer nor reader ever joins or copies a whole record. prefix_sha1 is the digest of the payload up
to the end of the chunk: the writer carries one running digest through a record, and the reader recomputes it chunk by
chunk; a difference marks the record as damaged. The digest of the header comes from the table of payloads and must
agree with the running one. Records of one chunk are read where they lie; only those of several chunks
are shuffled by archive and number and sorted, so that their digests can be carried.

Of records with equal payloads of at least `dedup_bytes` bytes, the one with the largest id is a response and the
others are revisits that refer to it, by page id and address, and hold no payload. Record ids are made of page id,
digest, archive and number, so that no two records share one.

Defined results: null payload is empty, with the digest of no bytes; repeated rows with one id: each is written, all
as responses if they hold the largest id of their payload; rows with one id and different payloads are told apart by
the payload; an empty table gives an empty archive; a null id is a record
of its own group and never a response to others; other columns are not read; a record whose bytes don't match its
digests has `intact` false.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linelake.llm.common import SLICE_BYTES, join_groups, map_arrow, materialize, slices, table

CHUNK_BYTES = 64 << 10
DEDUP_BYTES = 0
DATE = "2024-01-01T00:00:00Z"

CHUNKS = "archive int, number long, record long, chunk int, chunks int, data binary, prefix_sha1 binary"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def urn(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, ':'.join(map(str, parts)))}>"


def header(name: str, record: int | None, url: str | None, size: int, digest: str, refers: int | None, refers_url: str | None) -> bytes:
    revisit = refers is not None
    address = lambda x: " ".join((x or "").split())
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {address(url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Target-URI: {address(refers_url)}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page: {refers}"]
    lines += ["Content-Type: text/html", f"X-Page: {record}", f"X-Payload-Length: {size}", f"Content-Length: {0 if revisit else size}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def plan_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", dedup_bytes: int = DEDUP_BYTES) -> DataFrame:
    """record, digest (hex SHA-1), size, refers_to, refers_url: the payloads that other records hold as responses."""
    body = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    url = F.col(url_col).cast("string") if url_col in pages.columns else F.lit(None).cast("string")
    own = pages.select(F.col(id_col).cast("long").alias("record"), F.sha1(body).alias("digest"), F.octet_length(body).cast("long").alias("size"), url.alias("url"))
    own = materialize(own, "digests")
    groups = own.filter(F.col("size") >= dedup_bytes).groupBy("digest", "size").agg(F.max(F.struct("record", "url")).alias("keeper"), F.count("*").alias("n"))
    groups = materialize(groups.filter("n > 1 and keeper.record is not null").select("digest", "size", F.col("keeper.record").alias("refers_to"), F.col("keeper.url").alias("refers_url"), "n"), "repeated")
    rows = own.filter("record is not null").select("record", "digest", "size").distinct()
    return join_groups(rows, groups, ["digest", "size"], "n").filter("record <> refers_to").select("record", "digest", "size", "refers_to", "refers_url")


def chunk_rows(batch: pa.RecordBatch, numbers: Iterator[int], chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """The chunks of a batch of pages (archive, record, url, digest, refers_to, refers_url, payload), in batches of
    about SLICE_BYTES."""
    rows, held = [], 0
    payloads = batch.column(6).cast(pa.binary())
    for i, (archive, record, url, told, refers, refers_url) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(6)))):
        body = memoryview(payloads[i].as_buffer())  # the row's own bytes, not a copy
        number, revisit, told = next(numbers), refers is not None, base32(bytes.fromhex(told))
        name = urn("page", record, told, archive, number)
        running = hashlib.sha1()
        n = 1 if revisit else max(1, -(-len(body) // chunk_bytes))
        for k in range(n):
            piece = b"" if revisit else body[k * chunk_bytes : (k + 1) * chunk_bytes]
            running.update(piece)
            if k == n - 1 and not revisit and base32(running.digest()) != told:
                raise ValueError(f"payload of page {record} changed while it was written")
            head = header(name, record, url, len(body), told, refers, refers_url) if k == 0 else b""
            data = b"".join((head, piece, b"\r\n\r\n" if k == n - 1 else b""))
            rows.append((archive, number, record, k, n, data, running.digest()))
            held += len(data)
            if held >= SLICE_BYTES:
                yield _chunk_batch(rows)
                rows, held = [], 0
    if rows:
        yield _chunk_batch(rows)


def _chunk_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    names = ["archive", "number", "record", "chunk", "chunks", "data", "prefix_sha1"]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", chunk_bytes: int = CHUNK_BYTES, dedup_bytes: int = DEDUP_BYTES) -> DataFrame:
    """The chunk table of an archive of all pages, not yet stored."""
    revisits = plan_revisits(pages, id_col, url_col, payload_col, dedup_bytes)
    url = F.col(url_col).cast("string") if url_col in pages.columns else F.lit(None).cast("string")
    own = pages.select(F.col(id_col).cast("long").alias("record"), url.alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    own = own.withColumns({"digest": F.sha1(F.col("payload").cast("binary")), "size": F.octet_length("payload").cast("long")})
    joined = own.join(revisits, ["record", "digest", "size"], "left").select(F.spark_partition_id().alias("archive"), "record", "url", "digest", "refers_to", "refers_url", "payload")

    def make():
        numbers = count()  # a task writes one archive
        return lambda batch: chunk_rows(batch, numbers, chunk_bytes)

    return map_arrow(joined, make, CHUNKS)


class Reader:
    """Reads chunks in order and carries one record's header and running digest, never its payload."""

    def __init__(self):
        self.at, self.left = None, 0

    def chunk(self, archive, number, chunk, chunks, data: bytes, prefix: bytes) -> tuple | None:
        """The record's row when this is its last chunk."""
        if chunk == 0:
            head, _, data = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            self.head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
            self.good = lines[0] == "WARC/1.1"
            self.left, self.digest, self.at = int(self.head["Content-Length"]), hashlib.sha1(), (archive, number, 0)
        else:
            self.good &= self.at == (archive, number, chunk - 1)
            self.at = (archive, number, chunk)
        if chunk == chunks - 1:
            self.good &= data.endswith(b"\r\n\r\n")
            data = data[:-4]
        self.digest.update(data)
        self.left -= len(data)
        self.good &= self.digest.digest() == prefix
        if chunk < chunks - 1:
            return None
        kind, told = self.head["WARC-Type"], self.head["WARC-Payload-Digest"].removeprefix("sha1:")
        size = int(self.head["X-Payload-Length"])
        digest = told
        if kind == "response":
            digest = base32(self.digest.digest())
            self.good &= digest == told and self.left == 0
        page, refers = self.head["X-Page"], self.head.get("X-Refers-To-Page")
        return (None if page == "None" else int(page), size, digest, kind, None if refers is None else int(refers), self.good)


def _read(chunks: DataFrame) -> DataFrame:
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())

    def make():
        reader = Reader()

        def each(batch):
            for part, data in slices(batch, 5):
                rows = [reader.chunk(*x[:4], d, x[4]) for d, x in zip(data, zip(*(part.column(i).to_pylist() for i in (0, 1, 3, 4, 6))))]
                rows = [x for x in rows if x]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)

        return each

    return map_arrow(chunks, make, RECORDS)


def read_archive(chunks: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, intact of each record of a chunk table."""
    long = chunks.filter("chunks > 1").repartition("archive", "number").sortWithinPartitions("archive", "number", "chunk")
    return _read(chunks.filter("chunks = 1")).unionByName(_read(long))


def archive_bytes(chunks: DataFrame) -> Iterator[bytes]:
    """The archive as a WARC file, piece by piece."""
    for row in chunks.orderBy("archive", "number", "chunk").select("data").toLocalIterator():
        yield bytes(row.data)


def export_warc(chunks: DataFrame, path: str) -> None:
    """Stream the archive into one WARC file on any file system that Spark knows."""
    spark = chunks.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        for data in archive_bytes(chunks):
            out.write(bytearray(data))
    finally:
        out.close()


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archive(materialize(write_archive(table(spark, sf_dir, "pages")), "warc"))
