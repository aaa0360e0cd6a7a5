"""WARC archives as a chunked record table.

Writing: one record per row goes to gzip-per-record archives, one file a partition, in the shared
folder. Equal payloads are stored once: the row with the largest id is the response, the others are
revisit records without a payload. Reading: each archive is streamed; a payload comes back as rows
(record id, chunk number, bytes, digest of all bytes so far), so neither side holds more than one
chunk of a record besides what the source row itself holds.

Defined cases: a null payload is the empty payload, which is a payload like any other; a null id
gives a record without id header and reads back as null (such a row is a revisit when another row
with an id has its payload); rows repeated with the same id and payload are all responses, since each
carries the largest id; an empty table writes no record and reads back as no rows. Other columns of the pages are not read, so
their names may clash; a payload of any length is streamed in chunks.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, store

CHUNK_BYTES = 1 << 20
ID_URN = "urn:record:"
CHUNK_SCHEMA = (
    "record_id string, page_id long, url string, record_type string, refers_to long, chunk_no int, is_last boolean, "
    "payload_bytes long, payload_digest string, declared_digest string, data binary"
)


def with_revisits(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Adds payload, payload_sha1, refers_to. Payload digests are grouped narrow (id and digest only); the
    wide rows meet the groups' winners in a plain equi-join whose hot digests adaptive execution splits."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("payload_sha1", F.sha1("payload"))
    winners = store(rows.groupBy("payload_sha1").agg(F.max("page_id").alias("winner")), "warc-winners")
    revisit = F.octet_length("payload") >= min_revisit_bytes
    refers = F.when(revisit & ~F.col("page_id").eqNullSafe(F.col("winner")), F.col("winner"))
    return rows.join(winners, "payload_sha1").select("page_id", "url", "payload", "payload_sha1", refers.alias("refers_to"))


def write_archives(records: DataFrame, directory: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Streams with_revisits() rows to ``directory``; returns a stored manifest (path, n_records).

    A file is written under an attempt's name and renamed when complete, so a repeated or
    speculative task replaces it with the same bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        fs, root = pafs.FileSystem.from_uri(directory)
        final = f"{root}/part-{ctx.partitionId():06d}.warc.gz"
        temp, n = f"{final}.{ctx.taskAttemptId()}.tmp", 0
        with fs.open_output_stream(temp, compression=None) as out:
            for batch in batches:
                for i in range(batch.num_rows):
                    page_id, url, payload, sha1, refers_to = (c[i].as_py() for c in batch.columns)
                    write_record(out, page_id, url, payload.encode("utf-8", "surrogatepass"), sha1, refers_to, chunk_bytes)
                    n += 1
        if n:
            fs.move(temp, final)
            yield pa.RecordBatch.from_pydict({"path": [final], "n_records": pa.array([n], pa.int64())})
        else:
            fs.delete_file(temp)

    fs, root = pafs.FileSystem.from_uri(directory)
    fs.create_dir(root, recursive=True)
    return store(records.select("page_id", "url", "payload", "payload_sha1", "refers_to").mapInArrow(run, "path string, n_records long"), "warc-manifest")


def write_record(out, page_id: int | None, url: str | None, payload: bytes, sha1_hex: str, refers_to: int | None, chunk_bytes: int) -> None:
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{ID_URN}{'' if page_id is None else page_id}>"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode())
    head.append(f"X-Payload-Length: {len(payload)}")
    if refers_to is not None:
        head.append(f"WARC-Refers-To: <{ID_URN}{refers_to}>")
    head.append(f"Content-Length: {len(body)}")
    gz = zlib.compressobj(3, zlib.DEFLATED, 31)
    out.write(gz.compress(("\r\n".join(head) + "\r\n\r\n").encode()))
    for at in range(0, len(body), chunk_bytes):
        out.write(gz.compress(memoryview(body)[at : at + chunk_bytes]))
    out.write(gz.compress(b"\r\n\r\n"))
    out.write(gz.flush())


class _Stream:
    """Inflated bytes of a multi-member gzip stream, at most ``step`` input bytes at a time."""

    def __init__(self, raw, step: int = 1 << 18):
        self.raw, self.step, self.gz, self.rest, self.buf = raw, step, zlib.decompressobj(31), b"", bytearray()

    def _more(self) -> bool:
        data = self.rest or self.raw.read(self.step)
        if not data:
            return False
        if self.gz.eof:
            self.gz = zlib.decompressobj(31)
        self.buf += self.gz.decompress(data, self.step * 4)
        self.rest = self.gz.unconsumed_tail
        if self.gz.eof:
            self.rest = self.gz.unused_data
        return True

    def take(self, n: int) -> bytes:
        while len(self.buf) < n and self._more():
            pass
        out = bytes(self.buf[:n])
        del self.buf[:n]
        return out

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (at := self.buf.find(mark, seen)) < 0:
            seen = max(0, len(self.buf) - len(mark) + 1)
            if not self._more():
                return None
        return self.take(at + len(mark))[:at]


def read_records(raw, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple]:
    """Rows of CHUNK_SCHEMA from one open archive."""
    stream = _Stream(raw)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        h = dict(x.split(": ", 1) for x in lines[1:])
        rid = h["WARC-Record-ID"].strip("<>")
        as_id = lambda urn: int(urn[len(ID_URN) :]) if urn[len(ID_URN) :] else None
        left, sha, no, done = int(h["Content-Length"]), hashlib.sha1(), 0, 0
        kind, refers = h["WARC-Type"], as_id(h["WARC-Refers-To"].strip("<>")) if "WARC-Refers-To" in h else None
        url = h["WARC-Target-URI"].replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%") if "WARC-Target-URI" in h else None
        declared = h.get("WARC-Payload-Digest", "sha1:").split(":", 1)[1]
        while True:
            data = stream.take(min(left, chunk_bytes))
            if not data and left:
                raise EOFError(f"archive ends inside record {rid}")
            sha.update(data)
            left, done = left - len(data), done + len(data)
            last = left == 0
            digest = base64.b32encode(sha.digest()).decode()
            if last and kind == "revisit":  # no payload of its own: the declared values of the full one
                digest, done = declared, int(h["X-Payload-Length"])
            yield rid, as_id(rid), url, kind, refers, no, last, done, digest, declared, data
            no += 1
            if last:
                break
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError(f"record {rid} has no end mark")


def read_archives(manifest: DataFrame, directory: str, chunk_bytes: int = CHUNK_BYTES, n_tasks: int | None = None) -> DataFrame:
    """The chunked record table of all archives in the manifest, one archive per task at a time."""
    import pyspark.sql.types as T
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = T._parse_datatype_string(CHUNK_SCHEMA)
    schema = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in kinds])

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(directory)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as raw:
                    for row in read_records(raw, chunk_bytes):
                        rows.append(row)
                        held += len(row[-1])
                        if held >= 8 * chunk_bytes or len(rows) >= 2000:
                            yield flush(rows)
                            rows, held = [], 0
                if rows:
                    yield flush(rows)

    return manifest.select("path").repartition(n_tasks or manifest.sparkSession.sparkContext.defaultParallelism * 4).mapInArrow(run, CHUNK_SCHEMA)


def round_trip(spark: SparkSession, pages: DataFrame, chunk_bytes: int = CHUNK_BYTES, min_revisit_bytes: int = 0) -> DataFrame:
    """Writes all pages to archives and returns the chunked record table read back from them."""
    directory = new_path(spark, "warc")
    manifest = write_archives(with_revisits(pages, min_revisit_bytes), directory, chunk_bytes)
    return read_archives(manifest, directory, chunk_bytes)


def op1_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = round_trip(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))
    last = chunks.filter("is_last")
    checked = F.when(F.col("payload_digest") == F.col("declared_digest"), F.col("payload_digest"))
    return last.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")


ORACLE = {
    "op1_warc_chunks": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS winner FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
     1 + ((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)
     FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = winner THEN NULL ELSE winner END AS refers_to
FROM g"""
}
