"""WARC: archives in the shared folder, read back as a chunked record table.

Writing streams a payload's bytes into a gzip member a record, chunk by chunk, from the column's buffer; of equal payloads
of at least `least` bytes the record with the smallest id is the response, the others are revisits that refer to it.
Each task writes files of its own under a name that no other attempt has and returns their paths; the table of paths is
written once, so files of lost or repeated attempts are never read.

Reading inflates an archive as a stream and returns a row per chunk of a payload: (record id, chunk number), the chunk's
bytes if asked for, and the length and SHA-256 of the payload so far - never a whole record. The last chunk's digest is
the payload's.

The folder may be a path or URI that pyarrow.fs opens (file, hdfs, s3, gs).

Cases: a null payload is empty (one chunk of no bytes); a null url is left out of the record; a record of a null id is a
response; rows that share an id and payload are all the response or all revisits; line ends in a url are percent-encoded.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import _blocks as B
from gleaner.llm._shared import scratch_root, shuffle_partitions, written

CHUNK = 1 << 20
ARCHIVE_BYTES = 256 << 20
_END = b"\r\n\r\n"


def _urn(page: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'page:{page}'.encode()).hexdigest())}>"


def _head(page: str, url: str | None, size: int, digest: str, refers: str | None) -> bytes:
    """The headers of a record, with those of the HTTP response that its block begins with."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {_urn(page)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers is not None:
        lines += [f"WARC-Refers-To: {_urn(refers)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers}"]
    lines += [f"X-Page-ID: {page}", f"X-Payload-Length: {size}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    lines.append(f"Content-Length: {len(http) + (size if refers is None else 0)}")
    return "\r\n".join([*lines, "", http]).encode()


#: Schemes of Hadoop whose stores go by another name in Arrow.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def shared_uri(spark: SparkSession, folder: str) -> str:
    """A folder as Hadoop resolves it - a path without a scheme lies in the default file system, on every executor - as a URI
    that Arrow opens. A store that Arrow can't open is refused here, before a task runs."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if path.toUri().getScheme() is None:
        path = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path)
    scheme, rest = str(path.toUri()).split(":", 1)
    uri = f"{_SCHEMES.get(scheme, scheme)}:{rest if rest.startswith('//') else '//' + rest}"
    try:
        fs.FileSystem.from_uri(uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as e:
        raise ValueError(f"archives can't be kept in {folder}: {e}") from e
    return uri


def _writer(folder: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, path, records = None, "", 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64())], names=["path", "records"])

        for rb in batches:
            data, offsets = B.utf8(rb.column("html"))
            view = memoryview(np.ascontiguousarray(data))
            for i, (page, url, digest, refers) in enumerate(zip(*(rb.column(c).to_pylist() for c in ("page_id", "url", "digest", "refers_to")), strict=True)):
                if out is None:
                    path, records = f"{root.rstrip('/')}/{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(path, compression=None)
                a, b = int(offsets[i]), int(offsets[i + 1])
                with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=1, mtime=0) as z:
                    z.write(_head("" if page is None else str(page), url, b - a, digest, None if refers is None else str(refers)))
                    if refers is None:
                        for k in range(a, b, CHUNK):
                            z.write(view[k : min(k + CHUNK, b)])
                    z.write(_END)
                records += 1
                if out.tell() >= most:
                    out.close()
                    yield row()
                    out = None
        if out is not None:
            out.close()
            yield row()

    return run


class _Bytes:
    """A stream of the bytes of gzip members, one after another."""

    def __init__(self, source):
        self.source, self.z, self.raw, self.held = source, zlib.decompressobj(31), b"", b""

    def _more(self) -> bool:
        while True:
            if self.z.eof:
                self.raw, self.z = self.z.unused_data, zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.source.read(1 << 18)
                if not self.raw:
                    return False
            new = self.z.decompress(self.raw, 1 << 18)
            self.raw = self.z.unconsumed_tail
            if self.z.eof:
                self.raw = b""  # what follows is in unused_data
            if new:
                self.held += new
                return True

    def until(self, end: bytes) -> bytes | None:
        """Up to and without end; None at the end of the file."""
        while (at := self.held.find(end)) < 0:
            if not self._more():
                if self.held.strip(b"\r\n"):
                    raise ValueError("the archive ends within a record")
                return None
        out, self.held = self.held[:at], self.held[at + len(end) :]
        return out

    def parts(self, n: int, most: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self._more():
                raise ValueError("the archive ends within a payload")
            k = min(n, most, len(self.held))
            yield self.held[:k]
            self.held, n = self.held[k:], n - k


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a record: {lines[0][:40]!r}")
    return dict(x.split(": ", 1) for x in lines[1:])


_COLUMNS = {"page_id": pa.int64(), "record_type": pa.string(), "refers_to": pa.int64(), "header_digest": pa.string(), "payload_length": pa.int64(), "chunk_no": pa.int64(), "last": pa.bool_(), "n_so_far": pa.int64(), "digest_so_far": pa.string(), "chunk": pa.binary()}
CHUNKS = "page_id long, record_type string, refers_to long, header_digest string, payload_length long, chunk_no long, last boolean, n_so_far long, digest_so_far string, chunk binary"


def _reader(folder: str, payload: bool, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = fs.FileSystem.from_uri(folder)[0]
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _COLUMNS.values(), strict=True)], names=list(_COLUMNS))

        for rb in batches:
            for path in rb.column("path").to_pylist():
                with store.open_input_stream(path, compression=None) as source:
                    s = _Bytes(source)
                    while (head := s.until(_END)) is not None:
                        f = _fields(head.lstrip(b"\r\n"))
                        n = int(f["Content-Length"]) - len(s.until(_END)) - len(_END)
                        page, refers = f["X-Page-ID"], f.get("X-Refers-To-Page-ID")
                        common = (int(page) if page else None, f["WARC-Type"], int(refers) if refers else None, f["WARC-Payload-Digest"].removeprefix("sha256:"), int(f["X-Payload-Length"]))
                        sha, done, number, now = hashlib.sha256(), 0, 0, io.BytesIO()
                        for part in s.parts(n, size):
                            if now.tell() + len(part) > size:  # part is at most a chunk
                                rows.append((*common, number, False, done, sha.hexdigest(), now.getvalue() if payload else None))
                                number, now = number + 1, io.BytesIO()
                                held += size
                            sha.update(part)
                            done += len(part)
                            now.write(part)
                        rows.append((*common, number, True, done, sha.hexdigest(), now.getvalue() if payload else None))
                        held += now.tell() * payload + 300
                        if held >= 8 << 20:
                            yield batch()
                            rows, held = [], 0
                        if s.until(_END) is None:
                            raise ValueError("a record has no end")
        if rows:
            yield batch()

    return run


def write_archives(pages: DataFrame, least: int = 100, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", most: int = ARCHIVE_BYTES) -> tuple[DataFrame, str]:
    """Writes a record for every row; returns the table (path, records) of the archives, and their folder."""
    spark = pages.sparkSession
    folder = shared_uri(spark, folder or f"{scratch_root(spark)}/warc-{uuid.uuid4().hex}")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    large = rows.where(F.octet_length("html") >= least).select("page_id", "digest")
    first = large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = large.join(first, "digest").where("page_id <> refers_to").distinct()
    rows = rows.join(revisits.hint("merge"), ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")
    return written(rows.mapInArrow(_writer(folder, most), "path string, records long"), "archives"), folder


def read_archives(archives: DataFrame, folder: str, payload: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of archives (path). Their paths are dealt over a given number of tasks, which adaptive
    execution leaves apart: by the bytes of the paths it would read all archives in one."""
    n, folder = shuffle_partitions(archives.sparkSession), shared_uri(archives.sparkSession, folder)
    return archives.select("path").repartition(n, "path").mapInArrow(_reader(folder, payload, chunk), CHUNKS)


def record_digests(chunks: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record, from its last chunk."""
    response = F.col("record_type") == "response"
    return chunks.where("last").select("page_id", F.when(response, F.col("n_so_far")).otherwise(F.col("payload_length")).alias("payload_bytes"), F.when(response, F.col("digest_so_far")).otherwise(F.col("header_digest")).alias("payload_digest"), "record_type", "refers_to")
