"""WARC archives as a chunked record table.

Writing: each task streams its rows into gzip members, one for each record, of
files in the shared folder.  A file's segments are reported only when it is
closed, and only reported segments are read, so what a lost or repeated task
leaves behind is never seen.

Reading: a segment is decompressed piece by piece.  Each record gives rows
(record id, chunk number, offset, bytes) of at most ``chunk_bytes``; every row
carries the SHA-1 of the payload up to its end, the last one that of the whole.
The reader never holds more than one chunk of a record.  The writer gets whole rows
from Spark, in batches bounded in rows, and compresses each payload piece by piece.

Records with equal payloads of at least ``revisit_min_bytes`` are written once:
that with the largest page_id is the response, the others are revisits that
name it.  A revisit repeats the HTTP header, and with it the payload's length,
but not the payload.

The files are reached with ``pyarrow.fs`` (local or mounted folders, HDFS, S3,
GCS), which streams from the executors.

Edge cases: a null html is an empty payload; rows that share page_id and
payload are all responses; of a group in which some ids are null the largest
non-null id is the response, and if all are null, all are; blanks and control
characters in a url are percent-encoded, a null url is empty; extra columns are
ignored; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bytescan as bs
from quillspark.scratch import materialize, scratch_path

SEGMENTS = "path string, start long, length long, records long"
CHUNKS = "record_id string, page_id long, record_type string, refers_to long, declared_digest string, declared_bytes long, chunk_no int, offset long, data binary, digest_so_far string, last boolean"
_CHUNK_FIELDS = [
    ("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("declared_digest", pa.string()), ("declared_bytes", pa.int64()),
    ("chunk_no", pa.int32()), ("offset", pa.int64()), ("data", pa.binary()), ("digest_so_far", pa.string()), ("last", pa.bool_()),
]
_PIECE = 1 << 18
_BATCH_BYTES = 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def plan_records(pages: DataFrame, revisit_min_bytes: int = 0, most: int = 300_000) -> DataFrame:
    """page_id, url, html, digest (hex), keep_id: the response of equal payloads, null where the row has none other.

    Only digests and ids are grouped.  The digests that repeat are counted: up to
    ``most`` of them are broadcast, so that no payload is shuffled; more are joined,
    and Spark may split a hot digest, as the other side has one row for each.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    first = rows.groupBy(F.col("digest").alias("of")).agg(F.max("page_id").alias("keep_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = materialize(first.select("of", "keep_id"), "digests")
    first = F.broadcast(first) if first.count() <= most else first
    joined = rows.join(first, F.col("digest") == F.col("of"), "left").drop("of")
    other = (F.octet_length("html") >= revisit_min_bytes) & ~F.col("page_id").eqNullSafe(F.col("keep_id"))
    return joined.withColumn("keep_id", F.when(other, F.col("keep_id")))


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _clean(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url or "")


def _heads(page_id: int | None, url: str | None, digest: str, keep_id: int | None, size: int, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if keep_id is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {_clean(url)}"]
    lines += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if keep_id is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(keep_id)}"]
    body = len(http) + (size if keep_id is None else 0)
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {body}", "", ""]
    return ("\r\n".join(lines) + http).encode()


def _writer(root: str, date: str, file_bytes: int, segment_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        out, told = None, []
        path = size = start = count = 0

        def cut() -> None:
            nonlocal start, count
            if count:
                told.append((path, start, size - start, count))
            start, count = size, 0

        def report() -> pa.RecordBatch:
            rows = [pa.array(list(c), t) for c, t in zip(zip(*told), (pa.string(), pa.int64(), pa.int64(), pa.int64()))]
            told.clear()
            return pa.RecordBatch.from_arrays(rows, names=["path", "start", "length", "records"])

        for batch in batches:
            ids, urls, digests, keeps = (batch.column(i) for i in (0, 1, 3, 4))
            buf, offs = bs.text_buffers(batch.column(2))
            view = memoryview(buf)
            for i in range(batch.num_rows):
                if out is None:
                    store.create_dir(base, recursive=True)
                    path, size, start, count = f"{base}/warc-{uuid.uuid4().hex}.warc.gz", 0, 0, 0
                    out = store.open_output_stream(path, compression=None)
                payload = view[int(offs[i]) : int(offs[i + 1])]
                keep = keeps[i].as_py()
                pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                parts = [pack.compress(_heads(ids[i].as_py(), urls[i].as_py(), digests[i].as_py(), keep, len(payload), date))]
                for a in range(0, len(payload) if keep is None else 0, _PIECE):
                    parts.append(pack.compress(payload[a : a + _PIECE]))
                    size += sum(map(out.write, parts))
                    parts.clear()
                parts += [pack.compress(b"\r\n\r\n"), pack.flush()]
                size += sum(map(out.write, parts))
                count += 1
                if size - start >= segment_bytes:
                    cut()
                if size >= file_bytes:
                    cut()
                    out.close()
                    out = None
                    yield report()
        if out is not None:
            cut()
            out.close()
            yield report()

    return write


def write_archives(pages: DataFrame, root: str | None = None, revisit_min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", file_bytes: int = 512 << 20, segment_bytes: int = 4 << 20) -> DataFrame:
    """Write one record for each row and return the table of segments (path, start, length, records)."""
    spark = pages.sparkSession
    root = root or scratch_path(spark, "warc")
    records = plan_records(pages, revisit_min_bytes).select("page_id", "url", "html", "digest", "keep_id")
    return materialize(records.mapInArrow(_writer(root, date, file_bytes, segment_bytes), SEGMENTS), "segments")


class _Stream:
    """The decompressed members of one segment, read in small pieces."""

    def __init__(self, file, length: int) -> None:
        self.file, self.left, self.raw, self.data, self.unpack = file, length, b"", bytearray(), None

    def _more(self) -> bool:
        if not self.raw and self.left:
            self.raw = self.file.read(min(self.left, _PIECE))
            if not self.raw:
                raise EOFError("an archive ends before its segment")
            self.left -= len(self.raw)
        if not self.raw:
            return False
        if self.unpack is None:
            self.unpack = zlib.decompressobj(31)
        self.data += self.unpack.decompress(self.raw, _PIECE)
        self.raw = self.unpack.unconsumed_tail
        if self.unpack.eof:
            self.raw, self.unpack = self.unpack.unused_data, None
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Everything up to and without ``mark``; None at the end."""
        while (at := self.data.find(mark)) < 0:
            if not self._more():
                if self.data:
                    raise EOFError("an archive ends inside a header")
                return None
        head = bytes(self.data[:at])
        del self.data[: at + len(mark)]
        return head

    def take(self, n: int) -> bytes:
        while len(self.data) < n and self._more():
            pass
        if len(self.data) < n:
            raise EOFError("an archive ends inside a record")
        piece = bytes(self.data[:n])
        del self.data[:n]
        return piece


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def _b32(sha) -> str:
    return base64.b32encode(sha.digest()).decode()


def read_segment(store, path: str, start: int, length: int, chunk_bytes: int) -> Iterator[tuple]:
    """The chunk rows of one segment, in order."""
    with store.open_input_file(path) as file:
        file.seek(start)
        stream = _Stream(file, length)
        while (head := stream.until(b"\r\n\r\n")) is not None:
            warc = _fields(head)
            http = stream.until(b"\r\n\r\n") or b""
            left = int(warc["content-length"]) - len(http) - 4
            told = (warc["warc-record-id"], _page(warc["warc-record-id"]), warc["warc-type"], _page(warc.get("warc-refers-to")), warc["warc-payload-digest"].removeprefix("sha1:"), int(_fields(http)["content-length"]))
            sha, n, at = hashlib.sha1(), 0, 0
            while True:
                data = stream.take(min(left, chunk_bytes))
                left -= len(data)
                sha.update(data)
                yield (*told, n, at, data, _b32(sha), left == 0)
                n, at = n + 1, at + len(data)
                if left == 0:
                    break
            if stream.take(4) != b"\r\n\r\n":
                raise ValueError("a record does not end where its length says")


def _reader(root: str, chunk_bytes: int):
    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(zip(*rows), _CHUNK_FIELDS)], names=[n for n, _ in _CHUNK_FIELDS])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(root)
        rows, held = [], 0
        for batch in batches:
            for path, start, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for row in read_segment(store, path, start, length, chunk_bytes):
                    rows.append(row)
                    held += len(row[8]) + 200
                    if held >= _BATCH_BYTES:
                        yield pack(rows)
                        rows, held = [], 0
        if rows:
            yield pack(rows)

    return read


def read_archives(segments: DataFrame, root: str, chunk_bytes: int = 1 << 18, most_tasks: int = 20_000) -> DataFrame:
    """The chunk table of all records in ``segments``."""
    n = segments.count()
    spread = segments.select("path", "start", "length").repartition(max(1, min(n, most_tasks)))
    return spread.mapInArrow(_reader(root, chunk_bytes), CHUNKS)


def page_records(spark: SparkSession, pages: DataFrame, revisit_min_bytes: int = 0) -> DataFrame:
    """Write and read back ``pages``; one row for each record.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to,
    n_chunks, digest_ok (the digest of the bytes read is the one declared).
    """
    root = scratch_path(spark, "warc")
    chunks = read_archives(write_archives(pages, root, revisit_min_bytes), root)
    response = F.col("record_type") == "response"
    return chunks.where("last").select(
        "page_id",
        F.when(response, F.col("offset") + F.octet_length("data")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.when(response, F.col("digest_so_far")).otherwise(F.col("declared_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
        F.when(response, F.col("chunk_no") + 1).otherwise(0).cast("int").alias("n_chunks"),
        (~response | (F.col("digest_so_far") == F.col("declared_digest"))).alias("digest_ok"),
    )


_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_QUINT = "CAST('0x' || substr(h, 1 + 5 * i, 5) AS BIGINT)"
WARC_SQL = f"""
WITH rows AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
kept AS (SELECT h, max(page_id) AS keep_id FROM rows GROUP BY h),
told AS (
  SELECT page_id, payload_bytes, keep_id,
         list_aggregate(list_transform(range(8), lambda i: {" || ".join(f"substr('{_B32}', CAST(1 + (({_QUINT} >> {s}) & 31) AS INT), 1)" for s in (15, 10, 5, 0))}), 'string_agg', '') AS payload_digest
  FROM rows JOIN kept USING (h))
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM keep_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM keep_id THEN keep_id END AS refers_to,
       CAST(CASE WHEN page_id IS DISTINCT FROM keep_id THEN 0 ELSE greatest(1, ceil(payload_bytes / 262144)) END AS INT) AS n_chunks, TRUE AS digest_ok
FROM told
"""
