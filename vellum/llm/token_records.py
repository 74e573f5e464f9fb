"""Token ids as length-delimited binary records, with an offset index beside each file for shuffled reads.

Record: length (u64), masked checksum of the length (u32), payload, masked checksum of the payload (u32).  Payload: bytes
of an id (u8: 2 or 4), whether the document id is null (u8), document id (i64), ids.  All little-endian.  The checksum
is CRC-32, rotated right by 15 bits plus a constant, so that a record that holds checksums isn't mistaken for one.
Index: for each record offset (u64) and number of ids (u64).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blobs
from .bpe import word_end
from .common import bound_batches, column, fresh_path, materialise, texts

#: Rows of a file, about.
SHARD_ROWS = 4_096
# fixed value: added to a rotated checksum
MASK = 0xA282EAD8


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def pack(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return frame(struct.pack("<BBq", width, doc_id is None, doc_id or 0) + ids)


def read_record(file, offset: int | None = None) -> tuple[int | None, np.ndarray] | None:
    """The next record, or the one at an offset; None at the end.  A wrong checksum raises."""
    if offset is not None:
        file.seek(offset)
    head = file.read(12)
    if not head:
        return None
    n, crc = struct.unpack("<QI", head)
    if masked(head[:8]) != crc:
        raise ValueError("a record's length is damaged")
    body = file.read(n + 4)
    if len(body) != n + 4 or masked(body[:n]) != struct.unpack("<I", body[n:])[0]:
        raise ValueError("a record's payload is damaged")
    width, null, doc = struct.unpack("<BBq", body[:10])
    return None if null else doc, np.frombuffer(body[10:n], f"<u{width}")


def write_records(docs: DataFrame, path: str, end_id: int | None = 1, shard_rows: int = SHARD_ROWS, folder: str | None = None) -> DataFrame:
    """Encode every whole text, append the end id, write files in ascending doc_id order; returns the manifest.

    Manifest: shard (files in order), file, index, n_records, n_tokens.  Order: null ids first, repeated ids by text, null
    texts before empty ones; null and empty texts are records of the end id alone.  An empty table writes no file.
    Texts are dealt by range of doc_id before they are encoded; other columns are not read.
    """
    spark = docs.sparkSession
    bound_batches(spark, 500)
    folder = folder or fresh_path(spark, "token-records")
    docs = docs.select("doc_id", "text")
    shards = max(1, -(-docs.select("doc_id").count() // shard_rows))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, out, index, offset, tokens, n = word_end(path), None, [], 0, 0, 0
        width, shard = bpe.dtype.itemsize, TaskContext.get().partitionId()
        tail = b"" if end_id is None else np.array([end_id], bpe.dtype).tobytes()
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out, uri = blobs.create(folder, f"tokens-{shard:06d}.rec")
            buffer = []
            for doc, ids in zip(texts(batch, "doc_id"), bpe.encode_all([t or "" for t in texts(batch)]), strict=True):
                record = pack(doc, ids + tail, width)
                count = (len(ids) + len(tail)) // width
                index.append((offset, count))
                offset, tokens, n = offset + len(record), tokens + count, n + 1
                buffer.append(record)
            out.write(b"".join(buffer))
        if out is not None:
            out.close()
            side, index_uri = blobs.create(folder, f"tokens-{shard:06d}.idx")
            side.write(np.array(index, "<u8").tobytes())
            side.close()
            yield pa.record_batch([pa.array([shard]), pa.array([uri]), pa.array([index_uri]), pa.array([n]), pa.array([tokens])], ["shard", "file", "index", "n_records", "n_tokens"])

    dealt = docs.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    return materialise(dealt.mapInArrow(write, "shard long, file string, index string, n_records long, n_tokens long"), "token-manifest")


def read_records(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all records before), n_tokens and ids (binary, as stored) from the files."""
    first = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.withColumn("start", first)  # one row a file
    n = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(texts(batch, "file"), texts(batch, "start"), strict=True):
                rows, size = [], 0
                with blobs.stream(uri) as file:
                    while (got := read_record(file)) is not None:
                        doc, ids = got
                        rows.append((doc, start, len(ids), ids.tobytes(), ids.dtype.itemsize))
                        start, size = start + len(ids), size + ids.nbytes
                        if size > 4_000_000 or len(rows) >= 500:
                            yield _batch(rows)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows)

    def _batch(rows: list) -> pa.RecordBatch:
        return pa.record_batch(list(map(pa.array, zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32()))), ["doc_id", "start", "n_tokens", "ids", "width"])

    return files.select("shard", "file", "start").repartition(n, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary, width int")


def checksums(records: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [zlib.crc32(np.frombuffer(x, f"<u{w}").astype("<u4")) for x, w in zip(texts(batch, "ids"), texts(batch, "width"), strict=True)]
            yield pa.record_batch([*(column(batch, c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return records.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
