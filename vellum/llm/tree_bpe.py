"""BPE encoding by tree concatenation, and decoding.

A text that a pattern splits is encoded piece by piece.  A long stretch that nothing splits is halved down to leaves;
the leaves are encoded in parallel, and neighbours are joined: the tokens around the join are encoded again in a
growing window, until the window's first and last tokens are those that stood there before.  Then every two
neighbouring tokens of the result are neighbours in some true encoding, which makes the whole the true encoding.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ByteLevel, byte_level
from .common import arrow_map, bound_batches, column, texts

#: Texts of more characters are dealt out in parts, so that one long text doesn't hold up a task.
PART_CHARS = 32_768
#: Bytes of a leaf of an unsplit stretch, and tokens on either side of a join that the first window takes.
LEAF_BYTES, WINDOW = 64, 8
#: Texts without a run of so many characters of one class hold no unsplit stretch of more than a leaf: four bytes are the most of a character.
_BLANKS = re.compile(r"\s{16}")
_RUN = regex.compile(r"\p{L}{16,}|\p{N}{16,}|[^\s\p{L}\p{N}]{16,}|\s{16,}")


def join(left: list[int], right: list[int], size: Callable[[int], bytes], encode: Callable[[bytes], list[int]], window: int = WINDOW) -> list[int]:
    """The encoding of the concatenation of two encoded stretches."""
    if not left or not right:
        return left + right
    w = window
    while True:
        a, b = left[-w:], right[:w]
        whole_left, whole_right = w >= len(left), w >= len(right)
        mid = encode(b"".join(map(size, a + b)))
        if (whole_left or mid[0] == a[0]) and (whole_right or mid[-1] == b[-1]):
            return left[: -len(a)] + mid + right[len(b) :]
        w *= 2


def tree(parts: list[list[int]], size: Callable[[int], bytes], encode: Callable[[bytes], list[int]]) -> list[int]:
    """Join the leaves of one stretch, neighbours first."""
    while len(parts) > 1:
        parts = [join(parts[i], parts[i + 1], size, encode) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else []


def halves(raw: bytes, leaf: int = LEAF_BYTES) -> list[bytes]:
    if len(raw) <= leaf:
        return [raw]
    return halves(raw[: len(raw) // 2], leaf) + halves(raw[len(raw) // 2 :], leaf)


def _long_run(text: str, leaf: int) -> bool:
    """Could the text hold an unsplit stretch of more than ``leaf`` bytes?  A blank may lead one."""
    words = text.encode("utf-8", "surrogatepass").split()
    if leaf >= LEAF_BYTES and max(map(len, words), default=0) < leaf and not _BLANKS.search(text):
        return False
    return any(len(m[0].encode("utf-8", "surrogatepass")) >= leaf for m in _RUN.finditer(text)) if leaf >= LEAF_BYTES else True


def stretches(bpe: ByteLevel, text: str, part: int = PART_CHARS, leaf: int = LEAF_BYTES) -> Iterator[tuple[bool, bytes]]:
    """(unsplit, bytes) in order: long unsplit stretches, and runs of pieces of about ``part`` characters.

    A run ends only before a piece that follows a non-blank, where the pattern starts afresh whatever came before.
    """
    for some in bpe.added.split(text):
        if some in bpe.added.ids:
            yield False, some.encode()
            continue
        if len(some) <= part and not _long_run(some, leaf):
            yield False, some.encode("utf-8", "surrogatepass")
            continue
        begin, end = 0, 0
        for m in bpe.pieces.finditer(some):
            a, b = m.span()
            free = a > 0 and not some[a - 1].isspace()
            long = b - a >= leaf // 4 and len(raw := some[a:b].encode("utf-8", "surrogatepass")) > leaf and (free or a == 0)
            if a > begin and free and (long or b - begin > part):
                yield False, some[begin:a].encode("utf-8", "surrogatepass")
                begin = a
            if long and begin == a and (b == len(some) or not some[b - 1].isspace()):
                yield True, raw
                begin = b
            end = b
        if begin < end:
            yield False, some[begin:end].encode("utf-8", "surrogatepass")


def encode_text(bpe: ByteLevel, text: str) -> np.ndarray:
    """The same in one process."""
    out = []
    for unsplit, raw in stretches(bpe, text):
        if unsplit:
            out.append(np.array(tree([bpe.encode_piece(x) for x in halves(raw)], bpe.bytes_of.__getitem__, bpe.encode_piece), np.uint32))
        else:
            out.append(bpe.encode(raw.decode("utf-8", "surrogatepass")))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _finish(bpe: ByteLevel, keys: pa.Array, ids: list[np.ndarray], decoded: bool) -> pa.RecordBatch:
    cols, names = [keys, pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())], ["doc_id", "ids"]
    if decoded:
        cols.append(pa.array([bpe.decode(x) for x in ids], pa.string()))
        names.append("decoded")
    return pa.record_batch(cols, names)


def encode(docs: DataFrame, path: str, decoded: bool = False, part: int = PART_CHARS) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) of every whole text; with ``decoded`` their text too.

    Short texts are encoded where they are read, and their unsplit stretches through the tree there.  Long ones are cut into stretches, the stretches and the leaves of
    unsplit ones are dealt to all tasks, and one row a text gathers them again: what a task holds is one text's ids.
    Null and empty texts have no ids.  Null ids and repeated rows keep a row each; other columns are not read.
    """
    bound_batches(docs.sparkSession, 500)
    schema = "doc_id long, ids binary" + ", decoded string" * decoded
    docs = docs.select("doc_id", "text")
    is_long = F.coalesce(F.length("text"), F.lit(0)) > part

    def short():
        bpe = byte_level(path)
        return lambda batch: _finish(bpe, column(batch, "doc_id"), [encode_text(bpe, t or "") for t in texts(batch)], decoded)

    def cut():
        bpe = byte_level(path)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for key, doc, text in zip(texts(batch, "key"), texts(batch, "doc_id"), texts(batch), strict=True):
                seq = 0
                for group, (unsplit, raw) in enumerate(stretches(bpe, text, part // 2)):
                    for x in halves(raw) if unsplit else [raw]:
                        rows.append((key, doc, seq, group, unsplit, x))
                        seq += 1
            return pa.record_batch(list(map(pa.array, zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()))), ["key", "doc_id", "seq", "grp", "unsplit", "raw"])

        return f

    def leaf():
        bpe = byte_level(path)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [np.array(bpe.encode_piece(x), np.uint32) if u else bpe.encode(x.decode("utf-8", "surrogatepass")) for u, x in zip(texts(batch, "unsplit"), texts(batch, "raw"), strict=True)]
            packed = pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())
            return pa.record_batch([*(column(batch, c) for c in ("key", "doc_id", "seq", "grp", "unsplit")), packed], ["key", "doc_id", "seq", "grp", "unsplit", "ids"])

        return f

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, key, doc, rows = byte_level(path), None, None, []

        def done() -> pa.RecordBatch:
            out, at = [], 0
            while at < len(rows):
                to = at
                while to < len(rows) and rows[to][0] == rows[at][0]:
                    to += 1
                if rows[at][1]:
                    leaves = [np.frombuffer(x, "<u4").tolist() for *_, x in rows[at:to]]
                    out.append(np.array(tree(leaves, bpe.bytes_of.__getitem__, bpe.encode_piece), np.uint32))
                else:
                    out += [np.frombuffer(x, "<u4") for *_, x in rows[at:to]]
                at = to
            return _finish(bpe, pa.array([doc], pa.int64()), [np.concatenate(out)], decoded)

        for batch in batches:
            for k, d, g, u, x in zip(*(texts(batch, c) for c in ("key", "doc_id", "grp", "unsplit", "ids")), strict=True):
                if rows and k != key:
                    yield done()
                    rows = []
                key, doc = k, d
                rows.append((g, u, x))
        if rows:
            yield done()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stretch = "key long, doc_id long, seq int, grp int, unsplit boolean, "
    parts = arrow_map(docs.where(is_long).withColumn("key", F.monotonically_increasing_id()), cut, stretch + "raw binary")
    coded = arrow_map(parts.repartition(n, "key", "seq"), leaf, stretch + "ids binary")
    long = coded.repartition(n, "key").sortWithinPartitions("key", "seq").mapInArrow(gather, schema)
    return arrow_map(docs.where(~is_long), short, schema).unionByName(long)


def decode(coded: DataFrame, path: str) -> DataFrame:
    """doc_id and decoded text of rows of ids; null ids decode to the empty text."""

    def make():
        bpe = byte_level(path)
        return lambda batch: pa.record_batch([column(batch, "doc_id"), pa.array([bpe.decode(np.frombuffer(x or b"", "<u4")) for x in texts(batch, "ids")], pa.string())], ["doc_id", "decoded"])

    return arrow_map(coded.select("doc_id", "ids"), make, "doc_id long, decoded string")
