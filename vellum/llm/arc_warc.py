"""Legacy archives: write ARC files, read them by version, convert them to WARC, read WARC files.

An ARC file opens with a version block that names the fields of the header lines after it: five in version 1, ten in
version 2.  Each header line declares the length of the content that follows.  The converter synthesises what a WARC
record needs besides: an identifier by name (the same for the same capture), the date in ISO form, the type from the
content, and SHA-1 digests of block and payload.  Records with equal payloads refer to one of them.

Payloads never go through a shuffle: a first reading takes digests, a second one writes, file by file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs
from .common import bound_batches, fresh_path, materialise, texts

# fixed values: the header fields of the two versions, and the WARC profile of a revisit
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Uncompressed bytes after which a writer begins another file, and shares that a hot digest is split into.
FILE_BYTES, SALTS = 128_000_000, 16
MANIFEST = "file string, n_records long"
_MANIFEST_NAMES = ["file", "n_records"]


def gz(data: bytes) -> bytes:
    """One gzip member: archives hold one for each record."""
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def opened(uri: str) -> io.BufferedReader:
    file = blobs.stream(uri)
    return io.BufferedReader(gzip.GzipFile(fileobj=file), 1 << 20) if uri.rpartition("/")[2].startswith("gz-") else io.BufferedReader(file, 1 << 20)


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ---------------------------------------------------------------- ARC


def arc_head(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 vellum\n{FIELDS[version]}\n\n".encode()
    return f"filedesc://{name} 0.0.0.0 {date} text/plain ".encode() + (b"200 - - 0 " + name.encode() + b" " if version == 2 else b"") + f"{len(body)}\n".encode() + body


def arc_record(version: int, url: str, date: str, mime: str, content: bytes, status: int = 200, offset: int = 0, name: str = "-", ip: str = "0.0.0.0") -> bytes:
    """Blanks and controls in an address are percent-encoded, as the header line is split at blanks."""
    url = re.sub(r"[\x00-\x20\x7f-\xa0]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "-")
    middle = [url, ip, date, mime]
    if version == 2:
        middle += [str(status), sha1(content), "-", str(offset), name]
    return " ".join([*middle, str(len(content))]).encode("utf-8", "surrogatepass") + b"\n" + content + b"\n"


@dataclass
class Capture:
    """A record of an ARC file: header fields by name, and content of the declared length."""

    seq: int
    fields: dict[str, str]
    content: bytes

    @property
    def uri(self) -> str:
        return self.fields["URL"]

    @property
    def date(self) -> str:
        """ISO form of a date of up to 14 digits; what is missing is the earliest."""
        d = re.sub(r"\D", "", self.fields.get("Archive-date", ""))[:14]
        d = d + "00010101000000"[len(d) :]
        return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"

    @property
    def split(self) -> tuple[bytes, bytes]:
        """HTTP head and payload; content that isn't HTTP is all payload."""
        if self.content.startswith(b"HTTP/"):
            head, mark, body = self.content.partition(b"\r\n\r\n")
            return head + mark, body
        return b"", self.content

    @property
    def row_id(self) -> int | None:
        m = re.search(rb"\r\nX-Row-Id: (-?\d+)\r\n", self.split[0])
        return int(m[1]) if m else None


def read_arc(file: io.BufferedReader) -> Iterator[Capture]:
    """Captures in order.  Lines are split from the right, so an address may hold blanks; damage raises."""
    names, seq = None, 0
    while line := file.readline():
        line = line.rstrip(b"\r\n")
        if not line:
            continue
        count = len(names) if names else (10 if len(line.split(b" ")) >= 10 else 5)
        parts = line.rsplit(b" ", count - 1)
        if len(parts) != count or not parts[-1].isdigit():
            raise ValueError(f"not a header line: {line[:80]!r}")
        length = int(parts[-1])
        content = file.read(length)
        if len(content) != length:
            raise ValueError(f"{length} bytes declared, {len(content)} found")
        if names is None:
            if not line.startswith(b"filedesc:"):
                raise ValueError("the version block is missing")
            version, _, rest = content.partition(b"\n")
            names = rest.split(b"\n")[0].decode().split(" ")
            if names != FIELDS.get(int(version.split(b" ")[0]), "").split(" "):
                raise ValueError(f"unknown version: {version!r}")
            continue
        yield Capture(seq, dict(zip(names, (p.decode("utf-8", "replace") for p in parts), strict=True)), content)
        seq += 1


def write_arc(pages: DataFrame, folder: str | None = None, date: str = "20240101000000", file_bytes: int = FILE_BYTES) -> DataFrame:
    """ARC files of ``pages`` (page_id, url, html), versions 1 and 2 by turns; returns the manifest.

    Null html is an empty payload, null url the address "-", null page_id a record without a row number.
    """
    spark = pages.sparkSession
    bound_batches(spark, 500)
    folder = folder or fresh_path(spark, "arc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, turn = TaskContext.get().partitionId(), 0
        out, uri, n, offset = None, "", 0, 0
        for batch in batches:
            for key, url, html in zip(texts(batch, "page_id"), texts(batch, "url"), texts(batch, "html"), strict=True):
                version = 1 + (part + turn) % 2
                if out is None:
                    name = f"gz-{part:06d}-{turn:04d}.arc"
                    out, uri = blobs.create(folder, name)
                    out.write(gz(arc_head(version, name, date)))
                body = (html or "").encode("utf-8", "surrogatepass")
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n" + (f"X-Row-Id: {key}\r\n" if key is not None else "") + "\r\n"
                data = arc_record(version, url, date, "text/html", head.encode() + body, offset=offset, name=name)
                out.write(gz(data))
                n, offset = n + 1, offset + len(data)
                if offset >= file_bytes:
                    out.close()
                    yield pa.record_batch([pa.array([uri]), pa.array([n])], _MANIFEST_NAMES)
                    out, n, offset, turn = None, 0, 0, turn + 1
        if out is not None:
            out.close()
            yield pa.record_batch([pa.array([uri]), pa.array([n])], _MANIFEST_NAMES)

    return materialise(pages.select("page_id", "url", "html").mapInArrow(write, MANIFEST), "arc-manifest")


def by_file(manifest: DataFrame, read, schema: str) -> DataFrame:
    """Run over the files of a manifest, a few to a task; rows come in batches of bounded size."""
    fields = [f.name for f in manifest.sparkSession.createDataFrame([], schema).schema]
    types = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in texts(batch, "file"):
                rows = []
                for row in read(uri):
                    rows.append(row)
                    if len(rows) >= 2000:
                        yield pa.record_batch(list(map(pa.array, zip(*rows, strict=True), types)), fields)
                        rows = []
                if rows:
                    yield pa.record_batch(list(map(pa.array, zip(*rows, strict=True), types)), fields)

    return manifest.select("file").repartition(max(1, manifest.count()), "file").mapInArrow(run, schema)


def _arrow(schema: str) -> list[pa.DataType]:
    of = {"string": pa.string(), "long": pa.int64()}
    return [of[x.split()[1]] for x in schema.split(",")]


def scan_arc(manifest: DataFrame) -> DataFrame:
    """file, seq, row_id, uri, date, digest and bytes of the payload of each capture."""

    def read(uri: str):
        with opened(uri) as file:
            for c in read_arc(file):
                payload = c.split[1]
                yield uri, c.seq, c.row_id, c.uri, c.date, sha1(payload), len(payload)

    return by_file(manifest, read, "file string, seq long, row_id long, uri string, date string, digest string, bytes long")


# ---------------------------------------------------------------- WARC


def record_id(uri: str, date: str, digest: str, row_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{uri} {date} {digest} {row_id}')}>"


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.0\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def to_warc(c: Capture, refers_to: tuple[int | None, str, str] | None) -> bytes:
    """The equivalent record; with ``refers_to`` (row_id, uri, date) a revisit, which keeps the HTTP head only."""
    head, payload = c.split
    digest = sha1(payload)
    http = bool(head)
    kind = "revisit" if refers_to else "response" if http else "resource"
    block = head if refers_to else c.content
    headers = [
        ("WARC-Type", kind), ("WARC-Record-ID", record_id(c.uri, c.date, digest, c.row_id)), ("WARC-Date", c.date), ("WARC-Target-URI", c.uri),
        ("WARC-IP-Address", c.fields.get("IP-address", "0.0.0.0")), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{sha1(block)}"),
        ("Content-Type", "application/http; msgtype=response" if http else c.fields.get("Content-type") or "application/octet-stream"), ("X-Payload-Length", str(len(payload))),
    ]
    if c.row_id is not None:
        headers.append(("X-Row-Id", str(c.row_id)))
    if refers_to:
        row, uri, date = refers_to
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(uri, date, digest, row)), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date)]
        if row is not None:
            headers.append(("X-Refers-To-Row-Id", str(row)))
    return warc_record(headers, block)


def read_warc(file: io.BufferedReader) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) in order; damage raises."""
    while line := file.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:80]!r}")
        headers = {}
        while (line := file.readline().rstrip(b"\r\n")):
            k, _, v = line.partition(b":")
            headers[k.decode().lower()] = v.strip().decode("utf-8", "replace")
        n = int(headers["content-length"])
        block = file.read(n)
        if len(block) != n:
            raise ValueError(f"{n} bytes declared, {len(block)} found")
        yield headers, block


def revisits(captures: DataFrame, min_bytes: int = 0) -> DataFrame:
    """file, seq and ``ref`` (row_id, uri, date) of the captures that refer to another of equal payload.

    The one with the largest row number is referred to (captures that share this number all stay responses).  Captures
    without a number are only referred to if the group has no number; then the last by address, date, file and place.
    Groups are found by digest with partial aggregation, and a group's rows meet its one result in SALTS shares.
    """
    top = F.max(F.struct("row_id", "uri", "date", "file", "seq")).alias("top")
    groups = captures.where(F.col("bytes") >= min_bytes).groupBy("digest", "bytes").agg(top, F.count("*").alias("n")).where("n > 1")
    groups = groups.select("digest", "bytes", "top", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = captures.withColumn("salt", F.pmod(F.xxhash64("file", "seq"), F.lit(SALTS)).cast("int"))
    joined = salted.join(groups, ["digest", "bytes", "salt"])
    same = F.when(F.col("row_id").isNotNull(), F.col("row_id") == F.col("top.row_id")).otherwise((F.col("file") == F.col("top.file")) & (F.col("seq") == F.col("top.seq")))
    return joined.where(~F.coalesce(same, F.lit(False))).select("file", "seq", F.struct("top.row_id", "top.uri", "top.date").alias("ref"))


def convert(manifest: DataFrame, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """WARC files equivalent to the ARC files of a manifest, one for each; returns their manifest."""
    spark = manifest.sparkSession
    folder = folder or fresh_path(spark, "warc")
    marks = revisits(scan_arc(manifest), min_bytes).select("file", "seq", F.col("ref.row_id"), F.col("ref.uri"), F.col("ref.date"))
    files = manifest.select("file", F.lit(-1).cast("long").alias("seq"), F.lit(None).cast("long").alias("row_id"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("string").alias("date"))
    n = max(1, manifest.count())

    def one(uri: str, refs: dict[int, tuple]) -> pa.RecordBatch:
        name = uri.rpartition("/")[2].partition(".arc")[0] + ".warc"
        out, to = blobs.create(folder, name)
        count = 0
        with opened(uri) as file:
            info = f"software: vellum\r\nformat: WARC File Format 1.0\r\nconverted-from: {uri.rpartition('/')[2]}\r\n".encode()
            out.write(gz(warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name, "", "", None)), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], info)))
            for c in read_arc(file):
                out.write(gz(to_warc(c, refs.get(c.seq))))
                count += 1
        out.close()
        return pa.record_batch([pa.array([to]), pa.array([count])], _MANIFEST_NAMES)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, refs = None, {}
        for batch in batches:
            for uri, seq, row, target, date in zip(*(texts(batch, c) for c in ("file", "seq", "row_id", "uri", "date")), strict=True):
                if seq < 0:
                    if current is not None:
                        yield one(current, refs)
                    current, refs = uri, {}
                else:
                    refs[seq] = (row, target, date)
        if current is not None:
            yield one(current, refs)

    dealt = files.unionByName(marks).repartition(n, "file").sortWithinPartitions("file", "seq")
    return materialise(dealt.mapInArrow(write, MANIFEST), "warc-manifest")


def scan_warc(manifest: DataFrame) -> DataFrame:
    """row_id, bytes, digest, type, refers_to, uri and record id of the records, checked against their headers.

    A revisit's payload figures come from its headers, others are taken from the payload itself.
    """

    def number(headers: dict[str, str], key: str) -> int | None:
        return int(headers[key]) if key in headers else None

    def read(uri: str):
        with opened(uri) as file:
            for h, block in read_warc(file):
                if h["warc-type"] == "warcinfo":
                    continue
                digest, n = h["warc-payload-digest"].removeprefix("sha1:"), int(h["x-payload-length"])
                if h["warc-type"] != "revisit":
                    payload = block.partition(b"\r\n\r\n")[2] if h["content-type"].startswith("application/http") else block
                    if (sha1(payload), len(payload)) != (digest, n):
                        raise ValueError(f"{uri}: payload of {h['warc-record-id']} is damaged")
                yield number(h, "x-row-id"), n, digest, h["warc-type"], number(h, "x-refers-to-row-id"), h["warc-target-uri"], h["warc-record-id"]

    return by_file(manifest, read, "row_id long, bytes long, digest string, type string, refers_to long, uri string, record_id string")
