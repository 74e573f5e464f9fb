"""Compression classifier: dictionaries of good and bad text, and the normalised difference of compressed sizes.

A text is cut into blocks, and each block is compressed with either dictionary.  The bytes that the good dictionary
saves over the bad one, per byte of text, order the texts; isotonic regression on labelled rows that no dictionary has
seen turns the difference into a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, column, texts
from .gbt_rules import sample_labels

#: Bounds of the fitted sample: labelled rows, rows of each class for its dictionary, and blocks of each of these.
LABELLED_ROWS, CLASS_ROWS, PARTS = 30_000, 3_000, 6
BLOCK, DICT_BYTES, LEVEL = 2048, 112_640, 3


def blocks(raw: bytes, size: int = BLOCK) -> list[bytes]:
    return [raw[i : i + size] for i in range(0, len(raw), size)]


class Sizer:
    """Compressors are made once a task; the dictionaries are digested once."""

    def __init__(self, good: bytes, bad: bytes):
        self.of = []
        for raw in (good, bad):
            d = zstandard.ZstdCompressionDict(raw) if raw else None
            if d:
                d.precompute_compress(level=LEVEL)
            self.of.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False))

    def difference(self, text: str | None) -> float:
        """(size by the bad dictionary - size by the good one) / bytes; 0 for null and empty texts."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        good = bad = 0
        for part in blocks(raw):
            good += len(self.of[0].compress(part))
            bad += len(self.of[1].compress(part))
        return (bad - good) / max(len(raw), 1)


@dataclass
class Model:
    good: bytes
    bad: bytes
    knots: np.ndarray
    values: np.ndarray

    def calibrated(self, d: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(d, self.knots, self.values), 0.0, 1.0)


def isotonic(x: np.ndarray, y: np.ndarray, groups: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing fit of y on x by pooling neighbours, from at most ``groups`` equal groups; knots and their values."""
    if not len(x):
        return np.array([0.0]), np.array([0.5])
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for part in np.array_split(order, min(groups, len(order))):
        pools.append([float(x[part].mean()), float(y[part].sum()), float(len(part))])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            b, a = pools.pop(), pools.pop()
            pools.append([(a[0] * a[2] + b[0] * b[2]) / (a[2] + b[2]), a[1] + b[1], a[2] + b[2]])
    return np.array([p[0] for p in pools]), np.array([(p[1] + 0.1) / (p[2] + 0.2) for p in pools])


def spread(text: str) -> list[bytes]:
    """Blocks of the text, evenly spread over the whole of it if there are more than PARTS."""
    found = blocks(text.encode("utf-8", "surrogatepass"))
    return [found[i * len(found) // PARTS] for i in range(PARTS)] if len(found) > PARTS else found


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; of too little text to train on, the text itself."""
    parts = [b for b in samples if len(b) >= 8]
    if not parts:
        return b""
    try:
        return zstandard.train_dictionary(DICT_BYTES, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[:DICT_BYTES]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Dictionaries from one part of the bounded sample, calibration from the other.  ``labels`` must hold training rows only."""
    chosen = sample_labels(labels, label, LABELLED_ROWS)
    part = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").withColumn("_fit", F.pmod(F.xxhash64("doc_id", F.lit("dictionary")), F.lit(10)) < 5)
    def cut():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.record_batch([column(batch, "doc_id"), column(batch, "_label"), pa.array([spread(t) for t in texts(batch)], pa.list_(pa.binary()))], ["doc_id", "y", "parts"])

        return f

    parts = arrow_map(part.where("_fit").select("doc_id", "text", "_label"), cut, "doc_id long, y int, parts array<binary>")
    samples: dict[int, list[bytes]] = {}
    for y in (1, 0):  # what the driver holds is bounded in rows, and in bytes of each
        rows = parts.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(CLASS_ROWS).collect()
        samples[y] = [bytes(b) for r in rows for b in r["parts"]]
    good, bad = dictionary(samples[1]), dictionary(samples[0])

    def make():
        sizer = Sizer(good, bad)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.record_batch([column(batch, "doc_id"), column(batch, "_label"), pa.array([sizer.difference(t) for t in texts(batch)], pa.float64())], ["doc_id", "y", "d"])

        return f

    got = arrow_map(part.where("not _fit").select("doc_id", "text", "_label"), make, "doc_id long, y int, d double").toPandas().sort_values(["d", "doc_id"], kind="stable")
    knots, values = isotonic(got["d"].to_numpy(float), got["y"].to_numpy(float))
    return Model(good, bad, knots, values)


def compression_score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, difference, score and predicted for every whole text.

    Null and empty texts have difference 0 and are scored like any text of that difference.  Null ids, repeated rows
    and ties keep a row each; other columns are not read.
    """

    def make():
        sizer = Sizer(model.good, model.bad)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            d = np.array([sizer.difference(t) for t in texts(batch)], float)
            score = model.calibrated(d)
            return pa.record_batch([column(batch, "doc_id"), pa.array(d), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "difference", "score", "predicted"])

        return f

    return arrow_map(docs.select("doc_id", "text"), make, "doc_id long, difference double, score double, predicted int")
