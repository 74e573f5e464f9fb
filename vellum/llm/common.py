"""Shared plumbing: the shared work folder, materialised tables, Arrow batch helpers."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes in one Arrow batch handed to Python; long texts make larger batches needless and risky.
ARROW_ROWS, ARROW_BYTES = 1000, 16_000_000
#: Bytes that separate words, as in the pattern [^\x20\x09-\x0D]+; bytes.split() splits on exactly these.
SPACES = " \t\n\x0b\x0c\r"
#: The same words as a Java regular expression.
WORD = r"[^\x20\x09-\x0D]+"


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"file://{tempfile.mkdtemp(prefix='vellum-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/") if "://" in base or base.startswith("file:") else f"file://{base.rstrip('/')}"


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{work_dir(spark)}/vellum/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends here and a lost executor costs only its running tasks."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*frames: DataFrame) -> None:
    """Delete the files of materialised tables that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for d in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/vellum/" in d:
                path = spark._jvm.org.apache.hadoop.fs.Path(d)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bound_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Hold Arrow batches to so many rows and ARROW_BYTES, so that a batch of long texts fits a worker's memory."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        if not 0 < int(re.match(r"-?\d+", spark.conf.get(key))[0]) <= most:
            spark.conf.set(key, str(most))


def trim() -> None:
    """Give back what a task's batches left, as workers live on to run other tasks."""
    gc.collect()
    if not gc.get_freeze_count():
        gc.freeze()  # modules stay; searching them again would take some 50 ms of each task
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """Map Arrow batches; ``make`` runs once in each task and returns the function that maps one batch."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for batch in batches:
            if batch.num_rows:
                f = f or make()
                if (out := f(batch)) is not None and out.num_rows:
                    yield out
        f = batch = out = None
        trim()

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
