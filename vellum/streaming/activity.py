"""Structured Streaming twins of the event analytics."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.schemas import EVENT


def read(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Events as they arrive; malformed lines are skipped."""
    reader = spark.readStream.schema(EVENT)
    return reader.option("mode", "DROPMALFORMED").json(path) if fmt == "json" else reader.format(fmt).load(path)


def cadence(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Current ingests of each project and week; a week is final once the watermark has passed it."""
    flat = events.withWatermark("ts", late).withColumn("project", F.explode("projects"))
    return flat.where("ingest_kind = 'current'").groupBy(F.window("ts", "7 days"), "project").agg(F.count("*").alias("n")).select("project", F.col("window.start").alias("week"), "n")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """Bursts of events of a page."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "page").agg(F.count("*").alias("n")).select("page", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def fresh_requests(requests: DataFrame, late: str = "1 day") -> DataFrame:
    """Each requested name once within the watermark."""
    return requests.withWatermark("ts", late).dropDuplicatesWithinWatermark(["name"])


def upsert_batches(stream: DataFrame, folder: str, key: str, checkpoint: str):
    """Keep the last row of each key: every micro-batch writes a new version, readers take the newest whole one."""
    spark = stream.sparkSession

    def write(batch: DataFrame, epoch: int) -> None:
        from vellum.operators.tables import merge

        new = batch.dropDuplicates([key])
        if epoch:
            new = merge(spark.read.parquet(f"{folder}/v={epoch - 1}"), new, key)
        new.write.mode("overwrite").parquet(f"{folder}/v={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run over all that is there and return the result: files in the shared folder, which the driver doesn't hold.

    Appended rows are written as they come; of other modes the last batch with rows counts, as in a table that is written anew.
    """
    spark = stream.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='vellum-')}"
    folder = f"{base.rstrip('/')}/vellum/{name}-{uuid.uuid4().hex}"
    if mode == "append":
        out = stream.writeStream.format("parquet").option("path", f"{folder}/rows")
    else:
        out = stream.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/rows"))
    out.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
