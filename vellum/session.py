"""Session defaults."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "vellum", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE, skew handling, UTC and last-wins map keys; ``conf`` overrides (underscores for dots)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC", "spark.sql.mapKeyDedupPolicy": "LAST_WIN", "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (defaults | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in spark.checkpoint.dir, the folder that driver and executors share: what it came of isn't computed again."""
    base = df.sparkSession.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='vellum-')}"
    path = f"{base.rstrip('/')}/vellum/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
