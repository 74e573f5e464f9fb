"""Writers: changed pages, versioned tables, events, bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed(pages: DataFrame, rewritten: DataFrame) -> DataFrame:
    """path and new text of the pages whose text differs."""
    return pages.select("path", F.col("text").alias("_old")).join(rewritten.select("path", "text"), "path").where("not (_old <=> text)").select("path", "text")


def replace_tables(rows: DataFrame, folder: str) -> None:
    """Write extracted rows by table; only the tables at hand are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("table_stem").parquet(folder)


def append_events(events: DataFrame, folder: str) -> None:
    events.write.mode("append").json(folder)


def backup(rows: DataFrame, folder: str, backup_id: str, at: str) -> None:
    rows.withColumn("backup_id", F.lit(backup_id)).withColumn("backup_at", F.lit(at)).write.mode("append").partitionBy("backup_id").parquet(folder)


def restore(folder_df: DataFrame, backup_id: str) -> DataFrame:
    return folder_df.where(F.col("backup_id") == backup_id).drop("backup_id", "backup_at")


def graph(frames: dict[str, DataFrame], folder: str) -> None:
    """Vertices and edges, a Parquet table of each label."""
    for label, df in frames.items():
        df.write.mode("overwrite").parquet(f"{folder}/label={label}")


def bundle(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON line a node with its outgoing edges: a document that grows is never one cell."""
    out = edges.groupBy(F.col("src").alias("path")).agg(F.array_sort(F.collect_list("dst")).alias("edges"))
    got = nodes.join(out, "path", "left")
    return got.select("path", F.to_json(F.struct(*nodes.columns, "edges")).alias("json"))


def listing(pages: DataFrame) -> DataFrame:
    return pages.groupBy("dir").agg(F.array_sort(F.collect_list("stem")).alias("stems"))
