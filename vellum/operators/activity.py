"""Event analytics: by page, project and kind, decayed cadence, activity scores."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEEKS = 4


def period(text: str) -> str:
    """7d, 24h or 2w as an interval."""
    m = re.fullmatch(r"(\d+)([dhw])", text.strip())
    if not m:
        raise ValueError(f"not a period: {text!r}")
    return f"interval {m[1]} {dict(d='days', h='hours', w='weeks')[m[2]]}"


def since(events: DataFrame, as_of: str, window: str) -> DataFrame:
    return events.where(F.col("ts") >= F.expr(f"timestamp'{as_of}' - {period(window)}"))


def by_page(events: DataFrame) -> DataFrame:
    """page, counts of current and archival ingests and user signals, last event and projects."""
    counts = events.groupBy("page").agg(F.count_if(F.col("ingest_kind") == "current").alias("current"), F.count_if(F.col("ingest_kind") == "archival").alias("archival"), F.count_if(F.col("kind") == "user_signal").alias("signals"), F.max("ts").alias("last_ts"))
    projects = events.select("page", F.explode("projects").alias("p")).groupBy("page").agg(F.array_join(F.array_sort(F.collect_set("p")), ",").alias("projects"))
    return counts.join(projects, "page", "left")


def week(ts: Column | str, as_of: str) -> Column:
    """Whole weeks before ``as_of``, at least 0."""
    seconds = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(ts)
    return F.greatest(F.lit(0), F.floor(F.floor(seconds / 86400) / 7))


def by_project(events: DataFrame, as_of: str) -> DataFrame:
    """project, counts, and cadence: current ingests of four weeks, each weighing e^(-w/2), over the weights' sum."""
    flat = events.withColumn("project", F.explode("projects")).withColumn("w", week("ts", as_of))
    weight = F.exp(-F.col("w") / 2.0)
    fresh = (F.col("ingest_kind") == "current") & (F.col("w") < WEEKS)
    total = sum(2.718281828459045 ** (-w / 2) for w in range(WEEKS))
    return flat.groupBy("project").agg(F.count_if(F.col("ingest_kind") == "current").alias("current"), F.count_if(F.col("ingest_kind") == "archival").alias("archival"), F.count_if(F.col("kind") == "user_signal").alias("signals"), (F.sum(F.when(fresh, weight).otherwise(0.0)) / total).alias("cadence"))


def activity_score(projects: DataFrame) -> DataFrame:
    """project, score = .55 ingests + .30 signals + .15 cadence, each over its largest, and its complement."""
    w = Window.partitionBy()  # one row a project
    part = lambda c: F.coalesce(F.col(c) / F.nullif(F.max(c).over(w).cast("double"), F.lit(0.0)), F.lit(0.0))
    score = 0.55 * part("current") + 0.30 * part("signals") + 0.15 * part("cadence")
    return projects.select("project", score.alias("activity")).withColumn("archival", 1 - F.col("activity"))


def worst_within(scored: DataFrame, tags: DataFrame, k: int = 5) -> DataFrame:
    """The k worst pages of each project (tags: path, project)."""
    w = Window.partitionBy("project").orderBy(F.desc(F.round("composite", 6)), "path")
    return tags.join(scored.select("path", "composite"), "path").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("project", "rank", "path", "composite")
