"""Todos, notes, projects, identifiers and work queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as tx

# fixed values: line patterns, and the urgency of a mention's file
CHECKBOX = r"^(\s*[-*]\s*)\[([ xX])\](\s+)(.+)$"
TODO_ID, NOTE_ID = r"\btodo:T(\d+)\b", r"\bnote:N(\d+)\b"
CREATED, TOPIC = r"\(created:\s*(\d{4}-\d{2}-\d{2})\)", r"(?i)(?:^|\s)topic:\s*([a-z][a-z0-9-]*)"
URGENCY = {"day": 3, "month": 2, "year": 1}


def lines(pages: DataFrame) -> DataFrame:
    """path, pos, line outside fenced code."""
    return pages.select("path", F.explode(tx.keep_lines("text")).alias("x")).select("path", "x.pos", "x.line")


def todos(pages: DataFrame) -> DataFrame:
    """Checkbox lines: path, pos, done, todo_id (null if none yet), created, body."""
    got = lines(pages).where(F.col("line").rlike(CHECKBOX))
    tid = F.regexp_extract("line", TODO_ID, 1)
    return got.select("path", "pos", (F.lower(F.regexp_extract("line", CHECKBOX, 2)) == "x").alias("done"), F.nullif(tid, F.lit("")).cast("long").alias("todo_id"), F.nullif(F.regexp_extract("line", CREATED, 1), F.lit("")).alias("created"), F.regexp_extract("line", CHECKBOX, 4).alias("body"))


def mint(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows with every missing number filled: the largest known, plus one each in order.

    Places come of counts per partition and their running sums, so that no window gathers all rows in one task.
    """
    known = rows.agg(F.coalesce(F.max(key), F.lit(0)).alias("m")).first()["m"]
    fresh = rows.where(F.col(key).isNull()).drop(key)
    ordered = fresh.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    ordered = ordered.checkpoint()
    counts = {r["_part"]: (r["n"], r["lo"]) for r in ordered.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("lo")).collect()}
    before, total = [], 0
    for p in sorted(counts):
        before.append((p, total - counts[p][1]))
        total += counts[p][0]
    shift = rows.sparkSession.createDataFrame(before, "_part int, _shift long")
    numbered = ordered.join(F.broadcast(shift), "_part").withColumn(key, F.col("_at") + F.col("_shift") + known + 1).drop("_part", "_at", "_shift")
    return rows.where(F.col(key).isNotNull()).unionByName(numbered)


def sync_todos(mentions: DataFrame) -> DataFrame:
    """todo_id, status (done if any mention is), priority (most urgent file; year if none says) and mentions."""
    level = F.lit(1)
    for name, value in URGENCY.items():
        level = F.when(F.col("path").contains(name), F.lit(value)).otherwise(level)
    got = mentions.groupBy("todo_id").agg(F.bool_or("done").alias("_done"), F.max(level).alias("_p"), F.count("*").alias("mentions"))
    return got.select("todo_id", F.when(F.col("_done"), "done").otherwise("open").alias("status"), F.when(F.col("_p") == 3, "day").when(F.col("_p") == 2, "month").otherwise("year").alias("priority"), "mentions")


def route_notes(notes: DataFrame) -> DataFrame:
    """id, target: the first link's stem, else the topic's slug, else attention; equal notes keep their first."""
    link = F.try_element_at(tx.links("text"), F.lit(1))
    topic = F.nullif(F.lower(F.regexp_extract("text", TOPIC, 1)), F.lit(""))
    keyed = notes.withColumn("hash", tx.short_hash(F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))))
    first = keyed.groupBy("hash").agg(F.min("id").alias("id"))
    return keyed.join(first, ["hash", "id"], "left_semi").select("id", "hash", F.coalesce(tx.target(link), topic, F.lit("attention")).alias("target"))


def rename_project(tags: DataFrame, old: str, new: str) -> DataFrame:
    """path, projects with a name replaced, each name once."""
    return tags.select("path", F.array_sort(F.array_distinct(F.transform("projects", lambda p: F.when(p == old, F.lit(new)).otherwise(p)))).alias("projects"))


def delete_project(tags: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """What remains, and a manifest of the pages that lost the tag (moved: it was their only one)."""
    held = F.array_contains("projects", F.lit(name))
    manifest = tags.where(held).select("path", F.when(F.size("projects") == 1, "moved").otherwise("untagged").alias("action"), F.lit(name).alias("project"))
    remains = tags.where(~held | (F.size("projects") > 1)).select("path", F.array_remove("projects", name).alias("projects"))
    return remains, manifest


def restore_project(remains: DataFrame, manifest: DataFrame) -> DataFrame:
    back = manifest.select("path", F.col("project").alias("_p"))
    both = remains.join(back, "path", "full_outer")
    return both.select("path", F.array_sort(F.array_distinct(F.concat(F.coalesce("projects", F.array().cast("array<string>")), F.when(F.col("_p").isNotNull(), F.array("_p")).otherwise(F.array().cast("array<string>"))))).alias("projects"))


def normal_name(x: str):
    return F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))


def lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """name, status: what the cache holds of it (ok, not_found), else pending; its latest row counts."""
    latest = cache.groupBy(normal_name("name").alias("_k")).agg(F.max_by("status", "fetched_at").alias("_s"))
    return requests.join(latest, normal_name("name") == F.col("_k"), "left").select("name", F.when(F.col("_s").isin("ok", "not_found"), F.col("_s")).otherwise("pending").alias("status"))


def queue(requests: DataFrame, done: DataFrame) -> DataFrame:
    """name and source pages of the requested names (names array, source_page) that aren't done."""
    flat = requests.select(F.explode("names").alias("name"), "source_page").select(normal_name("name").alias("name"), "source_page")
    return flat.join(done.select(normal_name("name").alias("name")), "name", "left_anti").groupBy("name").agg(F.countDistinct("source_page").alias("n_pages"), F.min("source_page").alias("first_page"))


def assets(created: DataFrame, referenced: DataFrame) -> DataFrame:
    """asset and state: ok, missing or unreferenced."""
    both = created.select("asset").distinct().withColumn("_c", F.lit(1)).join(referenced.select("asset").distinct().withColumn("_r", F.lit(1)), "asset", "full_outer")
    return both.select("asset", F.when(F.col("_c").isNull(), "missing").when(F.col("_r").isNull(), "unreferenced").otherwise("ok").alias("state"))


def suffixes(pages: DataFrame) -> DataFrame:
    """path and stem with -2, -3 ... for repeats, by path."""
    n = F.row_number().over(Window.partitionBy("stem").orderBy("path"))
    return pages.select("path", F.when(n == 1, F.col("stem")).otherwise(F.concat("stem", F.lit("-"), n)).alias("stem"))


def rewrite_links(pages: DataFrame, renames: DataFrame) -> DataFrame:
    """path and text of the pages in which a renamed stem (old, new) is linked; aliases stay."""
    used = pages.select("path", F.explode(F.array_distinct(tx.links("text"))).alias("raw")).join(renames, tx.target("raw") == F.col("old")).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("raw", "new"))).alias("_m"))
    done = F.aggregate("_m", F.col("text"), lambda t, m: F.replace(F.replace(t, F.concat(F.lit("[["), m["raw"], F.lit("]]")), F.concat(F.lit("[["), m["new"], F.lit("]]"))), F.concat(F.lit("[["), m["raw"], F.lit("|")), F.concat(F.lit("[["), m["new"], F.lit("|"))))
    return pages.join(used, "path").select("path", done.alias("text"))


def cache_stats(cache: DataFrame, pending: DataFrame) -> DataFrame:
    """kind, status and n of the identifier caches; what is queued (kind) has the status pending."""
    every = cache.select("kind", "status").unionByName(pending.select("kind", F.lit("pending").alias("status")))
    return every.groupBy("kind", "status").agg(F.count("*").alias("n"))


def resolver_plan(names: DataFrame, endpoints: dict[str, str], enabled: bool) -> DataFrame:
    """kind, endpoint, enabled, n_names and first_name: what a run would send where; nothing is sent."""
    got = names.select("kind", normal_name("name").alias("name")).distinct().groupBy("kind").agg(F.count("*").alias("n_names"), F.min("name").alias("first_name"))
    at = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in endpoints.items()]) if endpoints else F.lit(None).cast("string")
    return got.select("kind", at.alias("endpoint"), F.lit(enabled).alias("enabled"), "n_names", "first_name")


def render_plan(files: DataFrame, made: DataFrame, force: bool = False) -> DataFrame:
    """path, page, asset and action (render or skip) of every page of the files (path, n_pages); assets there are skipped unless forced."""
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"(\.pdf){1,2}$", "")
    pages = files.where("n_pages > 0").select("path", stem.alias("_s"), F.explode(F.sequence(F.lit(1), F.col("n_pages").cast("int"))).alias("page"))
    plan = pages.select("path", "page", F.concat("_s", F.lit("-p"), "page", F.lit(".png")).alias("asset"))
    got = plan.join(made.select("asset").distinct().withColumn("_m", F.lit(True)), "asset", "left")
    return got.select("path", "page", "asset", F.when(F.col("_m") & F.lit(not force), "skip").otherwise("render").alias("action"))
