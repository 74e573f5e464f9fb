"""Ingest and work queues: stubs, originals, summaries, snippets, completion flags, backups, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as tx

SUMMARY_STOP, SUMMARY_MOST, SNIPPET_WORDS = 400, 500, 40


def stub_summary(text: Column | str) -> Column:
    """Lines that aren't blank, headings or comments, joined until they pass 400 characters, then cut to 500."""
    lines = F.filter(F.transform(F.split(tx.c(text), "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("<!--"))
    step = lambda acc, x: F.when(F.length(acc) > SUMMARY_STOP, acc).when(acc == "", x).otherwise(F.concat(acc, F.lit(" "), x))
    return F.substring(F.aggregate(lines, F.lit(""), step), 1, SUMMARY_MOST)


def snippet(text: Column | str, terms: list[str], width: int = SNIPPET_WORDS) -> Column:
    """The words around the first term, which is marked; without one the first words."""
    words = F.split(F.trim(F.regexp_replace(tx.c(text), r"\s+", " ")), " ")
    plain = F.transform(words, lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}]", "")))
    first = F.array_min(F.filter(F.array(*[F.array_position(plain, t.lower()) for t in terms]), lambda x: x > 0))
    begin = F.greatest(F.lit(1), F.coalesce(first, F.lit(1)) - width // 2).cast("int")
    marked = F.transform(F.slice(words, begin, width), lambda w: F.when(F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}]", "")).isin([t.lower() for t in terms]), F.concat(F.lit(">>>"), w, F.lit("<<<"))).otherwise(w))
    return F.array_join(marked, " ")


def primary_refs(text: Column | str) -> Column:
    """References that a document stands for, by its source_url lines."""
    urls = F.regexp_extract_all(tx.c(text), F.lit(r"(?mi)^\s*source_url:\s*(\S+)\s*$"), F.lit(1))
    joined = F.array_join(urls, " ")
    bare = F.transform(F.regexp_extract_all(joined, F.lit(r"(?i)arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,5})"), F.lit(1)), lambda x: F.concat(F.lit("arxiv:"), x))
    return F.array_sort(F.array_union(tx.external_refs(joined), bare))


def originals(files: DataFrame) -> DataFrame:
    """path of each extraction and its original: the first file of the same stem that is no extraction."""
    stem = F.regexp_replace("path", r"(\.extracted)?\.[^./]+$", "")
    marked = files.select("path", stem.alias("stem"), F.col("path").contains(".extracted.").alias("is_ext"))
    first = marked.where("not is_ext").groupBy("stem").agg(F.min("path").alias("original"))
    return marked.where("is_ext").join(first, "stem", "left").select("path", "original")


def uncovered(extractions: DataFrame, stubs: DataFrame) -> DataFrame:
    """Extractions (path, sha) that no stub (path, sha) covers by name or by hash."""
    return extractions.join(stubs.select("path"), "path", "left_anti").join(stubs.where("sha is not null").select("sha"), "sha", "left_anti").select("path")


def run_summary(files: DataFrame) -> DataFrame:
    """considered, ok, failed, full and snippet counts of an ingest run (status, mode)."""
    return files.agg(F.count("*").alias("considered"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") != "ok").alias("failed"), F.count_if(F.col("mode") == "full").alias("full"), F.count_if(F.col("mode") == "snippet").alias("snippet"))


def work_queues(pages: DataFrame) -> DataFrame:
    """queue and path of what is left to do, by frontmatter flags: multimodal, tables, figures."""
    flag = lambda k: F.lower(tx.frontmatter_field("text", k)) == "true"
    todo = {"multimodal": flag("multimodal_recommended") & ~flag("multimodal_done"), "tables": flag("has_tables") & ~flag("tables_extracted"), "figures": flag("has_figures") & ~flag("figures_done")}
    return pages.select("path", F.explode(F.array(*[F.when(v, F.lit(k)) for k, v in todo.items()])).alias("queue")).where("queue is not null").select("queue", "path")


def complete(fm: Column | str, key: str, value: str = "true") -> Column:
    """A frontmatter map with a flag set; the second time changes nothing."""
    return F.map_concat(F.map_filter(tx.c(fm), lambda k, _: k != key), F.create_map(F.lit(key), F.array(F.lit(value))))


def backups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("backup_id", "table_stem").agg(F.max("backup_at").alias("backup_at"), F.count("*").alias("n_rows"))


def image_targets(pages: DataFrame, images: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """stem, page and image of the page images (name-p3.png) of each source, in page order."""
    got = images.select(F.regexp_extract("image", r"^(.*)-p(\d+)\.png$", 1).alias("stem"), F.regexp_extract("image", r"^(.*)-p(\d+)\.png$", 2).alias("n"), "image").where("n <> ''").withColumn("page", F.col("n").cast("int"))
    got = got.where(F.col("page").isin(wanted)) if wanted else got
    return got.join(pages.select("stem"), "stem").select("stem", "page", "image").orderBy("stem", "page")


def stale(spark: SparkSession, source: str, built: str) -> bool:
    """Has any file of a folder changed since another was built?"""
    newest = lambda p: spark.read.format("binaryFile").option("recursiveFileLookup", True).load(p).agg(F.max("modificationTime")).first()[0]
    a, b = newest(source), newest(built)
    return b is None or (a is not None and a > b)
