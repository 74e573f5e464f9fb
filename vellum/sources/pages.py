"""Readers of page trees, drop folders, event logs and pipe tables."""

from __future__ import annotations

import re

import pandas as pd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.schemas import EVENT

# fixed values: names that aren't pages; suffixes that may be ingested
RESERVED = ("index.md", "log.md", "schema.md")
SUFFIXES = (".md", ".txt", ".csv", ".json", ".html", ".pdf", ".xlsx", ".pptx")


def hidden_folders(spark: SparkSession, root: str) -> list[str]:
    """Folders that Spark's readers pass over by themselves, as their names begin with an underscore or a dot."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs, todo, found = path.getFileSystem(spark._jsc.hadoopConfiguration()), [path], []
    while todo:
        for x in fs.listStatus(todo.pop()):
            if x.isDirectory():
                todo.append(x.getPath())
                if x.getPath().getName().startswith(("_", ".")):
                    found.append(x.getPath().toString())
    return found


def read_pages(spark: SparkSession, root: str, mode: str = "hygiene") -> DataFrame:
    """path, stem, dir, type, title, created, text of the markdown files under a folder.

    hygiene leaves out reserved names, the _suspect folder and dotted parts; scoring keeps _suspect and leaves out dotted
    files; graph leaves out reserved names and _suspect only.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text([root, *(hidden_folders(spark, root) if mode != "hygiene" else [])], wholetext=True)
    path = F.regexp_replace(F.url_decode(F.input_file_name()), "^.*?" + re.escape(root.removeprefix("file://").rstrip("/")) + "/", "")
    df = raw.select(path.alias("path"), F.col("value").alias("text"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    df = df.where(~name.isin(list(RESERVED)))
    if mode != "scoring":
        df = df.where(~F.col("path").rlike(r"(^|/)_suspect/"))
    if mode == "hygiene":
        df = df.where(~F.col("path").rlike(r"(^|/)\."))
    if mode == "scoring":
        df = df.where(~name.startswith("."))
    field = lambda k: F.nullif(tx.frontmatter_field("text", k), F.lit(""))
    stem = F.regexp_replace(name, r"\.md$", "")
    return df.select("path", stem.alias("stem"), F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise("root").alias("dir"), field("type").alias("type"), F.coalesce(field("title"), F.initcap(F.replace(stem, F.lit("-"), F.lit(" ")))).alias("title"), field("created").alias("created"), "text")


def read_drop(spark: SparkSession, root: str, most: int = 500, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """path, length, sha256 and text of the first files with an allowed suffix, by path; undecodable bytes become U+FFFD."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    ok = F.lower("path").rlike("(" + "|".join(re.escape(s) for s in suffixes) + ")$")
    return raw.where(ok).orderBy("path").limit(most).select("path", "length", F.sha2("content", 256).alias("sha256"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def read_events(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Events of JSON lines; malformed lines are skipped."""
    df = spark.read.schema(EVENT).option("mode", "DROPMALFORMED").json(path).where("ts is not null and kind is not null")
    return df.where(F.col("ts") >= F.lit(since).cast("timestamp")) if since else df


_BLOCK = re.compile(r"(?:\A|\n)(\s*\|.*\|[ \t]*\n[ \t]*\|[ \t:|-]+\|[ \t]*(?:\n[ \t]*\|.*\|[ \t]*)*)")


def split_row(line: str) -> list[str]:
    """Cells of a pipe-table row; an escaped pipe is text."""
    line = re.sub(r"^\||(?<!\\)\|$", "", line.strip())
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line)]


def pipe_tables(text: str) -> list[tuple[str, list[str], list[list[str]]]]:
    """(description, headers, rows) of the pipe tables of a text; blank rows go, the last heading before describes."""
    out = []
    for m in _BLOCK.finditer(text or ""):
        lines = m[1].strip().split("\n")
        rows = [split_row(x) for x in lines[2:]]
        heads = re.findall(r"(?m)^#+\s*(.+?)\s*$", text[: m.start()])
        out.append((heads[-1] if heads else "", split_row(lines[0]), [r for r in rows if any(r)]))
    return out


def explode_tables(pages: DataFrame) -> DataFrame:
    """path, table_no, description, headers, row_idx, cells of the pipe tables in pages."""


    kind = "array<struct<description:string,headers:array<string>,rows:array<array<string>>>>"

    @F.pandas_udf(kind)
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"description": d, "headers": h, "rows": r} for d, h, r in pipe_tables(t)])

    one = pages.select("path", F.posexplode(found("text")).alias("table_no", "t"))
    return one.select("path", "table_no", "t.description", "t.headers", F.posexplode("t.rows").alias("row_idx", "cells"))


def flatten_headers(band: list[list[str]], most: int = 3) -> list[str]:
    """One header a column from a band of header rows, parts joined by " / ", repeats once."""
    out = []
    for col in zip(*band[:most]):
        parts: list[str] = []
        for c in col:
            if c and (not parts or parts[-1] != c):
                parts.append(c)
        out.append(" / ".join(parts))
    return out


def fill_merges(rows: list[list[str]], merges: list[tuple[int, int, int, int]]) -> list[list[str]]:
    """Cells of merged ranges (top, left, bottom, right) take the first one's value."""
    rows = [list(r) for r in rows]
    for a, b, c, d in merges:
        for i in range(a, c + 1):
            for j in range(b, d + 1):
                rows[i][j] = rows[a][b]
    return rows


def render_table(headers: list[str], rows: list[list[str]]) -> str:
    """A pipe table, rows padded to the widest."""
    width = max([len(headers), *map(len, rows)], default=0)
    line = lambda r: "| " + " | ".join([*(str(c).replace("|", "\\|").replace("\n", " ") for c in r), *[""] * (width - len(r))]) + " |"
    return "\n".join([line(headers), "|" + "---|" * width, *map(line, rows)])
