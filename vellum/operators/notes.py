"""Notes: plain text for encoders, vectors of known notes, near repeats, topic pages, references asked for once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.operators import search
from vellum.operators.lifecycle import CREATED, NOTE_ID


def plain(line: Column | str) -> Column:
    """A note without bullet, markers and brackets of links (their alias, else their target, stays), blanks collapsed."""
    s = F.regexp_replace(F.regexp_replace(F.trim(tx.c(line)), r"^[-*] ", ""), rf"\(?{NOTE_ID}\)?", "")
    s = F.regexp_replace(F.regexp_replace(s, CREATED.replace("(\\d", "(?:\\d"), ""), r"\[\[[^\]|]+\|([^\]]+)\]\]", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"\[\[([^\]|]+)\|?\]\]", "$1"), r"\s+", " "))


def unit(vector: Column | str) -> Column:
    """A vector of length 1; zeros stay zeros."""
    v = F.transform(tx.c(vector), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 1e-12, F.transform(v, lambda x: x / norm)).otherwise(v)


def backfill(lines: DataFrame, known: DataFrame) -> DataFrame:
    """note_id and plain text of the notes marked in (path, pos, line) that have no vector (note_id) yet: their first line."""
    ids = lines.select("path", "pos", "line", F.explode(F.regexp_extract_all("line", F.lit(NOTE_ID), 1)).alias("n"))
    first = ids.groupBy(F.concat(F.lit("N"), "n").alias("note_id")).agg(F.min_by("line", F.struct("path", "pos")).alias("line"))
    return first.join(known, "note_id", "left_anti").select("note_id", plain("line").alias("text"))


def repeats(fresh: DataFrame, known: DataFrame, least: float = 0.92) -> DataFrame:
    """vec_id, anchor and similarity of fresh notes (vec_id, embedding) whose nearest known one (anchor, anchor_embedding) is so similar.

    With unit vectors, 1 - distance² / 2 is the dot product, so the nearest is the most similar.
    """
    return search.nearest(fresh.select("vec_id", unit("embedding").alias("embedding")), known.select("anchor", unit("anchor_embedding").alias("anchor_embedding")), least)


def append(pages: DataFrame, fresh: DataFrame, today: str) -> DataFrame:
    """path and text of the topic pages that get notes (path, id, line), in order of ids; missing pages are made."""
    added = fresh.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda x: x["line"]), "\n").alias("_new"))
    title = F.initcap(F.replace(F.regexp_extract("path", r"([^/]+?)(?:\.md)?$", 1), F.lit("-"), F.lit(" ")))
    head = F.concat(F.lit('---\ntitle: "[note] '), title, F.lit(f'"\ntype: note\ncreated: {today}\nupdated: {today}\n---\n\n## notes\n\n'))
    old = F.when(F.col("text").endswith("\n"), F.col("text")).otherwise(F.concat("text", F.lit("\n")))
    return added.join(pages.select("path", "text"), "path", "left").select("path", F.concat(F.coalesce(old, head), "_new", F.lit("\n")).alias("text"))


def requests(mentions: DataFrame, held: DataFrame, asked: DataFrame) -> DataFrame:
    """ref, status (asked, held or new) and the first three sources of every reference (ref, source); new ones join ``asked``."""
    refs = mentions.groupBy("ref").agg(F.slice(F.array_sort(F.collect_set("source")), 1, 3).alias("sources"))
    mark = lambda df, name: df.select("ref").distinct().withColumn(name, F.lit(True))
    got = refs.join(mark(asked, "_a"), "ref", "left").join(mark(held, "_h"), "ref", "left")
    return got.select("ref", F.when(F.col("_a"), "asked").when(F.col("_h"), "held").otherwise("new").alias("status"), F.array_join("sources", ", ").alias("sources"))


def sections(lines: DataFrame, last: int = 5) -> DataFrame:
    """pos and header of the last section headers of a log (pos, line)."""
    heads = lines.where(F.col("line").startswith("## ") & (F.length("line") > 3))
    return heads.select("pos", F.substring("line", 4, 1 << 30).alias("header")).orderBy(F.desc("pos")).limit(last)


def append_section(text: str, section: str, entry: str) -> str:
    """A log with an entry at its end, under a header that is added if it is missing; an entry stands there once."""
    closed = lambda s: s if not s or s.endswith("\n") else s + "\n"
    if f"## {section}" not in text:
        text = f"{closed(text)}\n## {section}\n\n"
    return text if entry in text else closed(closed(text) + entry)
