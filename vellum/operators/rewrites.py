"""Page rewrites; each changes nothing the second time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import naming
from vellum.functions import text as tx


def outside_code(text: Column | str, change) -> Column:
    """The text with a change of its lines outside fenced code: change(line) -> line."""
    lines = F.split(tx.c(text), "\n")
    fence = lambda x: F.ltrim(x).startswith("```")
    step = lambda acc, x: F.struct((acc["on"] != fence(x)).alias("on"), F.concat(acc["out"], F.array(F.when(acc["on"] | fence(x), x).otherwise(change(x)))).alias("out"))
    return F.array_join(F.aggregate(lines, F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("out")), step)["out"], "\n")


def collapse_percent(text: Column | str) -> Column:
    return outside_code(text, lambda x: F.regexp_replace(x, "%%+", "%"))


def normalise_links(text: Column | str) -> Column:
    """[[Some Page]] becomes [[some-page]], [[Some Page|x]] becomes [[some-page|x]]."""
    found = F.array_distinct(F.filter(tx.links(text), lambda x: x.rlike("[ A-Z]")))
    fix = lambda t, x: F.replace(F.replace(t, F.concat(F.lit("[["), x, F.lit("]]")), F.concat(F.lit("[["), tx.target(x), F.lit("]]"))), F.concat(F.lit("[["), x, F.lit("|")), F.concat(F.lit("[["), tx.target(x), F.lit("|")))
    return F.aggregate(found, tx.c(text), fix)


def title_prefix(text: Column | str) -> Column:
    """The title field with its type's display prefix."""
    kind, title = tx.frontmatter_field(text, "type"), tx.frontmatter_field(text, "title")
    return F.when(title == "", tx.c(text)).otherwise(F.replace(tx.c(text), F.concat(F.lit("\ntitle: "), title, F.lit("\n")), F.concat(F.lit("\ntitle: "), naming.display_title(kind, title), F.lit("\n"))))


def dedup_citations(text: Column | str) -> Column:
    """A citation that repeats within a line stands once."""
    return outside_code(text, lambda x: F.regexp_replace(x, r"(\(vault:[^)]+\))(?:\s*\1)+", "$1"))


def embed_images(text: Column | str) -> Column:
    """![[file.png]] becomes ![file](file.png)."""
    return F.regexp_replace(tx.c(text), r"!\[\[([^\]|]+?)\.(png|jpg|jpeg|svg|gif)(?:\|[^\]]*)?\]\]", "![$1]($1.$2)")


def apply_link(text: Column | str, anchor: Column | str, stem: Column | str) -> Column:
    """Link an anchor that stands exactly once outside links, citations and code; else the text as it is."""
    t, a = tx.c(text), tx.c(anchor)
    masked = F.regexp_replace(t, r"(?s)```.*?```|`[^`]*`|\[\[[^\]]*\]\]|\([a-z]+:[^)]*\)", "")
    once = (F.size(F.split(masked, F.concat(F.lit(r"\Q"), a, F.lit(r"\E")))) == 2) & (F.size(F.split(t, F.concat(F.lit(r"\Q"), a, F.lit(r"\E")))) == 2)
    return F.when(once, F.replace(t, a, F.concat(F.lit("[["), tx.c(stem), F.lit("|"), a, F.lit("]]")))).otherwise(t)


def fingerprint(files: DataFrame) -> DataFrame:
    """path and SHA-256 of the content."""
    return files.select("path", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


def tampered(now: DataFrame, guarded: DataFrame) -> DataFrame:
    """path and state of files that changed, went or came since the fingerprint was taken."""
    both = guarded.select("path", F.col("sha").alias("_old")).join(now, "path", "full_outer")
    return both.where("not (_old <=> sha)").select("path", F.when(F.col("sha").isNull(), "removed").when(F.col("_old").isNull(), "added").otherwise("changed").alias("state"))
