"""Text as column expressions: links, citations, references, words, slugs, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: markup patterns
LINK = r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"
CITATION = r"\(vault:([^)]+)\)"
TABLE_ID = r"\(table:([a-zA-Z_][a-zA-Z0-9_]*)#id=([^)]+)\)"
TABLE_QUERY = r"\(table:([a-zA-Z_][a-zA-Z0-9_]*)\?query=([^)]+)\)"
ARXIV = r"(?i)arxiv:\s*(\d{4}\.\d{4,5})"
DOI = r"(?i)(10\.\d{4,9}/[-._;()/:a-z0-9]{2,80})"
WORDS = r"[\p{L}\p{N}]+"
# fixed values: words that carry no claim, singular words in s, articles
CLAIM_STOP = ["the", "and", "for", "are", "was", "were", "with", "from", "that", "this", "which", "have", "has", "been", "also", "more", "than", "about", "their", "other", "some"]
NO_DEPLURAL = ["analysis", "basis", "bias", "chaos", "corpus", "thesis", "atlas", "lens", "bus", "gas", "plus", "canvas", "status", "focus", "radius", "virus", "census", "consensus"]


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def links(text: Column | str) -> Column:
    """Raw targets of [[target]] and [[target|alias]], embeds included."""
    return F.regexp_extract_all(c(text), F.lit(LINK), F.lit(1))


def target(raw: Column | str) -> Column:
    """Trimmed, lower case, blanks as hyphens."""
    return F.replace(F.lower(F.trim(c(raw))), F.lit(" "), F.lit("-"))


def citations(text: Column | str) -> Column:
    return F.regexp_extract_all(c(text), F.lit(CITATION), F.lit(1))


def table_citations(text: Column | str) -> Column:
    """array<struct<tbl, kind, value>> of table citations by id, then by query."""
    def of(pattern: str, kind: str) -> Column:
        return F.transform(F.arrays_zip(F.regexp_extract_all(c(text), F.lit(pattern), F.lit(1)).alias("t"), F.regexp_extract_all(c(text), F.lit(pattern), F.lit(2)).alias("v")), lambda x: F.struct(x["t"].alias("tbl"), F.lit(kind).alias("kind"), x["v"].alias("value")))

    return F.concat(of(TABLE_ID, "id"), of(TABLE_QUERY, "query"))


def external_refs(text: Column | str) -> Column:
    """Sorted distinct arxiv: and doi: references."""
    arxiv = F.transform(F.regexp_extract_all(c(text), F.lit(ARXIV), F.lit(1)), lambda x: F.concat(F.lit("arxiv:"), F.lower(x)))
    doi = F.transform(F.regexp_extract_all(c(text), F.lit(DOI), F.lit(1)), lambda x: F.concat(F.lit("doi:"), F.lower(F.regexp_replace(x, r"[^a-zA-Z0-9]+$", ""))))
    return F.array_sort(F.array_union(arxiv, doi))


def words(text: Column | str) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c(text)), F.lit(WORDS), F.lit(0))


def claim_words(line: Column | str) -> Column:
    """ASCII words of four letters or more, without markup and stop words, in order."""
    bare = F.regexp_replace(F.regexp_replace(c(line), r"\(vault:[^)]+\)", ""), r"\[\[[^\]]*\]\]", "")
    return F.filter(F.regexp_extract_all(bare, F.lit("[a-zA-Z]{4,}"), F.lit(0)), lambda w: ~F.lower(w).isin(CLAIM_STOP))


def tokens(text: Column | str) -> Column:
    """Number of words between blanks."""
    bare = F.trim(F.regexp_replace(c(text), r"[ \t\n\x0b\f\r]+", " "))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, " "))).cast("long")


def body(text: Column | str) -> Column:
    """The text after its frontmatter; all of it if the fence never closes."""
    return F.regexp_replace(c(text), r"(?s)\A---\n.*?\n---\n", "")


def frontmatter_field(text: Column | str, key: str) -> Column:
    """A top-level scalar of the frontmatter, without its quotes; empty if there is none."""
    head = F.regexp_extract(c(text), r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    return F.trim(F.regexp_replace(F.regexp_extract(head, rf"(?m)^{key}:[ \t]*(.*)$", 1), r"""^["']|["']$""", ""))


def first_line(text: Column | str, most: int = 400) -> Column:
    """First line that isn't blank, a heading, a comment or a fence."""
    keep = lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("#") & ~F.trim(x).startswith("<!--") & ~F.trim(x).startswith("---")
    return F.coalesce(F.substring(F.trim(F.try_element_at(F.filter(F.split(c(text), "\n"), keep), F.lit(1))), 1, most), F.lit(""))


def source_pages(text: Column | str) -> Column:
    """Sorted distinct page numbers of p.3, p.3-5 and p.3, 4; reversed ranges are swapped."""
    groups = F.regexp_extract_all(c(text), F.lit(r"p\.\s?(\d+(?:\s?[-,]\s?\d+)*)"), F.lit(1))
    parts = F.flatten(F.transform(groups, lambda g: F.split(F.replace(g, F.lit(" ")), ",")))
    ends = lambda p: F.transform(F.split(p, "-"), lambda x: x.cast("int"))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: F.sequence(F.array_min(ends(p)), F.array_max(ends(p)), F.lit(1))))))


def slug(text: Column | str) -> Column:
    """Lower case, other characters as single hyphens, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c(text), F.lit(""))), "[^a-z0-9-]+", "-"), "-{2,}", "-"), "^-+|-+$", "")


def fuzzy_slug(stem: Column | str) -> Column:
    """Key that near-equal slugs share: no separators, leading article or plural s."""
    s = F.trim(F.regexp_replace(F.lower(c(stem)), r"[-_\s]+", " "))
    for article in ("a ", "an ", "the "):
        s = F.when(s.startswith(article), F.substring(s, len(article) + 1, 1000)).otherwise(s)
    return F.when(s.endswith("s") & ~s.endswith("ss") & ~s.isin(NO_DEPLURAL), F.regexp_replace(s, "s$", "")).otherwise(s)


def short_hash(x: Column | str) -> Column:
    """First 16 hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(c(x), 256), 1, 16)


def collapse_percent(text: Column | str) -> Column:
    """Runs of two or more % become one."""
    return F.regexp_replace(c(text), "%%+", "%")


def keep_lines(text: Column | str, skip_code: bool = True) -> Column:
    """Lines outside fenced code, as array<struct<pos, line>>."""
    lines = F.split(c(text), "\n")
    fence = lambda x: F.ltrim(x).startswith("```")
    marked = F.transform(lines, lambda x, i: F.struct(i.alias("pos"), x.alias("line")))
    if not skip_code:
        return marked
    state = F.aggregate(
        lines, F.struct(F.lit(False).alias("on"), F.array().cast("array<boolean>").alias("out")),
        lambda acc, x: F.struct((acc["on"] != fence(x)).alias("on"), F.concat(acc["out"], F.array(acc["on"] | fence(x))).alias("out")),
    )["out"]
    return F.transform(F.filter(F.arrays_zip(marked.alias("m"), state.alias("s")), lambda x: ~x["s"]), lambda x: x["m"])
