"""Names of sources: origin of an address, topics, stems, display titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.text import c, slug
from vellum.schemas import STEM_PREFIX, TYPE_PREFIX

# fixed values: known domains and their labels, words that make no topic
ORIGINS = [
    ("wikipedia.org", "Wikipedia"), ("arxiv.org", "arXiv"), ("nature.com", "Nature"), ("sciencedirect.com", "ScienceDirect"), ("cell.com", "Cell"), ("springer.com", "Springer"),
    ("ieee.org", "IEEE"), ("acm.org", "ACM"), ("github.com", "GitHub"), ("nytimes.com", "NYTimes"), ("bbc.co", "BBC"),
]
TITLE_STOP = ["a", "an", "the", "of", "in", "for", "and", "is", "are", "on", "to", "with"]


def origin(url: Column | str) -> Column:
    """Label of a known domain, else the second-level label, else Web."""
    host = F.regexp_extract(c(url), r"//(?:www\.)?([^/]+)", 1)
    parts = F.split(host, r"\.")
    label = F.when(host == "", F.lit("Web")).otherwise(F.initcap(F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-2))).otherwise(F.try_element_at(parts, F.lit(1)))))
    for domain, name in reversed(ORIGINS):
        label = F.when(F.lower(c(url)).contains(domain), F.lit(name)).otherwise(label)
    return label


def title_topic(title: Column | str) -> Column:
    """First three words that aren't stop words or punctuation, hyphenated."""
    plain = F.regexp_replace(F.lower(c(title)), "[‒–—]", "-")
    words = F.filter(F.split(F.trim(F.regexp_replace(plain, r"\s+", " ")), " "), lambda w: ~w.isin(TITLE_STOP) & w.rlike(r"[\p{L}\p{N}]"))
    return F.array_join(F.slice(words, 1, 3), "-")


def topic(stem: Column | str) -> Column:
    """A stem without the runs of hexadecimal pairs that escaped characters leave."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c(stem), r"(?:-[0-9a-f]{2}){2,}", "-"), "-{2,}", "-"), "^-+|-+$", "")


def prefixed_stem(page_type: Column | str, name: Column | str) -> Column:
    prefix = F.lit("")
    for k, v in STEM_PREFIX.items():
        prefix = F.when(c(page_type) == k, F.lit(v)).otherwise(prefix)
    return F.concat(prefix, slug(name))


def display_title(page_type: Column | str, title: Column | str) -> Column:
    prefix = F.lit(None).cast("string")
    for k, v in TYPE_PREFIX.items():
        prefix = F.when(c(page_type) == k, F.lit(v)).otherwise(prefix)
    return F.when(prefix.isNull() | c(title).startswith(prefix), c(title)).otherwise(F.concat(prefix, F.lit(" "), c(title)))


def source_stem(author: Column | str, url: Column | str, year: Column | str, title: Column | str) -> Column:
    """author-or-origin, year and topic, as a slug."""
    who = F.coalesce(F.nullif(F.lower(c(author)), F.lit("")), F.lower(origin(url)))
    return slug(F.concat_ws("-", who, F.nullif(F.regexp_extract(c(year), r"(19|20)\d{2}", 0), F.lit("")), F.nullif(title_topic(title), F.lit(""))))
