"""Frontmatter as a map, and edits of single fields."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

PARSED = StructType([StructField("fm", MapType(StringType(), ArrayType(StringType()))), StructField("body", StringType())])
_FENCED = re.compile(r"\A---\n(.*?)\n?---[ \t]*(?:\n|\Z)", re.DOTALL)


def _scalar(x: str) -> str:
    x = x.strip()
    return x[1:-1] if len(x) > 1 and x[0] == x[-1] and x[0] in "\"'" else x


def parse(text: str, allowed: frozenset[str] | None = None) -> tuple[dict[str, list[str]], str]:
    """Fields (scalars are lists of one) and body; without a closing fence nothing is a field.

    Indented lines are never fields; fields that aren't allowed are dropped, so a source can't bring its own.
    """
    m = _FENCED.match(text or "")
    if not m:
        return {}, text or ""
    out: dict[str, list[str]] = {}
    key = None
    for line in m[1].split("\n"):
        if item := re.match(r"\s*-\s+(.*)", line):
            if key is not None:
                out[key].append(_scalar(item[1]))
            continue
        field = re.match(r"([A-Za-z_][\w-]*):(.*)", line)
        if not field:
            continue
        key, value = field[1], field[2].strip()
        if allowed is not None and key not in allowed:
            key = None
            continue
        if value.startswith("[") and value.endswith("]"):
            out[key] = [_scalar(x) for x in value[1:-1].split(",") if x.strip()]
        else:
            out[key] = [_scalar(value)] if value else []
    return out, text[m.end() :]


def edit(text: str, key: str, value: str | None) -> str:
    """The text with a field set, or taken out with its indented lines if the value is None.

    The first line of the key is the field; a new one goes behind the last line that isn't blank.  A text without
    frontmatter comes back as it is.
    """
    close = text.find("\n---\n", 4) if text.startswith("---\n") else -1
    if close < 0:
        return text
    head, field = text[:close].split("\n"), re.compile(rf"{re.escape(key)}\s*:")
    line = [] if value is None else [f"{key}: {value}"]
    begin = next((i for i, x in enumerate(head) if i and field.match(x)), None)
    if begin is None:
        begin = end = 1 + max(i for i, x in enumerate(head) if x.strip())
    else:
        end = next((i for i in range(begin + 1, len(head)) if not head[i].startswith((" ", "\t"))), len(head))
    return "\n".join([*head[:begin], *line, *head[end:]]) + text[close:]


def merged(text: str) -> dict[str, list[str]]:
    """The fields of a source page; those of the text it fetched, if that has frontmatter of its own, come before the outer ones."""
    outer, body = parse(text)
    at = body.find("<!-- BEGIN FETCHED CONTENT")
    begin = body.find("---\n", at) if at >= 0 else -1
    end = body.find("\n---", begin + 4) if begin >= 0 else -1
    return outer if end < 0 else outer | parse(f"---\n{body[begin + 4 : end]}\n---\n")[0]


@F.pandas_udf(MapType(StringType(), ArrayType(StringType())))
def source_fields(texts: pd.Series) -> pd.Series:
    """map<string,array<string>> of the merged fields of each text."""
    return texts.map(merged)


@F.pandas_udf(PARSED)
def parsed(texts: pd.Series) -> pd.DataFrame:
    """struct<fm map<string,array<string>>, body> of each text."""
    return pd.DataFrame([parse(t) for t in texts], columns=["fm", "body"])


@F.pandas_udf(StringType())
def edited(texts: pd.Series, keys: pd.Series, values: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else edit(t, k, v) for t, k, v in zip(texts, keys, values, strict=True)])
