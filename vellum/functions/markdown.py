"""Markdown to HTML, enough for pages: headings, lists, tables, code, emphasis, links, images."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def inline(text: str) -> str:
    """Marked-up text of one line.  Code spans are set aside first, so nothing inside them is read as markup."""
    held: list[str] = []

    def hold(m: re.Match) -> str:
        held.append(f"<code>{html.escape(m[1])}</code>")
        return f"\x00{len(held) - 1}\x00"

    out = html.escape(re.sub(r"`([^`]+)`", hold, text), quote=False)
    out = re.sub(r"!\[([^\]]*)\]\(([^)\s]+)\)", lambda m: f'<img alt="{m[1]}" src="{m[2]}">', out)
    out = re.sub(r"\[\[([^\]|]+)\|([^\]]+)\]\]", lambda m: f'<a class="link" data-stem="{m[1].strip().lower().replace(" ", "-")}">{m[2]}</a>', out)
    out = re.sub(r"\[\[([^\]|]+)\]\]", lambda m: f'<a class="link" data-stem="{m[1].strip().lower().replace(" ", "-")}">{m[1]}</a>', out)
    out = re.sub(r"\(vault:([^)]+)\)", r'<cite data-source="\1">\1</cite>', out)
    out = re.sub(r"\[([^\]]+)\]\((https?://[^)\s]+)\)", r'<a href="\2" rel="noopener">\1</a>', out)
    out = re.sub(r"\*\*([^*]+)\*\*", r"<strong>\1</strong>", out)
    out = re.sub(r"(?<!\*)\*([^*\s][^*]*)\*(?!\*)", r"<em>\1</em>", out)
    return re.sub("\x00(\\d+)\x00", lambda m: held[int(m[1])], out)


def _table(lines: list[str]) -> str:
    from vellum.sources.pages import split_row

    side = {(True, True): "center", (False, True): "right", (True, False): "left"}
    align = [side.get((c.startswith(":"), c.endswith(":")), "") for c in split_row(lines[1])]
    cell = lambda tag, i, c: f"<{tag}" + (f' style="text-align:{align[i]}"' if i < len(align) and align[i] else "") + f">{inline(c)}</{tag}>"
    row = lambda tag, x: "<tr>" + "".join(cell(tag, i, c) for i, c in enumerate(split_row(x))) + "</tr>"
    return f"<table><thead>{row('th', lines[0])}</thead><tbody>{''.join(row('td', x) for x in lines[2:])}</tbody></table>"


def render(text: str) -> str:
    """Blocks in order; frontmatter is left out."""
    lines = re.sub(r"\A---\n.*?\n---\n", "", text or "", flags=re.DOTALL).split("\n")
    out, i = [], 0
    while i < len(lines):
        line = lines[i]
        begin = i
        if line.lstrip().startswith("```"):
            i += 1
            while i < len(lines) and not lines[i].lstrip().startswith("```"):
                i += 1
            out.append("<pre><code>" + html.escape("\n".join(lines[begin + 1 : i])) + "</code></pre>")
            i += 1
        elif m := re.match(r"(#{1,6})\s+(.*)", line):
            out.append(f"<h{len(m[1])}>{inline(m[2])}</h{len(m[1])}>")
            i += 1
        elif line.startswith("|") and i + 1 < len(lines) and re.fullmatch(r"\s*\|[ \t:|-]+\|\s*", lines[i + 1]):
            while i < len(lines) and lines[i].startswith("|"):
                i += 1
            out.append(_table(lines[begin:i]))
        elif re.match(r"\s*([-*]|\d+\.)\s", line):
            tag = "ol" if re.match(r"\s*\d", line) else "ul"
            while i < len(lines) and re.match(r"\s*([-*]|\d+\.)\s", lines[i]):
                i += 1
            items = [re.sub(r"^\s*([-*]|\d+\.)\s+", "", x) for x in lines[begin:i]]
            box = {"[ ] ": '<input type="checkbox" disabled> ', "[x] ": '<input type="checkbox" checked disabled> '}
            out.append(f"<{tag}>" + "".join("<li>" + box.get(x[:4].lower(), "") + inline(x[4:] if x[:4].lower() in box else x) + "</li>" for x in items) + f"</{tag}>")
        elif line.startswith(">"):
            while i < len(lines) and lines[i].startswith(">"):
                i += 1
            out.append("<blockquote>" + "<br>".join(inline(x.lstrip("> ")) for x in lines[begin:i]) + "</blockquote>")
        elif re.fullmatch(r"\s*(-{3,}|\*{3,})\s*", line):
            out.append("<hr>")
            i += 1
        elif line.strip():
            while i < len(lines) and lines[i].strip() and not re.match(r"#{1,6}\s|\||>|```|\s*[-*]\s", lines[i]):
                i += 1
            i = max(i, begin + 1)
            out.append("<p>" + inline(" ".join(x.strip() for x in lines[begin:i])) + "</p>")
        else:
            i += 1
    return "\n".join(out)


@F.pandas_udf(StringType())
def rendered(texts: pd.Series) -> pd.Series:
    return texts.map(render)
