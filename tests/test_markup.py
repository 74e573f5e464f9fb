"""Frontmatter, rendering and rewrites of small texts."""

from pyspark.sql import functions as F

from vellum.functions import frontmatter, markdown
from vellum.operators import rewrites, search


def test_frontmatter(spark):
    text = "---\ntitle: 'A: b'\nsources:\n- x\n- \"y\"\ntags: [p, q]\n  nested: no\nempty:\n---\nbody\n"
    fm, body = frontmatter.parse(text)
    assert fm == {"title": ["A: b"], "sources": ["x", "y"], "tags": ["p", "q"], "empty": []} and body == "body\n"
    assert frontmatter.parse(text, frozenset({"title"}))[0] == {"title": ["A: b"]}
    assert frontmatter.parse("---\ntitle: x\nbody") == ({}, "---\ntitle: x\nbody") and frontmatter.parse(None) == ({}, "")
    text = text.replace("\n- ", "\n  - ")
    done = frontmatter.edit(text, "sources", "[z]")
    assert frontmatter.parse(done)[0]["sources"] == ["z"] and frontmatter.edit(done, "sources", "[z]") == done
    assert "sources" not in frontmatter.parse(frontmatter.edit(text, "sources", None))[0]
    assert frontmatter.edit("plain", "a", "1") == "plain" and frontmatter.edit("---\na: 1\nb", "a", "2") == "---\na: 1\nb"
    assert frontmatter.edit("---\nk : 1\n  - x\n\nz: 2\n\n---\nrest", "k", "3") == "---\nk: 3\n\nz: 2\n\n---\nrest"
    assert frontmatter.edit("---\nz: 2\n\n---\nrest", "k", "3") == "---\nz: 2\nk: 3\n\n---\nrest"
    df = spark.createDataFrame([(text,), (None,)], "t string").select(frontmatter.parsed("t").alias("x")).select("x.fm", "x.body")
    assert [r["body"] for r in df.collect()] == ["body\n", ""]


def test_markdown():
    got = markdown.render("---\na: b\n---\n# T <x>\n\npara **b** *i* `[[c]]` [[Some Page|alias]]\nmore (vault:p)\n\n- [x] done\n- item\n\n| a | b |\n|:--|--:|\n| 1 | 2 |\n\n```\n<raw>\n```\n> q\n---\n")
    assert "<h1>T &lt;x&gt;</h1>" in got and "<strong>b</strong> <em>i</em> <code>[[c]]</code>" in got
    assert 'data-stem="some-page">alias</a>' in got and '<cite data-source="p">' in got
    assert '<input type="checkbox" checked disabled> done' in got and '<td style="text-align:right">2</td>' in got
    assert "<pre><code>&lt;raw&gt;</code></pre>" in got and "<blockquote>q</blockquote>" in got and got.endswith("<hr>")


def test_rewrites_settle(spark):
    texts = ["a %% b\n```\nkeep %%\n```\n%%%", "[[A b]] [[A b|x]] [[c]]", "see (vault:x) (vault:x) (vault:y)", "![[pic.png|w]] ![[page]]", "---\ntitle: X\ntype: concept\n---\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for f, want in ((rewrites.collapse_percent, "a % b\n```\nkeep %%\n```\n%"), (rewrites.normalise_links, "[[a-b]] [[a-b|x]] [[c]]"), (rewrites.dedup_citations, "see (vault:x) (vault:y)"), (rewrites.embed_images, "![pic](pic.png) ![[page]]"), (rewrites.title_prefix, "---\ntitle: [con] X\ntype: concept\n---\n")):
        once = [r[0] for r in df.select(f("t").alias("t")).collect()]
        assert want in once
        assert [r[0] for r in df.select(f("t").alias("t")).select(f("t")).collect()] == once
    one = df.limit(1).select(rewrites.apply_link(F.lit("a+b `a+b`"), F.lit("a+b"), F.lit("s")), rewrites.apply_link(F.lit("x a+b"), F.lit("a+b"), F.lit("s"))).first()
    assert one[0] == "a+b `a+b`" and one[1] == "x [[s|a+b]]"


def test_hashed_vectors_are_unit(spark):
    docs = spark.createDataFrame([(1, "a b c a"), (2, "x")], "id long, text string")
    rows = search.hashed_vectors(docs, "id", 16).collect()
    assert all(abs(sum(x * x for x in r["embedding"]) - 1) < 1e-5 and len(r["embedding"]) == 16 for r in rows) and len(rows) == 2
