"""Findings on larger tables, on the smallest input that shows them."""

import time

from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.operators import graph, lint, search
from vellum.session import stored
from vellum.streaming import activity as streams


def test_phrase_is_linear_in_the_text(spark):
    """Words were extracted anew for every place of a phrase: quadratic in the text."""
    docs = spark.createDataFrame([(0, "one of the " * 20_000), (1, "a a a"), (2, ""), (3, None), (4, "of thesis, of the")], "doc_id long, text string")
    t = docs.select("doc_id", tx.words("text").alias("t"))
    began = time.time()
    got = t.select("doc_id", *[search.matches(F.col("t"), x).alias(n) for n, x in (("p", ["of", "the"]), ("a", ["a", "a"]), ("w", ["of", "the*"]))]).where("p >= 0 and a >= 0")
    assert {r["doc_id"]: (r["p"], r["a"], r["w"]) for r in got.collect()} == {0: (20_000, 0, 20_000), 1: (0, 2, 0), 2: (0, 0, 0), 4: (1, 0, 2)}
    assert time.time() - began < 30


def test_crossref_shuffles_only_what_may_be_a_stem(spark):
    """All phrases of all texts went through the shuffle; results as by the product of pages and stems."""
    filler = " ".join(f"alpha w{i}" for i in range(300))
    stems = ["alpha-beta", "alpha.beta", "gamma", "abc", "délta-x", "long-name-of-five-words"]
    texts = [f"Alpha beta and [[alpha.beta]] gamma {filler}", "alpha-beta [[Gamma]] Délta x", "a long name of five words, gamma gamma", "abc", filler, None]
    pages = spark.createDataFrame([(f"p/{s}.md", s, t) for s, t in zip(stems, texts, strict=True)], "path string, stem string, text string")
    got = {r["path"]: (r["mentioned"], r["linked"]) for r in lint.crossref(pages).collect()}
    assert got == {"p/alpha-beta.md": (2, 1), "p/alpha.beta.md": (3, 1), "p/gamma.md": (1, 0), "p/abc.md": (0, 0), "p/délta-x.md": (0, 0), "p/long-name-of-five-words.md": (0, 0)}
    known = pages.select(lint._plain("stem").alias("phrase"))
    many = spark.range(20_000).select(F.concat(F.lit("alpha w"), "id").alias("phrase")).unionByName(known)
    left = {r["phrase"] for r in lint._known(many, known).collect()}
    assert {r["phrase"] for r in known.collect()} <= left and len(left) < 200


def test_drained_rows_stay_out_of_the_driver(spark, tmp_path):
    """A stream's result was a table in the driver's memory, and cut off after 300 s."""
    spark.range(10).selectExpr("id % 3 as k").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long").parquet(str(tmp_path / "in"))
    got = streams.drain(stream, "t_rows")
    assert sorted(r["k"] for r in got.collect()) == [0, 0, 0, 0, 1, 1, 1, 2, 2, 2] and all("/vellum/" in f for f in got.inputFiles()) and got.inputFiles()
    whole = streams.drain(stream.groupBy("k").count(), "t_counts", "complete")
    assert {r["k"]: r["count"] for r in whole.collect()} == {0: 4, 1: 3, 2: 3} and whole.inputFiles()


def test_shortest_path_reads_its_edges_once(spark):
    """Every step made the links of all pages anew and shuffled them."""
    pages = spark.createDataFrame([(f"p/n{i}.md", f"n{i}", f"[[n{i + 1}]] [[N{i + 1}|x]] [[n{i}]]") for i in range(6)], "path string, stem string, text string")
    links = stored(graph.wiki_links(pages), "t-edges")
    assert sorted(map(tuple, links.collect())) == [(f"p/n{i}.md", f"p/n{i + 1}.md") for i in range(5)] and "/vellum/t-edges" in links.inputFiles()[0]
    found = graph.shortest_path(links, "p/n0.md", "p/n4.md", 4, stored=True)
    assert [r["depth"] for r in found.collect()] == [4] and not graph.shortest_path(links, "p/n0.md", "p/n5.md", 4, stored=True).count()
