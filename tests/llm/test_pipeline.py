"""The pipeline's stages, each against what it should do to its own input."""

import random
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_operators import brute_jaccard, odd_rows, whole_lines, DOCS
from tokenizers import Tokenizer

import corpus_pipeline as p
from vellum.llm import source_mix

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(80).cache()
    assert [n for n, _ in p.STAGES] == ["language_id", "line_dedup", "jaccard_join", "source_mix", "bpe_encode"]
    a = p.identify(spark, docs, SF).cache()
    assert a.columns == p.COLUMNS and a.count() >= 0.97 * docs.count()
    b = p.dedup_lines(spark, a, SF).cache()
    drop = defaultdict(set)
    before = rows_of(a)
    for r, k in whole_lines(before):
        drop[before[r][0]].add(k)
    kept = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop[i]) for i, t in rows_of(a)}
    assert dict(rows_of(b)) == {i: t for i, t in kept.items() if t.split() or not drop[i]}
    c = p.dedup_documents(spark, b, SF).cache()
    groups = brute_jaccard(rows_of(b))
    assert sorted(i for i, _ in rows_of(c)) == sorted(i for i, (_, g) in groups.items() if i == g)
    d = p.mix_sources(spark, c, SF).cache()
    size = lambda t: len(t.encode().split())
    total = sum(size(t) for _, t in rows_of(c))
    assert abs(sum(size(t) for _, t in rows_of(d)) - 1.5 * total) < 0.25 * total
    assert d.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for i, t in rows_of(d)}
    got = p.encode(spark, d, SF).collect()
    assert len(got) == d.count() and all(bytes(r["ids"]) == want[r["doc_id"]] and r["n_tokens"] * 4 == len(r["ids"]) for r in got)


def test_stages_on_odd_and_empty_tables(spark):
    for rows in (odd_rows(), []):
        docs = spark.createDataFrame(rows, DOCS)
        for name, stage in p.STAGES:
            out = stage(spark, docs, SF)
            out.write.mode("overwrite").format("noop").save()
            assert name == "bpe_encode" or out.columns == p.COLUMNS
    docs = spark.createDataFrame(odd_rows(), DOCS)
    assert {i for i, _ in rows_of(p.dedup_documents(spark, docs, SF))} >= {0, 3, 4, None}
    assert 2 not in {i for i, _ in rows_of(p.dedup_documents(spark, docs, SF))}
    assert not {3, 4, 5, 14} & {i for i, _ in rows_of(p.identify(spark, docs, SF))}


def test_texts_that_share_an_id_are_not_lost(spark):
    a, b = " ".join(f"alpha{chr(97 + i % 26)}{i}" for i in range(40)), " ".join(f"beta{chr(97 + i % 26)}{i}" for i in range(40))
    rows = [(5, a), (5, b), (5, a), (7, b), (9, a + " more"), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS.split(", key")[0])
    assert sorted(rows_of(p.dedup_documents(spark, docs, SF)), key=str) == sorted([(5, a), (5, b), (None, a)], key=str)


def test_every_source_comes_near_its_target(spark):
    r = random.Random(3)
    rows = [(i, " ".join(["word"] * r.randint(40, 600)), "en", "abcdefg"[min(r.randrange(12), 6)], 1) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    target = {x["source"]: x["target"] for x in source_mix.mix(docs).select("source", "target").distinct().collect()}
    words = F.sum(F.size(F.split("text", " "))).alias("words")
    got = {x["source"]: x["words"] for x in p.mix_sources(spark, docs, SF).groupBy("source").agg(words).collect()}
    assert set(got) == set(target) and all(abs(got[s] - target[s]) <= 0.02 * target[s] + 600 for s in target)
