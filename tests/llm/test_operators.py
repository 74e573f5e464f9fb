"""Every operator against brute force, held-out accuracy or an exact round trip, and on odd tables."""

import base64
import hashlib
import io
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vellum.llm import arc_warc, blobs, bpe, components, fuzzy_lines, gbt_rules, jaccard_join, language_id, mih_search, queries, source_mix, token_records, tree_bpe, zstd_quality

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key long, node long, size int, score double, dropped string, n_lines int, shard int, times int"
rng = random.Random(7)
VOCAB = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(400)]


def prose(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def odd_rows():
    """Nulls everywhere, empty and blank texts, a very long one, ties, repeated rows, and columns named like inner ones."""
    base, line = prose(120), prose(30)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    long = "\n".join(prose(40) for _ in range(2500))
    texts = [base, base, near, None, "", " \t\n ", "tiny text", "tiny text", long, "x" * 100_000, "été ÀÉÎ œuvre 日本語 \x00 nul <|endoftext|> don't  stop\n\n\n  end ", f"{line}\n{prose(9)}", f"{prose(8)}\n{line.upper()}!\n{prose(7)}", line, "123 456 !!! ###"]
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", "a", None][i % 4], len(t) if t else None) for i, t in enumerate(texts)]
    rows += [rows[0], (None, base, None, None, None), (None, None, None, None, None)]
    return [(*r, 1, 2, 3, 0.5, "x", 4, 5, 6) for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def small(spark):
    from conftest import SF

    return {n: spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels", "pages", "embeddings")}


# ---------------------------------------------------------------- 1


def test_arc_lines_of_both_versions():
    for version in (1, 2):
        data = arc_warc.arc_head(version, "f", "20200101000000")
        data += arc_warc.arc_record(version, "http://a/b c\n", "19990102", "text/plain", b"line\nnot a header 1 2 3 4 5\n")
        data += arc_warc.arc_record(version, "", "2001020304050607", "text/html", b"HTTP/1.0 200 OK\r\nX-Row-Id: 5\r\n\r\n\r\n\r\nbody")
        got = list(arc_warc.read_arc(io.BufferedReader(io.BytesIO(data))))
        assert [c.uri for c in got] == ["http://a/b%20c%0A", "-"]
        assert [c.date for c in got] == ["1999-01-02T00:00:00Z", "2001-02-03T04:05:06Z"]
        assert got[0].content.endswith(b"4 5\n") and got[1].split[1] == b"\r\n\r\nbody"
        assert got[1].row_id is None or got[1].row_id == 5
        with pytest.raises(ValueError):
            list(arc_warc.read_arc(io.BufferedReader(io.BytesIO(data[:-20]))))
    assert len(arc_warc.FIELDS[2].split()) == 10


def test_arc_to_warc_round_trip(spark):
    rows = [(1, "http://x/1", "same"), (2, None, "same"), (3, "http://x/3", ""), (4, "u v", None), (5, "é", "été" * 1000), (5, "é", "été" * 1000), (None, "n", "same"), (7, "big", "z" * 3_000_000), (None, None, None), (9, "q", "other")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, file string").repartition(3)
    archives = arc_warc.convert(arc_warc.write_arc(pages, file_bytes=10_000))
    got = sorted(((r["row_id"], r["bytes"], r["digest"], r["type"], r["refers_to"]) for r in arc_warc.scan_warc(archives).collect()), key=str)
    best = defaultdict(lambda: None)
    for i, _, h in rows:
        best[h or ""] = max(filter(None, (best[h or ""], i)), default=None)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        first = i is not None and i == best[h or ""]
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit", None if first else best[h or ""]))
    assert got == sorted(want, key=str)
    least = arc_warc.scan_warc(arc_warc.convert(arc_warc.write_arc(pages), min_bytes=4)).where("bytes < 4").select("type").distinct().collect()
    assert [r["type"] for r in least] == ["response"]
    assert arc_warc.scan_warc(arc_warc.convert(arc_warc.write_arc(pages.limit(0)))).count() == 0


# ---------------------------------------------------------------- 2


def test_statistics_by_hand():
    text = "a b c a b c # x\nline one\nline one\n\n \nLINE $"
    assert gbt_rules.statistics(text)[0] == [14, len(text.replace(" ", "").replace("\n", "")), 2, 1, 6]
    words = [rng.choice("abcd") for _ in range(300)]
    w = Counter(zip(words, words[1:], words[2:]))
    hit = {i + j for i in range(298) if w[tuple(words[i : i + 3])] > 1 for j in range(3)}
    assert gbt_rules.repeat_words([x.encode() for x in words]) == len(hit)
    assert gbt_rules.statistics(None)[0] == [0] * 5


def test_trees_fit_and_obey_constraints():
    x = np.random.default_rng(0).random((3000, 3))
    y = ((x[:, 0] < 0.4) | (x[:, 1] > 0.8)).astype(float)
    model = gbt_rules.fit(x, y, [-1, 0, 1])
    assert ((model.score(x) > 0.5) == y).mean() > 0.97
    line = np.tile(x[:200], (1, 1))
    for j, sign in ((0, -1), (2, 1)):
        previous = None
        for v in np.linspace(0, 1, 21):
            line[:, j] = v
            now = model.margin(line)
            assert previous is None or (sign * (now - previous) >= -1e-9).all()
            previous = now
    assert gbt_rules.fit(x[:0], y[:0], [0, 0, 0]).score(x[:2]).tolist() == [0.5, 0.5]


def test_quality_rules(spark, small, odd, empty):
    labels = small["labels"]
    held = queries.remainder(5) == 0
    model = gbt_rules.train(small["documents"], labels.where(~held))
    got = gbt_rules.quality_rules(small["documents"], model).join(labels.where(held), "doc_id").where("not base_failed").toPandas()
    assert (got["kept"] == (got["quality"] == 1)).mean() > 0.9
    rows = gbt_rules.quality_rules(odd, model).toPandas()
    assert len(rows) == odd.count() and rows["base_failed"].sum() >= 8
    assert gbt_rules.quality_rules(empty, gbt_rules.train(empty, labels.limit(0))).count() == 0


# ---------------------------------------------------------------- 3


def edit_ratio(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(prev[j - 1] if x == y else 1 + min(prev[j], row[-1]))
        prev = row
    return 1 - prev[-1] / max(len(a) + len(b), 1)


def test_similarity():
    for _ in range(200):
        a = [rng.choice("abcde") for _ in range(rng.randint(0, 25))]
        b = [c for c in a if rng.random() > 0.15] + [rng.choice("xyz")] * rng.randint(0, 3)
        assert fuzzy_lines.similar(a, b, 0.8) == (edit_ratio(a, b) >= 0.8 - 1e-9)


def test_fuzzy_lines(spark, odd, empty):
    base = prose(60).split()
    rows = [(i, "\n".join([" ".join([*base[:i], "w%d" % i, *base[i + 1 :]]), prose(6), prose(3)])) for i in range(25)]
    rows += [(100 + i, prose(12) + "\n" + prose(2) + "\n" + " ".join(base)) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = defaultdict(set)
    for r, k in whole_lines(rows):
        want[rows[r][0]].add(k)
    got = {r["doc_id"]: r for r in fuzzy_lines.dedup_lines(docs).collect()}
    assert {i: set(r["dropped"]) for i, r in got.items()} == {i: want[i] for i, _ in rows}
    for i, t in rows:
        assert got[i]["text"] == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i])
    got = fuzzy_lines.dedup_lines(odd)
    assert got.count() == odd.count() and set(got.columns) == set(odd.columns)
    by = {r["doc_id"]: r for r in got.where("doc_id is not null").collect()}
    assert by[3]["text"] is None and by[4]["text"] == "" and by[1]["text"] == ""
    assert sorted(r["text"] == "" for r in got.where("doc_id = 0").collect()) == [False, True]  # one of two equal rows keeps the line
    assert by[12]["dropped"] == [1] and by[13]["dropped"] == [0]
    assert fuzzy_lines.dedup_lines(empty).count() == 0


def whole_lines(rows):
    """Row numbers and lines that go where edit similarity alone links lines of MIN_WORDS words, and equal forms are one."""
    where = defaultdict(set)
    for r, (i, t) in enumerate(rows):
        for k, line in enumerate((t or "").split("\n")):
            if norm := fuzzy_lines.normal(line):
                where[norm].add(((1 << 63) if i is None else i, k, r))
    norms = [n.split() for n in where]
    links = [(i, j) for i in range(len(norms)) for j in range(i) if min(len(norms[i]), len(norms[j])) >= fuzzy_lines.MIN_WORDS and fuzzy_lines.similar(norms[i], norms[j])]
    group = list(range(len(norms)))
    for i, j in links:
        group = [group[j] if g == group[i] else g for g in group]
    found = defaultdict(set)
    for g, at in zip(group, where.values(), strict=True):
        found[g] |= at
    return {(r, k) for at in found.values() for _, k, r in sorted(at)[1:]}


def changed(r, words, share):
    """The words with a share of them changed, dropped or followed by a new one."""
    out = []
    for w in words:
        kind = r.randrange(3) if r.random() < share else None
        out += {None: [w], 0: ["n%d" % r.randrange(10**6)], 1: [], 2: [w, "n%d" % r.randrange(10**6)]}[kind]
    return out


def test_fuzzy_lines_link_by_edit_similarity_alone(spark):
    r = random.Random(11)
    lines = [[r.choice(VOCAB) for _ in range(n)] for n in (5, 6, 8, 11, 16, 20, 25, 40, 80, 200) for _ in range(8)]
    rows = [(i, " ".join(x)) for i, x in enumerate(lines)]
    rows += [(1000 + i, " ".join(changed(r, x, s))) for i, (x, s) in enumerate((x, s) for x in lines for s in (0.04, 0.1, 0.2))]
    rows = [(i, t) for i, t in rows if len(t.split()) >= fuzzy_lines.MIN_WORDS]
    want = {(rows[n][0], k) for n, k in whole_lines(rows)}
    got = {(x["doc_id"], k) for x in fuzzy_lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() for k in x["dropped"]}
    assert len(want) > 100 and got == want


def test_fuzzy_lines_of_words_of_all_frequencies(spark):
    r = random.Random(5)
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(5))  # noqa: E731  digits would all be alike
    words = [name(i) for i in range(3000)]
    odds = [1 / (i + 1) for i in range(3000)]
    rows = []
    for i, n in enumerate(r.choices(range(12, 120), k=150)):
        base = r.choices(words, odds, k=n)
        other = list(base)
        for k in r.sample(range(n), int(0.2 * n)):
            other[k] = r.choices(words, odds)[0] if i % 2 else name(r.randrange(26**5))
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    pairs = [i for i in range(150) if fuzzy_lines.similar(rows[2 * i][1].split(), rows[2 * i + 1][1].split())]
    got = {x["doc_id"] for x in fuzzy_lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() if x["dropped"]}
    assert len(pairs) > 140 and sum(2 * i + 1 in got for i in pairs) >= 0.95 * len(pairs)
    assert got <= {rows[n][0] for n, _ in whole_lines(rows)}


def test_repeated_rows_keep_each_line_once(spark):
    line, other = "one line of six plain words", "another line that stands here alone"
    rows = [(1, f"{line}\n--\n{other}")] * 3 + [(2, line)] + [(None, other + " too")] * 2
    got = [r["text"] for r in fuzzy_lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert sorted(got) == sorted([f"{line}\n--\n{other}", "--", "--", "", "", ""])


def test_short_and_unspaced_lines(spark):
    han = "東京都の天気は晴れで最高気温は二十度です"
    rows = [(1, "All rights reserved\n\nnext"), (2, "all rights reserved!\n\nother one"), (3, han), (4, han.replace("晴", "雨")), (5, "これは別の文章で似ていません"), (6, "Other, one\nall rights")]
    got = {r["doc_id"]: r["dropped"] for r in fuzzy_lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [0], 3: [], 4: [0], 5: [], 6: [0]}


# ---------------------------------------------------------------- 4


def test_compression_quality(spark, small, odd, empty):
    held = queries.remainder(5) == 0
    model = zstd_quality.train(small["documents"], small["labels"].where(~held))
    got = zstd_quality.compression_score(small["documents"], model).join(small["labels"].where(held), "doc_id").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.75  # few labels here; 0.99 on larger tables
    assert got[got["quality"] == 1]["score"].mean() > got[got["quality"] == 0]["score"].mean()
    rows = zstd_quality.compression_score(odd, model).toPandas()
    assert len(rows) == odd.count() and rows["score"].between(0, 1).all()
    assert (np.diff(model.values) >= 0).all() and (np.diff(model.knots) >= 0).all()
    nothing = zstd_quality.train(empty, small["labels"].limit(0))
    assert zstd_quality.compression_score(empty, nothing).count() == 0
    assert zstd_quality.compression_score(odd, nothing).count() == odd.count()


# ---------------------------------------------------------------- 5


def test_unsplit_stretches_of_short_texts_take_the_tree(monkeypatch):
    b, lib, ran = bpe.byte_level(BYTE), Tokenizer.from_file(BYTE), []
    plain_tree = tree_bpe.tree
    monkeypatch.setattr(tree_bpe, "tree", lambda parts, *a: ran.append(len(parts)) or plain_tree(parts, *a))
    r = random.Random(4)
    for text in ("see " + "x" * 200 + " and on", "日本語の長い文章は" * 12, " " + "q" * 65, "don't" + "z" * 80, "a" * 63 + "é", "\n" * 90 + "k", "=" * 300 + " <|endoftext|> " + "9" * 100, *("".join(r.choice("ab é'日\n") for _ in range(40)) + r.choice("xyz日é-5") * r.randrange(20, 200) + " end" for _ in range(300))):
        assert tree_bpe.encode_text(b, text).tolist() == lib.encode(text, add_special_tokens=False).ids
    assert len(ran) > 100 and max(ran) > 2


def test_joins_agree_with_whole_encoding():
    b = bpe.byte_level(BYTE)
    for text in ("x" * 3000, "ab" * 2000, "".join(rng.choice("etaoinshr") for _ in range(5000)), "日本" * 900, "é" * 777):
        raw = text.encode()
        for leaf in (1, 7, 64, 500):
            assert tree_bpe.tree([b.encode_piece(x) for x in tree_bpe.halves(raw, leaf)], b.bytes_of.__getitem__, b.encode_piece) == b.encode_piece(raw)


@pytest.mark.parametrize("part", [64, 32_768])
def test_byte_level_like_the_library(spark, odd, small, empty, part):
    lib = Tokenizer.from_file(BYTE)
    tree_bpe.LEAF_BYTES, kept = 256 if part == 64 else tree_bpe.LEAF_BYTES, tree_bpe.LEAF_BYTES
    docs = odd.select("doc_id", "text").unionByName(small["documents"].select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text").limit(60))
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    want = []
    for i, t in rows:
        ids = lib.encode(t, add_special_tokens=False).ids
        want.append((i, np.array(ids, "<u4").tobytes(), lib.decode(ids, skip_special_tokens=False)))
    got = [(r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in tree_bpe.encode(docs, BYTE, decoded=True, part=part).collect()]
    tree_bpe.LEAF_BYTES = kept
    assert sorted(got, key=str) == sorted(want, key=str)
    assert tree_bpe.encode(empty, BYTE).count() == 0
    back = tree_bpe.decode(tree_bpe.encode(odd.limit(3), BYTE), BYTE).collect()
    assert len(back) == 3


def test_whole_texts_in_one_process():
    lib, b = Tokenizer.from_file(BYTE), bpe.byte_level(BYTE)
    for text in ("  a\n\n b" * 3000, "!!!" * 9000 + " x", " " * 20_000 + "y", "don't " * 9000, "a" * 50_000 + " " + "b" * 50_000 + "\t" * 9000, "12" * 9000):
        assert tree_bpe.encode_text(b, text).tolist() == lib.encode(text, add_special_tokens=False).ids


# ---------------------------------------------------------------- 6


def test_apportion_is_sainte_lague():
    for _ in range(100):
        votes = [rng.choice([0.0, rng.random() * 100, 7.0]) for _ in range(6)]
        caps = [rng.randint(0, 60) for _ in votes]
        seats = rng.randint(0, 150)
        out = [0] * 6
        for _ in range(min(seats, sum(c for c, v in zip(caps, votes) if v > 0))):
            i = max((i for i in range(6) if out[i] < caps[i] and votes[i] > 0), key=lambda i: (votes[i] / (2 * out[i] + 1), -i))
            out[i] += 1
        assert source_mix.apportion(votes, seats, caps) == out


def test_targets_stop_at_twice_the_size():
    goal = source_mix.targets([10, 1000, 1000], [3, 1, 2])
    assert goal == [20.0, (3015 - 20) / 3, 2 * (3015 - 20) / 3]
    assert source_mix.targets([0, 0], [3, 1]) == [0.0, 0.0] and source_mix.targets([], []) == []


def test_mix(spark, odd, empty, small):
    docs = small["documents"].select("doc_id", "text", "source", F.lit(1).alias("pos"), F.lit(2).alias("target"))
    a = source_mix.mix(docs, shard_words=2000).toPandas().sort_values("doc_id")
    b = source_mix.mix(docs.repartition(7), shard_words=2000).toPandas().sort_values("doc_id")
    assert a["taken"].tolist() == b["taken"].tolist()
    assert (a["taken"] <= 2 * a["size"]).all() and (a["taken"] >= 0).all()
    per = a.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"))
    assert ((per["taken"] - per["target"]).abs() <= 0.02 * per["target"] + 32 * 4).all()
    assert abs(a["taken"].sum() - 1.5 * a["size"].sum()) < 0.02 * a["size"].sum()
    rows = source_mix.mix(odd).toPandas()
    assert len(rows) == odd.count() and (rows["taken"] <= 2 * rows["size"]).all()
    assert source_mix.mix(empty).count() == 0


# ---------------------------------------------------------------- 7


@pytest.mark.parametrize("segments", [None, 3])
def test_search_is_exact(spark, segments):
    r = np.random.default_rng(1)
    base = r.normal(size=(12, 64))
    vecs = [(base[i % 12] + r.normal(size=64) * (0.1 if i % 3 else 1.0)).tolist() for i in range(300)]
    rows = [(i, v, 1) for i, v in enumerate(vecs)] + [(1000 + i, vecs[0], 1) for i in range(40)] + [(5000, None, 1), (5001, [1.0], 1), (None, vecs[1], 1), (3, vecs[3], 1), (5002, [None] * 64, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, code int").repartition(4)
    asked = [r for r in rows if r[0] is not None and r[0] % 100 == 0 and r[1] is not None and len(r[1]) == 64 and r[1][0] is not None]
    good = {r[0]: np.array(r[1]) >= 0 for r in rows if r[0] is not None and r[1] is not None and len(r[1]) == 64 and r[1][0] is not None}
    want = set()
    for q, *_ in asked:
        d = sorted((int((good[q] != b).sum()), i) for i, b in good.items() if i != q)[:10]
        want |= {(q, k, i, n) for k, (n, i) in enumerate(d, 1)}
    got = mih_search.top_k(df, df.where("vec_id % 100 = 0"), segments=segments)
    assert {tuple(r) for r in got.collect()} == want
    assert mih_search.top_k(df.limit(0), df.limit(0)).count() == 0


def test_segments_stay_narrow_at_any_size(spark):
    assert all(w <= 16 for e in range(45) for _, w in mih_search.cuts(64, mih_search.count(1 << e)))
    for width, r in ((16, 2), (22, 2), (32, 0), (32, 2), (33, 3)):
        got = spark.range(1).select(mih_search.flipped(F.lit(5).cast("long"), width, r).alias("x")).first()["x"]
        assert sorted(got) == sorted(5 ^ sum(1 << b for b in c) for c in itertools.combinations(range(width), r))


def test_search_of_fewer_rows_than_k(spark):
    df = spark.createDataFrame([(i, [float((-1) ** (i * j % 3)) for j in range(64)]) for i in (0, 1, 2, 100)], "vec_id long, embedding array<double>")
    assert mih_search.top_k(df, df.where("vec_id % 100 = 0")).groupBy("query_id").count().collect() == [(0, 3), (100, 3)] or mih_search.top_k(df, df.where("vec_id % 100 = 0")).count() == 6


# ---------------------------------------------------------------- 8


def brute_viterbi(e, switch):
    v, back = e[0].copy(), []
    for row in e[1:]:
        best = int(v.argmax())
        moved = v[best] - switch > v
        back.append(np.where(moved, best, np.arange(len(v))))
        v = np.where(moved, v[best] - switch, v) + row
    path = [int(v.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def test_viterbi():
    r = np.random.default_rng(3)
    count = np.array([0, 1, 50, 7, 0, 200])
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    e = r.normal(size=(count.sum(), 4)) * 3
    got = language_id.viterbi(e, first, count, 4.0)
    for a, n in zip(first, count):
        if n:
            assert got[a : a + n].tolist() == brute_viterbi(e[a : a + n], 4.0)


def test_language_held_out(small, odd, empty, spark):
    docs = small["documents"]
    model = language_id.train(docs.where(queries.remainder(4) != 2))
    got = language_id.language_id(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(queries.remainder(4) == 2).toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.95
    by = {r["lang"]: r["text"] for r in docs.where("n_chars between 400 and 900 and lang is not null").collect()}
    mixed = spark.createDataFrame([(1, by["en"] + "\n" + by["de"])], "doc_id long, text string")
    spans = [s["lang"] for s in language_id.language_id(mixed, model).first()["spans"]]
    assert spans[0] == "en" and spans[-1] == "de" and len(spans) <= 4
    rows = {(r["doc_id"], r["lang_pred"]) for r in language_id.language_id(odd, model).collect()}
    assert {(3, "und"), (4, "und"), (5, "und"), (14, "und"), (None, "und")} <= rows and len(rows) >= 17
    carried = language_id.language_id(odd, model, ("doc_id", "text", "node"))
    assert carried.columns == ["doc_id", "text", "node", "lang_pred", "score", "spans"] and carried.count() == odd.count()
    nothing = language_id.train(empty)
    assert language_id.language_id(odd, nothing).select("lang_pred").distinct().collect()[0][0] == "und"
    assert language_id.language_id(empty, model).count() == 0


def test_scripts_narrow_candidates(spark):
    rows = [(i, t, x) for i, (t, x) in enumerate([("привет мир как дела", "ru"), ("hello world how are you", "en"), ("γεια σου κόσμε", "el")] * 20)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = language_id.identify(["мир", "world", "σου", "日本語", "мир world мир мир мир мир мир"], model)
    assert [g[0] for g in got[:3]] == ["ru", "en", "el"] and got[3][0] in model.langs and got[4][0] == "ru"


# ---------------------------------------------------------------- 9


def test_records_like_the_library(spark, odd, small, empty):
    lib = Tokenizer.from_file(WORD)
    docs = odd.select("doc_id", "text").where("doc_id is not null").unionByName(small["documents"].select((F.col("doc_id") + 1000).alias("doc_id"), "text").limit(80))
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0], r[1] is not None, r[1] or ""))
    manifest = token_records.write_records(docs.repartition(5), WORD, shard_rows=17)
    got = token_records.checksums(token_records.read_records(manifest)).collect()
    start, want = 0, []
    for i, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got)) == sorted(want)
    m = manifest.where("shard = 1").first()
    index = np.frombuffer(blobs.reader(m["index"]).read(), "<u8").reshape(-1, 2)
    file = blobs.reader(m["file"])
    for k in rng.sample(range(len(index)), len(index)):
        assert len(token_records.read_record(file, int(index[k, 0]))[1]) == index[k, 1]
    nulls = token_records.write_records(odd.where("doc_id is null"), WORD)
    assert [r["doc_id"] for r in token_records.read_records(nulls).collect()] == [None, None]
    assert token_records.read_records(token_records.write_records(empty, WORD)).count() == 0


def test_damage_is_found():
    good = token_records.pack(7, np.arange(5, dtype="<u2").tobytes(), 2)
    assert token_records.read_record(io.BytesIO(good))[1].tolist() == [0, 1, 2, 3, 4]
    for at in (0, 9, 15, len(good) - 1):
        with pytest.raises((ValueError, OverflowError)):
            token_records.read_record(io.BytesIO(good[:at] + bytes([good[at] ^ 1]) + good[at + 1 :]))


def test_words_like_the_library_on_every_code_point():
    lib, own = Tokenizer.from_file(WORD), bpe.word_end(WORD)
    points = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0x20000, 0x110000, 97)]
    for i in range(0, len(points), 400):
        text = " ".join(f"a{c}b {c}1" for c in points[i : i + 400])
        assert np.frombuffer(own.encode_all([text])[0], own.dtype).tolist() == lib.encode(text, add_special_tokens=False).ids, i
    r = random.Random(2)
    for _ in range(300):
        text = "".join(r.choice("ΑΒΣςσΟΔ abİıß'.") for _ in range(60))
        assert np.frombuffer(own.encode_all([text])[0], own.dtype).tolist() == lib.encode(text, add_special_tokens=False).ids
    assert own.n_slow > 0


# ---------------------------------------------------------------- 10


def brute_jaccard(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies():
    rows, i = [], 0
    for _ in range(12):  # chains of growing distance, dense groups, shared passages
        words, passage = prose(rng.randint(20, 150)).split(), prose(60)
        for _ in range(rng.randint(1, 14)):
            rows.append((i, " ".join(words) + (" " + passage if rng.random() < 0.2 else "")))
            i += 1
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(words))
                words = [*words[:k], rng.choice(VOCAB), *words[k + rng.randint(0, 1) :]]
    return [*rows, (i, "One two"), (i + 1, "one  TWO"), (i + 2, ""), (i + 3, None), (i + 4, None), (i + 5, "a b c d e")]


def test_jaccard_join(spark, odd, empty):
    rows = near_copies()
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, node long, size long").repartition(4)
    want = brute_jaccard(rows)
    assert len({c for _, c in want.values()}) < len(rows) - 20
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_groups(docs).collect()}
    assert got == want
    out = jaccard_join.jaccard_groups(odd).collect()
    assert len(out) == odd.count() and {r["component_id"] for r in out if r["doc_id"] in (0, 1, 2)} == {0}
    assert all(r["component_id"] is None for r in out if r["doc_id"] is None)
    assert jaccard_join.jaccard_groups(empty).count() == 0


def test_jaccard_join_of_small_chunks_and_hot_lists(spark, monkeypatch):
    rows = near_copies() + near_copies()
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for chunk, hot in ((400, 1), (4_000, 3), (10**6, 2)):
        monkeypatch.setattr(jaccard_join, "CHUNK", chunk)
        monkeypatch.setattr(jaccard_join, "HOT", hot)
        monkeypatch.setattr(jaccard_join, "BUCKET", 500)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_groups(docs).collect()} == brute_jaccard(rows)


def test_leaders_come_of_the_largest_components(spark):
    # a component of 40 among 300 nodes on their own: each of these meets some of it, in blocks cut by Arrow batches too
    rows = [(b, 1000 * b + i, 50, 7 if i < 40 else 1000 * b + i, bytes(8)) for b in (1, 2) for i in range(340)]
    frame = spark.createDataFrame(rows, "block long, node long, size long, comp long, bits binary")
    every = lambda n, m, x, y: np.ones(len(n), bool)
    got = {(r["a"], r["b"]) for r in jaccard_join.block_pairs(frame, 16, every).collect()}
    big = lambda x: x % 1000 < 40
    assert all(a < b and a // 1000 == b // 1000 and not (big(a) and big(b)) for a, b in got)
    met = {(a if big(b) else b) for a, b in got if big(a) != big(b)}
    assert met == {r[1] for r in rows if not big(r[1])}
    assert len(got) <= 2 * 16 * 340
    assert len(jaccard_join.block_pairs(frame, None, every).collect()) == 2 * (340 * 339 - 40 * 39) // 2


def test_prefixes_hold_the_rarest_shared_ngrams(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CHUNK", 300)
    monkeypatch.setattr(jaccard_join, "HOT", 2)
    passage = prose(20)
    rows = [(i, f"{prose(100)} {passage}") for i in range(12)] + [(20 + i, f"{passage} {prose(2)}") for i in range(3)]
    got = {r["doc_id"]: r for r in jaccard_join.incidence(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), 5, 80).collect()}
    # long documents have enough n-grams of their own; short ones must enter by the passage
    assert all(len(got[i]["prefix"]) == 0 for i in range(12)) and all(len(got[20 + i]["prefix"]) > 0 for i in range(3))
    assert all(got[i]["size"] == len({tuple(w[k : k + 5]) for w in [t.split()] for k in range(len(w) - 4)}) for i, t in rows)


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (-5, 120)]
    got = {r["node"]: r["comp"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[100 + i] for i in range(40)} == {-5}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_line_words_are_counted_in_all_documents(spark):
    """Beyond 10,000 documents the words of a sample were counted, and the 100,000 most frequent kept."""
    docs = spark.range(20_000).selectExpr("id as doc_id", "concat('every ', 'of', id % 50, if(id % 5000 = 7, ' seldom', '')) as text")
    hashes, logs, _ = fuzzy_lines.frequencies(docs)
    words = fuzzy_lines.words_of(b"every seldom")[0]
    got = dict(zip(hashes.tolist(), logs.tolist(), strict=True))
    total = 40_004
    assert [got[h] for h in words.tolist()] == [int(np.log2(n / total * 2**21)) for n in (20_000, 4)]


def test_trim_searches_imported_modules_once():
    """Each task of Python spent about 50 ms on modules that stay, half of what a small task took."""
    import gc

    from vellum.llm import common

    gc.unfreeze()
    try:
        common.trim()
        assert gc.get_freeze_count() > 10_000
        frozen, cycle = gc.get_freeze_count(), []
        cycle.append(cycle)
        common.trim()
        assert gc.get_freeze_count() <= frozen
    finally:
        gc.unfreeze()


def test_components_take_few_rounds(spark, monkeypatch):
    """A chain of 200 links in the order of its nodes; labels that halve their way took a round for each, with four shuffles of all links."""
    made = []
    monkeypatch.setattr(components, "materialise", lambda df, tag, f=components.materialise: (made.append(f(df, tag)), made[-1])[1])
    edges = [(i, i + 1) for i in range(200)] + [(1000 + 2 * i, 1001 + 2 * i) for i in range(300)]
    sizes = []
    monkeypatch.setattr(components, "release", lambda *frames: sizes.extend(x.count() for x in frames if x.columns == ["a", "b"]))
    got = {r["node"]: r["comp"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 + i - i % 2 for i in range(600)}
    assert sizes[0] == 500 and sum(sizes) < 1200  # links that are read in all rounds together


def test_blocks_by_size_give_the_same_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "ROWS", 30)
    near, close = fuzzy_lines.near(0.8), fuzzy_lines.close(0.8)
    rows = [(1, i, 10 if i < 50 else 100, i, bytes(32)) for i in range(100)] + [(2, 1000 + i, 10, 7, bytes(32)) for i in range(50)]
    table = spark.createDataFrame(rows, "block long, node long, size long, comp long, bits binary")
    want = {(i, j) for i in range(100) for j in range(i + 1, 100) if (i < 50) == (j < 50)}
    for f in (None, close):
        assert {(r["a"], r["b"]) for r in jaccard_join.block_pairs(table, None, near, f).collect()} == want


def test_word_hashes_of_any_length():
    words = [b"a" * n + b"b" * (k % 2) for n in (1, 7, 8, 9, 15, 16, 17, 63, 64, 65, 200) for k in (0, 1)] + ["é".encode() * 9, b"x"]
    raw = b"\n " + b"  ".join(words) + b"\n"
    hashes, begins = fuzzy_lines.words_of(raw)
    assert [raw[b : b + len(w)] for b, w in zip(begins.tolist(), words, strict=True)] == words
    assert len(set(hashes.tolist())) == len(set(words))
    assert [int(fuzzy_lines.words_of(w)[0][0]) for w in words] == hashes.tolist()
