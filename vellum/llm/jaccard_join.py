"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

Documents of equal n-gram sets are one node.  The incidence is cut into blocks of documents by n-grams, and these give
how many documents hold each n-gram.  A node enters the blocks of its prefix only, its rarest n-grams: with so many
missing, no overlap could reach the threshold.  So n-grams of one document make no entry, and passages that documents
share make none in documents that hold enough else.  Within blocks the product accumulates, for each pair, how many
n-grams of their prefixes they share; pairs below what their sizes demand are discarded, and the rest get their whole
overlap counted.

A dense group would fill a block with all its pairs.  So the product runs twice: first each node meets only the leaders
of its blocks, and what links is joined into components; then only nodes of different components meet.  No link between
components is lost, and members of one component need no second proof.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, bound_batches, column, materialise, release, texts
from .components import components

#: Incidences of a bucket and of a chunk, about, and documents of a chunk beyond which an n-gram's list stays there.
BUCKET, CHUNK, HOT = 1_000_000, 3_000_000, 16
#: Kinds of rows between chunks and buckets, in the order in which a chunk reads them.
DOCS, LISTS, COUNTS, SLICE = range(4)
#: Up to so many document ids are broadcast to fetch their texts; beyond, texts are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Shares that the partners of one node are split into.
SALTS = 16
#: Rows of blocks that are paired at a time.
ROWS = 50_000
#: Words kept with their hashes in a task; beyond, the store starts anew.
KEEP = 200_000
#: Bits of a set's bitmap, and leaders of a block that the second round tries.
BITMAP, LEADERS = 1024, 16
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of the n-word shingles of a text (ASCII letters lower-cased)."""

    def __init__(self, n: int = 5):
        self.n, self.kept = n, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < self.n:
            return np.array([xxhash.xxh3_64_intdigest(b"\0".join([b"short", *words]))], np.uint64)
        if len(self.kept) > KEEP:
            self.kept = {}
        kept = self.kept
        for w in set(words).difference(kept):
            kept[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(kept.__getitem__, words), np.uint64, len(words))
        k = len(h) - self.n + 1
        acc = h[:k].copy()
        for i in range(1, self.n):
            acc = acc * _M + h[i : i + k]
        return np.unique(_mix(acc))


def need(n: int, percent: int) -> int:
    """The least overlap that a set of n can have with any that it links to."""
    return -(-n * percent // 100)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def incidence(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, size, node, bits and prefix of every document, the prefix by how many documents hold an n-gram.

    The documents of a task form chunks; a chunk's incidence, sorted by n-gram, is cut into buckets of the hash range.  A
    bucket counts the documents of each of its n-grams over all chunks and answers each chunk with those that others hold
    too; from the answers a chunk makes its prefixes, rarest n-grams first.  N-grams of one document are no one's partner,
    so they fill places of a prefix and are left out of it.  What more than ``HOT`` documents of a chunk hold stays there
    as a list, and its bucket gets the count alone.

    ``bits`` has the parity of the number of n-grams that fall on each of BITMAP places: two sets differ in at least as
    many n-grams as their bitmaps differ in bits.  Equal sets of a chunk have one prefix, that of the first.
    """
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    cut = max(3, min(20, math.ceil(math.log2(max(chars / 6 / BUCKET, 1)))))
    chunk_size, spread = CHUNK if cut < 16 else max(CHUNK, 32 << cut), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = "kind int, deal long, chunk long, bucket int, a binary, b binary, c binary, d binary, e binary"
    names = [x.split()[0] for x in kinds.split(", ")]

    def rows(out: list[tuple]) -> pa.RecordBatch:
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 5)
        return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, part, turn = Shingler(n), TaskContext.get().partitionId(), 0
        sets, held, place, seen = [], [], 0, {}  # held: doc_id, node, size, bitmap, place of each document

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sets, held, place, seen, turn
            chunk, turn = (part << 32) + turn, turn + 1
            ids, node, size, bits, at = zip(*held, strict=True)
            known = np.array([x is not None for x in ids], bool)
            ids = np.array([x or 0 for x in ids], np.int64)
            yield rows([(DOCS, chunk, chunk, -1, ids.tobytes(), known.tobytes(), np.array(node, np.uint64).tobytes() + np.array(size, np.int64).tobytes(), b"".join(bits), np.array(at, np.int64).tobytes())])
            if sets:
                v = np.sort(np.concatenate(sets))
                sets = []
                edge = np.searchsorted(v, np.arange(1 << cut, dtype=np.uint64) << np.uint64(64 - cut)).tolist() + [len(v)]
                key, doc = ((v << np.uint64(cut)) >> np.uint64(32)).astype(np.uint32), (v & np.uint64(0xFFFF)).astype(np.uint16)
                if cut > 16:  # the lowest bits of such keys would be those of places
                    key &= np.uint32(0xFFFFFFFF << (cut - 16) & 0xFFFFFFFF)
                out, size = [], 0
                for bucket, (x, y) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
                    if x == y:
                        continue
                    k, d = key[x:y], doc[x:y]
                    begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
                    count = np.diff(np.append(begin, len(k)))
                    if count.max() > HOT:
                        hot = np.repeat(count > HOT, count)
                        lists = (k[begin[count > HOT]].tobytes(), count[count > HOT].astype(np.uint32).tobytes())
                        out.append((LISTS, chunk, chunk, bucket, *lists, d[hot].tobytes(), None, None))
                        out.append((COUNTS, bucket, chunk, bucket, *lists, None, None, None))
                        k, d = k[~hot], d[~hot]
                    out.append((SLICE, bucket, chunk, bucket, k.tobytes(), d.tobytes(), None, None, None))
                    size += 6 * (y - x)
                    if size > 8_000_000:
                        yield rows(out)
                        out, size = [], 0
                if out:
                    yield rows(out)
            sets, held, place, seen = [], [], 0, {}

        count = 0
        for batch in batches:
            for t, doc in zip(texts(batch), texts(batch, "doc_id"), strict=True):
                s = shingle(t)
                if not len(s) or doc is None:
                    held.append((doc, 0, len(s), bytes(BITMAP // 8), -1))
                else:
                    node = xxhash.xxh3_64_intdigest(s.tobytes())
                    bits = np.packbits(np.bincount((s & np.uint64(BITMAP - 1)).astype(np.int64), minlength=BITMAP) & 1).tobytes()
                    held.append((doc, node, len(s), bits, -1 if node in seen else place))
                    if node not in seen:
                        seen[node] = place
                        sets.append((s >> np.uint64(16) << np.uint64(16)) | np.uint64(place))
                        place, count = place + 1, count + len(s)
                if count >= chunk_size or place >= 65_535 or len(held) >= 200_000:
                    yield from flush()
                    count = 0
        if held:
            yield from flush()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            key = np.concatenate([np.frombuffer(x[4], "<u4") for x in held])
            weight = np.concatenate([np.frombuffer(x[5], "<u4") if x[0] == COUNTS else np.ones(len(x[4]) // 4, np.uint32) for x in held])
            by = np.argsort(key, kind="stable")
            begin = np.flatnonzero(np.concatenate([[True], key[by[1:]] != key[by[:-1]]])) if len(key) else np.zeros(0, np.int64)
            total = np.add.reduceat(weight[by], begin, dtype=np.int64) if len(key) else begin
            df = np.empty(len(key), np.int64)
            df[by] = np.repeat(total, np.diff(np.append(begin, len(key))))
            out, at = [], 0
            for kind, _, chunk, _, keys, places, *_ in held:
                mine = slice(at, at := at + len(keys) // 4)
                many = df[mine] >= 2
                if many.any():
                    found = np.frombuffer(keys, "<u4")[many].tobytes(), df[mine][many].astype("<u4").tobytes()
                    out.append((kind, chunk, chunk, bucket, *found, np.frombuffer(places, "<u2")[many].tobytes() if kind == SLICE else None, None, None))
            if out:
                yield rows(out)

        for batch in batches:
            forward = []
            for row in zip(*(texts(batch, c) for c in names), strict=True):
                if row[0] in (DOCS, LISTS):
                    forward.append(row)
                    continue
                if row[3] != bucket:
                    if held:
                        yield from done()
                    bucket, held = row[3], []
                held.append(row)
            if forward:
                yield rows(forward)
        if held:
            yield from done()

    def prefixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            (_, _, _, _, a, b, c, bits, e), *more = held
            ids, known, at = np.frombuffer(a, "<i8"), np.frombuffer(b, bool), np.frombuffer(e, "<i8")
            node, size = np.frombuffer(c[: 8 * len(ids)], "<i8"), np.frombuffer(c[8 * len(ids) :], "<i8")
            keys, dfs, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            lists = {x[3]: x for x in more if x[0] == LISTS}
            for kind, _, _, bucket, k, df, d, *_ in more:
                if kind == LISTS:
                    continue
                k, df = np.frombuffer(k, "<u4"), np.frombuffer(df, "<u4").astype(np.int64)
                if kind == COUNTS:
                    own = lists[bucket]
                    k, count, d = (np.frombuffer(own[i], t) for i, t in ((4, "<u4"), (5, "<u4"), (6, "<u2")))
                    k, df = np.repeat(k, count), np.repeat(df, count)
                else:
                    d = np.frombuffer(d, "<u2")
                keys.append(k.astype(np.int64) + (bucket << 32)), dfs.append(df), places.append(d.astype(np.int64))
            key, df, place = map(np.concatenate, (keys, dfs, places))
            by = np.lexsort((key, df, place))
            key, place = key[by], place[by]
            first = np.flatnonzero(at >= 0)  # documents with a set of their own, by place
            begin, end = np.searchsorted(place, np.arange(len(first))), np.searchsorted(place, np.arange(len(first)), side="right")
            alone = size[first] - (end - begin)
            # of the prefix, what is left beside the n-grams of one document
            take = np.clip(size[first] - -(-size[first] * percent // 100) + 1 - alone, 0, end - begin)
            prefix = [None] * len(ids)
            for i, x, k in zip(first.tolist(), begin.tolist(), take.tolist(), strict=True):
                prefix[i] = key[x : x + k]
            some, wide = known & (size > 0), BITMAP // 8
            for x in range(0, len(ids), 5000):
                y = min(x + 5000, len(ids))
                yield pa.record_batch([
                    pa.array(ids[x:y], mask=~known[x:y]), pa.array(size[x:y]), pa.array(node[x:y], mask=~some[x:y]),
                    pa.array([bits[wide * i : wide * i + wide] if some[i] else None for i in range(x, y)], pa.binary()), pa.array(prefix[x:y], pa.list_(pa.int64())),
                ], ["doc_id", "size", "node", "bits", "prefix"])

        for batch in batches:
            for row in zip(*(texts(batch, c) for c in names), strict=True):
                if row[2] != chunk:
                    if held:
                        yield from done()
                    chunk, held = row[2], []
                held.append(row)
        if held:
            yield from done()

    slices = docs.select("doc_id", "text").mapInArrow(chunked, kinds)
    # chunks go by their own numbers, which begin beyond those of buckets
    answers = slices.repartition(spread, "deal", F.col("kind").isin(DOCS, LISTS)).sortWithinPartitions("bucket", "chunk", "kind").mapInArrow(counted, kinds)
    return answers.repartition(spread, "chunk").sortWithinPartitions("chunk", "kind", "bucket").mapInArrow(prefixed, "doc_id long, size long, node long, bits binary, prefix array<long>")


def fits(a: str, b: str, percent: int) -> F.Column:
    """Sizes close enough for a link."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def alike(percent: int) -> Callable[..., np.ndarray]:
    """Sizes that fit, and bitmaps that leave room for enough overlap."""

    def f(n: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        far = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
        return (np.minimum(n, m) * 100 >= np.maximum(n, m) * percent) & (far * (100 + percent) <= (n + m) * (100 - percent))

    return f


def enough(c: str, a: str, b: str, percent: int) -> F.Column:
    """Could a pair of sizes a and b with c common n-grams in their prefixes link?  Beyond the prefixes a set has
    ``need`` - 1 n-grams, and overlap * (100 + percent) must reach percent * (a + b)."""
    rest = lambda x: F.ceil(F.col(x) * percent / 100) - 1
    return (F.col(c) + F.greatest(rest(a), rest(b))) * (100 + percent) >= (F.col(a) + F.col(b)) * percent


def block_pairs(rows: DataFrame, leaders: int | None, fit: Callable[..., np.ndarray], close: Callable[..., np.ndarray] | None = None) -> DataFrame:
    """Pairs a, b (with a_size, b_size) of rows (block, node, size, comp, bits) that share a block and may link.

    They are of different components, and ``fit`` says of arrays of sizes and bitmaps which pairs may link.  ``close``
    may say so of sizes alone; one that is too small for another must be so for all larger ones.  With
    ``leaders`` only pairs with one of so many nodes of each block: some of each of its largest components, then of the
    next, by a seeded order.  A pair comes once a block.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ("block", "node", "size", "comp")

    def led(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        turn = _mix(x["node"].view(np.uint64) + _M)
        by = np.lexsort((turn, x["comp"], x["block"]))
        begin = np.flatnonzero(np.concatenate([[True], (np.diff(x["block"][by]) != 0) | (np.diff(x["comp"][by]) != 0)]))
        count = np.diff(np.append(begin, len(by)))
        tier, many = np.empty(len(by), np.int64), np.empty(len(by), np.int64)
        tier[by] = (np.arange(len(by)) - np.repeat(begin, count)) // max(leaders // 4, 1)
        many[by] = np.repeat(count, count)
        order = np.lexsort((turn, -many, tier, x["block"]))
        return {c: v[order] for c, v in x.items()}

    def pairs(x: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        # blocks of one component are done
        begin = np.flatnonzero(np.concatenate([[True], x["block"][1:] != x["block"][:-1]]))
        several = np.minimum.reduceat(x["comp"], begin) != np.maximum.reduceat(x["comp"], begin)
        rows = np.repeat(several, np.diff(np.append(begin, len(x["block"]))))
        x = {c: v[rows] for c, v in x.items()}
        if not len(x["block"]):
            return
        by = None if leaders else np.lexsort((x["size"], x["block"]))
        x = led(x) if leaders else {c: v[by] for c, v in x.items()}
        at = np.arange(len(x["block"]))
        begins = np.concatenate([[True], x["block"][1:] != x["block"][:-1]])
        start = np.maximum.accumulate(np.where(begins, at, 0))
        edge = np.concatenate([np.flatnonzero(begins)[1:], [len(at)]])
        longest = int((edge - np.flatnonzero(begins)).max())
        j = at
        for k in range(leaders or longest):
            if not len(j):
                break
            # the k-th of the block with all after it; or every row with the one k + 1 before; rows that have none are done
            j = j[start[j] + k < j]
            i = start[j] + k if leaders else j - k - 1
            a, b = i, j
            if close:
                ok = close(x["size"][i], x["size"][j])
                a, b = i[ok], j[ok]
                if not leaders:
                    j = b  # rows further ahead are smaller still
            ok = x["comp"][a] != x["comp"][b]
            a, b = a[ok], b[ok]
            ok = fit(x["size"][a], x["size"][b], x["bits"][a], x["bits"][b])
            a, b = a[ok], b[ok]
            if len(a):
                swap = x["node"][a] > x["node"][b]
                a, b = np.where(swap, b, a), np.where(swap, a, b)
                yield pa.record_batch([pa.array(x[c][y]) for y in (a, b) for c in ("node", "size")], ["a", "a_size", "b", "b_size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        n_held, most = 0, ROWS
        for batch in batches:
            if not batch.num_rows:
                continue
            new = {c: column(batch, c).to_numpy(zero_copy_only=False) for c in names}
            new["bits"] = np.frombuffer(b"".join(texts(batch, "bits")), np.uint64).reshape(batch.num_rows, -1)
            held.append(new)
            n_held += batch.num_rows
            if n_held < most:
                continue
            x = {c: np.concatenate([y[c] for y in held]) for c in new}
            cut = int(np.searchsorted(x["block"], x["block"][-1]))  # the last block may go on in the next batch
            if cut:
                yield from pairs({c: v[:cut] for c, v in x.items()})
            held, n_held = [{c: v[cut:] for c, v in x.items()}], n_held - cut
            most = max(ROWS, 2 * n_held)  # a large block isn't copied again with every batch
        if held:
            yield from pairs({c: np.concatenate([y[c] for y in held]) for c in held[0]})

    dealt = rows.select(*names, "bits").repartition(n, "block").sortWithinPartitions("block", "node")
    return dealt.mapInArrow(run, "a long, a_size long, b long, b_size long")


def verify(pairs: DataFrame, docs: DataFrame, named: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link: whole overlaps, counted where the first one's set meets its partners, in SALTS shares.

    Only the nodes of the pairs have their sets made again, each from its first document.
    """
    involved = materialise(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(named, "node").select(F.col("first").alias("doc_id")), "jaccard-involved")
    ids = F.broadcast(involved) if involved.count() <= BROADCAST_IDS else involved
    sets = materialise(packed(docs.join(ids, "doc_id"), words), "jaccard-sets")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partners = pairs.join(sets.select(F.col("node").alias("b"), "packed"), "b").select("a", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("salt"), "b", "packed")
    firsts = pairs.select("a", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("salt")).distinct().join(sets.select(F.col("node").alias("a"), "packed"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "packed")

    def overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            out = []
            for a, b, packed in zip(texts(batch, "a"), texts(batch, "b"), texts(batch, "packed"), strict=True):
                s = np.frombuffer(packed, "<u8")
                if b is None:
                    own = s
                    continue
                both = len(np.intersect1d(own, s, assume_unique=True))
                if both * 100 >= percent * (len(own) + len(s) - both):
                    out.append((a, b))
            if out:
                yield pa.record_batch(list(map(pa.array, zip(*out, strict=True))), ["a", "b"])

    # null b sorts first: a set stands before its partners
    return firsts.unionByName(partners).repartition(n, "a", "salt").sortWithinPartitions("a", "salt", "b").mapInArrow(overlaps, "a long, b long")


def jaccard_groups(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) for every document.

    Two documents link when 100 * overlap >= percent * union of their sets of n-word shingles; fewer words make one
    shingle of them all.  Null and empty texts, and texts of blanks, have an empty set, link with nothing and are their
    own component.  Rows without an id link with nothing either, and their component is null.  Repeated rows and ties are
    copies like others.  An empty table gives no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select("doc_id", "text")
    node = materialise(incidence(docs, n, percent), "jaccard-nodes")
    named = node.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.max("size").alias("size"), F.first("bits").alias("bits"))

    entries = node.where("prefix is not null").select("node", "size", F.explode("prefix").alias("block"))
    # a block of sizes that all fit each other, and the block as a whole
    band = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int").alias("band")
    w, wb = Window.partitionBy("block"), Window.partitionBy("block").orderBy("band", "node")
    met = entries.select("block", "node", "size", band).withColumn("lo", F.min("node").over(w)).withColumn("hi", F.max("node").over(w)).where("lo <> hi")
    met = materialise(met.select("block", "node", "size", "band"), "jaccard-blocks")

    leader = F.first(F.struct("node", "size"))
    led = met.withColumn("in_band", leader.over(Window.partitionBy("block", "band").orderBy("node"))).withColumn("in_block", leader.over(wb))
    stars = []
    for k in ("in_band", "in_block"):
        star = led.select("node", "size", F.col(f"{k}.node").alias("a"), F.col(f"{k}.size").alias("a_size")).where(F.col("a") != F.col("node")).where(fits("size", "a_size", percent))
        star = star.groupBy("node", "size", "a", "a_size").agg(F.count("*").alias("c")).where(enough("c", "size", "a_size", percent))
        stars.append(star.groupBy("node").agg(F.max_by("a", F.struct("c", "a")).alias("a")))
    first = materialise(stars[0].unionByName(stars[1]).select("a", F.col("node").alias("b")).distinct(), "jaccard-first")
    links = materialise(verify(first, docs, named, n, percent), "jaccard-links")
    comp = components(links)

    # nodes of different components that share blocks: first some leaders of each block, then all that is left
    for leaders in (LEADERS, None):
        own = met.join(comp, "node", "left").select("block", "node", "size", F.coalesce("comp", "node").alias("comp"))
        spread = own.withColumn("one", F.min("comp").over(w)).withColumn("other", F.max("comp").over(w)).where("one <> other").select("block", "node", "size", "comp").distinct()
        pairs = block_pairs(spread.join(named.select("node", "bits"), "node"), leaders, alike(percent)).groupBy("a", "b", "a_size", "b_size").agg(F.count("*").alias("c")).where(enough("c", "a_size", "b_size", percent))
        if leaders:
            # a node's best leaders may have smaller or larger hashes than it
            rank = lambda x, y: F.row_number().over(Window.partitionBy(x).orderBy(F.desc("c"), y))
            pairs = pairs.withColumn("of_a", rank("a", "b")).withColumn("of_b", rank("b", "a")).where(F.least("of_a", "of_b") <= leaders)
        pairs = materialise(pairs.select("a", "b"), "jaccard-pairs")
        if not pairs.isEmpty():
            more = materialise(verify(pairs, docs, named, n, percent), "jaccard-links")
            links = materialise(links.unionByName(more), "jaccard-links")
            comp = components(links) if not more.isEmpty() else comp
    release(met)

    label = named.join(comp, "node", "left").select("node", "first", F.coalesce("comp", "node").alias("comp"))
    smallest = materialise(label, "jaccard-labels")
    smallest = smallest.join(smallest.groupBy("comp").agg(F.min("first").alias("component_id")), "comp").select("node", "component_id")
    smallest = materialise(smallest, "jaccard-components")
    key = F.coalesce("node", F.xxhash64("doc_id", "size", F.lit("empty")))  # empty sets are spread and meet nothing
    whole = node.select("doc_id", F.col("size").alias("n_shingles"), "node", key.alias("key")).join(smallest.withColumnRenamed("node", "key"), "key", "left")
    return whole.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def packed(docs: DataFrame, n: int) -> DataFrame:
    """node and packed set of some documents, one row a node."""

    def make():
        shingle, seen = Shingler(n), set()

        def f(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            ids, sets = [], []
            for t in texts(batch):
                s = shingle(t)
                node = xxhash.xxh3_64_intdigest(s.tobytes())
                node -= (node >> 63) << 64
                if len(s) and node not in seen:
                    seen.add(node), ids.append(node), sets.append(s.astype("<u8").tobytes())
            return pa.record_batch([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["node", "packed"]) if ids else None

        return f

    return arrow_map(docs.select("text"), make, "node long, packed binary")
