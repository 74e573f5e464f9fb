"""Exact top-k search of binary codes by incremental multi-index hashing.

A code is the signs of a vector.  It is cut into segments, and a table holds every code under each of its segments.
Step s = segments * r + a looks up segment ``a`` of the queries with exactly ``r`` bits flipped; after it, every code
within distance s has been met, as a code further from the query in each segment searched would differ in more bits.
A query is done once its k-th distance is within what is covered.  What a lookup returns is no farther than the k-th
distance known so far, so hot segments make few rows.

Equal codes are one entry with its smallest ids, k + 1 at most: no more can be among k neighbours of a row.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, release

BITS, K, SALTS = 64, 10, 64
#: Radii whose segments are looked up in one go; later ones take a segment at a time.
TOGETHER = 3
#: Bits of a segment at most: its flips are made of all numbers of so many bits, and C(16, 8) of them are few.
WIDEST = 16


def with_code(vectors: DataFrame, bits: int = BITS) -> DataFrame:
    """vec_id and code (signs as a long, null if the vector is null, has another length or a null element)."""
    whole = F.col("embedding").isNotNull() & (F.size("embedding") == bits) & ~F.exists("embedding", lambda x: x.isNull())
    code = F.aggregate("embedding", F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(F.when(x >= 0, F.lit(1)).otherwise(F.lit(0)).cast("long")))
    return vectors.select("vec_id", F.when(whole, code).alias("code"))


def cuts(bits: int, m: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    edge = [bits * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def segment(code: str, low: int, width: int) -> F.Column:
    return F.shiftrightunsigned(code, low).bitwiseAND(F.lit((1 << width) - 1))


def count(n: int, bits: int = BITS) -> int:
    """Segments for n codes: about log2(n) bits each, but no more than WIDEST."""
    return max(2, -(-bits // WIDEST), min(8, round(bits / max(math.log2(max(n, 2)), 1))))


def masks(width: int, r: int) -> str:
    """SQL of the array of all numbers of so many bits of which r are set; wide ones are put together of two halves."""
    if width <= WIDEST:
        return f"filter(sequence(0L, {(1 << width) - 1}L), x -> bit_count(x) = {r})"
    low, high = width // 2, width - width // 2
    parts = [f"flatten(transform({masks(low, i)}, a -> transform({masks(high, r - i)}, b -> a | shiftleft(b, {low}))))" for i in range(max(0, r - high), min(low, r) + 1)]
    return f"concat({', '.join(parts)})"


def flipped(value: F.Column, width: int, r: int) -> F.Column:
    """The value with each choice of r of its bits flipped; the choices are one constant array."""
    return F.transform(F.expr(masks(width, r)), lambda x: x.bitwiseXOR(value))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, bits: int = BITS, segments: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id and distance of the k nearest rows of each query, itself left out, ties by id.

    ``queries`` are rows of the form of ``vectors``.  Rows without an id or a whole vector take no part.  Repeated rows
    are one.  Fewer than k other rows: all of them.  Other columns are not read.
    """
    coded = materialise(with_code(vectors, bits).where("vec_id is not null and code is not null").distinct(), "codes")
    asked = materialise(with_code(queries, bits).where("vec_id is not null and code is not null").distinct(), "code-queries")
    share = Window.partitionBy("code", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).orderBy("vec_id")
    few = coded.withColumn("r", F.row_number().over(share)).where(F.col("r") <= k + 1)
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    index = materialise(few.groupBy("code").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "code-index")
    n = index.count()
    held = index.agg(F.sum(F.size("ids"))).first()[0] or 0
    m = segments or count(n, bits)
    pieces = cuts(bits, m)
    table = F.explode(F.array(*[F.struct(F.lit(i).alias("seg"), segment("code", *c).alias("val")) for i, c in enumerate(pieces)])).alias("s")
    tables = materialise(index.select("code", "ids", table).select("s.seg", "s.val", "code", "ids"), "code-tables")

    best = Window.partitionBy("q").orderBy("dist", F.col("ids")[0])
    found = None
    state = materialise(asked.select(F.col("code").alias("q")).distinct().withColumn("bound", F.lit(bits)), "code-state")
    steps = [[s for s in range(r * m, r * m + m)] for r in range(TOGETHER)] + [[s] for s in range(TOGETHER * m, m * (max(w for _, w in pieces) + 1))]
    for step in steps:
        probes = []
        for s in step:
            r, a = divmod(s, m)
            if r <= pieces[a][1]:
                value = segment("q", *pieces[a])
                probes.append(state.select("q", "bound", F.lit(a).alias("seg"), F.explode(flipped(value, pieces[a][1], r)).alias("val")))
        if not probes:
            continue
        probe = probes[0]
        for p in probes[1:]:
            probe = probe.unionByName(p)
        dist = F.bit_count(F.col("q").bitwiseXOR(F.col("code")))
        met = probe.hint("merge").alias("p").join(tables.alias("t"), (F.col("p.seg") == F.col("t.seg")) & (F.col("p.val") == F.col("t.val")) & (F.bit_count(F.col("q").bitwiseXOR(F.col("code"))) <= F.col("bound"))).select("q", "code", dist.alias("dist"), "ids")
        met = met.unionByName(found) if found is not None else met
        # equal rows come of several segments; k + 1 codes are enough, as each holds an id
        new = met.groupBy("q", "code", "dist").agg(F.first("ids").alias("ids")).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
        new = materialise(new, "code-found")
        if found is not None:
            release(found)
        found = new
        if held <= k + 1 and step[-1] < bits:
            continue  # every row is an answer: nothing bounds the search but the whole of it
        upto = Window.partitionBy("q").orderBy("dist").rangeBetween(Window.unboundedPreceding, 0)
        kth = found.withColumn("n", F.sum(F.size("ids")).over(upto)).where(F.col("n") >= k + 1).groupBy("q").agg(F.min("dist").alias("kth"))
        state = materialise(state.join(kth, "q", "left").select("q", F.least("bound", F.coalesce("kth", F.lit(bits))).alias("bound")).where(F.col("bound") > step[-1]), "code-state")
        if state.isEmpty():
            break
    if found is None:
        found = index.select(F.col("code").alias("q"), "code", F.lit(0).alias("dist"), "ids").limit(0)
    each = found.groupBy("q").agg(F.flatten(F.collect_list(F.transform("ids", lambda x: F.struct(F.col("dist").alias("dist"), x.alias("id"))))).alias("all"))
    own = asked.join(each, F.col("code") == F.col("q")).select(F.col("vec_id").alias("query_id"), "all")
    others = F.slice(F.sort_array(F.filter("all", lambda x: x["id"] != F.col("query_id"))), 1, k)
    out = own.select("query_id", F.posexplode(others).alias("i", "x"))
    return out.select("query_id", (F.col("i") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.dist").cast("int").alias("distance"))


#: The same by comparing every query with every row.
SQL = f"""
with v as (select distinct vec_id, list_transform(embedding, lambda x: x >= 0) as b from embeddings where vec_id is not null and len(embedding) = {BITS} and len(list_filter(embedding, lambda x: x is null)) = 0),
d as (select q.vec_id as query_id, v.vec_id, cast(len(list_filter(range(1, {BITS + 1}), lambda i: q.b[i] <> v.b[i])) as int) as distance from v q, v where q.vec_id % 100 = 0 and q.vec_id <> v.vec_id),
r as (select *, cast(row_number() over (partition by query_id order by distance, vec_id) as int) as rank from d)
select query_id, rank, vec_id, distance from r where rank <= {K}
"""
