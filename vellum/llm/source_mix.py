"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Targets: sources share a budget by weight, none above a multiple of its size.  Blocks of equally many words go to sources
by highest quotients target / (2k + 1); each source's blocks go to its shards the same way, by size.  A shard is a
seeded order of some of its source's documents, cut into blocks; whole passes take every block, and a seeded choice of
the blocks takes the rest.  What a document gives is the sum over the blocks that it lies in.

Only one row a source, then one row a shard, reaches the driver; there are ``MAX_SHARDS`` shards of a source at most.
"""

from __future__ import annotations

import hashlib
import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise

#: Words of a block, words of a shard (about), and shards of a source at most.
BLOCK, SHARD_WORDS, MAX_SHARDS = 32, 250_000, 4_096
WEIGHTS = (3, 1, 2)
#: Spreads the chosen blocks: a prime above any shard's number of blocks.
STEP = 2_147_483_647


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Split ``share`` times the sum of sizes by weight; who would exceed ``most`` times its size stops there and the rest is split anew."""
    out, left, free = [0.0] * len(sizes), share * sum(sizes), list(range(len(sizes)))
    while free:
        unit = left / sum(weights[i] for i in free)
        over = [i for i in free if unit * weights[i] > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = float(unit * weights[i])
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
        free = [i for i in free if i not in set(over)]
    return out


def apportion(votes: list[float], seats: int, caps: list[int]) -> list[int]:
    """Seats by the highest quotients votes / (2k + 1), no party above its cap; ties go to the earlier party."""
    seats = min(seats, sum(c for c, v in zip(caps, votes, strict=True) if v > 0))
    lo, hi = 0.0, 1.0

    def given(scale: float) -> list[int]:
        return [min(c, int(v * scale + 0.5)) for v, c in zip(votes, caps, strict=True)]

    if seats <= 0:
        return [0] * len(votes)
    while sum(given(hi)) < seats:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(given(mid)) < seats else (lo, mid)
    out = [max(0, x - 2) for x in given(lo)]  # surely not too many; the last seats by quotient
    heap = [(-v / (2 * k + 1), i) for i, (v, k, c) in enumerate(zip(votes, out, caps, strict=True)) if v > 0 and k < c]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heappush(heap, (-votes[i] / (2 * out[i] + 1), i))
    return out


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: int = 2, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every document.

    Sources in code point order, null last, take the weights in turn.  Null and empty texts have size 0 and give 0 words;
    so does a source of such texts.  Null ids and repeated rows are rows like others; ties in the seeded order are broken
    by id and size, so equal rows may trade places but the result is the same.  Other columns are not read.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("ord")
    sized = materialise(docs.select("doc_id", "source", size, order), "mix-sizes")

    per = [(r["source"], r["size"], r["n"]) for r in sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()]
    per.sort(key=lambda r: (r[0] is None, (r[0] or "").encode("utf-8", "surrogatepass")))
    goal = targets([r[1] for r in per], [weights[i % len(weights)] for i in range(len(per))], share, most)
    shards = [min(MAX_SHARDS, max(1, -(-r[1] // shard_words))) for r in per]
    by_source = spark.createDataFrame([(s, i, n, t, k) for i, ((s, n, _), t, k) in enumerate(zip(per, goal, shards, strict=True))], "src string, source_no int, source_size long, target double, shards long")
    number = F.conv(F.substring("ord", 1, 8), 16, 10).cast("long")
    dealt = sized.join(F.broadcast(by_source), F.col("source").eqNullSafe(F.col("src"))).drop("src").withColumn("shard", (number % F.col("shards")).cast("int"))

    table = dealt.groupBy("source_no", "shard").agg(F.sum("size").alias("size")).collect()
    own: dict[int, list] = {}
    for r in sorted(table):
        own.setdefault(r["source_no"], []).append((r["shard"], r["size"], -(-r["size"] // block)))
    caps = [most * sum(b for *_, b in own.get(i, [])) for i in range(len(per))]
    quota = apportion(goal, int(sum(goal) / block + 0.5), caps)
    plan = []
    for i, parts in own.items():
        split = apportion([float(n) for _, n, _ in parts], quota[i], [most * b for *_, b in parts])
        for (shard, _, b), q in zip(parts, split, strict=True):
            passes, rest = divmod(q, b) if b else (0, 0)
            plan.append((i, shard, b, passes, rest, _number(f"{seed}|{per[i][0] or ''}|{shard}") % b if b else 0))
    plan_df = spark.createDataFrame(plan, "source_no int, shard int, n_blocks long, passes long, rest long, shift long")
    plan_df = F.broadcast(plan_df) if len(plan) <= 100_000 else plan_df

    w = Window.partitionBy("source_no", "shard").orderBy("ord", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("pos", F.coalesce(F.sum("size").over(w), F.lit(0))).join(plan_df, ["source_no", "shard"])
    extra = F.expr(f"""aggregate(sequence(pos div {block}, (pos + size - 1) div {block}), 0L, (n, b) -> n + if(
        rest > 0 and pmod(b * {STEP}L + shift, n_blocks) < rest, least(pos + size, (b + 1) * {block}) - greatest(pos, b * {block}), 0L))""")
    taken = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("passes") * F.col("size") + extra).cast("long").alias("taken")
    return placed.select("doc_id", "source", "size", "source_size", "target", taken)


#: The same in SQL, with every quotient ranked.
SQL = f"""
with recursive s as (select doc_id, source, md5('mix|' || coalesce(cast(doc_id as varchar), '')) as ord,
    cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as size from documents),
p as (select source, cast(sum(size) as bigint) as source_size, cast(row_number() over (order by source is null, source) - 1 as int) as i from s group by source),
wt as (select *, cast([3, 1, 2][i % 3 + 1] as double) as w, greatest(1, least({MAX_SHARDS}, (source_size + {SHARD_WORDS - 1}) // {SHARD_WORDS})) as shards from p),
knots as (select i, 2.0 * source_size / w as lam, 2.0 * source_size as cap, w from wt),
fill as (select a.i, a.lam, sum(case when b.lam < a.lam then b.cap else 0 end) + a.lam * sum(case when b.lam >= a.lam then b.w else 0 end) as total from knots a, knots b group by a.i, a.lam),
budget as (select 1.5 * sum(source_size) as budget from p),
level as (select (budget - coalesce((select sum(cap) from knots where lam <= m), 0)) / nullif((select sum(w) from knots where lam > m), 0) as lam
    from (select budget, coalesce((select max(lam) from fill where total <= budget), -1) as m from budget)),
t as (select wt.*, least(2.0 * source_size, coalesce((select lam from level), 1e300) * w) as target from wt),
d as (select s.*, t.i, t.source_size, t.target, cast(('0x' || substr(ord, 1, 8)) as bigint) % shards as shard from s join t on s.source is not distinct from t.source),
sh as (select i, shard, sum(size) as size, cast((sum(size) + {BLOCK - 1}) // {BLOCK} as bigint) as b, any_value(source) as source from d group by i, shard),
q1 as (select i, count(*) as quota from (select t.i, row_number() over (order by target / (2 * k + 1) desc, t.i) as r from t join (select i, 2 * sum(b) as cap from sh group by i) c on t.i = c.i, unnest(range(0, cast(cap as bigint))) as u(k) where target > 0)
    where r <= (select cast(floor(sum(target) / {BLOCK} + 0.5) as bigint) from t) group by i),
q2 as (select i, shard, count(*) as q from (select sh.i, shard, quota, row_number() over (partition by sh.i order by cast(size as double) / (2 * k + 1) desc, shard) as r from sh join q1 on sh.i = q1.i, unnest(range(0, 2 * b)) as u(k) where size > 0)
    where r <= quota group by i, shard),
pl as (select sh.i, sh.shard, b, coalesce(q, 0) // nullif(b, 0) as passes, coalesce(q, 0) % nullif(b, 0) as rest, cast(('0x' || substr(md5('mix|' || coalesce(source, '') || '|' || sh.shard), 1, 8)) as bigint) % nullif(b, 0) as shift from sh left join q2 on sh.i = q2.i and sh.shard = q2.shard),
w as (select d.*, coalesce(sum(size) over (partition by i, shard order by ord, doc_id, size rows between unbounded preceding and 1 preceding), 0) as pos from d),
x as (select w.*, b, passes, rest, shift, cast(pos as bigint) as p0 from w join pl on w.i = pl.i and w.shard = pl.shard)
select doc_id, size, source_size, target, cast(case when size = 0 then 0 else passes * size + list_sum(list_transform(range(p0 // {BLOCK}, (p0 + size - 1) // {BLOCK} + 1),
    lambda k: case when (k * {STEP} + shift) % b < rest then least(p0 + size, (k + 1) * {BLOCK}) - greatest(p0, k * {BLOCK}) else 0 end)) end as bigint) as taken
from x
"""
