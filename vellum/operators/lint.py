"""Page health: hygiene scans, the four score dimensions and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.operators import search
from vellum.schemas import PAGE_TYPES


def inbound(links: DataFrame, pages: DataFrame) -> DataFrame:
    """stem, path, occurrences (self-links left out) and citers (distinct linking pages)."""
    got = links.where(F.col("target") != F.lower("stem")).groupBy(F.col("target").alias("s")).agg(F.count("*").alias("occurrences"), F.countDistinct("path").alias("citers"))
    own = pages.select("stem", "path", "dir", F.lower("stem").alias("s"))
    return own.join(got, "s", "left").select("stem", "path", "dir", F.coalesce("occurrences", F.lit(0)).alias("occurrences"), F.coalesce("citers", F.lit(0)).alias("citers"))


def dead_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    return links.join(pages.select(F.lower("stem").alias("target")), "target", "left_anti").select("path", "raw", "target")


def wanted(links: DataFrame, pages: DataFrame, least: int = 2, limit: int = 20) -> DataFrame:
    """Missing pages by distinct citers."""
    missing = links.join(pages.select(F.lower("stem").alias("target")), "target", "left_anti")
    return missing.groupBy("target").agg(F.countDistinct("path").alias("citers")).where(F.col("citers") >= least).orderBy(F.desc("citers"), "target").limit(limit)


def spaced_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Targets with a blank or a capital that name a page once normalised."""
    odd = links.where(F.col("raw").rlike("[ A-Z]"))
    return odd.join(pages.select(F.lower("stem").alias("target")), "target", "left_semi").select("path", "raw", "target")


def candidates(cited: DataFrame, covered: DataFrame, least: int = 2, keep: int = 10, limit: int = 20) -> DataFrame:
    """Sources cited by enough pages and not covered yet: source, demand, the first citers."""
    open_ = cited.join(covered.select(F.col("path").alias("dst")), "dst", "left_anti")
    got = open_.groupBy(F.col("dst").alias("source")).agg(F.countDistinct("src").alias("demand"), F.slice(F.array_sort(F.collect_set("src")), 1, keep).alias("citers"))
    return got.where(F.col("demand") >= least).orderBy(F.desc("demand"), "source").limit(limit)


def duplicate_slugs(pages: DataFrame) -> DataFrame:
    return pages.groupBy(tx.fuzzy_slug("stem").alias("slug")).agg(F.array_sort(F.collect_list("path")).alias("paths")).where(F.size("paths") > 1)


def frontmatter_issues(pages: DataFrame) -> DataFrame:
    """Pages that lack a required field, or have an unknown type."""
    field = lambda k: tx.frontmatter_field("text", k)
    missing = F.filter(F.array(*[F.when(field(k) == "", F.lit(k)) for k in ("title", "type", "created")]), lambda x: x.isNotNull())
    unknown = (field("type") != "") & ~field("type").isin(PAGE_TYPES)
    return pages.select("path", missing.alias("missing"), unknown.alias("unknown_type")).where((F.size("missing") > 0) | F.col("unknown_type"))


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of one side only: key and side."""
    both = left.select(key).distinct().withColumn("_l", F.lit(1)).join(right.select(key).distinct().withColumn("_r", F.lit(1)), key, "full_outer")
    return both.where("_l is null or _r is null").select(key, F.when(F.col("_l").isNull(), "right").otherwise("left").alias("side"))


def frontier(sources: DataFrame, cited: DataFrame) -> DataFrame:
    """Sources that nothing cites, by their path or its lower case: two anti joins instead of an OR."""
    dst = cited.select(F.col("source").alias("path"))
    return sources.join(dst, "path", "left_anti").join(dst.select(F.col("path").alias("low")), F.lower(sources["path"]) == F.col("low"), "left_anti").select("path")


# ---------------------------------------------------------------- dimensions


def orphan_rate(count: Column) -> Column:
    return F.when(count == 0, 1.0).when(count == 1, 0.66).when(count == 2, 0.33).otherwise(0.0)


def unsourced(text: Column | str) -> Column:
    """Share of the lines of five words or more, outside frontmatter and headings, without a citation."""
    long = lambda x: x.rlike(r"\A[ \t\n\x0b\f\r]*+(?:[^ \t\n\x0b\f\r]++[ \t\n\x0b\f\r]++){4}[^ \t\n\x0b\f\r]") & ~F.ltrim(x).startswith("#")
    none, one = F.struct(F.lit(0).alias("n"), F.lit(0).alias("bare")), lambda s, x: F.struct((s["n"] + 1).alias("n"), (s["bare"] + F.when(x.contains("(vault:"), 0).otherwise(1)).alias("bare"))
    counted = lambda s, x: F.when(long(x), one(s, x)).otherwise(s)
    return F.aggregate(F.split(tx.body(text), "\n"), none, counted, lambda s: F.when(s["n"] == 0, F.lit(0.0)).otherwise(s["bare"] / s["n"]))


def _grams(tokens: Column, n: int, first: list[str | None] = (None,)) -> Column:
    """Phrases of n words, of those that begin with one of ``first`` (None: all)."""
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.array().cast("array<int>"))
    if None not in first:
        starts = F.filter(starts, lambda i: F.get(tokens, i - 1).isin(list(first)))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))


#: Beyond so many first words of stems, all phrases of a text are looked up; bits of the map of stems' phrases, at most (as log2).
FIRST_WORDS, MAP_BITS = 10_000, 27


def _plain(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " "))


def _known(rows: DataFrame, phrases: DataFrame) -> DataFrame:
    """The rows whose phrase may be among ``phrases``: none that is goes, most others do.

    A map of one bit a hash, 16 bits a phrase as long as that stays within 2^MAP_BITS, is broadcast in blocks of 2^16 bits.
    """
    bits = min(MAP_BITS, max(16, (16 * phrases.count()).bit_length()))
    place = F.shiftrightunsigned(F.xxhash64("phrase"), 64 - bits)
    block, cell = F.shiftright("_p", 16).cast("int"), F.shiftright(F.col("_p").bitwiseAND(0xFFFF), 6).cast("int")
    bit = F.expr("cast(_p & 63 as int)")
    own = phrases.select(place.alias("_p")).select(block.alias("_b"), cell.alias("_c"), F.expr("shiftleft(1L, cast(_p & 63 as int))").alias("_v"))
    every = phrases.sparkSession.range(1 << (bits - 6)).select(F.shiftright("id", 10).cast("int").alias("_b"), F.col("id").bitwiseAND(1023).cast("int").alias("_c"), F.lit(0).cast("long").alias("_v"))
    cells = own.unionByName(every).groupBy("_b", "_c").agg(F.bit_or("_v").alias("_v"))
    held = cells.groupBy("_b").agg(F.sort_array(F.collect_list(F.struct("_c", "_v"))).alias("_w")).select("_b", F.col("_w._v").alias("_w"))
    at = rows.withColumn("_p", place).withColumn("_b", block)
    found = at.join(F.broadcast(held), "_b").where(F.call_function("shiftright", F.get("_w", cell), bit).bitwiseAND(F.lit(1).cast("long")) == 1)
    return found.drop("_p", "_b", "_w")


def crossref(pages: DataFrame, least: int = 4) -> DataFrame:
    """path, mentioned, linked and crossref = 1 - linked / mentioned of other pages' stems.

    A mention is a stem's words in the text, as a phrase.  Texts become phrases of as many words as stems have (a few
    lengths reach the driver) that begin with a first word of one, and an equi-join on the phrase replaces the product of
    pages and stems.  Phrases that can't be a stem's are left out before they are shuffled.
    """
    known = pages.where(F.length("stem") >= least).select(F.lower("stem").alias("stem"), _plain("stem").alias("phrase"))
    words = known.select(F.split("phrase", " ").alias("w"))
    begun = words.select(F.size("w").alias("n"), F.get("w", 0).alias("first")).distinct().limit(FIRST_WORDS + 1).collect()
    if len(begun) > FIRST_WORDS:  # many: every phrase of their lengths
        begun = [(r["n"], None) for r in words.select(F.size("w").alias("n")).distinct().collect()]
    begins = {n: [w for m, w in begun if m == n] for n in sorted({n for n, _ in begun})} or {1: [None]}
    tokens = F.split(_plain("text"), " ")
    links = F.transform(tx.links("text"), lambda x: F.struct(_plain(x).alias("phrase"), F.lower(x).alias("stem")))
    texts = pages.select("path", F.lower("stem").alias("own"), _plain("stem").alias("own_phrase"), tokens.alias("t"), links.alias("l"))
    grams = F.array_distinct(F.flatten(F.array(*[_grams(F.col("t"), n, first) for n, first in begins.items()])))
    said = _known(texts.select("path", "own", "own_phrase", "l", F.explode(grams).alias("phrase")), known)
    here = F.transform(F.filter("l", lambda x: x["phrase"] == F.col("phrase")), lambda x: x["stem"])
    said = said.select("path", "phrase", F.when(F.col("own_phrase") == F.col("phrase"), F.col("own")).alias("own"), F.when(F.size(here) > 0, F.array_distinct(here)).alias("l"))
    stems = known.groupBy("phrase").agg(F.collect_set("stem").alias("stems"))
    others = said.join(stems, "phrase").withColumn("stems", F.when(F.col("own").isNull(), F.col("stems")).otherwise(F.array_remove("stems", F.col("own"))))
    linked = F.coalesce(F.size(F.array_intersect("stems", "l")), F.lit(0))
    got = others.select("path", F.size("stems").alias("m"), F.when(F.col("l").isNull(), 0).otherwise(linked).alias("k")).where("m > 0")
    got = got.groupBy("path").agg(F.sum("m").alias("mentioned"), F.sum("k").alias("linked"))
    return pages.select("path").join(got, "path", "left").select("path", F.coalesce("mentioned", F.lit(0)).alias("mentioned"), F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce(1 - F.col("linked") / F.col("mentioned"), F.lit(0.0)).alias("crossref"))


def _extracts(text: Column | str) -> Column:
    """Names of extracts in the frontmatter's sources, a list or a scalar, in order."""
    head = F.regexp_extract(tx.c(text), r"(?s)\A---\n(.*?)\n---", 1)
    field = F.regexp_extract(head, r"(?m)^sources:([^\n]*(?:\n[ \t]*- [^\n]*)*)", 1)
    return F.array_distinct(F.regexp_extract_all(field, F.lit(r"([\w./-]+\.extracted\.md)"), 1))


def stubs_of(stubs: DataFrame) -> DataFrame:
    """source and stub: the first stub (path, text) whose sources name an extract."""
    return stubs.select("path", F.explode(_extracts("text")).alias("source")).groupBy("source").agg(F.min("path").alias("stub"))


def orphan_stubs(pages: DataFrame, incoming: DataFrame, extracts: DataFrame, limit: int = 30, best: int = 3, head: int = 8000) -> DataFrame:
    """stub, inbound and targets: the stubs that fewest pages link, and the concepts and entities they name most.

    Named means in a stub or in the beginning of its first extract (path, text).  Only the stubs reported are searched:
    phrases of as many words as stems have find the stems, then the texts are searched for those.  Ties go by stem, and
    stubs alike in inbound by path.
    """
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " "))
    counts = incoming.select(F.lower("stem").alias("_s"), F.col("occurrences").alias("inbound"))
    stubs = pages.where(F.col("path").startswith("sources/")).select("path", "text", F.lower("stem").alias("_s")).join(counts, "_s", "left")
    worst = stubs.select("path", "text", F.coalesce("inbound", F.lit(0)).alias("inbound")).orderBy("inbound", "path").limit(limit)
    begun = extracts.select(F.col("path").alias("_e"), F.substring("text", 1, head).alias("_x"))
    said = worst.withColumn("_e", F.get(_extracts("text"), 0)).join(begun, "_e", "left").select("path", F.concat_ws("\n", "text", "_x").alias("t"))
    known = pages.where(F.col("path").startswith("concepts/") | F.col("path").startswith("entities/")).where(F.length("stem") >= 3)
    names = known.groupBy(F.lower("stem").alias("stem")).agg(F.min("path").alias("target")).withColumn("phrase", plain("stem"))
    lengths = sorted(r["n"] for r in names.select(F.size(F.split("phrase", " ")).alias("n")).distinct().collect())
    words = said.select("path", F.split(plain("t"), " ").alias("w"))
    grams = words.select("path", F.explode(F.array_distinct(F.flatten(F.array(*[_grams(F.col("w"), n) for n in lengths or [1]])))).alias("phrase"))
    pattern = F.concat(F.lit(r"(?U)\b\Q"), F.replace("stem", F.lit("-"), F.lit(" ")), F.lit(r"\E\b"))
    hits = grams.join(names, "phrase").join(said, "path").select("path", "stem", "target", F.regexp_count(F.lower("t"), pattern).alias("n")).where("n > 0")
    top = hits.groupBy("path").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "stem", "target"))), 1, best).alias("_t"))
    return worst.select("path", "inbound").join(top, "path", "left").select(F.col("path").alias("stub"), F.col("inbound").cast("long").alias("inbound"), F.array_join(F.coalesce(F.col("_t.target"), F.array().cast("array<string>")), ",").alias("targets"))


def scores(pages: DataFrame, links: DataFrame, docs: DataFrame) -> DataFrame:
    """path, dir and the dimensions crossref, orphan, unsourced and coverage, with their composite (0.25 each).

    ``docs`` (doc, text) is the material that pages should cite.
    """
    pointed = links.where(F.col("target") != F.lower("stem")).select("target", "path").distinct().groupBy(F.col("target").alias("s")).agg(F.count("*").alias("citers"))
    count = pages.select("path", F.lower("stem").alias("s")).join(pointed, "s").select("path", "citers")
    own = pages.select("path", "stem", "dir", unsourced("text").alias("unsourced"), F.array_distinct(tx.citations(F.lower("text"))).alias("cited"))
    got = search.gaps(own, docs).withColumnRenamed("gap", "coverage").join(crossref(pages).select("path", "crossref"), "path").join(count, "path", "left")
    got = got.withColumn("orphan", orphan_rate(F.coalesce("citers", F.lit(0))))
    composite = (F.col("crossref") + F.col("orphan") + F.col("unsourced") + F.col("coverage")) * 0.25
    return got.select("path", "dir", "crossref", "orphan", "unsourced", "coverage", composite.alias("composite"))


def dimension_distribution(scored: DataFrame, dims: list[str]) -> DataFrame:
    long = scored.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("v")) for d in dims])).alias("x")).select("x.*")
    return long.groupBy("dimension").agg(F.avg("v").alias("mean"), F.count_if(F.col("v") > 0.5).alias("high"), F.count_if(F.col("v") == 0).alias("zero"))


def worst_dimension(scored: DataFrame, dims: list[str]) -> DataFrame:
    """How many non-source pages are worst in each dimension; nothing positive counts for the first one."""
    top = F.greatest(*dims)
    pick = F.lit(dims[0])
    for d in reversed(dims):
        pick = F.when((F.col(d) == top) & (top > 0), F.lit(d)).otherwise(pick)
    return scored.where("dir <> 'sources'").groupBy(pick.alias("dimension")).agg(F.count("*").alias("n"))


def clusters(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Links within and across directories, sources left out: one row."""
    d = pages.where("dir <> 'sources'").select("path", "dir")
    got = edges.join(d.toDF("src", "a"), "src").join(d.toDF("dst", "b"), "dst")
    return got.agg(F.count_if(F.col("a") == F.col("b")).alias("intra"), F.count_if(F.col("a") != F.col("b")).alias("inter")).withColumn("ratio", F.col("inter") / F.nullif(F.col("intra") + F.col("inter"), F.lit(0)))


def orphan_dominance(scored: DataFrame) -> DataFrame:
    return scored.where("dir <> 'sources'").agg((F.sum(F.col("orphan") * 0.25) / F.nullif(F.sum("composite"), F.lit(0.0))).alias("dominance"))


def rescore(pages: DataFrame, previous: DataFrame) -> DataFrame:
    """path, status hit (text and inbound as before) or miss; only misses need scoring again."""
    now = pages.select("path", tx.short_hash("text").alias("text_hash"), "inbound")
    old = previous.select("path", F.col("text_hash").alias("_h"), F.col("inbound").alias("_i"))
    same = F.coalesce((F.col("_h") == F.col("text_hash")) & (F.col("_i") == F.col("inbound")), F.lit(False))
    return now.join(old, "path", "left").select("path", F.when(same, "hit").otherwise("miss").alias("status"))


def saturated(rates: DataFrame, order: str, last: int, threshold: float) -> DataFrame:
    """Are the last rates all below the threshold?  One row: saturated, seen, low."""
    tail = rates.orderBy(F.desc(order)).limit(last)
    return tail.agg((F.coalesce(F.bool_and(F.col("rate") < threshold), F.lit(False)) & (F.count("*") >= last)).alias("saturated"), F.count("*").alias("seen"), F.count_if(F.col("rate") < threshold).alias("low"))


def log_tail(lines: DataFrame, size: int) -> DataFrame:
    """Lines (pos, line) of the last ``size`` bytes, whole ones only."""
    after = F.sum(F.octet_length("line") + 1).over(Window.orderBy(F.desc("pos")))
    return lines.withColumn("_b", after).where(F.col("_b") <= size).drop("_b")
