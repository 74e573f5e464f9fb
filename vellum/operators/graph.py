"""Property graph: edges from text, neighbours, paths, shared sources, bridges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as tx

#: Up to so many bytes of statistics Spark broadcasts by itself; hubs are left to AQE's skew handling.
MAX_PATH, MAX_HOPS = 20, 10
#: Nodes of a frontier up to which it is broadcast to stored edges; beyond, both are shuffled.
FEW = 100_000


def stem_paths(pages: DataFrame) -> DataFrame:
    """stem (lower case) and its page; colliding stems take the first path."""
    return pages.groupBy(F.lower("stem").alias("stem")).agg(F.min("path").alias("dst"))


def wiki_links(pages: DataFrame) -> DataFrame:
    """Distinct src, dst of resolved links without self-links."""
    raw = pages.select(F.col("path").alias("src"), F.explode(F.array_distinct(F.transform(tx.links("text"), tx.target))).alias("stem"))
    return raw.join(stem_paths(pages), "stem").where("src <> dst").select("src", "dst").distinct()


def cites(pages: DataFrame, sources: DataFrame) -> DataFrame:
    raw = pages.select(F.col("path").alias("src"), F.explode(F.array_distinct(tx.citations("text"))).alias("dst"))
    return raw.join(sources.select(F.col("path").alias("dst")), "dst", "left_semi").select("src", "dst")


def depicts(refs: DataFrame, pages: DataFrame) -> DataFrame:
    """src, dst of references (src, ref) that are a path, or else a stem."""
    by_path = pages.select(F.col("path").alias("ref"), F.col("path").alias("exact"))
    found = refs.join(by_path, "ref", "left").withColumn("stem", tx.target(F.regexp_replace("ref", r"^.*/|\.md$", ""))).join(stem_paths(pages).withColumnRenamed("dst", "by_stem"), "stem", "left")
    return found.select("src", F.coalesce("exact", "by_stem").alias("dst")).where("dst is not null").distinct()


def data_refs(rows: DataFrame, ref_columns: list[str], key: str, pages: DataFrame) -> DataFrame:
    """src (row key), dst (page), col_name of typed references; empty and unresolved ones go."""
    long = rows.select(F.col(key).cast("string").alias("src"), F.explode(F.array(*[F.struct(F.lit(x).alias("col_name"), F.lower(F.col(x).cast("string")).alias("stem")) for x in ref_columns])).alias("r"))
    return long.select("src", "r.col_name", "r.stem").where("stem <> ''").join(stem_paths(pages), "stem").select("src", "dst", "col_name")


def degree(*edges: DataFrame) -> DataFrame:
    ends = edges[0].select(F.explode(F.array("src", "dst")).alias("node"))
    for e in edges[1:]:
        ends = ends.unionByName(e.select(F.explode(F.array("src", "dst")).alias("node")))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def shared(cited: DataFrame, a: str, b: str) -> DataFrame:
    """Sources that both pages cite."""
    return cited.where(F.col("src") == a).select("dst").intersect(cited.where(F.col("src") == b).select("dst"))


def bridges(cited: DataFrame, linked: DataFrame, limit: int = 20) -> DataFrame:
    """Pairs of pages with most common sources that don't link each other: page_a < page_b, shared_sources.

    The product runs over sources; a pair's links are found by its ordered key, so one anti join does for both directions.
    """
    x, y = cited.toDF("page_a", "s"), cited.toDF("page_b", "s")
    pairs = x.join(y, "s").where("page_a < page_b").groupBy("page_a", "page_b").agg(F.countDistinct("s").alias("shared_sources"))
    known = linked.select(F.least("src", "dst").alias("page_a"), F.greatest("src", "dst").alias("page_b")).distinct()
    return pairs.join(known, ["page_a", "page_b"], "left_anti").orderBy(F.desc("shared_sources"), "page_a", "page_b").limit(max(1, min(100, limit)))


def expand(cited: DataFrame, seeds: DataFrame) -> DataFrame:
    """Sources cited together with seed sources (dst): dst, shared (citing pages)."""
    pages = cited.join(seeds.select("dst"), "dst", "left_semi").select("src").distinct()
    others = cited.join(pages, "src").join(seeds.select("dst"), "dst", "left_anti")
    return others.groupBy("dst").agg(F.countDistinct("src").alias("shared"))


def reach(edges: DataFrame, starts: DataFrame, hops: int, directed: bool = True, stored: bool = False) -> DataFrame:
    """start, node, depth (least, from 1) of the nodes within so many hops of each start, itself left out.

    Breadth first: each step joins the frontier with the edges and drops what was seen.  If the edges are ``stored``, and so
    cheap to read, each frontier is counted, and a small one leaves them unshuffled.
    """
    edges = edges.select("src", "dst") if directed else edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth"))
    frontier = seen
    for d in range(1, max(1, min(hops, MAX_PATH)) + 1):
        if stored and frontier.count() <= FEW:
            frontier = F.broadcast(frontier)
        step = frontier.join(edges, frontier["node"] == edges["src"]).select("start", F.col("dst").alias("node")).distinct()
        frontier = step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(d))
        if stored or d > 2:  # long lineages are cut in the shared folder
            frontier = frontier.checkpoint()
            if frontier.isEmpty():
                break
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def shortest_path(edges: DataFrame, a: str, b: str, most: int = 10, stored: bool = False) -> DataFrame:
    """One row depth if b is reachable from a in so many steps, else none."""
    start = edges.sparkSession.createDataFrame([(a,)], "node string")
    return reach(edges, start, most, stored=stored).where(F.col("node") == b).select("depth")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (node)."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")


def propagate_tags(pages: DataFrame, cited: DataFrame, frozen: DataFrame) -> DataFrame:
    """path and projects of source pages: their own and those of the non-source pages that link them, one hop."""
    tags = pages.where("type <> 'source'").select(F.col("path").alias("src"), F.explode("projects").alias("p"))
    got = cited.join(tags, "src").groupBy(F.col("dst").alias("path")).agg(F.collect_set("p").alias("new"))
    sources = pages.where("type = 'source'").join(frozen.select("path"), "path", "left_anti")
    return sources.join(got, "path", "left").select("path", F.array_sort(F.array_union("projects", F.coalesce("new", F.array().cast("array<string>")))).alias("projects"))


def tagged_bridges(pairs: DataFrame, tags: DataFrame) -> DataFrame:
    """Pairs with the sorted projects of both pages (path, projects); cross_project if both have some and they differ."""
    of = lambda end: tags.select(F.col("path").alias(f"page_{end}"), F.array_sort(F.array_distinct(F.filter("projects", lambda x: x != ""))).alias(f"projects_{end}"))
    got = pairs.join(of("a"), "page_a", "left").join(of("b"), "page_b", "left")
    for end in "ab":
        got = got.withColumn(f"projects_{end}", F.coalesce(f"projects_{end}", F.array().cast("array<string>")))
    return got.withColumn("cross_project", (F.size("projects_a") > 0) & (F.size("projects_b") > 0) & (F.col("projects_a") != F.col("projects_b")))


def radius(degrees: Column | str) -> Column:
    """How large a node is drawn."""
    return 4 + 1.6 * F.sqrt(F.coalesce(tx.c(degrees), F.lit(0)) + 1)
