"""Queries over the fixtures, and the SQL that each is compared with."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import frontmatter, naming
from vellum.functions import text as tx
from vellum.operators import activity, gates, graph, ingest, lifecycle, lint, notes, rewrites, search, tables
from vellum.operators.tables import Declared
from vellum.plans import fixtures, planner
from vellum.plans.fixtures import AS_OF, Fixtures
from vellum.session import stored
from vellum.streaming import activity as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query over the fixtures, with its SQL (after the fixtures' common table expressions)."""

    def put(f: Callable[[Fixtures], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
        if sql:
            s = sql.strip()
            ORACLE_SQL[f.__name__] = fixtures.SQL + (", " + s[5:] if s.startswith("with ") else s)
        return f

    return put


WORDS_SQL = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"


def _bm25_sql(terms: list[str], keep: str, having: str = "true") -> str:
    """BM25 in SQL; ``terms`` are conditions on a word x."""
    count = ", ".join(f"len(list_filter(w, lambda x: {t})) as f{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) filter (f{i} > 0) as d{i}" for i in range(len(terms)))
    score = " + ".join(f"greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * l / a))" for i in range(len(terms)))
    return f"""with tok as (select doc_id, {WORDS_SQL} as w from documents), cnt as (select doc_id, len(w) as l, {count} from tok), st as (select count(*) as n, avg(l) as a, {df} from cnt),
    sc as (select doc_id, round({score}, 6) as score from cnt, st where {keep}) """


# ---------------------------------------------------------------- search


@query(_bm25_sql(["x = 'that'", "x = 'with'"], "f0 > 0 and f1 > 0") + "select doc_id, score from sc order by score desc, doc_id limit 10")
def bm25_topk(f):
    return search.search(f.documents, "doc_id", "that with", 10).select("doc_id", F.round("score", 6).alias("score"))


@query(_bm25_sql(["x = 'that'", "x = 'zzqq'"], "f0 > 0 or f1 > 0") + "select doc_id, score, true as downgraded from sc order by score desc, doc_id limit 10")
def bm25_and_or_fallback(f):
    return search.search(f.documents, "doc_id", "that zzqq", 10).select("doc_id", F.round("score", 6).alias("score"), "downgraded")


@query("""with tok as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents),
hit as (select doc_id, len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' and w[i + 1] = 'the')) as phrase_n, len(list_filter(w, lambda x: starts_with(x, 'thi'))) as prefix_n from tok)
select doc_id, cast(phrase_n as int) as phrase_n, cast(prefix_n as int) as prefix_n from hit where phrase_n > 0 and prefix_n > 0""")
def phrase_prefix_match(f):
    t = f.documents.select("doc_id", tx.words("text").alias("t"))
    terms = search.parse('"of the" thi*')["must"]
    return t.select("doc_id", *[search.matches(F.col("t"), x).alias(n) for x, n in zip(terms, ("phrase_n", "prefix_n"), strict=True)]).where("phrase_n > 0 and prefix_n > 0")


@query(_bm25_sql(["x = 'that'", "x = 'with'"], "f0 > 0 and f1 = 0").replace(", greatest", ", greatest") + "select doc_id, round(s, 6) as score from (select cnt.doc_id, greatest(ln((n - d0 + 0.5) / (d0 + 0.5)), 1e-6) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * l / a)) as s from cnt, st where f0 > 0 and f1 = 0) order by score desc, doc_id limit 10")
def bm25_not(f):
    return search.search(f.documents, "doc_id", "that NOT with", 10, raw=True).select("doc_id", F.round("score", 6).alias("score"))


@query(f"""with tok as (select doc_id, unnest({WORDS_SQL}) as term from documents)
select term, cast(count(distinct doc_id) as bigint) as df, cast(count(*) as bigint) as cf from tok group by term order by df desc, term limit 50""")
def postings_stats(f):
    p = search.postings(f.documents, "doc_id")
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).orderBy(F.desc("df"), "term").limit(50)


@query("""with q as (select embedding as e from embeddings where vec_id = 0)
select vec_id, round(list_distance(cast(embedding as double[]), cast(e as double[])), 6) as distance from embeddings, q order by distance, vec_id limit 20""")
def vector_knn(f):
    return search.knn(f.embeddings, f.embeddings.where("vec_id = 0"), 20).select("vec_id", F.round("distance", 6).alias("distance"))


@query("""with an as (select min(vec_id) as anchor from embeddings group by label),
av as (select anchor, embedding as ae from an join embeddings on anchor = vec_id),
p as (select vec_id, anchor, round(list_inner_product(cast(embedding as double[]), cast(ae as double[])), 6) as similarity from embeddings, av),
r as (select *, row_number() over (partition by vec_id order by similarity desc, anchor) as r from p)
select vec_id, anchor, similarity from r where r = 1 and similarity >= 0.2""")
def semantic_classify(f):
    first = f.embeddings.groupBy("label").agg(F.min("vec_id").alias("vec_id")).select("vec_id")
    anchors = f.embeddings.join(first, "vec_id").select(F.col("vec_id").alias("anchor"), F.col("embedding").alias("anchor_embedding"))
    return search.nearest(f.embeddings, anchors, 0.2)


@query(_bm25_sql(["x = 'that'", "x = 'with'"], "f0 > 0 and f1 > 0") + """, lex as (select doc_id as id, 1 as stream, row_number() over (order by score desc, doc_id) as rank from sc qualify rank <= 20),
vq as (select embedding as e from embeddings where vec_id = 0),
vd as (select vec_id, round(list_distance(cast(embedding as double[]), cast(e as double[])), 6) as d from embeddings, vq),
vec as (select vec_id as id, 2 as stream, row_number() over (order by d, vec_id) as rank from vd qualify rank <= 20),
al as (select * from lex union all select * from vec),
fu as (select id, round(sum(1.0 / (60 + rank)), 6) as score, cast(min(stream) as int) as stream, arg_min(rank, stream) as fr from al group by id)
select id, score, stream from fu order by score desc, stream, fr, id limit 10""")
def rrf_hybrid(f):
    lex = search.ranked(search.bm25(f.documents, "doc_id", [["that"], ["with"]]).select(F.col("doc_id").alias("id"), F.round("score", 6).alias("score")), "id", [F.desc("score"), F.col("id")], 1, 20)
    vec = search.ranked(search.knn(f.embeddings, f.embeddings.where("vec_id = 0"), 20).select(F.col("vec_id").alias("id"), F.round("distance", 6).alias("distance")), "id", [F.col("distance"), F.col("id")], 2, 20)
    return search.fuse([lex, vec], "id", 10)


@query("""with seeds as (select distinct dst from cites order by dst limit 3), pg as (select distinct src from cites where dst in (select dst from seeds))
select dst, cast(count(distinct src) as bigint) as shared from cites where src in (select src from pg) and dst not in (select dst from seeds) group by dst order by shared desc, dst limit 20""")
def graph_expand(f):
    c = graph.cites(f.pages, f.sources)
    return graph.expand(c, c.select("dst").distinct().orderBy("dst").limit(3)).orderBy(F.desc("shared"), "dst").limit(20)


# ---------------------------------------------------------------- extraction


@query("select path, raw, target, cast(count(*) as bigint) as n from links group by all")
def extract_links(f):
    return f.links.groupBy("path", "raw", "target").agg(F.count("*").alias("n"))


@query("select path, source, cast(count(*) as bigint) as n from raw_cites group by path, source")
def extract_citations(f):
    return f.pages.select("path", F.explode(tx.citations("text")).alias("source")).groupBy("path", "source").agg(F.count("*").alias("n"))


@query("""with t as (select c_custkey, 'see (table:customer#id=' || c_custkey || ') and (table:part?query=size>' || (c_custkey % 9) || ') twice (table:nation#id=' || c_nationkey || ')' as text from customer)
select c_custkey, unnest(regexp_extract_all(text, '\\(table:([a-zA-Z_][a-zA-Z0-9_]*)#id=([^)]+)\\)', 1)) as tbl, 'id' as kind, unnest(regexp_extract_all(text, '\\(table:([a-zA-Z_][a-zA-Z0-9_]*)#id=([^)]+)\\)', 2)) as value from t
union all select c_custkey, unnest(regexp_extract_all(text, '\\(table:([a-zA-Z_][a-zA-Z0-9_]*)\\?query=([^)]+)\\)', 1)), 'query', unnest(regexp_extract_all(text, '\\(table:([a-zA-Z_][a-zA-Z0-9_]*)\\?query=([^)]+)\\)', 2)) from t""")
def extract_table_citations(f):
    text = F.expr("'see (table:customer#id=' || c_custkey || ') and (table:part?query=size>' || (c_custkey % 9) || ') twice (table:nation#id=' || c_nationkey || ')'")
    return f.customer.select("c_custkey", F.explode(tx.table_citations(text)).alias("x")).select("c_custkey", "x.tbl", "x.kind", "x.value")


@query("""select p_partkey, array_to_string(list_sort(['arxiv:2401.' || lpad(cast(p_partkey % 10000 as varchar), 5, '0'), 'doi:10.1234/part-' || p_partkey]), ',') as refs from part""")
def extract_refs(f):
    text = F.expr("'As arXiv: 2401.' || lpad(cast(p_partkey % 10000 as string), 5, '0') || 'v2 says, and ARXIV:2401.' || lpad(cast(p_partkey % 10000 as string), 5, '0') || '; doi 10.1234/PART-' || p_partkey || '.'")
    return f.part.select("p_partkey", F.array_join(tx.external_refs(text), ",").alias("refs"))


_STOP_SQL = "(" + ", ".join(f"'{w}'" for w in tx.CLAIM_STOP) + ")"


@query(f"""with w as (select path, list_filter(regexp_extract_all(regexp_replace(regexp_replace(string_split(text, chr(10))[7], '\\(vault:[^)]+\\)', '', 'g'), '\\[\\[[^\\]]*\\]\\]', '', 'g'), '[a-zA-Z]{{4,}}'), lambda x: lower(x) not in {_STOP_SQL}) as w from wiki_page)
select path, array_to_string(w, ' ') as claim from w""")
def claim_words(f):
    line = F.try_element_at(F.split("text", "\n"), F.lit(7))
    return f.pages.select("path", F.array_join(tx.claim_words(line), " ").alias("claim")).select("path", F.coalesce("claim", F.lit(None)).alias("claim"))


@query("""with l as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' and not starts_with(trim(x), '#') and not starts_with(trim(x), '<!--') and not starts_with(trim(x), '---')) as l from documents)
select doc_id, coalesce(substring(trim(l[1]), 1, 400), '') as line from l""")
def first_line(f):
    return f.documents.select("doc_id", tx.first_line("text").alias("line"))


@query("""select cast(k as bigint) as k, array_to_string(list_sort(list_distinct(flatten([range(least(a, b), greatest(a, b) + 1), [c], [d]]))), ',') as pages from
(select row_number() over (order by o_orderkey) as k, o_orderkey % 7 + 1 as a, o_custkey % 11 + 1 as b, o_orderkey % 5 + 20 as c, o_orderkey % 3 + 30 as d from orders)""")
def source_page_refs(f):
    text = F.expr("'Table p.' || (o_orderkey % 7 + 1) || '-' || (o_custkey % 11 + 1) || ' and p. ' || (o_orderkey % 5 + 20) || ', ' || (o_orderkey % 3 + 30)")
    rows = f.spark.sql("select *, row_number() over (order by o_orderkey) as k from {o}", o=f.orders.select("o_orderkey", "o_custkey"))
    return rows.select(F.col("k").cast("long").alias("k"), F.array_join(tx.source_pages(text), ",").alias("pages"))


@query("""select event_id, event_type = 'purchase' as done, event_id % 40 as todo_id, '2024-01-' || lpad(cast(event_id % 28 + 1 as varchar), 2, '0') as created from events""")
def todo_markers(f):
    text = F.expr("""'# Todo' || chr(10) || '```' || chr(10) || '- [ ] fake (todo:T9)' || chr(10) || '```' || chr(10) || '- [' || if(event_type = 'purchase', 'x', ' ') || '] do ' || event_id || ' (created: 2024-01-' || lpad(cast(event_id % 28 + 1 as string), 2, '0') || ') (todo:T' || (event_id % 40) || ')'""")
    pages = f.events.select(F.col("event_id").alias("path"), text.alias("text"))
    return lifecycle.todos(pages).select(F.col("path").alias("event_id"), "done", "todo_id", "created")


# ---------------------------------------------------------------- graph


@query("select src, dst from wiki_link")
def wiki_links(f):
    return graph.wiki_links(f.pages)


@query("select src, dst from cites")
def cites(f):
    return graph.cites(f.pages, f.sources)


@query("""select cast((select count(*) from wiki_page) as bigint) as pages, cast((select count(*) from sources) as bigint) as sources, cast((select count(*) from wiki_link) as bigint) as links, cast((select count(*) from cites) as bigint) as cites,
cast((select count(*) from (select distinct path, target from links)) as bigint) as wanted""")
def graph_stats(f):
    one = f.pages.agg(F.count("*").alias("pages"))
    for n, d in (("sources", f.sources), ("links", graph.wiki_links(f.pages)), ("cites", graph.cites(f.pages, f.sources)), ("wanted", f.links.select("path", "target").distinct())):
        one = one.crossJoin(d.agg(F.count("*").alias(n)))  # one row each
    return one


@query("with e as (select src as node from wiki_link union all select dst from wiki_link) select node, cast(count(*) as bigint) as degree from e group by node order by degree desc, node limit 50")
def degree(f):
    return graph.degree(graph.wiki_links(f.pages)).orderBy(F.desc("degree"), "node").limit(50)


def _path(f: Fixtures, stem: str) -> str:
    return f.pages.where(F.col("stem") == stem).agg(F.min("path")).first()[0]


@query("""with t as (select dst from cites group by dst order by count(distinct src) desc, dst limit 1), p as (select distinct src from cites where dst = (select dst from t) order by src limit 2)
select dst from cites where src = (select min(src) from p) intersect select dst from cites where src = (select max(src) from p)""")
def shared_sources(f):
    """Sources that the first two pages which cite the most cited source have in common."""
    c = graph.cites(f.pages, f.sources)
    top = c.groupBy("dst").agg(F.count_distinct("src").alias("n")).orderBy(F.desc("n"), "dst").limit(1).select("dst")
    first = c.join(F.broadcast(top), "dst").select("src").distinct().orderBy("src").limit(2).agg(F.min("src"), F.max("src")).first()
    return graph.shared(c, first[0], first[1])


@query("""with s as (select min(path) as p from wiki_page where stem = 'o-0'), h1 as (select distinct dst as node from wiki_link, s where src = p and dst <> p), h2 as (select distinct l.dst as node from wiki_link l join h1 on l.src = h1.node, s where l.dst <> p)
select node, cast(min(depth) as int) as depth from (select node, 1 as depth from h1 union all select node, 2 from h2) group by node""")
def neighbors_2hop(f):
    start = f.pages.where("stem = 'o-0'").agg(F.min("path").alias("node"))
    return graph.reach(graph.wiki_links(f.pages), start, 2).select("node", "depth")


@query("""with s as (select min(path) as p from wiki_page where stem = 'o-0'), h1 as (select distinct dst as n from wiki_link, s where src = p), h2 as (select distinct dst as n from wiki_link join h1 on src = n), h3 as (select distinct dst as n from wiki_link join h2 on src = n), h4 as (select distinct dst as n from wiki_link join h3 on src = n),
al as (select n, 1 as d from h1 union all select n, 2 from h2 union all select n, 3 from h3 union all select n, 4 from h4), near as (select n, min(d) as d from al, s where n <> p group by n)
select cast(d as int) as depth from near order by d desc, n limit 1""")
def shortest_path(f):
    """Steps from a page to one of the farthest that four steps reach."""
    links, start = stored(graph.wiki_links(f.pages), "edges"), _path(f, "o-0")
    reached = graph.reach(links, f.spark.createDataFrame([(start,)], "node string"), 4, stored=True)
    goal = reached.orderBy(F.desc("depth"), "node").limit(1).first()
    return graph.shortest_path(links, start, goal["node"] if goal else start, 4, stored=True)


@query("""with p as (select a.src as page_a, b.src as page_b, count(distinct a.dst) as shared_sources from cites a join cites b on a.dst = b.dst and a.src < b.src group by a.src, b.src),
k as (select distinct least(src, dst) as x, greatest(src, dst) as y from wiki_link)
select page_a, page_b, cast(shared_sources as bigint) as shared_sources from p where not exists (select 1 from k where x = page_a and y = page_b) order by shared_sources desc, page_a, page_b limit 20""")
def bridge_candidates(f):
    return graph.bridges(graph.cites(f.pages, f.sources), graph.wiki_links(f.pages), 20)


@query("""with s as (select min(path) as p from wiki_page where stem = 'o-0'), e as (select src, dst from wiki_link union select dst, src from wiki_link), h1 as (select distinct dst as n from e, s where src = p), h2 as (select n from h1 union select dst from e join h1 on src = n)
select n as node from h2, s where n <> p""")
def wave_scope(f):
    start = f.pages.where("stem = 'o-0'").agg(F.min("path").alias("node"))
    return graph.reach(graph.wiki_links(f.pages), start, 2, directed=False).select("node")


@query("""with s as (select min(path) as p from wiki_page where stem = 'o-1'), n as (select p as node from s union select dst from wiki_link, s where src = p union select src from wiki_link, s where dst = p)
select src, dst from wiki_link where src in (select node from n) and dst in (select node from n)""")
def subgraph_1hop(f):
    e = graph.wiki_links(f.pages)
    start = f.pages.where("stem = 'o-1'").agg(F.min("path").alias("node"))
    return graph.induced(e, graph.reach(e, start, 1, directed=False).select("node").unionByName(start))


@query("""with tg as (select path, type, 'proj-' || (length(path) % 5) as p from wiki_page), g as (select l.dst as path, tg.p from wiki_link l join tg on l.src = tg.path where tg.type <> 'source'),
al as (select path, p from tg where type = 'source' union select g.path, g.p from g join tg on g.path = tg.path where tg.type = 'source')
select path, string_agg(p, ',' order by p) as projects from al group by path""")
def propagate_tags(f):
    tagged = f.pages.select("path", "type", F.array(F.expr("'proj-' || (length(path) % 5)")).alias("projects"))
    got = graph.propagate_tags(tagged, graph.wiki_links(f.pages), f.pages.limit(0).select("path"))
    return got.select("path", F.array_join("projects", ",").alias("projects"))


@query("""with r as (select cast(c_custkey as varchar) as src, 'part-' || (c_custkey % 60) as a, case when c_custkey % 3 = 0 then '' else 'O-' || c_custkey end as b from customer),
l as (select src, 'a' as col_name, lower(a) as s from r union all select src, 'b', lower(b) from r where b <> '')
select l.src, stems.path as dst, col_name from l join stems on l.s = stems.stem""")
def data_refs(f):
    rows = f.customer.select("c_custkey", F.expr("'part-' || (c_custkey % 60)").alias("a"), F.expr("if(c_custkey % 3 = 0, '', 'O-' || c_custkey)").alias("b"))
    return graph.data_refs(rows, ["a", "b"], "c_custkey", f.pages)


# ---------------------------------------------------------------- lint


@query("select path, raw, target, cast(count(*) as bigint) as n from links where target not in (select stem from stems) group by all")
def dead_links(f):
    return lint.dead_links(f.links, f.pages).groupBy("path", "raw", "target").agg(F.count("*").alias("n"))


@query("select target, cast(count(distinct path) as bigint) as citers from links where target not in (select stem from stems) group by target having count(distinct path) >= 2 order by citers desc, target limit 20")
def concept_candidates(f):
    return lint.wanted(f.links, f.pages)


@query("""with cov as (select path from sources where cast(regexp_extract(path, 'p-(\\d+)', 1) as bigint) % 3 = 0), d as (select dst, count(distinct src) as demand, list_sort(list(distinct src))[1:10] as c from cites where dst not in (select path from cov) group by dst having count(distinct src) >= 2)
select dst as source, cast(demand as bigint) as demand, array_to_string(c, ',') as citers from d order by demand desc, source limit 20""")
def evidence_candidates(f):
    covered = f.part.where("p_partkey % 3 = 0").select(F.expr("'parts/p-' || p_partkey || '.extracted.md'").alias("path"))
    return lint.candidates(graph.cites(f.pages, f.sources), covered).withColumn("citers", F.array_join("citers", ","))


@query("""with i as (select target, count(*) as o, count(distinct path) as c from links where target <> lower(stem) group by target)
select p.stem, p.path, cast(coalesce(o, 0) as bigint) as occurrences, cast(coalesce(c, 0) as bigint) as citers from wiki_page p left join i on lower(p.stem) = i.target""")
def inbound_counts(f):
    return lint.inbound(f.links, f.pages).select("stem", "path", "occurrences", "citers")


@query("select path from wiki_page where lower(stem) not in (select target from links where target <> lower(stem))")
def orphans(f):
    return lint.inbound(f.links, f.pages).where("occurrences = 0").select("path")


@query("select path, raw, target, cast(count(*) as bigint) as n from links where regexp_matches(raw, '[ A-Z]') and target in (select stem from stems) group by all")
def spaced_links(f):
    return lint.spaced_links(f.links, f.pages).groupBy("path", "raw", "target").agg(F.count("*").alias("n"))


@query("""with a as (select doc_id from documents where doc_id % 3 <> 0), b as (select doc_id from documents where doc_id % 5 <> 0)
select coalesce(a.doc_id, b.doc_id) as doc_id, case when a.doc_id is null then 'right' else 'left' end as side from a full join b on a.doc_id = b.doc_id where a.doc_id is null or b.doc_id is null""")
def index_drift(f):
    return lint.reconcile(f.documents.where("doc_id % 3 <> 0"), f.documents.where("doc_id % 5 <> 0"), "doc_id")


@query("select path from sources where path not in (select source from raw_cites) and lower(path) not in (select source from raw_cites)")
def source_frontier(f):
    cited = f.pages.select(F.explode(tx.citations("text")).alias("source")).distinct()
    return lint.frontier(f.sources, cited)


@query(f"""with s as (select p_partkey, trim(regexp_replace(lower(case when p_partkey % 2 = 0 then 'the-' || p_name else p_name || 's' end), '[-_\\s]+', ' ', 'g')) as s from part),
t as (select p_partkey, case when starts_with(s, 'the ') then s[5:] else s end as s from s),
u as (select p_partkey, case when ends_with(s, 's') and not ends_with(s, 'ss') and s not in ({", ".join(repr(x) for x in tx.NO_DEPLURAL)}) then s[:-2] else s end as slug from t)
select slug, cast(count(*) as bigint) as n, cast(min(p_partkey) as bigint) as first from u group by slug having count(*) > 1""")
def duplicate_slugs(f):
    pages = f.part.select(F.col("p_partkey").alias("path"), F.expr("if(p_partkey % 2 = 0, 'the-' || p_name, p_name || 's')").alias("stem"))
    return lint.duplicate_slugs(pages).select("slug", F.size("paths").cast("long").alias("n"), F.array_min("paths").alias("first"))


@query("""with q as (select path, k, type from (select path, type, cast(regexp_extract(stem, '(\\d+)', 1) as bigint) as k from wiki_page))
select path, case when k % 11 = 0 then 'created' else '' end as missing, k % 7 = 0 as unknown_type from q where k % 11 = 0 or k % 7 = 0""")
def frontmatter_issues(f):
    k = F.regexp_extract("stem", r"(\d+)", 1).cast("long")
    broken = F.when(k % 11 == 0, F.regexp_replace("text", "created: [0-9-]+\n", "")).otherwise(F.col("text"))
    broken = F.when(k % 7 == 0, F.regexp_replace(broken, "type: [a-z]+", "type: gadget")).otherwise(broken)
    return lint.frontmatter_issues(f.pages.select("path", broken.alias("text"))).withColumn("missing", F.array_join("missing", ","))


@query("""select cast((select count(*) from links where target not in (select stem from stems)) + (select count(*) from links where regexp_matches(raw, '[ A-Z]') and target in (select stem from stems))
+ (select count(*) from sources where path not in (select source from raw_cites)) as bigint) as debt""")
def hygiene_debt(f):
    cited = f.pages.select(F.explode(tx.citations("text")).alias("source")).distinct()
    parts = [lint.dead_links(f.links, f.pages), lint.spaced_links(f.links, f.pages), lint.frontier(f.sources, cited)]
    counts = [p.agg(F.count("*").alias("n")) for p in parts]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).agg(F.sum("n").alias("debt"))


_UNSOURCED_SQL = """un as (select path, list_filter(string_split(regexp_replace(text, '^---\\n(?s:.*?)\\n---\\n', ''), chr(10)), lambda x: len(list_filter(string_split(trim(regexp_replace(x, '[ \\t]+', ' ', 'g')), ' '), lambda y: y <> '')) >= 5 and not starts_with(ltrim(x), '#')) as l from wiki_page),
unsourced as (select path, case when len(l) = 0 then 0.0 else len(list_filter(l, lambda x: not contains(x, '(vault:'))) / len(l) end as unsourced from un)"""


@query(f"with {_UNSOURCED_SQL} select path, round(unsourced, 6) as unsourced from unsourced")
def lint_unsourced(f):
    return f.pages.select("path", F.round(lint.unsourced("text"), 6).alias("unsourced"))


_CROSS_SQL = """ph as (select distinct lower(stem) as stem, trim(regexp_replace(lower(stem), '[^\\p{L}\\p{N}_]+', ' ', 'g')) as phrase from wiki_page where length(stem) >= 4),
tk as (select path, lower(stem) as own, string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g')), ' ') as t, list_transform(regexp_extract_all(text, '\\[\\[([^\\]|]+)(?:\\|[^\\]]+)?\\]\\]', 1), lambda x: lower(x)) as l from wiki_page),
gr as (select distinct path, own, l, phrase from (select path, own, l, unnest(list_transform(range(1, len(t) - n + 2), lambda i: array_to_string(t[i:i + n - 1], ' '))) as phrase from tk, (select distinct len(string_split(phrase, ' ')) as n from ph))),
cr as (select path, count(*) as mentioned, count(*) filter (list_contains(l, stem)) as linked from gr join ph using (phrase) where stem <> own group by path),
crossref as (select p.path, coalesce(mentioned, 0) as mentioned, coalesce(linked, 0) as linked, coalesce(1 - linked / mentioned, 0.0) as crossref from wiki_page p left join cr on p.path = cr.path)"""


@query(f"with {_CROSS_SQL} select path, cast(mentioned as bigint) as mentioned, cast(linked as bigint) as linked, round(crossref, 6) as crossref from crossref")
def lint_crossref(f):
    return lint.crossref(f.pages).withColumn("crossref", F.round("crossref", 6))


#: Share of the ten best documents for a page's stem words that it doesn't cite.
_GAP_SQL = """vt as (select doc, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as t from vault), vw as (select doc, unnest(t) as w from vt), vp as (select w, doc, count(*) as tf from vw group by all), vd as (select w, count(*) as df from vp group by w), vn as (select count(*) as n, avg(len(t)) as a from vt),
pw as (select distinct path, w from (select path, unnest(regexp_extract_all(lower(replace(stem, '-', ' ')), '[\\p{L}\\p{N}]+')) as w from wiki_page) where length(w) >= 3), pn as (select path, count(*) as terms from pw group by path),
vh as (select pw.path, vp.doc, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(vt.t) / a))) as s, count(*) as k from pw join vp on pw.w = vp.w join vd on vd.w = pw.w join vt on vt.doc = vp.doc, vn group by pw.path, vp.doc),
vb as (select vh.path, doc, row_number() over (partition by vh.path order by round(s, 6) desc, doc) as r from vh join pn on vh.path = pn.path where k = terms),
gap as (select path, avg(case when (path, lower(doc)) in (select path, lower(source) from raw_cites) then 0.0 else 1.0 end) as gap from vb where r <= 10 group by path)"""

_SCORE_SQL = f"""{_UNSOURCED_SQL}, {_CROSS_SQL}, {_GAP_SQL}, inb as (select target, count(distinct path) as c from links where target <> lower(stem) group by target),
scored as (select p.path, p.dir, crossref, unsourced, cast(case coalesce(c, 0) when 0 then 1.0 when 1 then 0.66 when 2 then 0.33 else 0.0 end as double) as orphan, coalesce(gap, 0.0) as coverage from wiki_page p left join gap g on g.path = p.path join unsourced u on p.path = u.path join crossref x on p.path = x.path left join inb on lower(p.stem) = inb.target),
sc as (select *, (crossref + orphan + unsourced + coverage) * 0.25 as composite from scored)"""


@query(f"with {_SCORE_SQL} select path, round(crossref, 6) as crossref, round(orphan, 6) as orphan, round(unsourced, 6) as unsourced, round(coverage, 6) as coverage, round(composite, 6) as composite from sc order by composite desc, path limit 50")
def lint_composite(f):
    cols = [F.round(x, 6).alias(x) for x in ("crossref", "orphan", "unsourced", "coverage", "composite")]
    return lint.scores(f.pages, f.links, f.vault).select("path", *cols).orderBy(F.desc("composite"), "path").limit(50)


DIMS = ["crossref", "orphan", "unsourced", "coverage"]


@query(f"with {_SCORE_SQL}, long as (select 'crossref' as dimension, crossref as v from sc union all select 'orphan', orphan from sc union all select 'unsourced', unsourced from sc union all select 'coverage', coverage from sc) select dimension, round(avg(v), 6) as mean, cast(count(*) filter (v > 0.5) as bigint) as high, cast(count(*) filter (v = 0) as bigint) as zero from long group by dimension")
def dimension_distribution(f):
    return lint.dimension_distribution(lint.scores(f.pages, f.links, f.vault), DIMS).withColumn("mean", F.round("mean", 6))


@query(f"with {_SCORE_SQL} select case when top <= 0 or crossref = top then 'crossref' when orphan = top then 'orphan' when unsourced = top then 'unsourced' else 'coverage' end as dimension, cast(count(*) as bigint) as n from (select *, greatest(crossref, orphan, unsourced, coverage) as top from sc) where dir <> 'sources' group by 1")
def worst_dimension(f):
    return lint.worst_dimension(lint.scores(f.pages, f.links, f.vault), DIMS)


@query(f"with {_SCORE_SQL} select round(sum(orphan * 0.25) / nullif(sum(composite), 0), 6) as dominance from sc where dir <> 'sources'")
def orphan_dominance(f):
    return lint.orphan_dominance(lint.scores(f.pages, f.links, f.vault)).withColumn("dominance", F.round("dominance", 6))


@query("""with d as (select path, dir from wiki_page where dir <> 'sources'), e as (select a.dir as x, b.dir as y from wiki_link l join d a on l.src = a.path join d b on l.dst = b.path)
select cast(count(*) filter (x = y) as bigint) as intra, cast(count(*) filter (x <> y) as bigint) as inter, round(count(*) filter (x <> y) / nullif(count(*), 0), 6) as ratio from e""")
def cluster_analysis(f):
    return lint.clusters(graph.wiki_links(f.pages), f.pages).withColumn("ratio", F.round("ratio", 6))


@query("select dir, cast(count(*) as bigint) as n from wiki_page group by dir")
def page_counts(f):
    return f.pages.groupBy("dir").agg(F.count("*").alias("n"))


@query("select round(1 - count(*) filter (path not in (select source from raw_cites)) / count(*), 6) as utilisation from sources")
def utilisation(f):
    cited = f.pages.select(F.explode(tx.citations("text")).alias("source")).distinct()
    open_ = lint.frontier(f.sources, cited).agg(F.count("*").alias("o"))
    return f.sources.agg(F.count("*").alias("n")).crossJoin(open_).select(F.round(1 - F.col("o") / F.col("n"), 6).alias("utilisation"))


@query("""with w as (select cast(ts as date) as d, avg(value) / 1000 as rate from events group by 1), l as (select * from w order by d desc limit 5)
select coalesce(bool_and(rate < 0.05), false) and count(*) >= 5 as saturated, cast(count(*) as bigint) as seen, cast(count(*) filter (rate < 0.05) as bigint) as low from l""")
def saturation(f):
    waves = f.events.groupBy(F.to_date("ts").alias("d")).agg((F.avg("value") / 1000).alias("rate"))
    return lint.saturated(waves, "d", 5, 0.05)


@query("""with l as (select event_id as pos, event_type || ':' || user_id as line from events), s as (select pos, line, sum(strlen(line) + 1) over (order by pos desc) as b from l) select pos, line from s where b <= 4096""")
def recent_log(f):
    return lint.log_tail(f.events.select(F.col("event_id").alias("pos"), F.expr("event_type || ':' || user_id").alias("line")), 4096)


@query("""select doc_id as path, case when doc_id % 4 = 0 or doc_id % 9 = 0 then 'miss' else 'hit' end as status from documents""")
def score_cache_hits(f):
    now = f.documents.select(F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"), F.lit(1).alias("inbound"))
    old = f.documents.where("doc_id % 9 <> 0").select(F.col("doc_id").alias("path"), tx.short_hash("text").alias("text_hash"), F.lit(1).alias("inbound"))
    return lint.rescore(now, old)


# ---------------------------------------------------------------- gates

_TOKENS_SQL = "len(list_filter(string_split(trim(regexp_replace({0}, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')), ' '), lambda x: x <> ''))"


@query(f"select conv_id, turn, cast({_TOKENS_SQL.format('before')} as bigint) as tokens_before, cast({_TOKENS_SQL.format('after')} as bigint) as tokens_after, 0::bigint as citations from turns")
def edit_metrics(f):
    b, a = gates.metrics("before"), gates.metrics("after")
    return f.turns.select("conv_id", "turn", b["tokens"].alias("tokens_before"), a["tokens"].alias("tokens_after"), a["citations"].alias("citations"))


@query(f"""with t as (select conv_id, turn, {_TOKENS_SQL.format('before')} as b, {_TOKENS_SQL.format('after')} as a from turns)
select conv_id, turn, case when turn % 3 = 0 then 'reject-citations' when b + (turn % 3 = 0)::int > 0 and a > b * 1.5 then 'reject-bloat' else 'accept' end as verdict from t""")
def edit_verdict(f):
    before = F.when(F.col("turn") % 3 == 0, F.concat("before", F.lit(" (vault:x)"))).otherwise(F.col("before"))
    return f.turns.select("conv_id", "turn", gates.verdict(gates.metrics(before), gates.metrics("after")).alias("verdict"))


@query(f"""with m as (select p.path, p.dir, len(regexp_extract_all(text, '\\(vault:([^)]+)\\)')) as c, len(list_filter(regexp_extract_all(text, '\\[\\[([^\\]|]+)(?:\\|[^\\]]+)?\\]\\]', 1), lambda x: not contains(x, ' '))) as l, {_TOKENS_SQL.format("regexp_replace(text, '^---\\n(?s:.*?)\\n---\\n', '')")} as t from wiki_page p)
select path, case when dir = 'evidence' then (case when c < 1 then 'citations' when l < 1 then 'links' when t < 50 then 'words' else 'accept' end) else (case when c < 2 then 'citations' when l < 2 then 'links' when t < 100 then 'words' else 'accept' end) end as verdict from m""")
def new_page_verdict(f):
    return f.pages.select("path", gates.new_page("path", "text").alias("verdict"))


@query("""select path, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '\\[\\[([^\\]|]+)(?:\\|[^\\]]+)?\\]\\]', 1), lambda x: regexp_matches(x, '[ A-Z]')))), ',') as added from wiki_page where regexp_matches(text, '\\[\\[Part ')""")
def bad_links_added(f):
    added = F.array_except(gates.bad_links("text"), gates.bad_links(F.regexp_replace("text", tx.LINK, "")))
    return f.pages.select("path", F.array_join(added, ",").alias("added")).where("added <> ''")


@query("select path, cast(regexp_extract(stem, '(\\d+)', 1) as bigint) % 2 = 0 as ok from wiki_page where contains(text, 'Item ')")
def append_only(f):
    k = F.regexp_extract("stem", r"(\d+)", 1).cast("long")
    after = F.when(k % 2 == 0, F.concat("text", F.lit("\n\nOne  more line."))).otherwise(F.regexp_replace("text", "(?s)Item .*", ""))
    return f.pages.where(F.col("text").contains("Item ")).select("path", gates.append_only("text", after).alias("ok"))


@query("""with n as (select p_partkey, 'Claims about ' || p_name || case when p_partkey % 3 = 0 then ' zebra' else '' end as line from part), w as (select p_partkey, unnest(['claims', 'about']) from n)
select 'page-' || p_partkey as page, 'parts/p-' || p_partkey || '.extracted.md' as source, case when p_partkey % 3 = 0 then 'suspect' else 'ok' end as relevance from part""")
def citation_relevance(f):
    src = F.expr("'parts/p-' || p_partkey || '.extracted.md'")
    new = f.part.select(F.expr("'page-' || p_partkey").alias("page"), F.concat(F.lit("Claims that "), F.col("p_name"), F.when(F.col("p_partkey") % 3 == 0, " zebra").otherwise(""), F.lit(" [[x]] (vault:y)")).alias("line"), src.alias("source"))
    body = f.part.select(src.alias("path"), F.concat(F.lit("the claims of "), F.col("p_name")).alias("text"))
    return gates.citation_relevance(new, search.postings(body, "path"))


@query("""select page_id, array_to_string(list_filter([case when regexp_matches(lower(html), '<\\s*script\\b') then 'script-tag' end, case when regexp_matches(lower(html), '\\bonclick\\s*=') then 'html-onclick-handler' end,
case when regexp_matches(lower(html), '\\bjavascript:') then 'javascript-uri' end], lambda x: x is not null), ',') as rules from pages""")
def injection_scan(f):
    return f.html_pages.select("page_id", F.array_join(gates.injections("html", True), ",").alias("rules"))


@query(f"select doc_id, {_TOKENS_SQL.format('text')} >= 50 as sane from documents")
def text_sanity(f):
    return f.documents.select("doc_id", gates.sane("text").alias("sane"))


@query("""select doc_id, doc_id % 6 = 0 or len(regexp_extract_all(text, '\\$\\$')) >= 3 as math, doc_id % 10 = 0 as tables from documents""")
def math_table_flags(f):
    text = F.concat("text", F.when(F.col("doc_id") % 6 == 0, " theorem lemma proof proposition corollary").otherwise(""), F.when(F.col("doc_id") % 10 == 0, " Table 3 and Table 4").otherwise(""))
    return f.documents.select("doc_id", gates.has_math(text).alias("math"), gates.has_tables(text).alias("tables"))


@query("""select p_partkey, case p_partkey % 3 when 0 then 'lab / Compound:chemicals' when 1 then 'gene_symbol:genes' else '' end as flags from part""")
def identifier_columns(f):
    headers = F.array(F.lit("id"), F.expr("case p_partkey % 3 when 0 then 'lab / Compound' when 1 then 'gene_symbol' else 'plain' end"))
    return f.part.select("p_partkey", F.array_join(gates.identifier_columns(headers), ",").alias("flags"))


# ---------------------------------------------------------------- tables

CUSTOMER = [Declared("c_custkey", "int", pk=True, nullable=False), Declared("c_name", "text", nullable=False), Declared("c_mktsegment", "enum", values=("BUILDING", "MACHINERY", "HOUSEHOLD")), Declared("c_nationkey", "ref")]


@query("select c_custkey, c_name from customer where c_acctbal > 5000 and c_mktsegment = 'MACHINERY' order by c_custkey limit 50")
def class_table_query(f):
    return tables.query(f.spark, f.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment").orderBy("c_custkey"), "c_acctbal > ? and c_mktsegment = ?", [5000.0, "MACHINERY"], 50).select("c_custkey", "c_name")


@query("""select c_custkey, array_to_string(list_filter([case when c_custkey % 97 = 0 then 'missing c_name' end, 'unknown c_acctbal', case when c_mktsegment not in ('BUILDING', 'MACHINERY', 'HOUSEHOLD') then 'not allowed c_mktsegment' end], lambda x: x is not null), ',') as errors from customer""")
def validate_rows(f):
    rows = f.customer.withColumn("c_name", F.when(F.col("c_custkey") % 97 != 0, F.col("c_name"))).withColumn("_x", F.lit(1))
    return rows.select("c_custkey", F.array_join(tables.errors(rows, CUSTOMER), ",").alias("errors"))


@query("select * from (values ('add', 'c_tier'), ('drop', 'c_nationkey'), ('narrow', 'c_mktsegment'), ('rename', 'c_name->c_title')) t(step, column_name)")
def schema_drift(f):
    new = [CUSTOMER[0], Declared("c_title", "text", nullable=False, alias="c_name"), Declared("c_mktsegment", "enum", values=("BUILDING",)), Declared("c_tier")]
    return f.spark.createDataFrame(tables.schema_changes(CUSTOMER, new), "step string, column_name string")


@query("select p_partkey as id, case when p_partkey % 97 = 0 then 'no such file' when p_partkey % 89 = 0 then 'bad prefix' else 'missing' end as reason from part where p_partkey % 97 = 0 or p_partkey % 89 = 0 or p_partkey % 83 = 0")
def provenance_verify(f):
    origin = F.expr("case when p_partkey % 97 = 0 then 'vault:gone.md' when p_partkey % 89 = 0 then 'http://x' when p_partkey % 83 = 0 then null when p_partkey % 5 = 0 then 'log:wave' else 'vault:parts/p-' || p_partkey || '.extracted.md' end")
    return tables.provenance(f.part.select(F.col("p_partkey").alias("id"), origin.alias("provenance")), f.sources)


@query("""with c as (select 'o-' || o_orderkey as page, case when o_orderkey % 50 = 0 then 'ghost' else 'customer' end as tbl, cast(o_custkey + case when o_orderkey % 20 = 0 then 1000000 else 0 end as varchar) as id from orders)
select page, tbl, id, case when tbl = 'ghost' then 'table not synced' else 'row not found' end as reason from c where tbl = 'ghost' or id not in (select cast(c_custkey as varchar) from customer)""")
def citation_audit(f):
    cited = f.orders.select(F.expr("'o-' || o_orderkey").alias("page"), F.expr("if(o_orderkey % 50 = 0, 'ghost', 'customer')").alias("tbl"), F.expr("cast(o_custkey + if(o_orderkey % 20 = 0, 1000000, 0) as string)").alias("id"))
    rows = f.customer.select(F.lit("customer").alias("tbl"), F.col("c_custkey").cast("string").alias("id"))
    return tables.citation_audit(cited, rows.select("tbl"), rows)


@query("""with m as (select n_name as table_name, n_nationkey * 3 as changes, count(c_custkey) as n_rows, case when n_nationkey % 4 = 0 then null else n_nationkey end as days from nation left join customer on n_nationkey = c_nationkey group by all)
select table_name, round(least(1.0, changes / greatest(n_rows, 1) * least(1.0, coalesce(days, 30) / 30)), 6) as risk from m""")
def citation_risk(f):
    rows = f.nation.join(f.customer, F.col("n_nationkey") == F.col("c_nationkey"), "left").groupBy("n_name", "n_nationkey").agg(F.count("c_custkey").alias("n_rows"))
    meta = rows.select(F.col("n_name").alias("table_name"), (F.col("n_nationkey") * 3).alias("changes"), "n_rows", F.expr(f"if(n_nationkey % 4 = 0, null, timestamp'{AS_OF}' - make_interval(0, 0, 0, n_nationkey))").alias("last_audit_at"))
    return tables.citation_risk(meta, AS_OF).withColumn("risk", F.round("risk", 6))


@query("select c_mktsegment as value, cast(count(*) as bigint) as n from customer where c_mktsegment not in ('BUILDING', 'MACHINERY') group by 1")
def enum_usage(f):
    return f.customer.where(~F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).groupBy(F.col("c_mktsegment").alias("value")).agg(F.count("*").alias("n"))


@query("select row_idx, cells[1] as id, cells[2] as name, cells[3] as size from extracted where table_stem = 'Brand#2' and row_idx % 7 <> 0 order by row_idx limit 200")
def extracted_query(f):
    flagged = f.extracted.where("table_stem = 'Brand#2' and row_idx % 7 = 0").select("row_idx")
    got = tables.extracted_query(f.extracted, "Brand#2", 200, flagged)
    return got.select("row_idx", *[F.col("cells")[h].alias(h) for h in ("id", "name", "size")])


@query("select table_stem, cast(count(*) as bigint) as n_rows, max(row_idx) as last_row from extracted group by table_stem")
def extracted_list(f):
    return tables.listing(f.extracted)


@query("""with l as (select table_stem, row_idx, ['id', 'name', 'size'][i] as header, nullif(trim(cells[i]), '') as v, try_cast(replace(cells[i], ',', '') as double) as num from extracted, unnest([1, 2, 3]) as u(i)),
g as (select table_stem, header, count(v) as non_empty, count(num) filter (v is not null) as numeric, min(num) as lo, max(num) as hi, count(distinct v) as nd from l group by table_stem, header),
fv as (select table_stem, header, v, min(row_idx) as f from l where v is not null group by all), r as (select *, row_number() over (partition by table_stem, header order by f, v) as r from fv), t as (select table_stem, header, string_agg(v, '|' order by r) as first_values from r where r <= 3 group by all)
select g.table_stem, g.header, cast(non_empty as bigint) as non_empty, numeric >= 0.8 * non_empty as is_numeric, case when numeric >= 0.8 * non_empty then lo end as lo, case when numeric >= 0.8 * non_empty then hi end as hi,
case when numeric < 0.8 * non_empty then cast(nd as bigint) end as n_distinct, case when numeric < 0.8 * non_empty then first_values end as first_values from g join t on g.table_stem = t.table_stem and g.header = t.header""")
def column_summary(f):
    return tables.column_summary(f.extracted)


@query("""with c as (select table_stem, count(*) as n from extracted group by table_stem)
select table_stem, case when n <= 100 then 'full' else 'snapshot' end as mode, case when table_stem = 'Brand#1' then 'created' when table_stem = 'Brand#2' then 'updated' else 'unchanged' end as status from c""")
def promote_status(f):
    sha = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "cells"))), lambda x: F.array_join(x["cells"], "|")), "\n"), 256)
    known = f.extracted.where("table_stem <> 'Brand#1'").groupBy("table_stem").agg(sha.alias("sha"), F.count("*").alias("n_rows"))
    known = known.withColumn("sha", F.when(F.col("table_stem") == "Brand#2", "old").otherwise(F.col("sha")))
    return tables.promotion(f.extracted, known)


@query("select table_stem, row_idx, array_to_string([case when row_idx % 5 = 0 then 'fixed' else cells[1] end, cells[2], case when row_idx % 10 = 0 then '0' else cells[3] end], '|') as cells from extracted")
def apply_corrections(f):
    fixes = f.extracted.where("row_idx % 5 = 0").select("table_stem", "row_idx", F.lit("id").alias("header"), F.lit("fixed").alias("suggested")).unionByName(f.extracted.where("row_idx % 10 = 0").select("table_stem", "row_idx", F.lit("size").alias("header"), F.lit("0").alias("suggested")))
    return tables.correct(f.extracted, fixes).select("table_stem", "row_idx", F.array_join("cells", "|").alias("cells"))


@query("select doc_id, case when doc_id % 3 = 0 then 'indexed' when doc_id % 7 = 0 then 'updated' else 'unchanged' end as status from documents")
def index_upsert_status(f):
    new = f.documents.select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return tables.upsert(f.documents.where("doc_id % 3 <> 0"), new, "doc_id", "text")


# ---------------------------------------------------------------- activity


@query("""with p as (select page, unnest(projects) as p from activity), q as (select page, string_agg(distinct p, ',' order by p) as projects from p group by page)
select a.page, cast(count(*) filter (ingest_kind = 'current') as bigint) as current, cast(count(*) filter (ingest_kind = 'archival') as bigint) as archival, cast(count(*) filter (kind = 'user_signal') as bigint) as signals, max(ts) as last_ts, any_value(q.projects) as projects
from activity a join q on a.page = q.page group by a.page""")
def activity_by_page(f):
    return activity.by_page(f.activity)


_TOTAL = sum(math.e ** (-w / 2) for w in range(4))
_PROJECT_SQL = f"""fl as (select unnest(projects) as project, kind, ingest_kind, greatest(0, floor(floor((epoch(timestamp '{AS_OF}') - floor(epoch(ts))) / 86400) / 7)) as w from activity),
pr as (select project, count(*) filter (ingest_kind = 'current') as current, count(*) filter (ingest_kind = 'archival') as archival, count(*) filter (kind = 'user_signal') as signals, sum(case when ingest_kind = 'current' and w < 4 then exp(-w / 2.0) else 0 end) / {_TOTAL!r} as cadence from fl group by project)"""


@query(f"with {_PROJECT_SQL} select project, cast(current as bigint) as current, cast(archival as bigint) as archival, cast(signals as bigint) as signals, round(cadence, 6) as cadence from pr")
def activity_by_project(f):
    return activity.by_project(f.activity, AS_OF).withColumn("cadence", F.round("cadence", 6))


@query("select kind, cast(count(*) as bigint) as n from activity where ts >= timestamp '2024-01-31 00:00:00' - interval 14 day group by kind")
def activity_by_kind(f):
    return activity.since(f.activity, AS_OF, "2w").groupBy("kind").agg(F.count("*").alias("n"))


@query(f"with {_PROJECT_SQL}, m as (select max(current) as a, max(signals) as b, max(cadence) as c from pr) select project, round(.55 * current / a + .30 * signals / b + .15 * cadence / c, 6) as activity from pr, m")
def activity_score(f):
    return activity.activity_score(activity.by_project(f.activity, AS_OF)).select("project", F.round("activity", 6).alias("activity"))


@query(f"""with {_PROJECT_SQL}, m as (select max(current) as a, max(signals) as b, max(cadence) as c from pr), sc as (select project, round(round(.55 * current / a + .30 * signals / b + .15 * cadence / c, 6), 4) as s from pr, m),
sh as (select project, s, least(4, greatest(1, round(28 * s / sum(s) over ()))) as n from sc where s > 0), su as (select *, 28 - sum(n) over () as left_over, sum(4 - n) over (order by s desc, project) - (4 - n) as room, sum(n - 1) over (order by s, project) - (n - 1) as spare from sh)
select project, cast(case when left_over > 0 then n + greatest(0, least(4 - n, left_over - room)) else n - greatest(0, least(n - 1, -left_over - spare)) end as int) as slots from su""")
def slot_allocation(f):
    rows = activity.activity_score(activity.by_project(f.activity, AS_OF)).orderBy("project").collect()  # one row a project
    share = planner.distribute({r["project"]: round(round(r["activity"], 6), 4) for r in rows}, planner.split_slots(40)["project"])
    return f.spark.createDataFrame(sorted(share.items()), "project string, slots int")


@query(f"""with {_SCORE_SQL}, tg as (select path, 'proj-' || (length(path) % 5) as project from wiki_page), r as (select project, tg.path, round(composite, 6) as composite, row_number() over (partition by project order by round(composite, 6) desc, tg.path) as rank from tg join sc on tg.path = sc.path)
select project, cast(rank as int) as rank, path, composite from r where rank <= 5""")
def worst_within(f):
    tags = f.pages.select("path", F.expr("'proj-' || (length(path) % 5)").alias("project"))
    return activity.worst_within(lint.scores(f.pages, f.links, f.vault), tags).withColumn("composite", F.round("composite", 6))


# ---------------------------------------------------------------- lifecycle


@query("""with m as (select event_id % 40 as todo_id, event_type = 'purchase' as done, case event_id % 3 when 0 then 'notes/day.md' when 1 then 'notes/month.md' else 'notes/other.md' end as path from events)
select todo_id, case when bool_or(done) then 'done' else 'open' end as status, case max(case when contains(path, 'day') then 3 when contains(path, 'month') then 2 else 1 end) when 3 then 'day' when 2 then 'month' else 'year' end as priority, cast(count(*) as bigint) as mentions from m group by todo_id""")
def todo_sync(f):
    m = f.events.select((F.col("event_id") % 40).alias("todo_id"), (F.col("event_type") == "purchase").alias("done"), F.expr("case event_id % 3 when 0 then 'notes/day.md' when 1 then 'notes/month.md' else 'notes/other.md' end").alias("path"))
    return lifecycle.sync_todos(m)


@query("""with n as (select event_id as id, case event_id % 3 when 0 then '[[Part 3]] seen' when 1 then 'topic: Rings-' || (event_id % 50) || ' x' else 'plain ' || (event_id % 20) end as text from events), h as (select min(id) as id, lower(text) as t from n group by lower(text))
select n.id, case n.id % 3 when 0 then 'part-3' when 1 then 'rings-' || (n.id % 50) else 'attention' end as target from n join h on n.id = h.id""")
def note_routing(f):
    text = F.expr("case event_id % 3 when 0 then '[[Part 3]]  seen' when 1 then 'topic: Rings-' || (event_id % 50) || ' x' else 'plain ' || (event_id % 20) end")
    return lifecycle.route_notes(f.events.select(F.col("event_id").alias("id"), text.alias("text"))).select("id", "target")


@query("""with k as (select event_id, case when event_id % 4 = 0 then event_id else null end as todo_id, user_id from events), m as (select max(todo_id) as m from k)
select event_id, todo_id from k where todo_id is not null union all select event_id, m + row_number() over (order by user_id, event_id) from k, m where todo_id is null""")
def id_minting(f):
    rows = f.events.select("event_id", "user_id", F.expr("if(event_id % 4 = 0, event_id, null)").alias("todo_id"))
    return lifecycle.mint(rows, "todo_id", ["user_id", "event_id"]).select("event_id", "todo_id")


@query("select 'o-' || o_orderkey as path, array_to_string(list_sort(list_distinct(['new', 'p' || (o_orderkey % 3)])), ',') as projects from orders where o_orderkey % 2 = 0 union all select 'o-' || o_orderkey, 'p' || (o_orderkey % 3) from orders where o_orderkey % 2 = 1")
def project_rename(f):
    tags = f.orders.select(F.expr("'o-' || o_orderkey").alias("path"), F.expr("if(o_orderkey % 2 = 0, array('old', 'p' || (o_orderkey % 3)), array('p' || (o_orderkey % 3)))").alias("projects"))
    return lifecycle.rename_project(tags, "old", "new").withColumn("projects", F.array_join("projects", ","))


@query("select 'o-' || o_orderkey as path, array_to_string(list_sort(list_distinct(['gone', 'p' || (o_orderkey % 3)])), ',') as projects from orders where o_orderkey % 2 = 0 union all select 'o-' || o_orderkey, 'gone' from orders where o_orderkey % 2 = 1")
def project_delete_restore(f):
    tags = f.orders.select(F.expr("'o-' || o_orderkey").alias("path"), F.expr("if(o_orderkey % 2 = 0, array('gone', 'p' || (o_orderkey % 3)), array('gone'))").alias("projects"))
    return lifecycle.restore_project(*lifecycle.delete_project(tags, "gone")).withColumn("projects", F.array_join("projects", ","))


@query("select p_name || ' ' || p_partkey as name, case when p_partkey % 3 = 0 then 'ok' when p_partkey % 3 = 1 then 'not_found' else 'pending' end as status from part")
def identifier_lookup(f):
    name = F.expr("p_name || ' ' || p_partkey")
    cache = f.part.where("p_partkey % 5 <> 7").select(F.upper(name).alias("name"), F.expr("case p_partkey % 3 when 0 then 'ok' when 1 then 'not_found' else 'error' end").alias("status"), F.lit(2).alias("fetched_at"))
    cache = cache.unionByName(cache.withColumn("status", F.lit("error")).withColumn("fetched_at", F.lit(1)))
    return lifecycle.lookup(f.part.select(name.alias("name")), cache)


@query("""with r as (select lower(trim(p_name)) as name, p_brand as page from part) select name, cast(count(distinct page) as bigint) as n_pages, min(page) as first_page from r where name not in (select lower(p_name) from part where p_partkey < 20) group by name""")
def request_queue(f):
    asked = f.part.groupBy(F.col("p_brand").alias("source_page")).agg(F.collect_list(F.upper("p_name")).alias("names"))
    return lifecycle.queue(asked, f.part.where("p_partkey < 20").select(F.col("p_name").alias("name")))


@query("select p_partkey as asset, case when p_partkey % 2 = 0 and p_partkey % 3 = 0 then 'ok' when p_partkey % 2 = 0 then 'unreferenced' else 'missing' end as state from part where p_partkey % 2 = 0 or p_partkey % 3 = 0")
def figure_check(f):
    a = f.part.select(F.col("p_partkey").alias("asset"))
    return lifecycle.assets(a.where("asset % 2 = 0"), a.where("asset % 3 = 0"))


@query("with s as (select p_partkey as path, p_name as stem, row_number() over (partition by p_name order by p_partkey) as n from part) select path, case when n = 1 then stem else stem || '-' || n end as stem from s")
def stem_suffixes(f):
    return lifecycle.suffixes(f.part.select(F.col("p_partkey").alias("path"), F.col("p_name").alias("stem")))


@query("select path, replace(replace(replace(text, '[[part-3]]', '[[piece-3]]'), '[[part-3|', '[[piece-3|'), '[[Part 3]]', '[[piece-3]]') as text from wiki_page where regexp_matches(text, '\\[\\[(part-3|Part 3)(\\]|\\|)')")
def link_rewrite(f):
    renames = f.spark.createDataFrame([("part-3", "piece-3")], "old string, new string")
    return lifecycle.rewrite_links(f.pages.select("path", "text"), renames)


@query("select doc_id, regexp_replace(regexp_replace(regexp_replace(lower(text), '[^a-z0-9-]+', '-', 'g'), '-{2,}', '-', 'g'), '^-+|-+$', '', 'g') as slug from documents")
def slugify(f):
    return f.documents.select("doc_id", tx.slug("text").alias("slug"))


@query("""with h as (select page_id, regexp_extract(url, '//(?:www\\.)?([^/]+)', 1) as h from pages), p as (select page_id, h, string_split(h, '.') as p from h)
select page_id, case when h = '' then 'Web' else upper(left(case when len(p) >= 2 then p[-2] else p[1] end, 1)) || lower(substring(case when len(p) >= 2 then p[-2] else p[1] end, 2)) end as origin from p""")
def url_origin(f):
    return f.html_pages.select("page_id", naming.origin("url").alias("origin"))


@query("select page_id, length(regexp_replace(html, '%%+', '%', 'g')) as n from pages")
def percent_collapse(f):
    return f.html_pages.select("page_id", F.length(tx.collapse_percent("html")).cast("long").alias("n"))


@query("""select doc_id, substring(sha256(text), 1, 16) as hash from documents""")
def content_hash(f):
    return f.documents.select("doc_id", tx.short_hash("text").alias("hash"))


@query(f"""with {_SCORE_SQL} select cast((select count(*) from wiki_page) as bigint) as pages, cast((select count(*) from sources) as bigint) as sources, cast((select count(*) from wiki_link) as bigint) as links, (select round(avg(composite), 6) from sc) as mean_composite, cast((select count(*) from sc where orphan = 1.0) as bigint) as orphans,
cast((select count(*) from links where target not in (select stem from stems)) as bigint) as dead, case when (select count(*) from links where target not in (select stem from stems)) > 0 then 'create' else 'repair' end as mode""")
def epoch_summary(f):
    scored = lint.scores(f.pages, f.links, f.vault)
    one = f.pages.agg(F.count("*").alias("pages"))
    for d in (f.sources.agg(F.count("*").alias("sources")), graph.wiki_links(f.pages).agg(F.count("*").alias("links")), scored.agg(F.round(F.avg("composite"), 6).alias("mean_composite"), F.count_if(F.col("orphan") == 1.0).alias("orphans")), lint.dead_links(f.links, f.pages).agg(F.count("*").alias("dead"))):
        one = one.crossJoin(d)  # one row each
    return one.withColumn("mode", F.when(F.col("dead") > 0, "create").otherwise("repair"))


# ---------------------------------------------------------------- rewrites


@query("select path, replace(replace(text, '[[Part ', '[[part-'), 'title: ' || title, 'title: ' || case type when 'concept' then '[con]' when 'entity' then '[ent]' when 'analysis' then '[ana]' when 'evidence' then '[evi]' else '[src]' end || ' ' || title) as text from wiki_page")
def page_rewrites(f):
    fixed = f.pages.select("path", rewrites.title_prefix("text").alias("text"))
    return fixed.select("path", rewrites.normalise_links("text").alias("text"))


@query("select p_partkey, 'ring `ring` (vault:a) see [[x|y]] ' || case when p_partkey % 3 = 0 then 'widget widget' else '[[w|widget]]' end as text from part")
def link_application(f):
    text = F.expr("'ring `ring` (vault:a) (vault:a) see [[x|y]] ' || if(p_partkey % 3 = 0, 'widget widget', 'widget')")
    once = rewrites.dedup_citations(text)
    return f.part.select("p_partkey", rewrites.apply_link(once, F.lit("widget"), F.lit("w")).alias("text"))


@query("select doc_id as path, case when doc_id % 10 = 0 then 'removed' when doc_id % 10 = 1 then 'added' else 'changed' end as state from documents where doc_id % 10 in (0, 1, 2)")
def guard_check(f):
    base = f.documents.select(F.col("doc_id").alias("path"), "text")
    now = base.where("path % 10 <> 0").withColumn("text", F.when(F.col("path") % 10 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return rewrites.tampered(rewrites.fingerprint(now), rewrites.fingerprint(base.where("path % 10 <> 1")))


@query("""with s as (select p_partkey, round((case when contains(lower(p_name), 'red ring') then 0.0 else levenshtein(lower(p_name), 'red ring') / greatest(length(p_name), 8) end) * 0.875 + (case when contains(lower(p_type), 'red ring') then 0.0 else levenshtein(lower(p_type), 'red ring') / greatest(length(p_type), 8) end) * 0.125, 6) as score from part)
select p_partkey, score from s where score <= 0.35 order by score, p_partkey limit 200""")
def fuzzy_titles(f):
    return search.fuzzy(f.part, "p_partkey", "Red Ring", {"p_name": 0.7, "p_type": 0.1})


@query("""with tok as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as t from documents),
wd as (select doc_id, unnest(t) as w from tok), lw as (select doc_id, w, row_number() over (partition by doc_id order by length(w) desc, w) as r from (select distinct doc_id, w from wd where length(w) >= 3)),
asked as (select doc_id, w from lw where r = 1), post as (select w, doc_id, count(*) as tf from wd group by all), df as (select w, count(*) as df from post group by w), st as (select count(*) as n, avg(len(t)) as a from tok),
hit as (select q.doc_id as page, p.doc_id as doc, row_number() over (partition by q.doc_id order by round(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(k.t) / a)), 6) desc, 'src/' || p.doc_id) as r
    from asked q join post p on q.w = p.w join df on df.w = q.w join tok k on k.doc_id = p.doc_id, st),
g as (select page, avg(case when page % 2 = 0 and page = doc then 0.0 else 1.0 end) as gap from hit where r <= 10 group by page)
select 'p/' || d.doc_id as path, round(coalesce(gap, 0.0), 6) as gap from documents d left join g on g.page = d.doc_id""")
def coverage_gap(f):
    words = F.array_distinct(F.filter(tx.words("text"), lambda w: F.length(w) >= 3))
    longest = F.try_element_at(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), F.lit(1))["w"]
    cite = F.expr("if(doc_id % 2 = 0, '(vault:src/' || doc_id || ')', 'none')")
    asked = f.documents.select(F.expr("'p/' || doc_id").alias("path"), F.coalesce(longest, F.lit("")).alias("stem"), cite.alias("text"))
    docs = f.documents.select(F.expr("'src/' || doc_id").alias("doc"), "text")
    return search.coverage_gap(asked, docs).withColumn("gap", F.round("gap", 6))


# ---------------------------------------------------------------- ingest


@query("""with l as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '' and not starts_with(x, '#') and not starts_with(x, '<!--')) as l from documents),
n as (select doc_id, l, list_min(list_filter(range(1, len(l) + 1), lambda i: length(array_to_string(l[1:i], ' ')) > 400)) as k from l)
select doc_id, substring(array_to_string(l[1:coalesce(k, len(l))], ' '), 1, 500) as summary from n""")
def stub_summary(f):
    return f.documents.select("doc_id", ingest.stub_summary("text").alias("summary"))


@query("""select p_partkey, 'arxiv:2401.' || lpad(cast(p_partkey % 10000 as varchar), 5, '0') || case when p_partkey % 2 = 0 then ',doi:10.1234/x' || p_partkey else '' end as refs from part""")
def primary_refs(f):
    text = F.expr("'source_url: https://arxiv.org/abs/2401.' || lpad(cast(p_partkey % 10000 as string), 5, '0') || chr(10) || if(p_partkey % 2 = 0, 'source_url: https://doi.org/10.1234/X' || p_partkey || chr(10), '') || 'arXiv: 9999.00001 in the body'")
    return f.part.select("p_partkey", F.array_join(ingest.primary_refs(text), ",").alias("refs"))


@query("""select 'd/p-' || p_partkey || '.extracted.md' as path, case when p_partkey % 3 = 0 then null when p_partkey % 2 = 0 then 'd/p-' || p_partkey || '.csv' else 'd/p-' || p_partkey || '.pdf' end as original from part""")
def original_files(f):
    name = lambda s: F.expr(f"'d/p-' || p_partkey || '{s}'").alias("path")
    files = f.part.select(name(".extracted.md")).unionByName(f.part.where("p_partkey % 3 <> 0").select(name(".pdf"))).unionByName(f.part.where("p_partkey % 3 <> 0 and p_partkey % 2 = 0").select(name(".csv")))
    return ingest.originals(files)


@query("""with e as (select doc_id as path, sha256(text) as sha from documents), s as (select doc_id as path, case when doc_id % 7 = 0 then sha256(text) end as sha from documents where doc_id % 4 = 0)
select path from e where path not in (select path from s) and sha not in (select sha from s where sha is not null)""")
def missing_stubs(f):
    rows = f.documents.select(F.col("doc_id").alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    return ingest.uncovered(rows, rows.where("path % 4 = 0").withColumn("sha", F.when(F.col("path") % 7 == 0, F.col("sha"))))


@query("""select cast(count(*) as bigint) as considered, cast(count(*) filter (n_chars >= 300) as bigint) as ok, cast(count(*) filter (n_chars < 300) as bigint) as failed, cast(count(*) filter (n_chars <= 4000) as bigint) as "full", cast(count(*) filter (n_chars > 4000) as bigint) as snippet from documents""")
def ingest_summary(f):
    return ingest.run_summary(f.documents.select(F.expr("if(n_chars >= 300, 'ok', 'short')").alias("status"), F.expr("if(n_chars <= 4000, 'full', 'snippet')").alias("mode")))


@query("""select 'multimodal' as queue, doc_id as path from documents where doc_id % 2 = 0 and doc_id % 6 <> 0 union all select 'tables', doc_id from documents where doc_id % 5 = 0""")
def work_queues(f):
    text = F.expr("'---' || chr(10) || if(doc_id % 2 = 0, 'multimodal_recommended: true' || chr(10), '') || if(doc_id % 6 = 0, 'multimodal_done: True' || chr(10), '') || if(doc_id % 5 = 0, 'has_tables: \\'true\\'' || chr(10), '') || 'title: x' || chr(10) || '---' || chr(10) || text")
    return ingest.work_queues(f.documents.select(F.col("doc_id").alias("path"), text.alias("text")))


@query("""select 'b' || (row_idx % 3) as backup_id, table_stem, max('2024-01-' || lpad(cast(row_idx % 28 + 1 as varchar), 2, '0')) as backup_at, cast(count(*) as bigint) as n_rows from extracted group by 1, 2""")
def backup_list(f):
    rows = f.extracted.select(F.expr("'b' || (row_idx % 3)").alias("backup_id"), "table_stem", F.expr("'2024-01-' || lpad(cast(row_idx % 28 + 1 as string), 2, '0')").alias("backup_at"))
    return ingest.backups(rows)


@query("""with w as (select doc_id, list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: true) as w from documents),
p as (select doc_id, w, list_position(list_transform(w, lambda x: lower(regexp_replace(x, '[^\\p{L}\\p{N}]', '', 'g'))), 'that') as p from w), b as (select doc_id, w, cast(greatest(1, coalesce(nullif(p, 0), 1) - 20) as bigint) as b from p)
select doc_id, array_to_string(list_transform(w[b:b + 39], lambda x: case when lower(regexp_replace(x, '[^\\p{L}\\p{N}]', '', 'g')) = 'that' then '>>>' || x || '<<<' else x end), ' ') as snippet from b""")
def keyword_snippet(f):
    return f.documents.select("doc_id", ingest.snippet("text", ["that"]).alias("snippet"))


# ---------------------------------------------------------------- notes, names, plans


_NOTE_OF = "'- ' || {t} || ' [[part-3|the part]] of [[Rings]]  here (note:N' || doc_id || ') (created: 2024-01-05)'"


@query(r"""with l as (select doc_id, trim(regexp_replace('the part of Rings here', '\s+', ' ', 'g')) as tail, substr(regexp_replace(coalesce(text, ''), '[^a-z ]', '', 'g'), 1, 40) as t from documents where doc_id is not null)
select 'N' || doc_id as note_id, trim(regexp_replace(any_value(t) || ' ' || any_value(tail), '\s+', ' ', 'g')) as text from l where doc_id % 3 <> 0 group by doc_id""")
def note_backfill(f):
    said = f.documents.where("doc_id is not null").withColumn("t", F.expr("substr(regexp_replace(coalesce(text, ''), '[^a-z ]', ''), 1, 40)"))
    lines = said.select(F.lit("notes/a.md").alias("path"), F.col("doc_id").alias("pos"), F.expr(_NOTE_OF.format(t="t")).alias("line"))
    known = f.documents.where("doc_id % 3 = 0").select(F.expr("'N' || doc_id").alias("note_id"))
    return notes.backfill(lines, known)


@query("""with u as (select vec_id, list_transform(cast(embedding as double[]), lambda x: x / sqrt(list_inner_product(cast(embedding as double[]), cast(embedding as double[])))) as e from embeddings),
p as (select a.vec_id, b.vec_id as anchor, round(list_inner_product(a.e, b.e), 6) as similarity from u a, u b where a.vec_id % 7 = 0 and b.vec_id % 7 <> 0),
r as (select *, row_number() over (partition by vec_id order by similarity desc, anchor) as r from p)
select vec_id, anchor, similarity from r where r = 1 and similarity >= 0.3""")
def note_repeats(f):
    known = f.embeddings.where("vec_id % 7 <> 0").select(F.col("vec_id").alias("anchor"), F.col("embedding").alias("anchor_embedding"))
    return notes.repeats(f.embeddings.where("vec_id % 7 = 0"), known, 0.3)


@query("""with n as (select 'notes/topic-' || (event_id % 60) || '.md' as path, string_agg('- seen ' || event_id, chr(10) order by event_id) as l from events where event_id % 4 = 1 group by 1),
p as (select 'notes/topic-' || r_regionkey || '.md' as path, 'old ' || r_name || case when r_regionkey % 2 = 0 then chr(10) else '' end as text from region)
select n.path, coalesce(case when ends_with(p.text, chr(10)) then p.text else p.text || chr(10) end, '---' || chr(10) || 'title: "[note] Topic ' || regexp_extract(n.path, '(\\d+)', 1) || '"' || chr(10) || 'type: note' || chr(10) || 'created: 2024-01-31' || chr(10) || 'updated: 2024-01-31' || chr(10) || '---' || chr(10) || chr(10) || '## notes' || chr(10) || chr(10)) || n.l || chr(10) as text from n left join p on n.path = p.path""")
def note_append(f):
    pages = f.region.select(F.expr("'notes/topic-' || r_regionkey || '.md'").alias("path"), F.expr("'old ' || r_name || if(r_regionkey % 2 = 0, chr(10), '')").alias("text"))
    fresh = f.events.where("event_id % 4 = 1").select(F.expr("'notes/topic-' || (event_id % 60) || '.md'").alias("path"), F.col("event_id").alias("id"), F.expr("'- seen ' || event_id").alias("line"))
    return notes.append(pages, fresh, "2024-01-31")


@query("""with m as (select 'arxiv:' || (l_partkey % 300) as ref, 's-' || (l_suppkey % 9) as source from lineitem), g as (select ref, list_sort(list(distinct source)) as s from m group by ref)
select ref, case when cast(substr(ref, 7) as int) % 5 = 0 then 'asked' when cast(substr(ref, 7) as int) % 3 = 0 then 'held' else 'new' end as status, array_to_string(s[1:3], ', ') as sources from g""")
def reference_requests(f):
    of = lambda k: f.spark.range(300).where(f"id % {k} = 0").select(F.expr("'arxiv:' || id").alias("ref"))
    return notes.requests(f.lineitem.select(F.expr("'arxiv:' || (l_partkey % 300)").alias("ref"), F.expr("'s-' || (l_suppkey % 9)").alias("source")), of(3), of(5))


@query("select event_id as pos, 'wave ' || event_id as header from events where event_id % 10 = 0 order by event_id desc limit 5")
def log_sections(f):
    return notes.sections(f.events.select(F.col("event_id").alias("pos"), F.expr("if(event_id % 10 = 0, '## wave ' || event_id, '### ' || event_type)").alias("line")))


_NAMES = ["alpha-2", "2alpha", "beta-", "Gamma", "a", "", "x\n", "notes/day.md", "todos/a/b.md", "notes/../x.md", "/notes/x.md", "notes/", "pages/x.md", "notes\\x.md", "./notes/y.md", "notes/.md", "notes/x.txt", "..", "raw/a b?.pdf", ".hidden", "raw/", "dé.png"]
_NAME_ROWS = ", ".join("(" + "'" + n.replace("\n", "' || chr(10) || '") + "')" for n in _NAMES)


@query(rf"""with n as (select * from (values {_NAME_ROWS}) t(name)), c as (select name, regexp_replace(regexp_extract(name, '([^/]*)/*$', 1), '[^a-zA-Z0-9._-]', '_', 'g') as c from n)
select name, regexp_full_match(name, '[a-z]([a-z0-9-]*[a-z0-9])?') as project, regexp_full_match(name, '(\./)*(notes|todos)/(.*/)?[^/\\]+\.md') and not contains(name, '..') as editable, case when c <> '' and not starts_with(c, '.') then c end as file_name from c""")
def name_safety(f):
    rows = f.spark.createDataFrame([(n,) for n in _NAMES], "name string")
    return rows.select("name", gates.project_name("name").alias("project"), gates.editable("name").alias("editable"), gates.file_name("name").alias("file_name"))


@query("""with t as (select doc_id, regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', '?', 'g') as text from documents), c as (select doc_id, text, substr(text, 1, 300) as c from t)
select doc_id, case when length(text) > 300 then case when contains(c, chr(10)) then regexp_replace(c, '\\n[^\\n]*$', '') else c end else text end as text, case when length(text) > 300 then 'snippet' else 'full' end as mode from c""")
def extract_truncation(f):
    cut = gates.truncated(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7F]", "?"), 300)
    return f.documents.select("doc_id", cut.alias("c")).select("doc_id", "c.text", "c.mode")


@query("""with st as (select path, lower(stem) as s, 'parts/p-' || (length(text) % 200 + 1) || '.extracted.md' as e, text from wiki_page where dir = 'sources'),
ib as (select target, count(*) as n from links where lower(stem) <> target group by target),
wo as (select path, e, text, coalesce(n, 0) as inbound from st left join ib on s = target order by inbound, path limit 30),
sd as (select path, replace(lower(wo.text), 'type: source' || chr(10), 'type: source' || chr(10) || 'sources: [' || e || ']' || chr(10)) || coalesce(chr(10) || lower(vault.text), '') as t from wo left join vault on e = doc),
nm as (select lower(stem) as stem, min(path) as target from wiki_page where dir in ('concepts', 'entities') and length(stem) >= 3 group by lower(stem)),
h as (select sd.path, nm.stem, target, len(regexp_extract_all(t, '\\b' || replace(nm.stem, '-', ' ') || '\\b')) as n from sd, nm where contains(t, replace(nm.stem, '-', ' '))),
r as (select path, target, row_number() over (partition by path order by n desc, stem) as r from h where n > 0), a as (select path, string_agg(target, ',' order by r) as targets from r where r <= 3 group by path)
select wo.path as stub, cast(inbound as bigint) as inbound, coalesce(targets, '') as targets from wo left join a on wo.path = a.path""")
def orphan_stubs(f):
    named = F.expr("replace(text, 'type: source' || chr(10), 'type: source' || chr(10) || 'sources: [parts/p-' || (length(text) % 200 + 1) || '.extracted.md]' || chr(10))")
    pages = f.pages.withColumn("text", F.when(F.col("dir") == "sources", named).otherwise(F.col("text")))
    return lint.orphan_stubs(pages, lint.inbound(f.links, f.pages), f.vault.select(F.col("doc").alias("path"), "text"))


@query("""select 'parts/p-' || (length(text) % 200 + 1) || '.extracted.md' as source, min(path) as stub from wiki_page where dir = 'sources' group by 1""")
def stub_lookup(f):
    named = F.expr("replace(text, 'type: source' || chr(10), 'type: source' || chr(10) || 'sources:' || chr(10) || '  - parts/p-' || (length(text) % 200 + 1) || '.extracted.md' || chr(10))")
    return lint.stubs_of(f.pages.where("dir = 'sources'").select("path", named.alias("text")))


@query("""with p as (select a.src as page_a, b.src as page_b, count(distinct a.dst) as shared_sources from cites a join cites b on a.dst = b.dst and a.src < b.src group by a.src, b.src),
k as (select distinct least(src, dst) as x, greatest(src, dst) as y from wiki_link),
t as (select path, case when length(path) % 3 = 0 then '' when length(path) % 3 = 1 then 'p1' else 'p1,p2' end as p from wiki_page where type <> 'source'),
b as (select page_a, page_b, cast(shared_sources as bigint) as shared_sources from p where not exists (select 1 from k where x = page_a and y = page_b) order by shared_sources desc, page_a, page_b limit 20)
select page_a, page_b, shared_sources, coalesce(ta.p, '') as projects_a, coalesce(tb.p, '') as projects_b, coalesce(ta.p <> '' and tb.p <> '' and ta.p <> tb.p, false) as cross_project from b left join t ta on ta.path = page_a left join t tb on tb.path = page_b""")
def bridge_projects(f):
    tags = f.pages.where("type <> 'source'").select("path", F.expr("case length(path) % 3 when 0 then array('') when 1 then array('p1') else array('p2', 'p1', 'p2') end").alias("projects"))
    got = graph.tagged_bridges(graph.bridges(graph.cites(f.pages, f.sources), graph.wiki_links(f.pages), 20), tags)
    return got.withColumn("projects_a", F.array_join("projects_a", ",")).withColumn("projects_b", F.array_join("projects_b", ","))


@query("with d as (select p, count(*) as n from (select src as p from wiki_link union all select dst from wiki_link) group by p) select path, round(4 + 1.6 * sqrt(coalesce(n, 0) + 1), 6) as radius from wiki_page left join d on path = p")
def node_radius(f):
    linked = graph.wiki_links(f.pages)
    ends = linked.select(F.col("src").alias("path")).unionAll(linked.select(F.col("dst").alias("path"))).groupBy("path").agg(F.count("*").alias("n"))
    return f.pages.join(ends, "path", "left").select("path", F.round(graph.radius("n"), 6).alias("radius"))


_CHANGES = "select c_custkey * 3 as c_custkey, 'renamed ' || c_custkey as c_name, case when c_custkey % 2 = 0 then -1.0 end as c_acctbal, case when c_custkey % 7 = 0 then 'web' else 'log:' || c_custkey end as _provenance from {customer} where c_custkey % 5 = 0"


@query(f"""with ch as ({_CHANGES.format(customer="customer")}) select c.c_custkey, coalesce(ch.c_name, c.c_name) as c_name, cast(coalesce(ch.c_acctbal, c.c_acctbal) as double) as c_acctbal, ch._provenance, case when ch.c_custkey is not null then '2024-01-31' end as _updated_at
from customer c left join (select * from ch where _provenance <> 'web') ch on c.c_custkey = ch.c_custkey""")
def class_table_update(f):
    rows = f.customer.select("c_custkey", "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    return tables.update(rows, f.spark.sql(_CHANGES, customer=f.customer).withColumn("c_acctbal", F.col("c_acctbal").cast("double")), "c_custkey", "2024-01-31")[0]


@query(f"""with ch as ({_CHANGES.format(customer="customer")}) select c_custkey, case when _provenance = 'web' then 'refused' when c_custkey in (select c_custkey from customer) then 'updated' else 'not_found' end as status from ch""")
def class_table_update_status(f):
    return tables.update(f.customer.select("c_custkey", "c_name"), f.spark.sql(_CHANGES, customer=f.customer), "c_custkey", "2024-01-31")[1]


@query("""with a as (select c_mktsegment as t, max(timestamp '2024-01-01 00:00:00' + to_days(cast(c_custkey % 9 as int))) as audited from customer where c_mktsegment <> 'MACHINERY' group by 1),
e as (select ts, ['MACHINERY', 'BUILDING', 'FURNITURE', 'UNKNOWN'][event_id % 4 + 1] as t from events) select e.t as table_name, cast(count(*) filter (audited is null or ts > audited) as bigint) as changes from e left join a on e.t = a.t group by e.t""")
def change_counter(f):
    audits = f.customer.where("c_mktsegment <> 'MACHINERY'").select(F.col("c_mktsegment").alias("table_name"), F.expr("timestamp '2024-01-01 00:00:00' + make_dt_interval(c_custkey % 9)").alias("last_audit_at"))
    changes = f.events.select(F.expr("array('MACHINERY', 'BUILDING', 'FURNITURE', 'UNKNOWN')[event_id % 4]").alias("table_name"), F.col("ts").alias("at"))
    return tables.change_counts(changes, audits)


@query("""with m as (select distinct p_brand as table_name from part union all select 'empty'), n as (select p_brand as t, count(*) as n from part group by 1)
select table_name, 'h-' || table_name as schema_hash, 'entities/' || lower(table_name) || '.md' as entity_page, cast(coalesce(n, 0) as bigint) as row_count from m left join n on t = table_name""")
def class_table_list(f):
    names = f.part.select(F.col("p_brand").alias("table_name")).distinct().unionAll(f.spark.range(1).select(F.lit("empty").alias("table_name")))
    meta = names.select("table_name", F.expr("'h-' || table_name").alias("schema_hash"), F.expr("'entities/' || lower(table_name) || '.md'").alias("entity_page"))
    return tables.class_tables(meta, f.part.groupBy(F.col("p_brand").alias("table_name")).agg(F.count("*").alias("n")))


@query("""select coalesce(l.n, d.n) as table_name, case when d.n is null then 'undeclared' when l.n is null then 'not synced' when l.n % 3 = 0 then 'stale' else 'synced' end as state
from (select n_nationkey as n from nation where n_nationkey % 5 <> 0) l full join (select n_nationkey as n from nation where n_nationkey % 4 <> 0) d on l.n = d.n""")
def schema_report(f):
    of = lambda keep, h: f.nation.where(keep).select(F.col("n_nationkey").alias("table_name"), F.expr(h).alias("schema_hash"))
    return tables.declared_report(of("n_nationkey % 5 <> 0", "'a'"), of("n_nationkey % 4 <> 0", "if(n_nationkey % 3 = 0, 'b', 'a')"))


@query("""select case when event_id % 3 = 0 then 'genes' else 'chemicals' end as kind, case when event_type = 'purchase' then 'ok' when event_type = 'signup' then 'not_found' else 'pending' end as status, cast(count(*) as bigint) as n from events group by 1, 2""")
def cache_status(f):
    e = f.events.select(F.expr("if(event_id % 3 = 0, 'genes', 'chemicals')").alias("kind"), F.expr("case event_type when 'purchase' then 'ok' when 'signup' then 'not_found' end").alias("status"))
    return lifecycle.cache_stats(e.where("status is not null"), e.where("status is null").select("kind"))


@query("""select case when p_partkey % 3 = 0 then 'genes' else 'chemicals' end as kind, case when p_partkey % 3 = 0 then 'https://genes.example' else 'https://chemicals.example' end as endpoint, false as enabled, cast(count(distinct lower(p_name)) as bigint) as n_names, min(lower(p_name)) as first_name from part group by 1, 2""")
def resolver_plan(f):
    names = f.part.select(F.expr("if(p_partkey % 3 = 0, 'genes', 'chemicals')").alias("kind"), F.expr("'  ' || upper(p_name)").alias("name"))
    return lifecycle.resolver_plan(names, {"genes": "https://genes.example", "chemicals": "https://chemicals.example"}, False)


@query("""with x as (select 'vault/p-' || p_partkey || case when p_partkey % 2 = 0 then '.pdf.pdf' else '.pdf' end as path, p_partkey as k, unnest(range(1, p_size % 5 + 1)) as page from part)
select path, cast(page as int) as page, 'p-' || k || '-p' || page || '.png' as asset, case when page = 1 and k % 3 = 0 then 'skip' else 'render' end as action from x""")
def render_plan(f):
    files = f.part.select(F.expr("'vault/p-' || p_partkey || if(p_partkey % 2 = 0, '.pdf.pdf', '.pdf')").alias("path"), F.expr("p_size % 5").alias("n_pages"))
    return lifecycle.render_plan(files, f.part.where("p_partkey % 3 = 0").select(F.expr("'p-' || p_partkey || '-p1.png'").alias("asset")))


@query("select doc_id, case when doc_id % 2 = 0 then 'inner ' || doc_id else 'outer' end as title, 'u' as source_url, 'mail' as kind from documents")
def source_fields(f):
    inner = F.expr("if(doc_id % 2 = 0, '---' || chr(10) || 'title: inner ' || doc_id || chr(10) || 'source_url: u' || chr(10) || '---' || chr(10), '')")
    head = "---\ntitle: outer\nkind: mail\nsource_url: u\n---\n\n<!-- BEGIN FETCHED CONTENT -->\n"
    fields = f.documents.select("doc_id", frontmatter.source_fields(F.concat(F.lit(head), inner, F.lit("# body"))).alias("m"))
    return fields.select("doc_id", *[F.col("m")[k][0].alias(k) for k in ("title", "source_url", "kind")])


# ---------------------------------------------------------------- streams


def _stream(f: Fixtures) -> DataFrame:
    raw = f.spark.readStream.schema(f.events.schema).option("pathGlobFilter", "events*.parquet").parquet(f.sf_dir)
    return raw.select(F.col("ts").cast("timestamp").alias("ts"), F.expr("'o-' || user_id").alias("page"), F.expr("case event_type when 'signup' then 'archival' when 'purchase' then 'current' end").alias("ingest_kind"), F.array(F.expr("'proj-' || (user_id % 10)")).alias("projects"), F.expr("'n-' || (event_id % 97)").alias("name"))


@query()
def stream_cadence(f):
    return streams.drain(streams.cadence(_stream(f)), "vellum_cadence")


@query()
def stream_sessions(f):
    return streams.drain(streams.sessions(_stream(f).select("ts", "page")), "vellum_sessions")


@query()
def stream_request_dedup(f):
    return streams.drain(streams.fresh_requests(_stream(f).select("ts", "name")), "vellum_requests")
