"""Native shapes (pages, sources, links, events, tables) from the driver's tables, in Spark and in SQL.

Both engines run the same definitions, so that a query and its SQL start from equal inputs.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as tx

AS_OF = "2024-01-31 00:00:00"
#: Concept pages of parts: stems part-0 ... part-38 and one of five words, while links go to part-0 ... part-49.
PART_PAGES, PART_TARGETS = 40, 50

_DIR = "case o_orderpriority when '1-URGENT' then 'concepts' when '2-HIGH' then 'entities' when '3-MEDIUM' then 'analyses' when '4-NOT SPECIFIED' then 'evidence' else 'sources' end"
_TYPE = "case o_orderpriority when '1-URGENT' then 'concept' when '2-HIGH' then 'entity' when '3-MEDIUM' then 'analysis' when '4-NOT SPECIFIED' then 'evidence' else 'source' end"
_LINK = f"case when l_partkey % 17 = 0 then '[[Part ' || (l_partkey % {PART_TARGETS}) || ']]' when l_linenumber = 2 then '[[part-' || (l_partkey % {PART_TARGETS}) || '|the part]]' else '[[part-' || (l_partkey % {PART_TARGETS}) || ']]' end"
_CITE = "case when l_partkey % 4 = 0 then '' else ' (vault:parts/p-' || l_partkey || '.extracted.md)' end"
_SENTENCE = f"'Item ' || l_linenumber || ' moves part ' || l_partkey || ' under flag ' || l_returnflag || ' as noted in ' || {_LINK} || {_CITE} || '.'"
_HEAD = "'---' || chr(10) || 'title: ' || title || chr(10) || 'type: ' || type || chr(10) || 'created: ' || created || chr(10) || '---' || chr(10) || '# ' || title || chr(10)"

_CREATED = "cast(cast(o_orderdate as date) as string)"
_NEXT = "lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey)"
_PAGE_OF_ORDER = f"""select o_orderkey as k, {_DIR} as dir, {_TYPE} as type, 'Order ' || o_orderkey as title, {_CREATED} as created,
    'o-' || o_orderkey as stem, {_NEXT} as nxt from {{orders}}"""
_PAGE_TEXT = f"{_HEAD} || coalesce(items || chr(10), '') || coalesce('Next in line is [[o-' || nxt || ']].', '')"
_PART_PAGE = f"""select p_partkey as k, 'concepts' as dir, 'concept' as type, 'Part ' || p_partkey as title, '2024-01-01' as created, case when p_partkey = 39 then 'long-review-of-part-39' else 'part-' || p_partkey end as stem,
    'Part ' || p_partkey || ' relates to [[part-' || ((p_partkey * 7 + 1) % {PART_TARGETS}) || ']].' || case when p_partkey % 5 = 1 then ' A long review of part 39 says so.' when p_partkey % 5 = 2 then ' Read the [[long-review-of-part-39]], a long review of part 39.' else '' end as items, cast(null as bigint) as nxt from {{part}} where p_partkey < {PART_PAGES}"""

#: Common table expressions of DuckDB that every catalogue SQL may use.
SQL = f"""
with order_page as ({_PAGE_OF_ORDER.format(orders="orders")}),
body as (select l_orderkey as k, string_agg(s, chr(10) order by l_linenumber, l_partkey, s) as items from (select l_orderkey, l_linenumber, l_partkey, {_SENTENCE} as s from lineitem) group by l_orderkey),
all_page as (select o.k, dir, type, title, created, stem, items, nxt from order_page o left join body b on o.k = b.k union all {_PART_PAGE.format(part="part")}),
wiki_page as (select dir || '/' || stem || '.md' as path, stem, dir, type, title, created, {_PAGE_TEXT} as text from all_page),
sources as (select 'parts/p-' || p_partkey || '.extracted.md' as path, p_name as title from part),
vault as (select 'parts/p-' || p_partkey || '.extracted.md' as doc, 'part ' || p_partkey || ' ' || p_name as text from part),
raw_links as (select path, stem, dir, type, unnest(regexp_extract_all(text, '\\[\\[([^\\]|]+)(?:\\|[^\\]]+)?\\]\\]', 1)) as raw from wiki_page),
links as (select *, replace(lower(trim(raw)), ' ', '-') as target from raw_links),
stems as (select lower(stem) as stem, min(path) as path from wiki_page group by lower(stem)),
wiki_link as (select distinct l.path as src, s.path as dst from links l join stems s on l.target = s.stem where l.path <> s.path),
raw_cites as (select path, dir, type, unnest(regexp_extract_all(text, '\\(vault:([^)]+)\\)', 1)) as source from wiki_page),
cites as (select distinct c.path as src, s.path as dst from raw_cites c join sources s on c.source = s.path),
activity as (select event_id, ts, case when event_type in ('signup', 'purchase') then 'ingest' else 'user_signal' end as kind, 'o-' || user_id as page,
    case event_type when 'signup' then 'archival' when 'purchase' then 'current' end as ingest_kind, event_type as action,
    case when event_id % 5 = 0 and user_id % 10 <> user_id % 7 then ['proj-' || (user_id % 10), 'proj-' || (user_id % 7)] else ['proj-' || (user_id % 10)] end as projects from events),
extracted as (select p_brand as table_stem, cast(row_number() over (partition by p_brand order by p_partkey) - 1 as int) as row_idx, [cast(p_partkey as varchar), p_name, case when p_partkey % 13 = 0 then '' else cast(p_size as varchar) end] as cells from part),
turns as (select a.conv_id, a.turn, a.text as before, b.text as after from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1)
"""


class Fixtures:
    """Lazily built frames of a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "html_pages", "benchmark", "labels", "conversations"):
            return self.table("pages" if name == "html_pages" else name)
        raise AttributeError(name)

    @cached_property
    def pages(self) -> DataFrame:
        """path, stem, dir, type, title, created, text.

        Shuffles carry keys and short values; sentences and texts are made behind them.
        """
        sentence = F.expr(f"transform(lines, r -> struct(r.l_linenumber, r.l_partkey, {re.sub(r'l_(linenumber|partkey|returnflag)', r'r.l_\1', _SENTENCE)} as s))")
        lines = F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag")).alias("lines")
        body = self.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(lines)
        orders = self.spark.sql(f"select o_orderkey as k, o_orderpriority, o_orderdate, {_NEXT} as nxt from {{orders}}", orders=self.orders)
        items = F.array_join(F.sort_array(sentence)["s"], "\n").alias("items")
        order_page = orders.join(body, "k", "left").select("k", F.expr(_DIR).alias("dir"), F.expr(_TYPE).alias("type"), F.expr("'Order ' || k").alias("title"), F.expr(_CREATED).alias("created"), F.expr("'o-' || k").alias("stem"), items, "nxt")
        part_page = self.spark.sql(_PART_PAGE, part=self.part)
        every = order_page.select(*part_page.columns).unionByName(part_page)
        return every.select(F.expr("dir || '/' || stem || '.md'").alias("path"), "stem", "dir", "type", "title", "created", F.expr(_PAGE_TEXT).alias("text"))

    @cached_property
    def sources(self) -> DataFrame:
        return self.part.select(F.expr("'parts/p-' || p_partkey || '.extracted.md'").alias("path"), F.col("p_name").alias("title"))

    @cached_property
    def vault(self) -> DataFrame:
        return self.part.select(F.expr("'parts/p-' || p_partkey || '.extracted.md'").alias("doc"), F.expr("'part ' || p_partkey || ' ' || p_name").alias("text"))

    @cached_property
    def activity(self) -> DataFrame:
        first, second = F.expr("'proj-' || (user_id % 10)"), F.expr("'proj-' || (user_id % 7)")
        return self.events.select(
            "event_id", "ts", F.when(F.col("event_type").isin("signup", "purchase"), "ingest").otherwise("user_signal").alias("kind"), F.expr("'o-' || user_id").alias("page"),
            F.expr("case event_type when 'signup' then 'archival' when 'purchase' then 'current' end").alias("ingest_kind"), F.col("event_type").alias("action"),
            F.when((F.col("event_id") % 5 == 0) & (F.col("user_id") % 10 != F.col("user_id") % 7), F.array(first, second)).otherwise(F.array(first)).alias("projects"),
        )

    @cached_property
    def extracted(self) -> DataFrame:
        return self.spark.sql(
            """select p_brand as table_stem, cast(row_number() over (partition by p_brand order by p_partkey) - 1 as int) as row_idx, array('id', 'name', 'size') as headers,
            array(cast(p_partkey as string), p_name, case when p_partkey % 13 = 0 then '' else cast(p_size as string) end) as cells from {part}""", part=self.part)

    @cached_property
    def turns(self) -> DataFrame:
        """Consecutive turns of a conversation as an edit: before, after."""
        a = self.conversations
        b = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("after"))
        return a.select("conv_id", "turn", F.col("text").alias("before")).join(b, ["conv_id", "turn"])

    @cached_property
    def links(self) -> DataFrame:
        raw = self.pages.select("path", "stem", "dir", "type", F.explode(tx.links("text")).alias("raw"))
        return raw.withColumn("target", tx.target("raw"))
