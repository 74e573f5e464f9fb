"""Class tables (declared schema, provenance, audit) and extracted tables (long rows, summaries, corrections)."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from vellum.schemas import column_type

# fixed values: substrings that a caller's condition may not hold
FORBIDDEN = ("--", ";", "drop ", "delete ", "update ", "insert ", "alter ", "attach ", "pragma ")
PROVENANCE = r"^(vault:|log:)\S+$"


@dataclass(frozen=True)
class Declared:
    """A column as a page declares it."""

    name: str
    type: str = "text"
    pk: bool = False
    nullable: bool = True
    values: tuple[str, ...] = ()
    default: str | None = None
    alias: str | None = None


def struct(columns: list[Declared]) -> StructType:
    """Spark type of a class table; references carry their kind as metadata."""
    return StructType([StructField(c.name, _parse_datatype_string(column_type(c.type)), c.nullable, {"kind": "ref"} if c.type in ("ref", "wikilink") else {}) for c in columns])


def schema_hash(columns: list[Declared]) -> str:
    return hashlib.sha256(json.dumps([vars(c) for c in columns], sort_keys=True, default=list).encode()).hexdigest()[:16]


def refuse(condition: str) -> None:
    if found := [x for x in FORBIDDEN if x in condition.lower()]:
        raise ValueError(f"forbidden in a condition: {found[0]!r}")


def query(spark: SparkSession, table: DataFrame, where: str = "true", args: list | None = None, limit: int = 50) -> DataFrame:
    """Rows that a caller's condition with ``?`` parameters keeps."""
    refuse(where)
    return spark.sql(f"select * from {{t}} where {where} limit {int(limit)}", args=args or [], t=table) if not args else _bound(spark, table, where, args, limit)


def _bound(spark: SparkSession, table: DataFrame, where: str, args: list, limit: int) -> DataFrame:
    table.createOrReplaceTempView("_vellum_query")
    return spark.sql(f"select * from _vellum_query where {where} limit {int(limit)}", args=args)


def errors(rows: DataFrame, columns: list[Declared]) -> Column:
    """Faults of a row: missing columns, unknown keys, values out of an enumeration.  Types aren't checked."""
    names = {c.name for c in columns}
    found = [F.when(F.col(c.name).isNull(), F.lit(f"missing {c.name}")) if c.name in rows.columns else F.lit(f"missing {c.name}") for c in columns if not c.nullable and c.default is None]
    found += [F.when(F.col(x).isNotNull(), F.lit(f"unknown {x}")) for x in rows.columns if x not in names and not x.startswith("_")]
    found += [F.when(F.col(c.name).isNotNull() & ~F.col(c.name).isin(list(c.values)), F.lit(f"not allowed {c.name}")) for c in columns if c.values and c.name in rows.columns]
    return F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<string>")


def schema_changes(old: list[Declared], new: list[Declared]) -> list[tuple[str, str]]:
    """Steps from one declaration to another: create, rename, add, drop, narrow."""
    if not old:
        return [("create", c.name) for c in new]
    before, after = {c.name: c for c in old}, {c.name: c for c in new}
    renamed = {c.alias: c.name for c in new if c.alias in before and c.name not in before}
    steps = [("rename", f"{a}->{b}") for a, b in renamed.items()]
    steps += [("add", n) for n in after if n not in before and n not in renamed.values()]
    steps += [("drop", n) for n in before if n not in after and n not in renamed]
    steps += [("narrow", n) for n, c in after.items() if n in before and set(before[n].values) - set(c.values) and c.values]
    return steps


def sync(rows: DataFrame, old: list[Declared], new: list[Declared], confirm: bool = False) -> DataFrame:
    """Rows in the new declaration's form; drops, and narrowings of values in use, need ``confirm``."""
    for step, name in schema_changes(old, new):
        if step == "rename":
            rows = rows.withColumnRenamed(*name.split("->"))
        elif step in ("add", "create"):
            if name not in rows.columns:
                kind = next(column_type(c.type) for c in new if c.name == name)
                rows = rows.withColumn(name, F.lit(None).cast(kind))
        elif step == "drop":
            if not confirm:
                raise ValueError(f"dropping {name} needs confirmation")
            rows = rows.drop(name)
        elif not confirm:
            allowed = next(c.values for c in new if c.name == name)
            if not rows.where(~F.col(name).isin(list(allowed))).isEmpty():
                raise ValueError(f"rows use values that {name} no longer allows")
    return rows


def upsert(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """key and status of new rows against old ones: indexed, updated or unchanged, by hash of the content."""
    before = old.select(key, F.sha2(content, 256).alias("_old"))
    status = F.when(F.col("_old").isNull(), "indexed").when(F.col("_old") == F.sha2(content, 256), "unchanged").otherwise("updated")
    return new.join(before, key, "left").select(key, status.alias("status"))


def merge(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows, and old ones that none replaces."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def update(rows: DataFrame, changes: DataFrame, key: str, at: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the changes' values, and key with status (updated, not_found or refused) of every change.

    ``changes`` holds the key, columns to set (null leaves a value as it is), and _provenance, without a valid one a change
    is refused; the key itself is never set.  Of several changes to a key the one with the largest _provenance counts.
    """
    fields = [c for c in changes.columns if c not in (key, "_provenance") and c in rows.columns]
    valid = F.coalesce(F.col("_provenance").rlike(PROVENANCE), F.lit(False))
    last = changes.where(valid).groupBy(key).agg(F.max_by(F.struct(*[F.col(c).alias(f"_set_{c}") for c in fields], F.col("_provenance").alias("_set_prov")), "_provenance").alias("_c"))
    kept = [F.coalesce(f"_c._set_{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns if c not in ("_provenance", "_updated_at")]
    old = [F.col(c) if c in rows.columns else F.lit(None).cast("string") for c in ("_provenance", "_updated_at")]
    done = rows.join(last, key, "left").select(*kept, F.coalesce("_c._set_prov", old[0]).alias("_provenance"), F.when(F.col("_c").isNotNull(), F.lit(at)).otherwise(old[1]).alias("_updated_at"))
    there = rows.select(key).distinct().withColumn("_there", F.lit(True))
    status = changes.join(there, key, "left").select(key, F.when(~valid, "refused").when(F.col("_there"), "updated").otherwise("not_found").alias("status"))
    return done, status


def change_counts(changes: DataFrame, audits: DataFrame) -> DataFrame:
    """table_name, changes: inserts and effective updates (table_name, at) since the table's last audit (table_name, last_audit_at)."""
    got = changes.join(audits.groupBy("table_name").agg(F.max("last_audit_at").alias("_a")), "table_name", "left")
    return got.groupBy("table_name").agg(F.count_if(F.col("_a").isNull() | (F.col("at") > F.col("_a"))).alias("changes"))


def class_tables(meta: DataFrame, counts: DataFrame) -> DataFrame:
    """table_name, schema_hash, entity_page and row_count of the synced tables; a table without rows has 0."""
    n = counts.groupBy("table_name").agg(F.sum("n").alias("_n"))
    return meta.join(n, "table_name", "left").select("table_name", "schema_hash", "entity_page", F.coalesce("_n", F.lit(0)).cast("long").alias("row_count"))


def declared_report(live: DataFrame, declared: DataFrame) -> DataFrame:
    """table_name, state: synced, stale (declared otherwise since), undeclared or not synced, by schema hash."""
    both = live.select("table_name", F.col("schema_hash").alias("_l")).join(declared.select("table_name", F.col("schema_hash").alias("_d")), "table_name", "full_outer")
    return both.select("table_name", F.when(F.col("_d").isNull(), "undeclared").when(F.col("_l").isNull(), "not synced").when(F.col("_l") == F.col("_d"), "synced").otherwise("stale").alias("state"))


def exists(spark: SparkSession, names: list[str]) -> dict[str, bool]:
    """Of each system table: does the catalogue hold it?"""
    return {name: spark.catalog.tableExists(name) for name in names}


def provenance(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows (id, provenance) without an origin, and why: missing, bad prefix, no such file."""
    path = F.regexp_replace("provenance", "^vault:", "")
    known = files.select(F.col("path").alias("_p")).distinct()
    got = rows.join(known, path == F.col("_p"), "left")
    why = F.when(F.coalesce("provenance", F.lit("")) == "", "missing").when(F.col("provenance").startswith("log:"), F.lit(None)).when(~F.col("provenance").startswith("vault:"), "bad prefix").when(F.col("_p").isNull(), "no such file")
    return got.select("id", why.alias("reason")).where("reason is not null")


def citation_audit(cited: DataFrame, tables: DataFrame, rows: DataFrame) -> DataFrame:
    """Citations (page, tbl, id) of unknown tables or rows."""
    got = cited.join(tables.select("tbl").distinct().withColumn("_t", F.lit(1)), "tbl", "left").join(rows.select("tbl", "id").distinct().withColumn("_r", F.lit(1)), ["tbl", "id"], "left")
    return got.where("_r is null").select("page", "tbl", "id", F.when(F.col("_t").isNull(), "table not synced").otherwise("row not found").alias("reason"))


def citation_risk(meta: DataFrame, as_of: str, period: int = 30) -> DataFrame:
    """table_name and risk = min(1, changes / rows * min(1, days / period)); never audited counts as a whole period."""
    days = F.coalesce(F.datediff(F.lit(as_of).cast("timestamp"), "last_audit_at"), F.lit(period))
    churn = F.col("changes") / F.greatest(F.col("n_rows"), F.lit(1))
    return meta.select("table_name", F.least(F.lit(1.0), churn * F.least(F.lit(1.0), days / period)).alias("risk"))


# ---------------------------------------------------------------- extracted tables


def fit_cells(cells: Column | str, headers: Column | str) -> Column:
    """Cells padded with empty ones, or cut, to the width of the headers."""
    cells, headers = (F.col(x) if isinstance(x, str) else x for x in (cells, headers))
    return F.transform(F.sequence(F.lit(1), F.size(headers)), lambda i: F.coalesce(F.try_element_at(cells, i), F.lit("")))


def extracted_query(rows: DataFrame, stem: str, limit: int = 200, flagged: DataFrame | None = None) -> DataFrame:
    """row_idx and a map of header to cell, in order; flagged rows (row_idx) are left out unless ``flagged`` is None."""
    got = rows.where(F.col("table_stem") == stem)
    if flagged is not None:
        got = got.join(flagged.select("row_idx"), "row_idx", "left_anti")
    return got.orderBy("row_idx").limit(limit).select("row_idx", F.map_from_arrays("headers", fit_cells("cells", "headers")).alias("cells"))


def column_summary(rows: DataFrame) -> DataFrame:
    """Of each column of each table: non-empty cells, numeric (four fifths parse), min and max or distinct count and the first three values."""
    long = rows.select("table_stem", "row_idx", F.posexplode(F.arrays_zip(F.col("headers").alias("h"), F.col("cells").alias("c"))).alias("pos", "x"))
    cell = F.nullif(F.trim("x.c"), F.lit(""))
    long = long.select("table_stem", "row_idx", "pos", F.col("x.h").alias("header"), cell.alias("v"), F.expr("try_cast(replace(x.c, ',', '') as double)").alias("num"))
    per_value = long.where("v is not null").groupBy("table_stem", "pos", "header", "v").agg(F.min("row_idx").alias("first"), F.count("*").alias("n"), F.max("num").alias("num"))
    top = Window.partitionBy("table_stem", "pos", "header").orderBy("first", "v")
    ranked = per_value.withColumn("r", F.row_number().over(top))
    got = ranked.groupBy("table_stem", "pos", "header").agg(
        F.sum("n").alias("non_empty"), F.sum(F.when(F.col("num").isNotNull(), F.col("n")).otherwise(0)).alias("numeric"), F.min("num").alias("lo"), F.max("num").alias("hi"), F.count("*").alias("n_distinct"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.struct("r", "v")))), lambda x: x["v"]), "|").alias("first_values"),
    )
    numeric = F.col("numeric") >= 0.8 * F.col("non_empty")
    return got.select("table_stem", "header", "non_empty", numeric.alias("is_numeric"), F.when(numeric, F.col("lo")).alias("lo"), F.when(numeric, F.col("hi")).alias("hi"), F.when(~numeric, F.col("n_distinct")).alias("n_distinct"), F.when(~numeric, F.col("first_values")).alias("first_values"))


def correct(rows: DataFrame, corrections: DataFrame) -> DataFrame:
    """Rows with the suggested values of (table_stem, row_idx, header, suggested) put in their cells."""
    per_row = corrections.groupBy("table_stem", "row_idx").agg(F.map_from_entries(F.collect_list(F.struct("header", "suggested"))).alias("_fix"))
    fixed = F.transform("cells", lambda x, i: F.coalesce(F.try_element_at("_fix", F.try_element_at("headers", i + 1)), x))
    return rows.join(per_row, ["table_stem", "row_idx"], "left").withColumn("cells", F.when(F.col("_fix").isNull(), F.col("cells")).otherwise(fixed)).drop("_fix")


def listing(rows: DataFrame) -> DataFrame:
    return rows.groupBy("table_stem").agg(F.count("*").alias("n_rows"), F.max("row_idx").alias("last_row"))


def promotion(rows: DataFrame, known: DataFrame, full: int = 100) -> DataFrame:
    """table_stem, mode (full page or snapshot) and status against what was promoted (table_stem, sha, n_rows)."""
    sha = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "cells"))), lambda x: F.array_join(x["cells"], "|")), "\n"), 256)
    now = rows.groupBy("table_stem").agg(F.count("*").alias("n_rows"), sha.alias("sha"))
    old = known.select("table_stem", F.col("sha").alias("_s"), F.col("n_rows").alias("_n"))
    status = F.when(F.col("_s").isNull(), "created").when((F.col("_s") == F.col("sha")) & (F.col("_n") == F.col("n_rows")), "unchanged").otherwise("updated")
    return now.join(old, "table_stem", "left").select("table_stem", F.when(F.col("n_rows") <= full, "full").otherwise("snapshot").alias("mode"), status.alias("status"))
