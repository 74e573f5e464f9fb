"""Every catalogue query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest
from conftest import SF

from vellum.plans.catalog import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(tuple(round(v, 6) if isinstance(v, float) and not math.isnan(v) else str(v) if hasattr(v, "year") else v for v in r) for r in rows) if all(None not in r for r in rows) else sorted((tuple(str(round(v, 6) if isinstance(v, float) else v) for v in r) for r in rows))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_like_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLE_SQL[name])
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    quoted = ", ".join(f'"{c}"' for c in cols)
    assert plain([tuple(r) for r in got.select(*cols).collect()]) == plain(duck.sql(f"select {quoted} from ({ORACLE_SQL[name]})").fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["bridge_candidates", "lint_composite", "column_summary", "id_minting"])
@pytest.mark.parametrize("parts", ["1", "17"])
def test_partitioning_changes_nothing(spark, name, parts):
    want = sorted(map(str, QUERIES[name](spark, SF).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert sorted(map(str, QUERIES[name](spark, SF).collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
