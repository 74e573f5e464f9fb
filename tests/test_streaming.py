"""Streams over files, against batch."""

import json

from vellum.streaming import activity as streams


def test_streams(spark, tmp_path):
    events = [{"ts": f"2024-01-{d:02d}T{h:02d}:00:00Z", "kind": "ingest", "page": "p", "ingest_kind": "current", "projects": ["x", "y"]} for d in (1, 2, 9, 28) for h in (1, 2, 9)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, events)) + "\nbroken\n")
    week = streams.drain(streams.cadence(streams.read(spark, str(tmp_path / "in"))), "t_cadence").collect()
    assert sum(r["n"] for r in week) >= 18 and {r["project"] for r in week} == {"x", "y"}
    bursts = streams.drain(streams.sessions(streams.read(spark, str(tmp_path / "in"))), "t_sessions").collect()
    assert {r["n"] for r in bursts} == {1, 2}


def test_upsert_keeps_last(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    for i, rows in enumerate(([("a", 1), ("b", 1)], [("a", 2), ("c", 1)])):
        spark.createDataFrame(rows, "k string, v int").coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema("k string, v int").parquet(str(src))
        streams.upsert_batches(stream, out, "k", cp).trigger(availableNow=True).start().awaitTermination(120)
    got = {r["k"]: r["v"] for r in spark.read.parquet(f"{out}/v=1").collect()}
    assert got == {"a": 2, "b": 1, "c": 1}
