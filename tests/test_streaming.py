import os

import pytest
from pyspark.sql import functions as F

from concordat.operators.cache import CacheColumn
from concordat.streaming import state


def run(spark, stream, tmp_path, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    state.drain(q, 120)
    return spark.table(name)


def land(df, path, when):
    """One more file, later than those before it by its time stamp."""
    before = set(path.glob("*.parquet"))
    df.coalesce(1).write.mode("append").parquet(str(path))
    for f in set(path.glob("*.parquet")) - before:
        os.utime(f, (when, when))


def test_dedup_over_batches(spark, tmp_path):
    kinds = "dedup_key string, line_no long, fingerprint string"
    for i, rows in enumerate([[("k", 1, "a"), ("j", 2, "x")], [("k", 3, "a"), ("k", 4, "b")]]):
        land(spark.createDataFrame(rows, kinds), tmp_path / "in", 1_700_000_000 + i)
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.line_no: r.dedup for r in run(spark, state.dedup_stream(stream), tmp_path, "dedup_out").collect()}
    assert got == {1: "first", 2: "first", 3: "duplicate", 4: "conflict"}


def test_pending_wakes(spark, tmp_path):
    kinds = "event string, dataset string, lookup_key string, source_row_id string, resolved_id string"
    first = [("request", "d", "k:1", "r1", None), ("request", "d", "k:2", "r2", None), ("request", "d", "k:3", "r3", None)]
    second = [("identity", "d", "k:1", None, "77"), ("request", "d", "k:2", "r2", None)]
    for i, rows in enumerate([first, second]):
        land(spark.createDataFrame(rows, kinds), tmp_path / "ev", 1_700_000_000 + i)
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ev"))
    got = sorted((r.source_row_id, r.status, r.resolved_id) for r in run(spark, state.pending_stream(stream, max_attempts=2), tmp_path, "pending_out").collect())
    assert got == [("r1", "resolved", "77"), ("r2", "conflict", None)]


LINKS = "event string, dataset string, lookup_key string, source_row_id string, resolved_id string"


def links(spark, tmp_path, batches, name, **settings):
    """What a stream of these batches tells, sorted."""
    for i, rows in enumerate(batches):
        land(spark.createDataFrame(rows, LINKS), tmp_path / name, 1_700_000_000 + i)
    stream = spark.readStream.schema(LINKS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    told = run(spark, state.pending_stream(stream, **settings), tmp_path, f"{name}_out").collect()
    return sorted((r.lookup_key or "", r.source_row_id, r.status, r.resolved_id or "") for r in told)


def asks(key, *rows):
    return [("request", "d", key, row, None) for row in rows]


def comes(key, found):
    return [("identity", "d", key, None, found)]


def test_drain_tells_that_input_is_left(spark, tmp_path):
    land(spark.createDataFrame(asks("k", "r"), LINKS), tmp_path / "left", 1_700_000_000)
    stream = state.pending_stream(spark.readStream.schema(LINKS).parquet(str(tmp_path / "left")))
    q = stream.writeStream.format("memory").queryName("left_out").option("checkpointLocation", str(tmp_path / "left_cp")).trigger(availableNow=True).start()
    with pytest.raises(TimeoutError):
        state.drain(q, 0)
    assert not q.isActive


def test_drain_ends_without_rows(spark, tmp_path):
    assert links(spark, tmp_path, [asks("k", "r")[:0]], "no_rows") == []


def test_pending_parts_divide(spark, tmp_path, monkeypatch):
    """Keys share a page whose parts divide as it grows; each request still has its own attempts."""
    monkeypatch.setattr(state, "PART", 2)
    rows = [f"r{i}" for i in range(20)]
    batches = [asks("a", *rows[:3]), asks("a", *rows[3:]) + asks("b", *rows) + asks(None, "n"), asks("b", "r0", "r0", "r7") + asks("c", "r1", "r1", "r1"), comes("a", "9") + comes("a", "7") + asks("a", "late"), asks("a", "r0") + comes("b", "5")]
    got = links(spark, tmp_path, batches, "divide", max_attempts=3, pages=1)
    want = [("a", r, "resolved", "7") for r in [*rows, "late", "r0"]] + [("b", "r0", "conflict", "")] + [("b", r, "resolved", "5") for r in rows[1:]] + [("c", "r1", "conflict", "")]
    assert got == sorted(want)


def test_pending_forgets(spark, tmp_path, monkeypatch):
    """Requests expire by their deadlines, ids after a time without being seen."""
    monkeypatch.setattr(state, "PART", 2)
    rows = [f"r{i}" for i in range(9)]
    got = links(spark, tmp_path, [asks("a", *rows), asks("b", "x"), asks("b", "x")], "expire", ttl_ms=1, pages=1)
    assert [g for g in got if g[0] == "a"] == [("a", r, "expired", "") for r in rows]
    batches = [[c for r in rows for c in comes(r, "1")], asks("r1", "x"), comes("r1", "2"), asks("r2", "y")]
    assert links(spark, tmp_path, batches, "forget", known_ttl_ms=1, pages=1) == [("r1", "x", "resolved", "2")]
    assert links(spark, tmp_path, batches, "keep", pages=1) == [("r1", "x", "resolved", "1"), ("r2", "y", "resolved", "1")]


def test_refresh_versions(spark, tmp_path):
    kinds = "id long, name string, ord long"
    for i, rows in enumerate([[(1, "a", 1), (2, "b", 2)], [(1, "c", 3), (3, None, 4)]]):
        land(spark.createDataFrame(rows, kinds), tmp_path / "pages", 1_700_000_000 + i)
    pages = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "pages"))
    cols = [CacheColumn("id", F.col("id"), "bigint", required=True), CacheColumn("name", F.col("name"))]
    log = state.snapshot_log(str(tmp_path / "snap"), "id")
    state.refresh_stream(pages, log, cols, "id", ["ord"], F.lit(False), str(tmp_path / "cp")).awaitTermination(120)
    version = lambda v: {r.id: r.name for r in log.read(spark, v).collect()}
    assert version(0) == {1: "a", 2: "b"} and version(1) == {1: "c", 2: "b", 3: None}
