"""Keyed logs, the streams that fill them, split CSV files, interval labels, bounded lookups."""

import os
import random
import time

from pyspark.sql import functions as F

from concordat.operators import hierarchy, links, lookup
from concordat.operators.cache import CacheColumn
from concordat.sources import files
from concordat.sources.keyed_log import GONE, KeyedLog
from concordat.streaming import state


def size(path) -> int:
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


def test_log_versions(spark, tmp_path):
    log = KeyedLog(str(tmp_path / "log"), ("k",), buckets=4)
    put = lambda v, rows: log.append(spark.createDataFrame(rows, f"k int, v string, {GONE} boolean"), v)
    get = lambda v=None: {r.k: r.v for r in log.read(spark, v).collect()}
    assert log.read(spark) is None and log.versions(spark) == []
    put(0, [(1, "a", False), (2, "b", False), (3, None, False)])
    put(1, [(2, "c", False), (1, None, True)])
    put(1, [(2, "d", False), (1, None, True)])  # repeated: the batch replaces itself
    put(2, [(1, "again", False), (4, "x", False)])
    assert get(0) == {1: "a", 2: "b", 3: None} and get(1) == {2: "d", 3: None} and get() == {1: "again", 2: "d", 3: None, 4: "x"}
    assert log.pending_deltas(spark) == 3 and log.compact(spark) == 2 and log.pending_deltas(spark) == 0
    put(3, [(4, None, True)])
    assert get(2) == {1: "again", 2: "d", 3: None, 4: "x"} and get(1) == {2: "d", 3: None} and get() == {1: "again", 2: "d", 3: None}
    assert sorted(log.vacuum(spark, 2)) == ["delta 0", "delta 1", "delta 2"]
    assert log.versions(spark) == [2, 3] and get() == {1: "again", 2: "d", 3: None} and get(2)[4] == "x"
    assert log.vacuum(spark, 3) == []


def test_bytes_written_follow_the_batch(spark, tmp_path):
    """A batch with keys of every bucket writes its own rows and nothing else."""
    log = state.snapshot_log(str(tmp_path / "snap"), "id", buckets=8)
    cols = [CacheColumn("id", F.col("id"), "bigint", required=True), CacheColumn("name", F.col("name"))]
    pages = lambda n, tag: spark.range(n).select("id", F.concat(F.lit(tag), F.sha2(F.col("id").cast("string"), 256)).alias("name"), F.col("id").alias("ord"))
    sizes = []
    for v, (n, tag) in enumerate([(40_000, "a"), (400, "b"), (400, "c")]):
        before = size(tmp_path / "snap")
        state.refresh_batch(log, pages(n, tag), v, cols, "id", ["ord"], F.lit(False), compact_every=0)
        sizes.append(size(tmp_path / "snap") - before)
    assert sizes[1] * 10 < sizes[0] and sizes[2] * 10 < sizes[0]
    assert {r.t: r["count"] for r in log.read(spark).groupBy(F.substring("name", 1, 1).alias("t")).count().collect()} == {"a": 39_600, "c": 400}
    assert {r.t: r["count"] for r in log.read(spark, 1).groupBy(F.substring("name", 1, 1).alias("t")).count().collect()} == {"a": 39_600, "b": 400}
    state.refresh_batch(log, pages(10, "d"), 3, cols, "id", ["ord"], F.lit(False), compact_every=4)
    assert log.pending_deltas(spark) == 0 and log.read(spark).count() == 40_000


def land(df, path, when):
    before = set(path.glob("*.parquet"))
    df.coalesce(1).write.mode("append").parquet(str(path))
    for f in set(path.glob("*.parquet")) - before:
        os.utime(f, (when, when))


EVENT = "event string, dataset string, lookup_key string, source_row_id string, resolved_id string"


def test_requests_expire_each_by_its_own_deadline(spark, tmp_path):
    land(spark.createDataFrame([("request", "d", "k:1", "early", None), ("request", "d", "k:2", "other", None)], EVENT), tmp_path / "in", 1_700_000_000)
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = state.pending_stream(stream, ttl_ms=12_000, max_attempts=9).writeStream.format("memory").queryName("expiring").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    told, at = {}, {}
    try:
        end = time.monotonic() + 120
        while time.monotonic() < end and len(told) < 4:
            if "late" not in at and q.lastProgress and any(p["numInputRows"] for p in q.recentProgress):
                time.sleep(4)
                land(spark.createDataFrame([("request", "d", "k:1", "late", None), ("identity", "d", "k:2", None, "7"), ("request", "d", "k:1", "early", None)], EVENT), tmp_path / "in", 1_700_000_100)
                at["late"] = time.monotonic()
            for r in spark.table("expiring").collect():
                if r.source_row_id not in told:
                    told[r.source_row_id], at[f"told {r.source_row_id}"] = (r.status, r.resolved_id), time.monotonic()
            if len(told) == 3:
                break
            time.sleep(0.3)
        assert q.exception() is None
    finally:
        q.stop()
    assert told == {"other": ("resolved", "7"), "early": ("expired", None), "late": ("expired", None)}
    assert at["told early"] < at["told late"]


def test_ids_that_arrived_answer_later_requests(spark, tmp_path):
    batches = [[("identity", "d", "k:1", None, "5")], [("request", "d", "k:1", "r1", None), ("request", "d", "k:2", "r2", None)], [("identity", "d", "k:1", None, "4"), ("request", "d", "k:1", "r3", None), ("request", "d", "k:2", "r2", None)]]
    for i, rows in enumerate(batches):
        land(spark.createDataFrame(rows, EVENT), tmp_path / "in", 1_700_000_000 + i)
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = state.pending_stream(stream, max_attempts=2).writeStream.format("memory").queryName("answered").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    state.drain(q, 120)
    assert sorted(tuple(r)[2:] for r in spark.table("answered").collect()) == [("r1", "resolved", "5"), ("r2", "conflict", None), ("r3", "resolved", "4")]


def test_index_stream(spark, tmp_path):
    for i, ids in enumerate([range(0, 50), range(40, 60)]):
        land(spark.createDataFrame([(str(x), f"n{x % 7}") for x in ids], "id string, name string"), tmp_path / "in", 1_700_000_000 + i)
    log = links.index_log(str(tmp_path / "index"), buckets=4)
    stream = spark.readStream.schema("id string, name string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    state.index_stream(stream, log, "id", {"name": F.col("name")}, "people", str(tmp_path / "cp")).awaitTermination(120)
    assert log.read(spark).count() == 60 and log.read(spark, 0).count() == 50
    assert spark.read.parquet(str(tmp_path / "index/data/kind=delta/written=1")).count() == 10  # new ones only


def test_split_csv_equals_whole_files(spark, tmp_path):
    rnd = random.Random(3)
    value = lambda: rnd.choice(["a", "b c", '"q, ""x"" y"', '"two\nlines"', '"three\n\n""li""\nnes, z"', "", "null"])
    for f in range(3):
        with open(tmp_path / f"f{f}.csv", "w", newline="") as h:
            h.write("a,b,c\n")
            for i in range(700):
                h.write(f"{i},{value()},{value()}" + (",extra" if i % 97 == 0 else "") + "\n" + ("\n" if i % 50 == 0 else ""))
    whole = files.read_csv(spark, str(tmp_path), multiline=True).orderBy("line_no").collect()
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2500")
    try:
        assert files.csv_records(spark, str(tmp_path)).select("file").rdd.getNumPartitions() > 10
        split = files.read_csv_split(spark, str(tmp_path)).orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(whole) == 2100 and split == whole


def labels_of(nodes):
    kids = {}
    for n, p in nodes:
        kids.setdefault(p, []).append(n)
    out, at = {}, 0
    todo = [(n, 0, False) for n in sorted(kids.get(None, []), reverse=True)]
    while todo:
        n, d, leave = todo.pop()
        if leave:
            out[n][1] = at
        else:
            out[n] = [at, None, d]
            todo.append((n, d, True))
            todo += [(k, d + 1, False) for k in sorted(kids.get(n, []), reverse=True)]
        at += 1
    return {n: tuple(v) for n, v in out.items()}


def test_interval_labels(spark):
    rnd = random.Random(4)
    nodes = [(0, None), (1, None)] + [(i, rnd.choice([0, rnd.randrange(i)])) for i in range(2, 300)]
    odd = [(900, 901), (901, 900), (902, 900), (910, 5555), (911, 910)]  # a cycle, what hangs on it, a missing parent and what lies below
    got = hierarchy.interval_labels(spark.createDataFrame(nodes + odd, "node_id long, parent_id long"))
    rows = {r.node_id: (r.lo, r.hi, r.depth) for r in got.collect()}
    assert {n: v for n, v in rows.items() if n < 900} == labels_of(nodes) and all(rows[n] == (None, None, None) for n, _ in odd)
    paths = hierarchy.path_table(spark.createDataFrame([(n, p, str(n)) for n, p in nodes], "node_id long, parent_id long, label string"))
    want = sorted((r.node_id, r.descendant_id, r.distance) for r in hierarchy.descendants(paths).collect())
    assert sorted(tuple(r)[:3] for r in hierarchy.descendants_in(got, got.select("node_id"), stretch=16).collect()) == want
    assert {r.node_id: r.below for r in hierarchy.descendant_counts(got).collect()} == {n: sum(a == n for a, _, _ in want) for n, _ in nodes}


def test_interval_labels_of_a_long_chain(spark):
    n = 10_000
    chain = spark.range(n).select(F.col("id").alias("node_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    got = hierarchy.interval_labels(chain)
    assert got.where((F.col("lo") != F.col("node_id")) | (F.col("hi") != 2 * n - 1 - F.col("node_id")) | (F.col("depth") != F.col("node_id"))).count() == 0


def test_limited_lookup_of_a_hot_key(spark):
    """A third of the values have one key; tasks pass on the least ones only."""
    side = spark.range(200_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.format_string("%07d", 200_000 - F.col("id")).alias("v"))
    rows = spark.createDataFrame([(1, "hot"), (2, "7")], "rid int, k string")
    got = lookup.lookup(rows, "rid", lookup.LookupRule("t", F.col("k"), side, F.col("k"), F.col("v")), limit=5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    values = {r.rid: [c.value for c in r.candidates] for r in got.collect()}
    assert values == {1: [f"{200_000 - i:07d}" for i in range(199_998, 199_983, -3)], 2: ["0199993"]}
