"""Queries of feeds, labels and stored tables, with equivalent SQL; registered beside those of ``queries``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from concordat.operators import hierarchy, links
from concordat.operators.cache import CacheColumn
from concordat.queries import _TREE, query, tree
from concordat.session import materialize, shared_dir, table
from concordat.sources import files
from concordat.streaming import state


def _fresh(spark, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


@query("""SELECT CAST(row_number() OVER (ORDER BY doc_id) + 1 AS BIGINT) AS line_no, CAST(doc_id AS VARCHAR) AS doc_id, length(trim(regexp_replace(text, '[\\x00-\\x1F\\x7F-\\xA0]+', ' ', 'g'))) AS n_chars, lang FROM documents""")
def s1_split_csv(spark, sf):
    """Documents as CSV files whose quoted texts hold line breaks, read in splits of half a megabyte and less."""
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    path = _fresh(spark, "csv")
    d.repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id").write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    rows = files.read_csv_split(spark, path)
    flat = F.trim(F.regexp_replace("text", "[\\x00-\\x1F\\x7F-\\xA0]+", " "))
    return rows.select("line_no", "doc_id", F.coalesce(F.char_length(flat), F.lit(0)).cast("long").alias("n_chars"), "lang")


@query(f"""SELECT n.node_id, n.depth, count(d.node_id) AS below, count(CASE WHEN d.depth = n.depth + 1 THEN 1 END) AS kids FROM ({_TREE}) n LEFT JOIN ({_TREE}) d ON d.node_id <> n.node_id AND (d.path = n.path OR starts_with(d.path, n.path || '/')) AND d.depth > n.depth GROUP BY ALL""")
def h5_interval_labels(spark, sf):
    """Regions, nations and customers numbered on one walk around their tree; what lies below a node is a range of numbers."""
    labels = materialize(hierarchy.interval_labels(tree(spark, sf)), "labels")
    pairs = hierarchy.descendants_in(labels, labels.select("node_id"))
    kids = pairs.groupBy("node_id").agg(F.count_if(F.col("distance") == 1).alias("kids"))
    out = labels.join(hierarchy.descendant_counts(labels), "node_id").join(kids, "node_id", "left")
    return out.select("node_id", "depth", "below", F.coalesce("kids", F.lit(0)).alias("kids"))


@query("""SELECT user_id, event_type, 2 AS version FROM (SELECT user_id, arg_max(event_type, (event_id % 3, event_id)) AS event_type FROM events GROUP BY user_id)
UNION ALL SELECT user_id, event_type, 1 FROM (SELECT user_id, arg_max(event_type, (event_id % 3, event_id)) AS event_type FROM events WHERE event_id % 3 < 2 GROUP BY user_id)""")
def ts4_versions_after_compaction(spark, sf):
    """A snapshot of three batches, compacted after the second and cleared of what came before; both versions left read the same as ever."""
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id")
    log = state.snapshot_log(_fresh(spark, "snapshot"), "user_id", buckets=16)
    cols = [CacheColumn("user_id", F.col("user_id"), "bigint", required=True), CacheColumn("event_type", F.col("event_type"))]
    for v in range(3):
        state.refresh_batch(log, e.where(F.col("event_id") % 3 == v), v, cols, "user_id", ["event_id"], F.lit(False), compact_every=2)
    log.vacuum(spark, 1)
    return log.read(spark, 2).withColumn("version", F.lit(2)).unionByName(log.read(spark, 1).withColumn("version", F.lit(1)))


@query("""SELECT 'orders' AS dataset, 'cust:' || o_custkey AS lookup_key, CAST(o_orderkey AS VARCHAR) AS id FROM orders UNION ALL SELECT 'customers', 'nation:' || c_nationkey, CAST(c_custkey AS VARCHAR) FROM customer""")
def ts5_index_stream(spark, sf):
    """A stored index filled by two streams, one a data set; orders come in two files of which the second repeats a part of the first."""
    log = links.index_log(_fresh(spark, "index"), buckets=16)
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    src = _fresh(spark, "orders")
    for part in (o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 3 < 2")):
        part.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(o.schema).option("maxFilesPerTrigger", 1).parquet(src)
    state.index_stream(stream, log, "o_orderkey", {"cust": F.col("o_custkey")}, "orders", _fresh(spark, "offsets")).awaitTermination(600)
    c = table(spark, sf, "customer")
    links.append_index(log, links.identity_index(c, "c_custkey", {"nation": F.col("c_nationkey")}, dataset="customers"), log.versions(spark)[-1] + 1)
    return log.read(spark)
