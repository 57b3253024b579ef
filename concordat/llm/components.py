"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.llm.common import join_spread
from concordat.session import materialize


def _large_star(e: DataFrame, total: int) -> DataFrame:
    """Each larger neighbour of a node is linked to the least node around it. The hub of a star is a hot key."""
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least")
    return join_spread(both.where("v > u"), least, ["u"], "n", 2 * total).select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()


def _small_star(e: DataFrame, total: int) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them; edges have a < b."""
    least = materialize(e.groupBy("b").agg(F.min("a").alias("m"), F.count(F.lit(1)).alias("n")), "least")
    kept = join_spread(e, least, ["b"], "n", total)
    return (
        kept.select(F.col("m").alias("a"), F.col("a").alias("b")).where("a <> b").unionByName(least.select(F.col("m").alias("a"), "b")).distinct()
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of ``edges`` (a, b: long); component is its least id.

    Only counts come to the driver. Each round is written to the shared folder,
    so that a lost executor costs a reread and no replay.
    """
    e = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        state = e.agg(F.count(F.lit(1)), F.sum("a").cast("decimal(38,0)"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before or not state[0]:
            break
        before = state
        e = materialize(_large_star(e, state[0]), "edges")
        e = materialize(_small_star(e, state[0]), "edges")
    members = e.select(F.col("b").alias("id"), F.col("a").alias("component"))
    roots = e.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    return members.unionByName(roots)
