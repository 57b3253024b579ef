"""Hierarchy positions as tie-breakers for matches and links, with their policies and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions.text import blank, canonical_segments
from concordat.operators.hierarchy import ladder


def locator(columns: list[Column], steps: list[tuple] = (("trim",), ("lower",))) -> Column:
    """Canonical path of a row from its path columns; null if no segment is left."""
    segs = canonical_segments(F.array(*[c.cast("string") for c in columns]), list(steps), drop_blank=True)
    return F.when(F.size(segs) > 0, segs)


def refine_match(df: DataFrame, row_id: str, segments: str, candidates: DataFrame, paths: DataFrame, policy: str = "ambiguous_only", on_missing: str = "skip") -> DataFrame:
    """Adjust match_status and target_ref by the position of candidates (row_id, node_id).

    ``ambiguous_only`` looks at rows whose status is 'ambiguous'; ``all_candidates``
    at every row that has candidates, and may turn not_found into matched and
    matched into ambiguous. Rows without a path are left ('skip') or get the
    status 'error'.
    """
    seen = F.col("match_status") == "ambiguous" if policy == "ambiguous_only" else F.lit(True)
    pool = df.where(seen & F.col(segments).isNotNull()).select(row_id, segments)
    found = ladder(pool, row_id, segments, candidates, paths).withColumnsRenamed({"mode": "topology_mode", "node_id": "__node"})
    out = df.join(found, row_id, "left")
    split = F.endswith(F.coalesce("topology_mode", F.lit("")), F.lit(":ambiguous"))
    status = F.when(seen & F.col(segments).isNull(), F.lit("error") if on_missing == "error" else F.col("match_status"))
    status = status.when(F.col("__node").isNotNull(), "matched").when(split, "ambiguous").otherwise(F.col("match_status"))
    ref = F.when(F.col("__node").isNotNull(), F.col("__node")).when(~split, F.col("target_ref"))
    return out.withColumns({"match_status": status, "target_ref": ref}).drop("__node")


def refine_link(df: DataFrame, row_id: str, field: str, segments: str, candidates: DataFrame, paths: DataFrame, policy: str = "pending") -> DataFrame:
    """Adjust <field>__status and <field>__id of ambiguous links. Still open ones become pending, error or none by policy."""
    open_ = df.where(F.col(f"{field}__status") == "ambiguous").select(row_id, segments)
    found = ladder(open_.where(F.col(segments).isNotNull()), row_id, segments, candidates, paths).select(row_id, F.col("node_id").alias("__node"))
    left = {"pending": "pending", "hard_error": "error", "skip": "none"}[policy]
    was = F.col(f"{field}__status") == "ambiguous"
    out = df.join(found, row_id, "left")
    status = F.when(was & F.col("__node").isNotNull(), "resolved").when(was, left).otherwise(F.col(f"{field}__status"))
    return out.withColumns({f"{field}__id": F.when(was, F.col("__node")).otherwise(F.col(f"{field}__id")), f"{field}__status": status}).drop("__node")


def mode_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("topology_mode").agg(F.count(F.lit(1)).alias("n"))


def dropped_by_reason(verdicts: DataFrame) -> DataFrame:
    return verdicts.where("verdict <> 'anchored'").groupBy(F.col("verdict").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def has_path(columns: list[Column]) -> Column:
    return ~F.forall(F.array(*[c.cast("string") for c in columns]), blank)
