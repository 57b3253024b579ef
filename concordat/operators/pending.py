"""Pending links: requests that could not be resolved yet, kept between runs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.operators.diagnostics import add, diag, with_channels

KEY = ["dataset", "source_row_id", "field", "lookup_key"]


def upsert_pending(stored: DataFrame, requests: DataFrame, now: Column, ttl_seconds: int, max_attempts: int) -> DataFrame:
    """The stored table after this run's requests (KEY, payload).

    A request that is pending already counts one more attempt and becomes a
    conflict at ``max_attempts``; new ones start at 1 attempt. Stored rows in a
    final state don't meet requests.
    """
    new = requests.groupBy(*KEY).agg(F.max("payload").alias("__payload"), F.lit(True).alias("__new"))
    open_ = stored.where("status = 'pending'").join(new, KEY, "full_outer")
    seen, again = F.col("status").isNotNull(), F.col("__new").isNotNull()
    attempts = F.coalesce("attempts", F.lit(0)) + again.cast("int")
    merged = open_.select(
        *KEY, F.coalesce("__payload", "payload").alias("payload"), attempts.alias("attempts"),
        F.when(seen & again & (attempts >= max_attempts), "conflict").otherwise("pending").alias("status"),
        F.coalesce("created_at", now).alias("created_at"), F.when(again, now).otherwise(F.col("last_attempt_at")).alias("last_attempt_at"),
        F.coalesce("expires_at", now + F.make_dt_interval(secs=F.lit(ttl_seconds))).alias("expires_at"),
    )
    return merged.unionByName(stored.where("status <> 'pending'").select(*merged.columns))


def expire(stored: DataFrame, now: Column) -> DataFrame:
    return stored.withColumn("status", F.when((F.col("status") == "pending") & (F.col("expires_at") <= now), "expired").otherwise(F.col("status")))


def purge(stored: DataFrame, cutoff: Column) -> DataFrame:
    """Without processed rows last touched before the cutoff; pending rows stay."""
    return stored.where((F.col("status") == "pending") | (F.coalesce("last_attempt_at", "created_at") > cutoff))


def wake(stored: DataFrame, arrived: DataFrame) -> DataFrame:
    """Pending rows whose lookup key has arrived (dataset, lookup_key) are resolved."""
    keys = arrived.select("dataset", "lookup_key").distinct().withColumn("__here", F.lit(True))
    out = stored.join(keys, ["dataset", "lookup_key"], "left")
    return out.withColumn("status", F.when((F.col("status") == "pending") & F.col("__here"), "resolved").otherwise(F.col("status"))).drop("__here").select(*stored.columns)


def close_sources(stored: DataFrame, clean_rows: DataFrame) -> DataFrame:
    """Pending rows of source rows that resolved cleanly are resolved."""
    done = clean_rows.select("source_row_id").distinct().withColumn("__done", F.lit(True))
    out = stored.join(done, "source_row_id", "left")
    return out.withColumn("status", F.when((F.col("status") == "pending") & F.col("__done"), "resolved").otherwise(F.col("status"))).drop("__done").select(*stored.columns)


def latest_payloads(stored: DataFrame, dataset: str | None = None) -> DataFrame:
    """The latest pending row of each source row of a data set (of every data set, if none is named).

    Rows of one source row are few, and tasks keep only the best of theirs before the shuffle.
    """
    mine = stored if dataset is None else stored.where(F.col("dataset") == dataset)
    late = F.struct(F.coalesce("last_attempt_at", "created_at").alias("at"), F.col("lookup_key").alias("k"), F.col("field").alias("f"))
    best = mine.where("status = 'pending'").groupBy("dataset", "source_row_id").agg(F.max_by(F.struct(*stored.columns), late).alias("r"))
    return best.select("r.*")


def encode(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumn("payload", F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}))


def _decoded(stored: DataFrame, schema: str, required: str, dataset: str | None) -> DataFrame:
    """Latest payloads as ``p`` and whether they are ``fit``: they parse and hold the required field."""
    return latest_payloads(stored, dataset).select("dataset", F.from_json("payload", schema).alias("p")).withColumn("fit", F.coalesce(F.col(f"p.{required}").isNotNull(), F.lit(False)))


def replay(df: DataFrame, stored: DataFrame, schema: str, required: str, dataset: str | None = None) -> DataFrame:
    """Rows of this run and rows decoded from pending payloads; payloads that don't parse are left out (see ``replay_counts``)."""
    decoded = _decoded(stored, schema, required, dataset).where("fit").select("p.*")
    return df.withColumn("replayed", F.lit(False)).unionByName(decoded.withColumn("replayed", F.lit(True)), allowMissingColumns=True)


def replay_counts(stored: DataFrame, schema: str, required: str, dataset: str | None = None) -> DataFrame:
    """One row a data set: payloads that were decoded, and those that were skipped as invalid."""
    return _decoded(stored, schema, required, dataset).groupBy("dataset").agg(F.count_if("fit").alias("decoded"), F.count_if(~F.col("fit")).alias("invalid"))


def report_expired(stored: DataFrame, now: Column, policy: str = "error") -> DataFrame:
    """Rows that ``expire`` would turn, with errors and warnings by policy: error, report_only (a warning) or skip (neither)."""
    if policy not in ("error", "report_only", "skip"):
        raise ValueError(f"unknown report policy {policy!r}")
    gone = stored.where((F.col("status") == "pending") & (F.col("expires_at") <= now)).withColumn("status", F.lit("expired"))
    found = [diag("resolve", "PENDING_EXPIRED", F.col("field"), F.concat(F.lit("no record came for "), "lookup_key"))]
    return add(with_channels(gone), errors=found if policy == "error" else [], warnings=found if policy == "report_only" else [])


def due(last: datetime | None, now: datetime, every_seconds: float) -> bool:
    """Interval guard of a sweep: has it been long enough since the last one?"""
    return last is None or (now - last).total_seconds() >= every_seconds
