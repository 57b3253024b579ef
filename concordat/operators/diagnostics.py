"""Each row carries its own errors and warnings: arrays of one diagnostic struct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIAG = "struct<stage:string,code:string,field:string,message:string>"


def diag(stage: str, code: str, field: str | Column | None = None, message: str | Column | None = None, when: Column | None = None) -> Column:
    """A diagnostic, or null unless ``when``."""
    col = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    one = F.struct(F.lit(stage).alias("stage"), F.lit(code).alias("code"), col(field).alias("field"), col(message).alias("message")).cast(DIAG)
    return one if when is None else F.when(when, one)


def gather(*items: Column) -> Column:
    """The diagnostics that are not null, in order."""
    if not items:
        return F.array().cast(f"array<{DIAG}>")
    return F.filter(F.array(*items), lambda d: d.isNotNull())


def with_channels(df: DataFrame) -> DataFrame:
    """Add empty ``errors`` and ``warnings`` where they are missing."""
    none = F.array().cast(f"array<{DIAG}>")
    return df.withColumns({c: none for c in ("errors", "warnings") if c not in df.columns})


def add(df: DataFrame, errors: list[Column] = (), warnings: list[Column] = ()) -> DataFrame:
    out = {}
    if errors:
        out["errors"] = F.concat("errors", gather(*errors))
    if warnings:
        out["warnings"] = F.concat("warnings", gather(*warnings))
    return with_channels(df).withColumns(out)


def has_errors(stage: str | None = None) -> Column:
    return F.size("errors") > 0 if stage is None else F.exists("errors", lambda d: d["stage"] == stage)


def stage_stats(df: DataFrame, stage: str) -> DataFrame:
    """One row: rows, failed, ok, with warnings; only diagnostics of this stage count."""
    warned = F.exists("warnings", lambda d: d["stage"] == stage)
    return df.agg(
        F.count(F.lit(1)).alias("rows_total"), F.count_if(has_errors(stage)).alias("failed"),
        F.count_if(~has_errors(stage)).alias("ok"), F.count_if(warned).alias("with_warnings"),
    )


def report_counts(df: DataFrame) -> DataFrame:
    """(stage, severity, n) with subtotals by stage and a grand total (nulls), in one rollup."""
    tag = lambda c, s: F.transform(c, lambda d: F.struct(d["stage"].alias("stage"), F.lit(s).alias("severity")))
    flat = df.select(F.explode(F.concat(tag(F.col("errors"), "error"), tag(F.col("warnings"), "warning"))).alias("d"))
    return flat.select("d.*").rollup("stage", "severity").agg(F.count(F.lit(1)).alias("n"))


def run_status(total: Column, failed: Column) -> Column:
    return F.when(failed == 0, "SUCCESS").when(failed < total, "PARTIAL").otherwise("FAILED")


def report_items(df: DataFrame, limit: int, order: str = "line_no") -> DataFrame:
    """The first rows with diagnostics; ``truncated`` tells whether there are more."""
    bad = df.where((F.size("errors") > 0) | (F.size("warnings") > 0))
    some = bad.orderBy(order).limit(limit + 1)
    return some.withColumn("truncated", F.lit(some.count() > limit)).orderBy(order).limit(limit)
