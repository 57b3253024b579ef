"""Plans: items, summaries, payloads, dry-run results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions.ops import OPS, op
from concordat.functions.text import blank, strip


def plan_items(resolved: DataFrame) -> DataFrame:
    """Rows to act on: an operation other than skip, and no error."""
    return resolved.where("op in ('create', 'update') and row_ok")


def plan_summary(resolved: DataFrame) -> DataFrame:
    """One row of counters; rows with errors or without an operation failed."""
    good = F.col("row_ok") & F.col("op").isNotNull()
    n = lambda c: F.count_if(c)
    return resolved.agg(
        F.count(F.lit(1)).alias("rows_total"), n(good).alias("valid"), n(~good).alias("failed"),
        n(good & (F.col("op") == "create")).alias("to_create"), n(good & (F.col("op") == "update")).alias("to_update"), n(good & (F.col("op") == "skip")).alias("skipped"),
    )


def first_actions(items: DataFrame, limit: int, order: str = "line_no", failed: Column | None = None) -> DataFrame:
    """At most ``limit`` items in order; with ``failed``, none after the first failing one."""
    if failed is not None:
        stop = items.where(failed).agg(F.min(order).alias("__stop"))
        items = items.crossJoin(F.broadcast(stop)).where(F.col("__stop").isNull() | (F.col(order) <= F.col("__stop"))).drop("__stop")  # one row
    return items.orderBy(order).limit(limit)


@dataclass(frozen=True)
class PayloadField:
    """A payload entry: ``source`` column under ``name``; ``default`` wins; ``conditional`` entries go when blank."""

    source: str
    name: str
    type: str = "string"
    required: bool = False
    conditional: bool = False
    default: str | None = None
    true_as: str | None = None
    false_as: str | None = None


def payload(fields: list[PayloadField], preview: bool = False) -> tuple[Column, Column]:
    """(JSON payload, first error). A preview keeps raw values that don't fit their type."""
    entries, errors = [], []
    for f in fields:
        raw = F.lit(f.default) if f.default is not None else F.col(f.source).cast("string")
        v = OPS.apply(op("coerce", kind=f.type), raw)
        value = v.value
        if f.type == "bool" and f.true_as is not None:
            value = F.when(v.value, f.true_as).when(~v.value, f.false_as)
        text = F.coalesce(value.cast("string"), raw) if preview else value.cast("string")
        if v.error is not None and not preview:
            errors.append(F.when(v.error.isNotNull(), F.concat(F.lit(f"{f.name}: "), v.error)))
        if f.required:
            errors.append(F.when(blank(raw), f"{f.name}: missing"))
        entries.append(F.when(~blank(raw) if f.conditional else F.lit(True), F.struct(F.lit(f.name).alias("k"), text.alias("v"))))
    body = F.to_json(F.map_from_entries(F.array_compact(F.array(*entries))), {"ignoreNullFields": "false"})
    return body, F.coalesce(*errors, F.lit(None).cast("string"))


def id_params(c: Column) -> tuple[Column, Column]:
    """(id without outer space, error when blank)."""
    s = c.cast("string")
    return F.when(~blank(s), strip(s)), F.when(blank(s), "no target id")


def dry_run(items: DataFrame, error: Column) -> DataFrame:
    """Counts of what an apply would do: by operation, and failed by error."""
    out = items.withColumn("__e", error)
    return out.groupBy(F.when(F.col("__e").isNull(), F.col("op")).otherwise("failed").alias("outcome"), F.col("__e").alias("error")).agg(F.count(F.lit(1)).alias("n"))


def rates(summary: DataFrame, pairs: dict[str, tuple[str, str]], limits: dict[str, float] = {}) -> DataFrame:
    """Percent rates of columns (0 where the base is 0, 3 decimals) and whether they pass their limits."""
    cols = {n: F.when(F.col(b) == 0, F.lit(0.0)).otherwise(F.round(100 * F.col(a) / F.col(b), 3)) for n, (a, b) in pairs.items()}
    return summary.withColumns(cols).withColumns({f"{n}_alert": F.col(n) > v for n, v in limits.items()})


def mask_fields(df: DataFrame, names: set[str], shown: str = "***") -> DataFrame:
    """Replace values of the fields named (any case) at any depth of structs and arrays; nulls stay null."""
    from pyspark.sql import types as T

    low = {n.lower() for n in names}

    def walk(c: Column, t: T.DataType) -> Column:
        if isinstance(t, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[(F.when(c[f.name].isNotNull(), shown) if f.name.lower() in low else walk(c[f.name], f.dataType)).alias(f.name) for f in t.fields]))
        if isinstance(t, T.ArrayType) and isinstance(t.elementType, (T.StructType, T.ArrayType)):
            return F.transform(c, lambda x: walk(x, t.elementType))
        if isinstance(t, T.MapType) and isinstance(t.keyType, T.StringType) and isinstance(t.valueType, T.StringType):
            return F.transform_values(c, lambda k, v: F.when(F.lower(k).isin(*low) & v.isNotNull(), shown).otherwise(v))
        return c

    return df.select(*[(F.when(F.col(f.name).isNotNull(), shown) if f.name.lower() in low else walk(F.col(f.name), f.dataType)).alias(f.name) for f in df.schema.fields])
