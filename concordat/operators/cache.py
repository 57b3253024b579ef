"""The snapshot of a target: projection, filters, last-wins upsert, refresh."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions.ops import all_of, any_of
from concordat.functions.text import blank, strip


@dataclass(frozen=True)
class CacheColumn:
    """``value`` over a raw item, cast to ``type``; on_error: error, warn, skip or set_null when it doesn't fit.

    All but error store null; warn leaves a warning with the item.
    """

    name: str
    value: Column
    type: str = "string"
    required: bool = False
    on_error: str = "error"


def project_items(raw: DataFrame, columns: list[CacheColumn], keep: tuple[str, ...] = ()) -> DataFrame:
    """Cache columns, ``failed``: null or why the item can't be stored, and ``warned``: what was stored as null with a warning."""
    out, why, warned = {}, [], []
    for c in columns:
        if c.on_error not in ("error", "warn", "skip", "set_null"):
            raise ValueError(f"{c.name}: unknown on_error {c.on_error!r}")
        v = c.value.try_cast(c.type) if c.type != "string" else c.value.cast("string")
        out[c.name] = v
        if c.on_error in ("error", "warn"):
            (why if c.on_error == "error" else warned).append(F.when(c.value.isNotNull() & v.isNull(), f"{c.name}: not of type {c.type}"))
        if c.required:
            why.append(F.when(blank(v.cast("string")), f"{c.name}: missing"))
    notes = F.array_compact(F.array(*warned)) if warned else F.array().cast("array<string>")
    return raw.select(*keep, *[v.alias(n) for n, v in out.items()], F.coalesce(*why, F.lit(None).cast("string")).alias("failed"), notes.alias("warned"))


def nullish(c: Column) -> Column:
    s = F.lower(strip(c.cast("string")))
    return s.isNull() | s.isin("", "null", "none")


def soft_deleted(any_rules: list[tuple] = (), all_rules: list[tuple] = ()) -> Column:
    """Deletion flag of raw items. Rules: ('equals', column, value) or ('not_null', column)."""

    def test(rule):
        kind, c, *v = rule
        return ~nullish(c) if kind == "not_null" else strip(F.lower(c.cast("string"))).eqNullSafe(F.lit(str(v[0]).lower().strip()))

    parts = ([any_of([test(r) for r in any_rules])] if any_rules else []) + ([all_of([test(r) for r in all_rules])] if all_rules else [])
    return all_of(parts) if parts else F.lit(False)


def truthy(c: Column) -> Column:
    """true, a number other than 0, or 1/true/yes/y."""
    s = F.lower(strip(c.cast("string")))
    return F.coalesce(s.isin("1", "true", "yes", "y") | (s.try_cast("double") != 0), F.lit(False))


def find(cache: DataFrame, equals: dict | None = None, like: dict | None = None, within: dict | None = None, include_deleted: bool = False) -> DataFrame:
    """Rows that meet all conditions. Null equals nothing, an empty list holds nothing, LIKE ignores case."""
    conds = [F.lit(False) if v is None else F.col(k) == v for k, v in (equals or {}).items()]
    conds += [F.col(k).ilike(v) for k, v in (like or {}).items()]
    conds += [F.col(k).isin(*v) if v else F.lit(False) for k, v in (within or {}).items()]
    if not include_deleted and "deletion_date" in cache.columns:
        conds.append(F.col("deletion_date").isNull())
    return cache.where(all_of(conds)) if conds else cache


def last_wins(batch: DataFrame, pk: str, order: list[str]) -> DataFrame:
    """The last item of each key, by page and ordinal; ``sightings`` counts them. Tasks keep one item a key before the shuffle."""
    per = batch.groupBy(pk).agg(F.max_by(F.struct(*batch.columns), F.struct(*order)).alias("__last"), F.count(F.lit(1)).alias("sightings"))
    return per.select("__last.*", "sightings")


def upsert(snapshot: DataFrame, batch: DataFrame, pk: str) -> DataFrame:
    """The next version: batch rows replace those of their key as a whole. ``change``: inserted, updated, kept."""
    cols = [c for c in snapshot.columns if c != pk]
    new = batch.select(pk, F.struct(*cols).alias("__new"))
    both = snapshot.select(pk, F.struct(*cols).alias("__old")).join(new, pk, "full_outer")
    change = F.when(F.col("__old").isNull(), "inserted").when(F.col("__new").isNotNull(), "updated").otherwise("kept")
    take = F.when(F.col("__new").isNotNull(), F.col("__new")).otherwise(F.col("__old"))
    return both.select(pk, take.alias("__row"), change.alias("change")).select(pk, *[F.col(f"__row.{c}").alias(c) for c in cols], "change")


def unique_violations(rows: DataFrame, pk: str, unique: str, order: str) -> DataFrame:
    """Rows whose unique value belongs to the key that came first with it. Null values are free."""
    some = rows.where(F.col(unique).isNotNull())
    owners = some.groupBy(F.col(unique).alias("__u")).agg(F.min(F.struct(F.col(order).alias("o"), F.col(pk).alias("k")))["k"].alias("__owner"))
    return some.join(owners, F.col(unique) == F.col("__u")).where(F.col("__owner") != F.col(pk)).drop("__u", "__owner")


def refresh(snapshot: DataFrame, raw: DataFrame, columns: list[CacheColumn], pk: str, order: list[str], deleted: Column) -> tuple[DataFrame, DataFrame]:
    """(next snapshot with ``change``, one row of counts) of landed pages.

    Deleted items are left out, which does not remove a stored row; items that
    can't be stored are counted as failed.
    """
    items = project_items(raw.withColumn("__deleted", deleted), columns, keep=("__deleted", *order))
    good = items.where(~F.col("__deleted") & F.col("failed").isNull())
    last = last_wins(good, pk, order)
    state = upsert(snapshot, last.select(*snapshot.columns), pk)
    base = items.agg(F.count_if("__deleted").alias("skipped"), F.count_if(~F.col("__deleted") & F.col("failed").isNotNull()).alias("failed"))
    # A key seen n times is inserted once, if it is new, and updated the other times.
    seen = last.join(state.select(pk, "change"), pk).agg(
        F.count_if(F.col("change") == "inserted").alias("inserted"), F.coalesce(F.sum(F.col("sightings") - (F.col("change") == "inserted").cast("int")), F.lit(0)).alias("updated"),
    )
    return state, base.crossJoin(seen)  # one row each


def refresh_totals(counts: dict[str, DataFrame]) -> DataFrame:
    """Counts of ``refresh`` by data set, with a total (null data set)."""
    rows = reduce(DataFrame.unionByName, [c.withColumn("dataset", F.lit(n)) for n, c in counts.items()])
    return rows.rollup("dataset").agg(*[F.sum(c).alias(c) for c in ("inserted", "updated", "failed", "skipped")])


def clear(parts: dict[str, DataFrame], parents: dict[str, list[str]], dataset: str | None = None, cascade: bool = True) -> tuple[dict[str, DataFrame], DataFrame]:
    """(the emptied data sets, dependants first; one row each with what it held) of one data set or of all.

    With ``cascade`` what depends on the data set is cleared too; without, a data
    set that others depend on is refused.
    """
    order = [d for d in clear_order(parents) if d in parts]
    below = {d: {c for c, ps in parents.items() if d in ps} for d in order}
    chosen, open_ = set(order if dataset is None else [dataset]), [] if dataset is None else [dataset]
    while open_:
        new = below.get(open_.pop(), set()) - chosen
        chosen |= new
        open_ += new
    if dataset is not None and not cascade and len(chosen) > 1:
        raise ValueError(f"{dataset} is needed by {', '.join(sorted(chosen - {dataset}))}")
    names = [d for d in order if d in chosen]
    counts = reduce(DataFrame.unionByName, [parts[d].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(i).alias("step"), F.lit(d).alias("dataset"), "rows") for i, d in enumerate(names)])
    return {d: parts[d].limit(0) for d in names}, counts


def schema_hash(df: DataFrame) -> str:
    return hashlib.sha256(df.schema.json().encode()).hexdigest()


def drift(df: DataFrame, stored_hash: str | None, policy: str = "fail") -> str:
    """'same', 'first' or 'rebuild'; a changed schema under the policy 'fail' is an error."""
    if stored_hash is None:
        return "first"
    if schema_hash(df) == stored_hash:
        return "same"
    if policy == "fail":
        raise ValueError("the snapshot's schema has changed")
    return "rebuild"


def rebuilt(df: DataFrame, snapshot: DataFrame, stored_hash: str | None, policy: str = "fail") -> DataFrame:
    """The snapshot to refresh from: the stored one, or an empty one of the new schema where the schema's drift asks for a rebuild.

    Policies: fail, rebuild. All data sets are rebuilt by calling this for each.
    """
    return df.limit(0) if drift(df, stored_hash, policy) in ("rebuild", "first") else snapshot


def status_by_dataset(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows of each dataset and a grand total (null dataset)."""
    all_ = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("dataset"))
        all_ = one if all_ is None else all_.unionByName(one)
    return all_.rollup("dataset").agg(F.count(F.lit(1)).alias("rows"))


def clear_order(parents: dict[str, list[str]]) -> list[str]:
    """Datasets so that dependants come before what they depend on."""
    from graphlib import TopologicalSorter

    return list(TopologicalSorter(parents).static_order())[::-1]
