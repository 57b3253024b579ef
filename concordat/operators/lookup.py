"""Enrichment: lookups as joins, candidate decisions, generated unique values, secrets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concordat.functions.text import blank, collapse, strip


@dataclass(frozen=True)
class LookupRule:
    """Candidates for ``target`` from rows of a provider whose key equals the row's key."""

    target: str
    key: Column  # over the fed rows
    provider: DataFrame
    provider_key: Column  # over the provider
    value: Column  # over the provider
    priority: int = 0
    confidence: float = 1.0
    merge: str = "if_empty"  # recompute_always, never, if_empty, if_authoritative


class Providers:
    """Lookup and existence providers by name: functions of keyword arguments that return a DataFrame."""

    def __init__(self):
        self._made: dict[str, Callable[..., DataFrame]] = {}

    def register(self, name: str, make: Callable[..., DataFrame]) -> None:
        if name in self._made:
            raise ValueError(f"provider {name!r} is registered already")
        self._made[name] = make

    def get(self, name: str, **args) -> DataFrame:
        try:
            return self._made[name](**args)
        except KeyError:
            raise ValueError(f"unknown provider {name!r}") from None


def _found(side: DataFrame, limit: int | None) -> DataFrame:
    """(__k, found): the sorted values (v) of each key, or the ``limit`` least; see ``lookup`` for limits 1 and 2."""
    if limit == 1:
        return side.groupBy("__k").agg(F.array(F.min("v")).alias("found"))
    if limit == 2:  # the least and the greatest: all that a decision needs of several
        return side.groupBy("__k").agg(F.when(F.count("v") > 1, F.array(F.min("v"), F.max("v"))).otherwise(F.array(F.min("v"))).alias("found"))
    if limit:  # tasks pass on the least values of a key only, however many they have
        w = Window.partitionBy("__k").orderBy("v")
        side = side.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit)
    return side.groupBy("__k").agg(F.array_sort(F.collect_list("v")).alias("found"))


def lookup(df: DataFrame, row_id: str, rule: LookupRule, limit: int | None = None) -> DataFrame:
    """(row_id, candidates) of rows with a key: array of (priority, confidence, value); nulls are no candidates.

    ``provider_key`` is aggregated first, so that the join has one row a key and
    a frequent key of the feed never multiplies. With a ``limit`` nothing grows
    with a key's rows, in a task or in the shuffle (with 2, of more values the two
    are the least and the greatest, which is what decisions need; else the least
    ones); without a limit a key's values are one list.
    """
    side = rule.provider.select(strip(rule.provider_key.cast("string")).alias("__k"), rule.value.cast("string").alias("v"))
    side = side.where("__k <> '' and v is not null")
    side = _found(side, limit)
    keyed = df.select(row_id, strip(rule.key.cast("string")).alias("__k")).where(~blank(F.col("__k")))
    one = lambda v: F.struct(F.lit(rule.priority).alias("priority"), F.lit(rule.confidence).alias("confidence"), v.alias("value"))
    return keyed.join(side, "__k").select(row_id, F.transform("found", one).alias("candidates"))


def decide(candidates: Column) -> Column:
    """Struct (status, value): none, selected, or ambiguous if the two best tie, equal values or not."""
    ranked = F.array_sort(F.transform(candidates, lambda c: F.struct((-c["priority"]).alias("p"), (-c["confidence"]).alias("c"), c["value"].alias("value"))))
    a, b = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    tie = b.isNotNull() & (a["p"] == b["p"]) & (a["c"] == b["c"])
    status = F.when(a.isNull(), "none").when(tie, "ambiguous").otherwise("selected")
    return F.struct(status.alias("status"), F.when(status == "selected", a["value"]).alias("value"))


def may_write(policy: str, current: Column, source: str = "", authoritative: frozenset[str] = frozenset({"sink_cache"})) -> Column:
    """Merge policy: may a found value replace the current one?"""
    return {
        "recompute_always": F.lit(True), "never": F.lit(False), "if_empty": current.isNull() | (current == ""),
        "if_authoritative": F.lit(source in authoritative),
    }[policy]


def enrich(df: DataFrame, row_id: str, rules: list[LookupRule]) -> DataFrame:
    """Rules in order, each a join; a later rule may read what an earlier one set.

    Adds ``<target>__status``. Rows without a key have status 'none'.
    """
    for r in rules:
        found = lookup(df, row_id, r, limit=2)
        df = df.join(found, row_id, "left").withColumn("__d", decide(F.coalesce("candidates", F.array().cast("array<struct<priority:int,confidence:double,value:string>>"))))
        cur = F.col(r.target) if r.target in df.columns else F.lit(None).cast("string")
        take = (F.col("__d.status") == "selected") & may_write(r.merge, cur)
        df = df.withColumns({r.target: F.when(take, F.col("__d.value")).otherwise(cur), f"{r.target}__status": F.col("__d.status")}).drop("__d", "candidates")
    return df


def exists_in(df: DataFrame, key: Column, provider: DataFrame, provider_key: Column, out: str) -> DataFrame:
    """Flag: does the provider hold this key? Null keys are in nothing."""
    side = provider.select(provider_key.alias("__p")).where("__p is not null").distinct().withColumn(out, F.lit(True))
    return df.withColumn("__q", key).join(side, F.col("__q") == F.col("__p"), "left").withColumn(out, F.coalesce(out, F.lit(False))).drop("__q", "__p")


def unique_value(df: DataFrame, row_id: str, base: Column, suffixes: list[str], taken: DataFrame, taken_key: Column, owner: Column | None = None, own: Column | None = None, out: str = "value") -> DataFrame:
    """The first of base, base+suffix... that is free, or taken by the row's own record.

    Adds ``out`` (null when exhausted) and ``<out>__conflict``. Checks stored
    values only, not the other rows of the batch. ``owner`` is over ``taken``,
    ``own`` over ``df``.
    """
    tries = df.select(row_id, (own if own is not None else F.lit(None)).cast("string").alias("__own"), base.alias("__base"))
    tries = tries.select(row_id, "__own", F.posexplode(F.transform(F.array(*map(F.lit, ["", *suffixes])), lambda s: F.concat("__base", s))).alias("pos", "cand"))
    held = taken.select(taken_key.cast("string").alias("cand"), (owner if owner is not None else F.lit(None)).cast("string").alias("__owner"))
    held = held.where("cand is not null").groupBy("cand").agg(F.min("__owner").alias("__owner"), F.lit(True).alias("__taken"))
    free = F.col("__taken").isNull() | (F.col("__own") == F.col("__owner"))
    best = tries.where("cand is not null").join(held, "cand", "left").where(free).groupBy(row_id).agg(F.min_by("cand", "pos").alias(out))
    return df.join(best, row_id, "left").withColumn(f"{out}__conflict", F.col(out).isNull() & base.isNotNull())


def match_key(parts: list[Column], sep: str = "|", strict: bool = True) -> tuple[Column, Column]:
    """(key, error) of identity parts with inner white space collapsed; strict: any blank part is an error."""
    key = F.array_join(F.array(*[F.coalesce(collapse(p.cast("string")), F.lit("")) for p in parts]), sep)
    bad = F.exists(F.array(*[p.cast("string") for p in parts]), blank)
    return (F.when(~bad, key), F.when(bad, "blank key part")) if strict else (key, F.lit(None).cast("string"))


def split_secrets(df: DataFrame, fields: list[str], dataset: str, key: str = "match_key") -> tuple[DataFrame, DataFrame]:
    """(rows without their secrets, side table dataset, match_key, field, value). Rows without a key keep theirs and ``secret_error``."""
    keyed = ~blank(F.col(key))
    some = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    side = df.where(keyed).select(F.lit(dataset).alias("dataset"), F.col(key).alias("match_key"), F.explode(some).alias("s")).select("dataset", "match_key", "s.*").where("value is not null")
    has = F.exists(F.array(*[F.col(f).cast("string") for f in fields]), lambda x: x.isNotNull())
    rows = df.withColumn("secret_error", F.when(~keyed & has, "no match key to store secrets under"))
    return rows.withColumns({f: F.when(~keyed, F.col(f)) for f in fields}), side


def hydrate_secrets(items: DataFrame, secrets: DataFrame, dataset: str, fields: list[str], key: str = "match_key") -> DataFrame:
    """Fill missing secret fields from the side table; ``missing_secrets`` lists those that are not there."""
    wide = secrets.where(F.col("dataset") == dataset).groupBy("match_key").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"__{f}") for f in fields])
    out = items.join(wide.withColumnRenamed("match_key", "__mk"), F.col(key) == F.col("__mk"), "left").drop("__mk")
    out = out.withColumns({f: F.coalesce(F.col(f), F.col(f"__{f}")) if f in items.columns else F.col(f"__{f}") for f in fields}).drop(*[f"__{f}" for f in fields])
    return out.withColumn("missing_secrets", F.array_compact(F.array(*[F.when(F.col(f).isNull(), f) for f in fields])))


SECRET = ["dataset", "field", "match_key"]


def retire_secrets(secrets: DataFrame, applied: DataFrame) -> DataFrame:
    """Secrets left after items (dataset, field, match_key) were applied."""
    return secrets.join(applied.select(*SECRET).distinct(), SECRET, "left_anti")


def retire_counters(secrets: DataFrame, applied: DataFrame) -> DataFrame:
    """One row a data set: secrets deleted, kept, and applied items skipped since they have none."""
    mark = lambda d, n: d.select(*SECRET).distinct().withColumn(n, F.lit(True))
    both = mark(secrets, "__s").join(mark(applied, "__a"), SECRET, "full_outer")
    held, used = F.col("__s").isNotNull(), F.col("__a").isNotNull()
    return both.groupBy("dataset").agg(F.count_if(held & used).alias("deleted"), F.count_if(held & ~used).alias("kept"), F.count_if(~held).alias("skipped"))


def canonicalize(df: DataFrame, row_id: str, key: Column, provider: DataFrame, provider_key: Column, fields: list[str]) -> DataFrame:
    """Adds ``entry``, all ``fields`` of the provider's row with the least of them for the key, and ``entry_status``: none, selected or ambiguous."""
    row = F.struct(*fields)
    side = provider.select(strip(provider_key.cast("string")).alias("__k"), row.alias("__r")).where("__k <> ''").groupBy("__k").agg(F.min("__r").alias("__r"), F.count(F.lit(1)).alias("__n"))
    out = df.withColumn("__q", strip(key.cast("string"))).join(side, F.col("__q") == F.col("__k"), "left")
    status = F.when(F.col("__n").isNull(), "none").when(F.col("__n") == 1, "selected").otherwise("ambiguous")
    return out.withColumn("entry_status", status).withColumn("entry", F.when(F.col("entry_status") == "selected", F.col("__r"))).drop("__q", "__k", "__r", "__n")


def canonical_lookup(df: DataFrame, row_id: str, rule: LookupRule, canonical, limit: int | None = None) -> DataFrame:
    """``lookup`` with both sides in canonical form. A null field is '' there and matches a key that becomes ''.

    ``canonical`` maps a Column to its form, never null. One hash join instead of
    a scan of the provider for each row.
    """
    side = rule.provider.select(canonical(rule.provider_key.cast("string")).alias("__k"), rule.value.cast("string").alias("v")).where("v is not null")
    side = _found(side, limit)
    one = lambda v: F.struct(F.lit(rule.priority).alias("priority"), F.lit(rule.confidence).alias("confidence"), v.alias("value"))
    keyed = df.where(rule.key.isNotNull()).select(row_id, canonical(rule.key.cast("string")).alias("__k"))
    return keyed.join(side, "__k").select(row_id, F.transform("found", one).alias("candidates"))


def append_when(base: Column, when: Column, then: Column) -> Column:
    """``base``, or ``base`` and ``then`` where the condition holds."""
    return F.when(F.coalesce(when, F.lit(False)), F.concat(base, then)).otherwise(base)


def lookup_counters(df: DataFrame, name: str, hit: Column, failed: Column | None = None) -> DataFrame:
    """Hits, misses and errors of lookups by dictionary name, with a total (null name)."""
    bad = F.coalesce(failed, F.lit(False)) if failed is not None else F.lit(False)
    flagged = df.select(F.col(name).alias("dictionary"), hit.alias("__h"), bad.alias("__b"))
    return flagged.rollup("dictionary").agg(F.count_if(F.col("__h") & ~F.col("__b")).alias("hits"), F.count_if(~F.col("__h") & ~F.col("__b")).alias("misses"), F.count_if("__b").alias("errors"))


def outcome(failure: Column, policy: str) -> dict[str, Column]:
    """Where a failure (null: none) goes under a policy: skip, warn, error or needs_resolve."""
    none = F.lit(None).cast("string")
    return {"error": failure if policy == "error" else none, "warning": failure if policy == "warn" else none, "hint": failure if policy == "needs_resolve" else none}


def runs(policy: str, has_errors: Column) -> Column:
    """Does an operation run on this row? 'never' on rows with errors (the default), or 'always'."""
    if policy not in ("never", "always"):
        raise ValueError(f"unknown run policy {policy!r}")
    return F.lit(True) if policy == "always" else ~has_errors
