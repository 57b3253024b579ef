"""Merge, diff and the operation of each row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from concordat.functions.ops import fingerprint
from concordat.functions.text import blank, collapse, compare_form


@dataclass(frozen=True)
class DiffRule:
    """Compare ``desired`` with ``existing`` (default: the same name) after normalising both; report as ``output``."""

    desired: str
    existing: str | None = None
    output: str | None = None
    norm: str = "none"  # none, text, bool


def _norm(c: Column, kind: str) -> Column:
    if kind == "text":
        return compare_form(c.cast("string"))
    if kind == "bool":
        s = F.lower(collapse(c.cast("string")))
        return F.when(s.isin("1", "true", "yes", "y"), True).when(s.isin("0", "false", "no", "n", ""), False)
    return c


def default_rules(fields: list[str]) -> list[DiffRule]:
    """One plain rule a field; names that start with two underscores are ignored."""
    return [DiffRule(f) for f in fields if not f.startswith("__")]


def same_content(fields: list[str], desired: str = "desired", existing: str = "existing") -> Column:
    """Fingerprint shortcut: do both sides have the same content, so that no diff is needed?"""
    names = [f for f in fields if not f.startswith("__")]
    mark = lambda side: fingerprint({f: F.col(f"{side}.{f}") for f in names})
    return F.coalesce(mark(desired) == mark(existing), F.lit(False))


def field_changes(rules: list[DiffRule], desired: str = "desired", existing: str = "existing", ignore: frozenset[str] = frozenset()) -> Column:
    """Map of changed fields to their desired values (JSON text); null-safe comparison. Fields of ``ignore`` never change."""
    pairs = []
    for r in rules:
        if r.desired in ignore:
            continue
        d, e = F.col(f"{desired}.{r.desired}"), F.col(f"{existing}.{r.existing or r.desired}")
        pairs.append(F.when(~_norm(d, r.norm).eqNullSafe(_norm(e, r.norm)), F.struct(F.lit(r.output or r.desired).alias("k"), F.to_json(F.struct(d.alias("v")), {"ignoreNullFields": "false"}).alias("v"))))
    return F.map_from_entries(F.array_compact(F.array(*pairs)))


def fill_from_existing(fields: list[str], in_desired: set[str], fill_blank: bool = False) -> dict[str, Column]:
    """Merged values. A field of the desired state keeps its own value, null too, unless ``fill_blank``."""
    out = {}
    for f in fields:
        d, e = (F.col(f"desired.{f}") if f in in_desired else F.lit(None)), F.col(f"existing.{f}")
        out[f] = d if f in in_desired and not fill_blank else F.when(blank(d.cast("string")), e).otherwise(d) if fill_blank else e
    return out


def operation(status: Column, changes: Column) -> Column:
    """create for new records, skip without changes, else update; conflicts and ambiguous rows have none."""
    return F.when(status == "not_found", "create").when((status == "matched") & (F.size(changes) == 0), "skip").when(status == "matched", "update")


def secret_fields(op: Column, on_create: list[str] = (), on_update: list[str] = ()) -> Column:
    arr = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    return F.when(op == "create", arr(on_create)).when(op == "update", arr(on_update)).otherwise(arr([]))


def secret_lifecycle(op: Column, mode: str = "persistent", delete_on_success: bool = False, ttl_seconds: int | None = None) -> Column:
    """Struct (mode, delete_on_success, ttl_seconds) of rows that carry secrets; null for rows without an operation."""
    if mode not in ("persistent", "ephemeral"):
        raise ValueError(f"unknown secret mode {mode!r}")
    gone = F.lit(delete_on_success or mode == "ephemeral")
    one = F.struct(F.lit(mode).alias("mode"), gone.alias("delete_on_success"), F.lit(ttl_seconds).cast("long").alias("ttl_seconds"))
    return F.when(op.isin("create", "update"), one)


def target_id(status: Column, existing_id: Column, own: Column) -> tuple[Column, Column]:
    """(id, error): the matched record's id, else the row's own."""
    v = F.when(status == "matched", existing_id.cast("string")).otherwise(own.cast("string"))
    return v, F.when(v.isNull(), "no target id")
