"""Map and normalize stages: declared rules compiled to projections."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions.ops import OPS, Op, OpRegistry, run_chains
from concordat.functions.text import blank, strip
from concordat.operators.diagnostics import add, diag, has_errors, with_channels


@dataclass(frozen=True)
class MapRule:
    """``targets`` get the result of ``ops`` on ``sources`` (several: an array of them).

    Several targets: a struct is assigned by name, an array by position (short
    ones leave null), a scalar goes to each. on_error: 'error' or 'warn'.
    """

    targets: tuple[str, ...]
    sources: tuple[str, ...]
    ops: tuple[Op, ...] = ()
    on_error: str = "error"
    required: bool = False


@dataclass(frozen=True)
class SinkField:
    name: str
    type: str = "string"
    required: bool = False
    nullable: bool = True


def _source(df: DataFrame, names: tuple[str, ...]) -> Column:
    cols = [F.col(n) for n in names]
    return cols[0] if len(cols) == 1 else F.array(*[c.cast("string") for c in cols])


def _assign(kind: str, c: Column, targets: tuple[str, ...]) -> dict[str, Column]:
    if len(targets) == 1:
        return {targets[0]: c}
    if kind.startswith("struct"):
        return {t: c[t] for t in targets}
    if kind.startswith("array"):
        return {t: F.get(c, F.lit(i)) for i, t in enumerate(targets)}
    return dict.fromkeys(targets, c)


def map_rows(df: DataFrame, rules: list[MapRule], keep: tuple[str, ...] = (), ops: OpRegistry = OPS) -> DataFrame:
    """Columns ``keep`` and each rule's targets. A row with an error gets null targets and ``row_ok`` false.

    A source column that does not exist is an error of every row, known when the
    rules are compiled.
    """
    df = with_channels(df)
    present = set(df.columns)
    missing = {i: [s for s in r.sources if s not in present] for i, r in enumerate(rules)}
    chains = {f"__m{i}": (_source(df, r.sources), list(r.ops)) for i, r in enumerate(rules) if not missing[i]}
    out = run_chains(df, chains, ops)
    kinds = dict(out.dtypes)
    errors, warnings, targets = [], [], {}
    for i, r in enumerate(rules):
        if missing[i]:
            errors.append(diag("map", "SOURCE_COLUMN_MISSING", ",".join(r.targets), f"no column {missing[i][0]}"))
            targets |= {t: F.lit(None).cast("string") for t in r.targets}
            continue
        err = F.col(f"__m{i}__err")
        failed = diag("map", "OP_FAILED", ",".join(r.targets), err, err.isNotNull())
        (warnings if r.on_error == "warn" else errors).append(failed)
        targets |= {t: F.when(err.isNull(), c) for t, c in _assign(kinds[f"__m{i}"], F.col(f"__m{i}"), r.targets).items()}
        if r.required:
            errors += [diag("map", "REQUIRED_FIELD_MISSING", t, None, blank(targets[t].cast("string"))) for t in r.targets]
    out = add(out, errors, warnings)
    return out.select(*keep, *[F.when(~has_errors(), c).alias(t) for t, c in targets.items()], "errors", "warnings", (~has_errors()).alias("row_ok"))


@dataclass(frozen=True)
class NormalizeRule:
    field: str
    ops: tuple[Op, ...]
    on_error: str = "error"


def normalize_rows(df: DataFrame, rules: list[NormalizeRule], ops: OpRegistry = OPS) -> DataFrame:
    """Rules in order on existing fields; rows with errors are passed on as they are.

    With on_error='warn' the value from before the failing operation is stored.
    """
    df = with_channels(df)
    errors, warnings = [], []
    for i, r in enumerate(rules):  # a later rule sees what an earlier one made
        out = run_chains(df, {f"__n{i}": (F.col(r.field), list(r.ops))}, ops)
        kinds = dict(out.dtypes)
        kept = F.col(r.field) if kinds[f"__n{i}"] == kinds[r.field] else F.col(r.field).try_cast(kinds[f"__n{i}"])
        df = out.withColumn(r.field, F.when(has_errors(), kept).otherwise(F.col(f"__n{i}")))
        err = F.col(f"__n{i}__err")
        failed = diag("normalize", "OP_FAILED", r.field, err, err.isNotNull() & ~has_errors())
        (warnings if r.on_error == "warn" else errors).append(failed)
    return add(df, errors, warnings).drop(*[f"__n{i}{x}" for i in range(len(rules)) for x in ("", "__err")])


def type_matches(c: Column, kind: str, dtype: str) -> Column:
    """Does a value fit a sink type? Typed columns are known when compiled."""
    exact = {"string": ("string",), "int": ("int", "bigint", "smallint"), "float": ("double", "float", "int", "bigint"), "bool": ("boolean",)}
    if dtype in exact.get(kind, ()):
        return F.lit(True)
    if kind == "object":
        return F.lit(dtype.startswith(("struct", "map")))
    if kind == "list":
        return F.lit(dtype.startswith("array"))
    if dtype != "string":
        return F.lit(False)
    s = strip(c)
    return {
        "int": s.rlike(r"^\d+$"), "float": s.try_cast("double").isNotNull(),
        "bool": F.lower(s).isin("true", "false", "1", "0", "yes", "no", "y", "n"),
    }.get(kind, F.lit(True))


def check_sink(df: DataFrame, fields: list[SinkField], stage: str = "normalize", as_warnings: bool = False, touched: set[str] | None = None) -> DataFrame:
    """Required and type checks of a sink spec, on all its fields or those touched."""
    df = with_channels(df)
    kinds = dict(df.dtypes)
    found = []
    for f in fields:
        if touched is not None and f.name not in touched:
            continue
        if f.name not in kinds:
            if f.required:
                found.append(diag(stage, "REQUIRED_FIELD_MISSING", f.name, "absent"))
            continue
        c = F.col(f.name)
        empty = blank(c) if kinds[f.name] == "string" else c.isNull()
        if f.required or not f.nullable:
            found.append(diag(stage, "REQUIRED_FIELD_MISSING", f.name, "blank", empty))
        found.append(diag(stage, "TYPE_MISMATCH", f.name, f"not of type {f.type}", ~empty & ~type_matches(c, f.type, kinds[f.name])))
    return add(df, warnings=found) if as_warnings else add(df, errors=found)


def with_meta(df: DataFrame, values: dict[str, Column], meta: str = "meta") -> DataFrame:
    """Meta values of rows without errors; nulls leave no entry."""
    pairs = F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull())
    return with_channels(df).withColumn(meta, F.when(~has_errors(), pairs))


def desired_state(fields: list[str], drop: set[str] = frozenset()) -> Column:
    return F.struct(*[F.col(f) for f in fields if f not in drop])


def source_ref(values: dict[str, Column], primary: tuple[str, Column] | None = None) -> Column:
    """Identity values that are not blank, by name; with ``primary`` (name, value) that one too, unless it is there."""
    all_ = values if primary is None or primary[0] in values else values | {primary[0]: primary[1]}
    return F.map_filter(F.create_map(*[x for k, v in all_.items() for x in (F.lit(k), v.cast("string"))]), lambda _, v: ~blank(v))


def path_column(path: str, record: str | None = None, meta: str = "meta") -> Column:
    """The column a path reads: ``row.x`` and ``record.x`` are fields, ``meta.x`` an entry of the meta map, other paths are dotted names.

    ``record``: the struct that holds the record's fields, if they are no plain columns.
    """
    head, _, rest = path.partition(".")
    if head == "meta" and rest:
        return F.col(meta)[rest]
    if head in ("row", "record") and rest:
        return F.col(f"{record}.{rest}" if record else rest)
    return F.col(path)
