"""Declarative operations: ``Column -> Value``, a value with an error channel.

An operation never raises on data. Its ``Value.error`` is null or a message; a
chain stops at its first error and keeps the value from before the failing
operation if the types agree, else null. A chain runs as projections, one per
position, so that expressions don't nest in each other.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions import text, vector
from concordat.session import ship


@dataclass(frozen=True)
class Value:
    value: Column
    error: Column | None = None


@dataclass(frozen=True)
class Op:
    """A call of a registered operation."""

    name: str
    args: dict = field(default_factory=dict)


def op(name: str, **args) -> Op:
    return Op(name, args)


class OpRegistry:
    """Operations by name. Unknown names fail when a rule is compiled, not on a row."""

    def __init__(self):
        self._ops: dict[str, Callable[..., Value | Column]] = {}
        self._sequences: set[str] = set()

    def register(self, name: str, fn: Callable | None = None, *, override: bool = False, sequence: bool = False):
        """``sequence``: the operation takes an array; a scalar counts as an array of one, null as none."""

        def put(f):
            if name in self._ops and not override:
                raise ValueError(f"operation {name!r} is registered already")
            self._ops[name] = f
            (self._sequences.add if sequence else self._sequences.discard)(name)
            return f

        return put(fn) if fn else put

    def get(self, name: str) -> Callable:
        try:
            return self._ops[name]
        except KeyError:
            raise ValueError(f"unknown operation {name!r}") from None

    def names(self) -> list[str]:
        return sorted(self._ops)

    def apply(self, call: Op, c: Column, kind: str | None = None) -> Value:
        """``kind``: the column's type, where it is known."""
        if kind is not None and call.name in self._sequences and not kind.startswith("array"):
            c = F.when(c.isNotNull(), F.array(c))
        out = self.get(call.name)(c, **call.args)
        return out if isinstance(out, Value) else Value(out)


OPS = OpRegistry()
_put = OPS.register


def run_chains(df: DataFrame, chains: dict[str, tuple[Column, list[Op]]], ops: OpRegistry = OPS) -> DataFrame:
    """Add ``name`` and ``name__err`` for each chain: a start value and operations."""
    ship(df.sparkSession)  # a few operations are Arrow helpers
    df = df.withColumns({n: c for n, (c, _) in chains.items()} | {f"{n}__err": F.lit(None).cast("string") for n in chains})
    for i in range(max((len(calls) for _, calls in chains.values()), default=0)):
        kinds = dict(df.dtypes)
        step = {n: ops.apply(calls[i], F.col(f"`{n}`"), kinds[n]) for n, (_, calls) in chains.items() if i < len(calls)}
        new = df.select(*[v.value.alias(n) for n, v in step.items()]).dtypes
        cols = {}
        for n, kind in new:
            v, err = step[n], F.col(f"`{n}__err`")
            failed = err.isNotNull() if v.error is None else err.isNotNull() | v.error.isNotNull()
            kept = F.col(f"`{n}`") if kinds[n] == kind else F.lit(None).cast(kind)
            cols[n] = F.when(failed, kept).otherwise(v.value)
            if v.error is not None:
                cols[f"{n}__err"] = F.coalesce(err, v.error)
        df = df.withColumns(cols)
    return df


def _fail(when: Column, message: str) -> Column:
    return F.when(when, F.lit(message))


# Strings


@_put("trim")
def _trim(c):
    return text.empty_to_null(text.collapse(c))


_put("lower", F.lower)
_put("upper", F.upper)
_put("title", lambda c: text.title(c))
_put("capitalize", lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2**31 - 1))))
_put("upper_first", lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 2**31 - 1)))
_put("transliterate", lambda c: vector.transliterate(c))
_put("casefold", text.casefold)
_put("to_string", lambda c: text.empty_to_null(text.strip(c.cast("string"))))
_put("normalize_text", text.collapse)
_put("concat", lambda c, sep="": F.when(F.exists(c, lambda x: x.isNotNull()), F.array_join(c, sep)))


@_put("substring")
def _substring(c, start=0, length=None):
    """A slice from 0; a negative start counts from the end."""
    if length is not None and length < 0:
        return Value(c, F.lit("length must not be negative"))
    n = F.length(c)
    first = F.lit(start) if start >= 0 else F.greatest(F.lit(0), n + start)
    return F.substring(c, first + 1, F.lit(length) if length is not None else n)


_put("split", lambda c, sep=",": F.split(c, re.escape(sep) if sep else "", -1))
_put("digits_only", lambda c: text.empty_to_null(F.regexp_replace(c, r"[^\p{Nd}]", "")))
_put("strip_non_alnum", lambda c: F.regexp_replace(c, "[^A-Za-z0-9]", ""))
_put("contains_non_ascii", lambda c: c.rlike(r"[^\x00-\x7F]"))
_put("is_blank", text.blank)


def java_regex(pattern: str, flags: str = "", full: bool = False) -> str:
    """A Python-style pattern for Spark's engine: named groups, flags, Unicode classes, full match."""
    pattern = re.sub(r"\(\?P<", "(?<", pattern)
    marks = "".join({"ignorecase": "i", "multiline": "m", "dotall": "s"}.get(f, "") for f in flags.split())
    return f"(?{'' if 'ascii' in flags else 'U'}{marks})".replace("(?)", "") + (rf"\A(?:{pattern})\z" if full else pattern)


def _groups(pattern: str) -> int:
    return re.compile(pattern).groups


def java_replacement(repl: str) -> str:
    """A Python-style replacement for Spark's engine: ``\\1`` and ``\\g<name>`` are groups, ``$`` is itself."""

    def one(m: re.Match) -> str:
        if m[1] or m[2]:
            return f"${{{m[1]}}}" if m[1] and not m[1].isdigit() else f"${m[1] or m[2]}"
        return {"\\\\": "\\\\", "$": "\\$"}.get(m[0], "\\" + m[0] if m[0] == "\\" else m[0])

    return re.sub(r"\\g<(\w+)>|\\(\d)|\\\\|\\|\$", one, repl)


@_put("regex_extract")
def _regex_extract(c, pattern, group=0):
    if group > _groups(pattern):
        return F.lit(None).cast("string")
    p = java_regex(pattern)
    return F.when(c.rlike(p), F.regexp_extract(c, p, group))


@_put("regex_replace")
def _regex_replace(c, pattern, repl=""):
    return F.regexp_replace(c, java_regex(pattern), java_replacement(repl))


@_put("format_mask")
def _format_mask(c, mask, placeholder="#"):
    n = mask.count(placeholder)
    at, parts = 0, []
    for ch in mask:
        if ch == placeholder:
            at += 1
            parts.append(F.substring(c, at, 1))
        else:
            parts.append(F.lit(ch))
    return Value(F.when(c != "", F.concat(*parts)), _fail((c != "") & (F.length(c) != n), "value does not fill the mask"))


@_put("split_name")
def _split_name(c, fields=("last", "first", "middle"), separator=None, allow_comma=True, max_parts=None):
    """Parts of a name as a struct; ``Last, First Middle`` too. Missing parts are null, extra ones are cut."""
    cut = text.WS if separator is None else re.escape(separator)
    plain = F.split(c, cut, -1)
    if allow_comma:
        head, tail = F.substring_index(c, ",", 1), F.expr("null")
        tail = F.substring(c, F.length(head) + 2, F.length(c))
        plain = F.when(F.contains(c, F.lit(",")), F.concat(F.array(text.collapse(head)), F.split(tail, cut, -1))).otherwise(plain)
    parts = F.filter(F.transform(plain, text.strip), lambda x: x != "")
    if max_parts:
        parts = F.slice(parts, 1, max_parts)
    return F.struct(*[F.get(parts, F.lit(i)).alias(f) for i, f in enumerate(fields)])


# Numbers, booleans


def _plain_number(c: Column) -> Column:
    return F.regexp_replace(text.strip(c.cast("string")), r"(?<=\d)_(?=\d)", "")


@_put("to_int")
def _to_int(c):
    s = _plain_number(c)
    v = F.when(s.rlike(r"^[+-]?\d+$"), s.try_cast("bigint"))
    return Value(v, _fail(v.isNull(), "not a whole number"))


@_put("to_float")
def _to_float(c):
    s = _plain_number(c)
    v = F.when(~s.rlike("[dDfF]$") | s.rlike("(?i)(?:inf)$"), s.try_cast("double"))
    return Value(v, _fail(v.isNull(), "not a number"))


@_put("to_bool")
def _to_bool(c):
    s = F.lower(text.strip(c.cast("string")))
    v = F.when(s == "true", True).when(s == "false", False)
    return Value(v, _fail(v.isNull(), "neither true nor false"))


@_put("parse_bool")
def _parse_bool(c, true_values=("true", "1", "yes", "y"), false_values=("false", "0", "no", "n"), casefold=True, trim=True):
    norm = (lambda x: x.lower()) if casefold else (lambda x: x)
    yes, no = {norm(x) for x in true_values}, {norm(x) for x in false_values}
    if yes & no:
        raise ValueError(f"values both true and false: {sorted(yes & no)}")
    s = text.strip(c) if trim else c
    s = F.lower(s) if casefold else s
    v = F.when(s.isin(*sorted(yes)), True).when(s.isin(*sorted(no)), False)
    return Value(v, _fail(v.isNull() & ~text.blank(c), "unknown truth value"))


@_put("int_if_digits")
def _int_if_digits(c):
    """Digits lose leading zeros; other text stays. The type remains string."""
    s = text.strip(c.cast("string"))
    return F.when(s.rlike(r"^\d+$"), s.try_cast("decimal(38,0)").cast("string")).otherwise(text.empty_to_null(s))


@_put("coerce")
def _coerce(c, kind="string"):
    """Value of a target type; blank is null, what does not fit is an error."""
    s = text.strip(c.cast("string"))
    if kind == "bool":
        t = F.lower(s)
        v = F.when(t.isin("1", "true", "yes", "y"), True).when(t.isin("0", "false", "no", "n"), False)
    elif kind in ("int", "float"):
        v = s.try_cast("bigint" if kind == "int" else "double")
    else:
        return Value(F.when(~text.blank(s), s))
    return Value(v, _fail(v.isNull() & ~text.blank(s), f"not of type {kind}"))


# Null handling, constants, maps

_put("copy", lambda c: c)
_put("const", lambda c, value=None: F.lit(value))
_put("coalesce", lambda c, default=None: F.coalesce(F.get(F.filter(c, lambda x: ~text.blank(x)), F.lit(0)), F.lit(default).cast("string")))


@_put("pick_when_blank")
def _pick_when_blank(c, guard_index=0, value_index=1, else_value=None):
    return F.when(text.blank(F.get(c, F.lit(guard_index))), F.get(c, F.lit(value_index))).otherwise(F.lit(else_value).cast("string"))


@_put("map_dict")
def _map_dict(c, mapping, casefold=False):
    """Small constant mappings; large ones are a dictionary lookup (a join)."""
    pairs = {(k.lower() if casefold else k): v for k, v in mapping.items()}
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.try_element_at(table, F.lower(c) if casefold else c)


@_put("build_delimited_key")
def _build_delimited_key(c, sep="|", strict=False):
    parts = F.transform(c, text.strip)
    key = F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), sep)
    return Value(key, _fail(F.exists(c, text.blank), "blank key part") if strict else None)


_put("build_link_keys", lambda c, field="", link_type="": F.create_map(F.lit(field), F.create_map(F.lit(link_type), c)))
_put("equals", lambda c: F.get(c, F.lit(0)).eqNullSafe(F.get(c, F.lit(1))))


@_put("parse_kv_pairs")
def _parse_kv_pairs(c, sep=";", kv_sep="=", keys=()):
    """``a=1;b=2`` as a struct of the keys asked for; the last of a key wins; no pair at all gives null."""
    pairs = F.filter(F.split(c, re.escape(sep), -1), lambda x: F.contains(x, F.lit(kv_sep)))

    def split(x):
        k = F.substring_index(x, kv_sep, 1)
        return F.struct(F.lower(text.strip(k)).alias("k"), text.strip(F.substring(x, F.length(k) + 1 + len(kv_sep), F.length(x))).alias("v"))

    found = F.transform(pairs, split)

    def last(key):
        return F.try_element_at(F.filter(found, lambda p: p["k"] == key.lower()), F.lit(-1))["v"]

    return F.when(F.size(found) > 0, F.struct(*[last(k).alias(k) for k in keys]))


@_put("extract_patterns")
def _extract_patterns(c, patterns, split_pattern=r"\s+", keyed_prefixes=()):
    """Tokens by pattern: the last one with a key prefix, else the first plain one."""
    tokens = F.filter(F.flatten(F.transform(c, lambda x: F.split(x, split_pattern, -1))), lambda x: x != "")

    def keyed(x):
        rest = [F.when(F.startswith(F.lower(x), F.lit(p.lower())), F.substring(x, len(p) + 1, 2**31 - 1)) for p in keyed_prefixes]
        return F.coalesce(*rest) if rest else F.lit(None).cast("string")

    def best(pattern):
        p = java_regex(pattern, full=True)
        with_key = F.filter(F.transform(tokens, keyed), lambda x: x.rlike(p))
        return F.coalesce(F.try_element_at(with_key, F.lit(-1)), F.get(F.filter(tokens, lambda x: x.rlike(p)), F.lit(0)))

    return F.struct(*[best(p).alias(n) for n, p in patterns.items()])


# Arrays

_put("first", lambda c: F.get(c, F.lit(0)), sequence=True)
_put("last", lambda c: F.try_element_at(c, F.lit(-1)), sequence=True)
_put("at", lambda c, index=0: F.get(c, F.lit(index)) if index >= 0 else F.try_element_at(c, F.lit(index)), sequence=True)
_put("compact", lambda c: F.coalesce(F.filter(c, lambda x: ~text.blank(x.cast("string"))), F.array()), sequence=True)
_put("unique", lambda c: F.coalesce(F.array_distinct(c), F.array()), sequence=True)
_put("count", lambda c: F.when(c.isNull(), 0).otherwise(F.size(c)), sequence=True)


@_put("map_each")
def _map_each(c, ops):
    """A chain on each element; one failing element fails the operation."""

    def run(x):
        v, err = x, F.lit(None).cast("string")
        for call in ops:
            out = OPS.apply(call, v)
            v, err = out.value, err if out.error is None else F.coalesce(err, out.error)
        return v, err

    failed = F.exists(c, lambda x: run(x)[1].isNotNull())
    return Value(F.transform(c, lambda x: run(x)[0]), _fail(failed, "an element failed"))


_put("filter_regex", lambda c, pattern, flags="", full=False: F.filter(c, lambda x: x.rlike(java_regex(pattern, flags, full))))
_put("reject_regex", lambda c, pattern, flags="", full=False: F.filter(c, lambda x: ~x.rlike(java_regex(pattern, flags, full))))


# Generated values: derived from a row's key, so that a recomputed task agrees with the first


def _digest(seed: str, key: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256)


@_put("uuid")
def _uuid(c, key="record_id", seed="", only_blank=False):
    h = _digest(f"uuid{seed}", key)
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    made = F.concat(parts[0], F.lit("-"), parts[1], F.lit("-4"), parts[2], F.lit("-a"), parts[3], F.lit("-"), parts[4])
    return F.when(~text.blank(c), c).otherwise(made) if only_blank else made


_put("default_prefixed_uuid", lambda c, prefix="", key="record_id", seed="": F.when(~text.blank(c), c).otherwise(F.concat(F.lit(prefix), F.substring(_digest(f"prefix{seed}", key), 1, 8))))


@_put("default_password")
def _default_password(c, salt, key="record_id"):
    h = _digest(f"password{salt}", key)
    letter = F.substring(F.lit("abcdef"), (F.ascii(F.substring(h, 64, 1)) % 6) + 1, F.lit(1))
    return F.when(~text.blank(c), c).otherwise(F.concat(letter, F.substring(h, 1, 32)))


@_put("random_digits")
def _random_digits(c, length=6, key="record_id", seed=""):
    if length <= 0:
        return Value(c, F.lit("length must be positive"))
    blocks = -(-length // 9)
    made = [F.lpad((F.conv(F.substring(_digest(f"digits{seed}{i}", key), 1, 12), 16, 10).cast("bigint") % 1_000_000_000).cast("string"), 9, "0") for i in range(blocks)]
    return F.substring(F.concat(*made), 1, length)


def fingerprint(fields: dict[str, Column]) -> Column:
    """Content hash of named values, by name; equal content has equal hashes."""
    names = sorted(fields)
    return F.sha2(F.to_json(F.struct(*[fields[n].alias(n) for n in names]), {"ignoreNullFields": "false"}), 256)


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds, F.lit(False))


def all_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds, F.lit(True))
