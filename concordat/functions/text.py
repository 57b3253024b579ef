"""Text primitives as Columns. White space is that of Python's ``str.split``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"(?U)[\s\x1c-\x1f]+"
EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def strip(c: Column) -> Column:
    """White space of any kind off both ends (``trim`` knows only U+0020)."""
    return F.regexp_replace(c, EDGES, "")


def blank(c: Column) -> Column:
    """Null, empty, or white space only."""
    return c.isNull() | ~c.rlike(r"(?U)[^\s\x1c-\x1f]")


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def collapse(c: Column) -> Column:
    """Runs of white space become one space, ends are stripped; '' stays ''."""
    return F.trim(F.regexp_replace(c, WS, " "))


# The dotless i folds to itself, and what stands for it meanwhile.
_KEPT, _SPARE = "ı", "\ue000"


def casefold(c: Column) -> Column:
    """Full Unicode case folding without Python: lower, upper and lower case again.

    The final sigma folds to the plain one. Cherokee, whose folding is upper case,
    comes out in lower case on both sides of a comparison.
    """
    # Spark drops the inner one of two case functions that follow each other: something stands between them.
    upper = F.upper(F.translate(F.lower(c), _KEPT, _SPARE))
    return F.translate(F.lower(F.translate(upper, "ϴ", "Θ")), "ς" + _SPARE, "σ" + _KEPT)


def compare_form(c: Column) -> Column:
    """Form in which texts are compared: collapsed, case-folded, null as ''."""
    return casefold(collapse(F.coalesce(c, F.lit(""))))


def shorten(c: Column, limit: int) -> Column:
    """Texts longer than ``limit`` are cut to it; with room for more than three dots they end in these."""
    dots = "..." if limit > 3 else ""
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(max(limit - len(dots), 0))), F.lit(dots))).otherwise(c)


def key_digest(c: Column, salt: str = "", length: int = 12) -> Column:
    """First hex digits of a salted SHA-256: stands for a key in logs."""
    return F.substring(F.sha2(F.concat(F.lit(salt), c), 256), 1, length)


def percent_bucket(c: Column) -> Column:
    """Bucket 0..99 of a key, for sampling by key."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("bigint") % 100


def canonical_segments(arr: Column, steps: list[tuple], drop_blank: bool = False) -> Column:
    """Path segments in canonical form: steps are ('trim',), ('lower',) or ('replace', pattern, text)."""

    def one(x: Column) -> Column:
        x = F.coalesce(x, F.lit(""))
        for kind, *args in steps:
            x = collapse(x) if kind == "trim" else F.lower(x) if kind == "lower" else F.regexp_replace(x, *args)
        return x

    out = F.transform(arr, one)
    return F.filter(out, lambda x: ~blank(x)) if drop_blank else out


def canonical_scalar(c: Column, steps: list[tuple], drop_blank: bool = False) -> Column:
    """One segment; '' when it was dropped."""
    return F.coalesce(F.get(canonical_segments(F.array(c), steps, drop_blank), F.lit(0)), F.lit(""))


def title(c: Column) -> Column:
    """Each run of letters that have a case begins with a capital and goes on in small ones, as in O'Neil."""
    runs = F.regexp_extract_all(c, F.lit(r"[\p{IsLowercase}\p{IsUppercase}\p{Lt}]+|[^\p{IsLowercase}\p{IsUppercase}\p{Lt}]+"), F.lit(0))

    def one(x: Column) -> Column:
        # A letter whose capital is several (as of a ligature) keeps the first of them large.
        head = F.upper(F.substring(x, 1, 1))
        large = F.when(F.char_length(head) > 1, F.concat(F.substring(head, 1, 1), F.lower(F.substring(head, 2, 9)))).otherwise(F.initcap(F.substring(x, 1, 1)))
        return F.concat(large, F.lower(F.substring(x, 2, 1 << 30)))

    return F.array_join(F.transform(runs, one), "")
