"""What each filter of a corpus adds to the others, in every order of applying them.

Five filters; a text fails: A with under 50 words, B if under 65 % of its words
are distinct, C if over 5 % of its characters are capitals A-Z, D if it holds one
of ``#$%&*|``, E if a row with a smaller doc_id has the same text.

Duplicates: a counting Bloom prepass. Tasks count the hashes of their texts in
sparse counters, which saturate at two; Spark adds these up by stretch, and what
remains is a bitmap of the counters that reached two. A text one of whose
counters did not is surely unique; only the others, possible repeats, shuffle
with their whole text, for the least doc_id of each. The sketch has at least
``COUNTERS`` counters a row, in slices by hash of at most ``SLICE`` rows each: a
slice's bitmap, which is broadcast, is bounded, and their number follows the
input (with several slices, texts are written once, sorted by slice within their
tasks). Tasks combine the copies of a text before it is shuffled.

Counts: each row is a mask of the filters it fails. Rows, and those of good and
of toxic label, are counted by part and mask, at most 32 rows a part; whatever
order, step or filter is asked for is a sum of these counts.

Null text counts as empty, a null part as the empty text. A null doc_id is no
smaller and no larger than another, so that its row fails no E, and has no
label. Rows that repeat doc_id and text do not fail E on each other's account.
Labels that repeat a doc_id count once, 1 if any is. Other columns are not read
and may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.llm.common import prepare, utf8
from concordat.session import materialize

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT = 50, 65, 5
#: Counters of the sketch a row, at least; rows of a slice, at most (a bitmap of 64 MB); counters of a stretch, which is a row of the merge.
COUNTERS, SLICE, STRETCH = 8, 1 << 26, 1 << 16
PROBES = 3

_NOT_CAPITAL = bytes(c for c in range(256) if not 65 <= c <= 90)
_ODD = set(b"#$%&*|")
_PLAIN = bytes(c for c in range(256) if c not in _ODD)
_CONTINUED = bytes(range(0x80, 0xC0))


def text_mask(text: str | None) -> int:
    """Bits of the filters A to D that a text fails."""
    data = utf8(text)
    words = data.split()  # ASCII white space only, as the filters' words have it
    n = len(words)
    out = int(n < MIN_WORDS)
    out |= (100 * len(set(words)) < DISTINCT_PERCENT * n) << 1
    out |= (100 * len(data.translate(None, _NOT_CAPITAL)) > CAPITALS_PERCENT * len(data.translate(None, _CONTINUED))) << 2
    return out | bool(data.translate(None, _PLAIN)) << 3


def flagged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, mask, h, g) of each row: filters A to D that it fails, and two hashes of its text."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            masks = pa.array([text_mask(x) for x in b.column(4).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), masks, b.column(2), b.column(3)], names=["doc_id", "part", "mask", "h", "g"])

    return _picked(docs, id_col, text_col, part_col).select("doc_id", "part", "h", "g", "text").mapInArrow(run, "doc_id long, part string, mask int, h long, g long")


def _picked(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    cols = (F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return docs.select(*cols).withColumns({"h": F.xxhash64("text"), "g": F.xxhash64(F.lit(1), "text")})


def probes(h: np.ndarray, g: np.ndarray, size: int) -> np.ndarray:
    """Counters of texts with hashes ``h`` and ``g``: one row a probe; ``size`` is a power of two."""
    h, g = h.astype(np.int64).view(np.uint64), g.astype(np.int64).view(np.uint64) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([(h + g * np.uint64(k) >> np.uint64(8)) & np.uint64(size - 1) for k in range(PROBES)]).astype(np.int64)


def sketch_size(rows: int) -> int:
    """Counters for so many rows: a power of two, ``COUNTERS`` a row or more."""
    return max(STRETCH, 1 << (COUNTERS * max(rows, 1) - 1).bit_length())


def repeat_bits(rows: DataFrame, size: int) -> np.ndarray:
    """Which counters of the merged sketch of (h, g) rows reach two: a bitmap of ``size`` bits, eight a byte."""

    def count(batches):
        held, n = [], 0

        def merged():
            at, many = np.unique(np.concatenate(held), return_counts=True)
            stretch = at // STRETCH
            cuts = np.flatnonzero(np.r_[True, stretch[1:] != stretch[:-1]])
            ends = [*cuts[1:].tolist(), len(at)]
            where, many = (at % STRETCH).astype(np.uint16), np.minimum(many, 2).astype(np.uint8)
            found = [(int(stretch[a]), where[a:b].tobytes(), many[a:b].tobytes()) for a, b in zip(cuts.tolist(), ends)]
            for i in range(0, len(found), 1000):
                s, w, m = zip(*found[i : i + 1000])
                yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(w, pa.binary()), pa.array(m, pa.binary())], names=["stretch", "at", "n"])

        for b in batches:
            held.append(probes(b.column(0).to_numpy(), b.column(1).to_numpy(), size).ravel())
            n += len(held[-1])
            if n > 4_000_000:
                yield from merged()
                held, n = [], 0
        if held:
            yield from merged()

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        counters = np.zeros(STRETCH, np.uint8)
        for at, n in zip(pdf["at"], pdf["n"]):
            at = np.frombuffer(at, np.uint16)
            counters[at] = np.minimum(counters[at] + np.frombuffer(n, np.uint8), 2)
        return pd.DataFrame({"stretch": [pdf["stretch"].iloc[0]], "bits": [np.packbits(counters > 1).tobytes()]})

    sparse = rows.select("h", "g").mapInArrow(count, "stretch int, at binary, n binary")
    out = np.zeros(size // 8, np.uint8)
    for r in sparse.groupBy("stretch").applyInPandas(total, "stretch int, bits binary").toLocalIterator():
        out[r.stretch * STRETCH // 8 : (r.stretch + 1) * STRETCH // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def may_repeat(spark, bits: np.ndarray) -> Column:
    """Can the text with hashes ``h`` and ``g`` occur twice? The bitmap is bounded by ``SLICE``."""
    shared, size = spark.sparkContext.broadcast(bits), len(bits) * 8

    def test(h: pd.Series, g: pd.Series) -> pd.Series:
        at = probes(h.to_numpy(), g.to_numpy(), size)
        return pd.Series((shared.value[at >> 3] >> (7 - (at & 7)) & 1).all(axis=0))

    return F.pandas_udf(test, "boolean")("h", "g")


def failed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", slice_rows: int = SLICE) -> DataFrame:
    """(doc_id, part, mask) of each row: all five filters that it fails."""
    spark = docs.sparkSession
    rows = materialize(flagged(docs, id_col, text_col, part_col), "flags")
    n = rows.count()
    slices = max(1, -(-n // slice_rows))
    slice_ = F.pmod("g", F.lit(slices))
    texts = _picked(docs, id_col, text_col, part_col).select("doc_id", "text", "h", "g")
    if slices > 1:
        # Sorted within its tasks, so that a slice reads little but its own row groups.
        texts = materialize(texts.withColumn("slice", slice_).sortWithinPartitions("slice"), "texts-by-slice")
    else:
        texts = texts.withColumn("slice", F.lit(0))
    out = None
    for s in range(slices):
        mine = rows.where(slice_ == s)
        maybe = may_repeat(spark, repeat_bits(mine, sketch_size(-(-n // slices))))
        firsts = texts.where(F.col("slice") == s).where(maybe).groupBy("text", "h", "g").agg(F.min("doc_id").alias("doc_id"))
        firsts = materialize(firsts.select("doc_id", "h", "g", F.lit(True).alias("first")).where("doc_id is not null"), "first-ids")
        marked = mine.withColumn("maybe", maybe & F.col("doc_id").isNotNull())
        repeated = marked.where("maybe").join(firsts, ["doc_id", "h", "g"], "left")
        e = F.when(F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
        both = repeated.select("doc_id", "part", (F.col("mask") + e).alias("mask")).unionByName(marked.where("not maybe").select("doc_id", "part", "mask"))
        out = both if out is None else out.unionByName(both)
    return out


def mask_counts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): rows of each part and mask, and those of them labelled good and toxic."""
    one = lambda c: F.max((F.col(c) == 1).cast("long"))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    told = rows.where("doc_id is not null").join(known, "doc_id", "left").select("part", "mask", "good", "toxic")
    bare = rows.where("doc_id is null").select("part", "mask", F.lit(None).cast("long").alias("good"), F.lit(None).cast("long").alias("toxic"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return told.unionByName(bare).groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), total("good"), total("toxic"))


def _shares() -> tuple[list[str], list[int], dict[str, np.ndarray]]:
    """Orders and steps of all result rows, and for each count which masks add to it: arrays of masks by rows."""
    masks = np.arange(1 << len(FILTERS))
    orders, steps, cols = [], [], {"kept": [], "removed": [], "redundant": [], "unique_fails": []}
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order):
            fails, met = masks >> f & 1, (masks & before) != 0
            orders.append("".join(FILTERS[i] for i in order))
            steps.append(step + 1)
            cols["removed"].append(fails * ~met)
            cols["redundant"].append(fails * met)
            cols["unique_fails"].append(masks == 1 << f)
            before |= 1 << f
            cols["kept"].append((masks & before) == 0)
    out = {k: np.array(v).astype(np.int64).T for k, v in cols.items()}
    last = np.array([o[s - 1] for o, s in zip(orders, steps)])
    # A filter's removed, summed over all its places in all orders.
    out["shapley"] = np.stack([out["removed"][:, last == f].sum(axis=1) for f in last], axis=1)
    return orders, steps, out


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", slice_rows: int = SLICE) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows a part."""
    counts = mask_counts(failed(docs, id_col, text_col, part_col, slice_rows), labels)
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # at most 32
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def expand(batches):
        orders, steps, shares = _shares()
        for b in batches:
            for part, masks in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n, good, toxic = np.zeros((3, 1 << len(FILTERS)), np.int64)
                for m in masks:
                    n[m["mask"]], good[m["mask"]], toxic[m["mask"]] = m["n"], m["good"], m["toxic"]
                of = {k: n @ v for k, v in shares.items()} | {"good_lost": good @ shares["removed"], "toxic_lost": toxic @ shares["removed"]}
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(orders), pa.string()), pa.array(orders), pa.array(steps, pa.int32()), *[pa.array(of[c]) for c in names]], names=["part", "filter_order", "step", *names])

    return parts.mapInArrow(expand, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in names))
