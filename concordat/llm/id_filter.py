"""A fixed-size bitmap of ids: tells which rows surely are not in a set before their texts are moved.

No false negatives; false positives grow with the set and cost only the shuffle
that there would be without the filter. Rows that pass still meet the exact set
in a join. The bitmap is ``2 ** BITS`` bits (4 MB) whatever the input.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.llm.common import prepare
from concordat.session import materialize

BITS, SLICES = 25, 16


def _places(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(64 - BITS)).astype(np.int64)


def build(ids: DataFrame, within=None) -> np.ndarray:
    """Bitmap of a one-column frame of long ids. Tasks fill their own, slices are joined in Spark.

    ``within``: a broadcast bitmap; ids that it surely does not hold are left out.
    """
    prepare(ids.sparkSession)
    kinds = "slice int, bits binary"
    schema = pa.schema([("slice", pa.int32()), ("bits", pa.binary())])

    def fill(batches):
        bits = np.zeros(1 << (BITS - 3), np.uint8)
        for b in batches:
            own = b.column(0).drop_null()
            if within is not None:
                own = own.filter(pa.array(may_hold(within.value, own)))
            at = _places(own.to_numpy(zero_copy_only=False))
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        parts = [(i, p) for i, p in enumerate(np.split(bits, SLICES)) if p.any()]
        yield pa.RecordBatch.from_pydict({"slice": [i for i, _ in parts], "bits": [zlib.compress(p.tobytes(), 1) for _, p in parts]}, schema=schema)

    def join(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(zlib.decompress(c), np.uint8)
                total[i] = total[i] | x if i in total else x
        yield pa.RecordBatch.from_pydict({"slice": list(total), "bits": [zlib.compress(x.tobytes(), 1) for x in total.values()]}, schema=schema)

    out = np.zeros((SLICES, (1 << (BITS - 3)) // SLICES), np.uint8)
    for r in ids.mapInArrow(fill, kinds).repartition(SLICES, "slice").mapInArrow(join, kinds).collect():
        out[r["slice"]] |= np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return out.reshape(-1)


def may_hold(bits: np.ndarray, ids: pa.Array) -> np.ndarray:
    """For each id (no nulls): could it be in the set?"""
    at = _places(ids.to_numpy(zero_copy_only=False))
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def split(df: DataFrame, id_col: str, *held) -> tuple[DataFrame, DataFrame]:
    """(rows surely not in the first set, rows that may be in all of them), all columns, by broadcast bitmaps; null ids are in none."""
    prepare(df.sparkSession)
    at = df.columns.index(id_col)

    def pick(first: bool):
        def run(batches):
            for b in batches:
                ids = b.column(at).cast(pa.int64())
                known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0)
                hits = [may_hold(x.value, ids) & known for x in held]
                yield b.filter(pa.array(~hits[0] if first else np.logical_and.reduce(hits), pa.bool_()))

        return df.mapInArrow(run, df.schema)

    return pick(True), pick(False)


def without(df: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``df`` whose id is not in ``gone`` (one column ``id``), null ids included.

    A second bitmap holds the ids of ``df`` that the first takes for gone but
    that are not: a row that hits the first only is gone for sure and dropped
    where it is. Only rows that hit both, few beside those that go, are shuffled.
    """
    sc = df.sparkSession.sparkContext
    first = sc.broadcast(build(gone))
    flagged = split(df.select(df[id_col].cast("long").alias("id")), "id", first)[1]
    spared = materialize(flagged.distinct().join(gone, "id", "left_anti"), "spared")
    clear, both = split(df, id_col, first, sc.broadcast(build(spared)))
    both = both.alias("d")
    return clear.unionByName(both.join(gone.alias("g"), F.col(f"d.`{id_col}`") == F.col("g.id"), "left_anti"))
