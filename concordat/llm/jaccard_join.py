"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact intersection.

A text's set holds the distinct ``k``-word shingles (64-bit fingerprints of
lower-cased words; a text of fewer words is one shingle as a whole), so that
results are exact up to collisions of 64 bits. Two sets link when their Jaccard
similarity is at least ``p / q``.

1. One pass gives each row its set's size, 128-bit key and two least elements
   under different hashes, and fills a sketch of shingle frequencies of fixed
   size. Rows with equal sets are one node from here on (the least id stands for
   them).
2. Nodes that share a least element are paired with one pivot of that group and
   the pair is checked exactly: most groups of near copies are components now.
3. A node's shingles are put in one global order, rare ones first (by the
   sketch, then by value: any total order is exact). Linked sets share a
   shingle among the first ``n - ceil(n p / q) + 1``. With a size band (powers
   of two; a set near the lower edge also visits the band below) these make its
   tile keys. Keys are counted packed, some four bytes each; what more than one
   node has is marked in a bitmap of fixed size, and only rows of marked keys
   move (false marks cost a shuffle, never a link).
4. Tiles that still hold several components are the ones to search. A pair must
   pass the size bound, the positional bound, and the bitmap bound: signatures
   are 128-bit parities, so the popcount of their xor never exceeds the symmetric
   difference, which bounds the overlap from above. Sets are tried with ``HEADS``
   sets of each tile first; then all pairs across components that a signature of
   ``WIDE`` bits cannot rule out are made and checked on sorted arrays, so that no
   link between components is lost. A group of n near copies costs some n pairs.

Null and empty texts have the empty set and link with nothing. Rows that repeat
an id are one document that has the links of all of them; a null id links with
nothing and has a null component. Only the id and text columns are read. An
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.llm import id_filter
from concordat.llm.common import prepare, utf8
from concordat.llm.components import connected_components
from concordat.session import materialize

#: Counters of the frequency sketch: 4 MB, whatever the input, kept in slices.
SKETCH_BITS, SLICES = 20, 16
#: Bits of the bitmap of tile keys (16 MB), of the keys that are counted, and keys of a counting task.
MARK_BITS, KEY_BITS, KEYS_A_TASK = 27, 40, 400_000
#: Keys a task holds before it counts and packs them.
FLUSH = 500_000
#: Bits of the signatures that rows still apart get, and sets of a tile they are tried with before.
WIDE, HEADS = 1024, 8


@dataclass(frozen=True)
class Params:
    k: int = 3
    p: int = 90
    q: int = 100


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct shingle fingerprints (uint64)."""
    # bytes.lower() and bytes.split() know ASCII only: A-Z, and \x20 \x09-\x0D.
    ws = utf8(text).lower().split()
    n = len(ws)
    if n < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(ws), seed=n)], np.uint64) if n else np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, n)
    x = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        x = (x + h[i : n - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return np.unique(x * np.uint64(0xBF58476D1CE4E5B9))


def bucket(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def signature(s: np.ndarray, bits: int, shift: int) -> np.ndarray:
    """Parities of a set's elements by hashed place, as 64-bit words."""
    at = (s >> np.uint64(shift)).astype(np.int64) & (bits - 1)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def _picked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def _least(s: np.ndarray) -> tuple[int, int]:
    """Least elements of a set that is not empty, under two hashes."""
    x = s * np.uint64(0x9E3779B97F4A7C15)
    return int(s[0].view(np.int64)), int((x ^ (x >> np.uint64(31))).min().view(np.int64))


def _sized(docs: DataFrame, k: int) -> DataFrame:
    """Rows (id, n, k1, k2, m1, m2), and with ``slice`` set each task's part of the frequency sketch."""
    prepare(docs.sparkSession)
    names = ["id", "n", "k1", "k2", "m1", "m2"]
    schema = pa.schema([(c, pa.int64()) for c in names] + [("slice", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for b in batches:
            out = {"id": b.column(0)} | {c: [] for c in names[1:]} | {"slice": pa.nulls(b.num_rows, pa.int32()), "counts": pa.nulls(b.num_rows, pa.binary())}
            for text in b.column(1).to_pylist():
                s = shingle_set(text, k)
                np.add.at(total, bucket(s), 1)
                key = xxhash.xxh3_128_digest(s.tobytes())
                halves = (int.from_bytes(x, "little", signed=True) for x in (key[:8], key[8:]))
                for c, v in zip(names[1:], (len(s), *halves, *(_least(s) if len(s) else (0, 0)))):
                    out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=schema)
        parts = [(i, p) for i, p in enumerate(np.split(total, SLICES)) if p.any()]
        none = {c: pa.nulls(len(parts), pa.int64()) for c in names}
        yield pa.RecordBatch.from_pydict(none | {"slice": [i for i, _ in parts], "counts": [zlib.compress(p.tobytes(), 1) for _, p in parts]}, schema=schema)

    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in names) + ", slice int, counts binary")


def _sketch(parts: DataFrame) -> np.ndarray:
    """Sum of the tasks' sketches: one array of fixed size. A slice's parts are added up as they stream by."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(zlib.decompress(c), np.uint32)
                total[i] = total[i] + x if i in total else x.astype(np.uint64)
        schema = pa.schema([("slice", pa.int32()), ("total", pa.binary())])
        yield pa.RecordBatch.from_pydict({"slice": list(total), "total": [zlib.compress(x.tobytes(), 1) for x in total.values()]}, schema=schema)

    out = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.uint64)
    for r in parts.select("slice", "counts").repartition(SLICES, "slice").mapInArrow(add, "slice int, total binary").collect():
        out[r["slice"]] += np.frombuffer(zlib.decompress(r["total"]), np.uint64)
    return np.minimum(out.reshape(-1), np.iinfo(np.uint32).max).astype(np.uint32)


def _nodes(texts: DataFrame, reps: DataFrame, copies: DataFrame):
    """A function ``over(fn, ddl)``: ``mapInArrow`` over the (id, text) of rows whose id stands for a node.

    Two bitmaps decide nearly all rows in place: of ids that are copies, and of
    nodes that the first one takes for copies. Only rows that hit both move.
    """
    spark = texts.sparkSession
    prepare(spark)
    twice = spark.sparkContext.broadcast(id_filter.build(copies))

    def hits(bits, batches, want=True):
        for b in batches:
            yield b.filter(pa.array(id_filter.may_hold(bits.value, b.column(0)) == want))

    both = spark.sparkContext.broadcast(id_filter.build(reps, within=twice))
    moved = texts.mapInArrow(lambda batches: hits(both, hits(twice, batches)), "id long, text string").join(reps, "id", "left_semi")
    moved = materialize(moved, "nodes")

    def over(fn, ddl: str) -> DataFrame:
        return texts.mapInArrow(lambda batches: fn(hits(twice, batches, False)), ddl).unionByName(moved.mapInArrow(fn, ddl))

    return over


class Prefixes:
    """Tile keys of texts: hashes of a prefix shingle with a size band."""

    def __init__(self, freq: np.ndarray, params: Params):
        self.freq, self.params = freq, params

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
        """(set, keys by position, how many bands: 1, or 2 with the keys of the band below after the own ones)."""
        k, p, q = self.params.k, self.params.p, self.params.q
        s = shingle_set(text, k)
        n = len(s)
        if not n:
            return s, s, 1
        need = -(-p * n // q)  # ceil(n p / q): the least size that may link, and the least overlap with it
        # s is sorted, so a stable sort breaks ties by value.
        tokens = s[np.argsort(self.freq[bucket(s)], kind="stable")[: n - need + 1]]
        bands = [n.bit_length()] if need.bit_length() == n.bit_length() else [n.bit_length(), n.bit_length() - 1]
        x = [(tokens ^ np.uint64(0x632BE59BD9B4E019 * b & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9FB21C651E98DF25) for b in bands]
        x = np.concatenate(x)
        return s, (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93), len(bands)


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte planes apart, so that the high zero bytes vanish."""
    return zlib.compress(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _marks(over, sketch, rows: int, params: Params) -> np.ndarray:
    """Bitmap of the tile keys that two nodes or more have. ``rows``: how many keys there are, about.

    A task packs its distinct keys by range, so that a key sends one entry a task
    however many of its texts have it; a range's bits are one slice of the bitmap.
    """
    ranges = min(20, max(5, (rows // KEYS_A_TASK).bit_length()))
    schema = pa.schema([("range", pa.int32()), ("once", pa.binary()), ("more", pa.binary())])

    def count(batches):
        pre, held, size = Prefixes(sketch.value, params), [], 0

        def flush():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(keys >> np.uint64(KEY_BITS - ranges), np.arange(1, 1 << ranges).astype(np.uint64))
            parts = [(i, k[c == 1], k[c > 1]) for i, (k, c) in enumerate(zip(np.split(keys, cuts), np.split(n, cuts))) if len(k)]
            return pa.RecordBatch.from_pydict({"range": [i for i, _, _ in parts], "once": [_pack(x) for _, x, _ in parts], "more": [_pack(y) for _, _, y in parts]}, schema=schema)

        for b in batches:
            for text in b.column(1).to_pylist():
                keys = pre.of(text)[1] >> np.uint64(64 - KEY_BITS)
                held.append(keys)
                size += len(keys)
                if size > FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def mark(batches):
        once, more = defaultdict(list), defaultdict(list)
        for b in batches:
            for i, x, y in zip(*(b.column(c).to_pylist() for c in range(3))):
                once[i].append(x)
                more[i].append(y)
        for i in once:
            keys = np.sort(np.concatenate([_unpack(x) for x in once[i]]))
            several = [np.unique(_unpack(y)) for y in more[i]]
            # Seen by two tasks, or twice by one, or once by one and more often by another.
            shared = np.concatenate([keys[1:][keys[1:] == keys[:-1]], *several])
            bits = np.zeros(1 << (MARK_BITS - ranges), np.uint8)
            bits[(shared >> np.uint64(KEY_BITS - MARK_BITS)).astype(np.int64) & ((1 << (MARK_BITS - ranges)) - 1)] = 1
            yield pa.RecordBatch.from_pydict({"range": [i], "bits": [zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)]}, schema=pa.schema([("range", pa.int32()), ("bits", pa.binary())]))

    counted = over(count, "range int, once binary, more binary").repartition(1 << ranges, "range").mapInArrow(mark, "range int, bits binary")
    out = np.zeros((1 << ranges, (1 << MARK_BITS) // 8 >> ranges), np.uint8)
    for r in counted.collect():  # 16 MB in all
        out[r["range"]] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return out.reshape(-1)


def _tile_rows(over, sketch, marked, params: Params) -> DataFrame:
    """(key, home, id, n, pos, s0, s1) of each node's marked keys, with its signature."""
    schema = pa.schema([("key", pa.int64()), ("home", pa.bool_()), ("id", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("s0", pa.int64()), ("s1", pa.int64())])

    def run(batches):
        pre, bits = Prefixes(sketch.value, params), marked.value
        for b in batches:
            cols: list[list[np.ndarray]] = [[] for _ in schema]
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s, keys, bands = pre.of(text)
                at = (keys >> np.uint64(64 - MARK_BITS)).astype(np.int64)
                at = np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)
                if len(at):
                    each = len(keys) // bands
                    for c, v in zip(cols, (keys[at].view(np.int64), at < each, i, len(s), at % each, *signature(s, 128, 9))):
                        c.append(np.broadcast_to(v, len(at)))
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)).cast(t.type) for c, t in zip(cols, schema)], schema=schema)

    return over(run, "key long, home boolean, id long, n int, pos int, s0 long, s1 long")


def _may_link(a: dict[str, Column], b: dict[str, Column], params: Params) -> Column:
    """Size, positional and bitmap bounds, all in whole numbers."""
    p, q = params.p, params.q
    size = a["n"].cast("long") + b["n"]
    differing = F.bit_count(a["s0"].bitwiseXOR(b["s0"])) + F.bit_count(a["s1"].bitwiseXOR(b["s1"]))
    return (
        (F.least(a["n"], b["n"]) * F.lit(q) >= F.greatest(a["n"], b["n"]) * F.lit(p))
        & (F.least(a["n"] - a["pos"], b["n"] - b["pos"]) * F.lit(p + q) >= size * p)
        & (size * F.lit(q - p) >= differing * F.lit(p + q))
    )


def _verified(pairs: DataFrame, texts: DataFrame, params: Params) -> DataFrame:
    """Pairs (a, b) whose sets are similar enough, by exact intersection of sorted arrays.

    Texts move, not sets: they are less than half as large. Those of rows that may
    be needed are written once and joined from there.
    """
    k, p, q = params.k, params.p, params.q
    need = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    wanted = texts.sparkSession.sparkContext.broadcast(id_filter.build(need))

    def pick(batches):
        for b in batches:
            yield b.filter(pa.array(id_filter.may_hold(wanted.value, b.column(0))))

    def run(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        known: dict[int, tuple[str, np.ndarray]] = {}

        def cut(i: int, text: str | None) -> np.ndarray:
            """A set; the last one of an id is remembered, since a pivot meets many."""
            if i not in known or known[i][0] != text:
                if len(known) >= 64:
                    known.clear()
                known[i] = text, shingle_set(text, k)
            return known[i][1]

        for x in batches:
            keep = []
            for i, j, one, two in zip(*(x.column(c).to_pylist() for c in range(4))):
                s, t = cut(i, one), cut(j, two)
                at = np.searchsorted(t, s)
                at[at == len(t)] = 0
                both = int((t[at] == s).sum()) if len(t) else 0
                keep.append(q * both >= p * (len(s) + len(t) - both))
            x = x.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], schema=schema)

    some = materialize(texts.mapInArrow(pick, "id long, text string"), "texts")
    joined = pairs.join(some.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(some.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return joined.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


def _columns(prefix: str = "") -> dict[str, Column]:
    return {c: F.col(prefix + c) for c in ("n", "pos", "s0", "s1")}


def _stars(parts: DataFrame) -> DataFrame:
    """What is connected already, as one edge a node."""
    return parts.select(F.col("id").alias("a"), F.col("component").alias("b")).where("a <> b")


def _mixed(tiles: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows of the tiles that hold several components, with ``comp`` and the tile's ``top``, that of some row of it."""
    rows = materialize(tiles.join(parts, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component"), "tiles")
    about = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.struct(F.xxhash64("id"), "comp"))["comp"].alias("top"))
    return materialize(rows.join(about.where("lo <> hi").select("key", "top"), "key"), "mixed")


def _heads(left: DataFrame) -> DataFrame:
    """Up to ``HEADS`` rows of each tile, as aggregates: tasks send one row each for a hot tile."""
    me = ["id", "home", "comp", "n", "pos", "s0", "s1"]
    picks = left.groupBy("key").agg(F.array(*[F.min(F.struct(F.xxhash64("id", F.lit(j)).alias("prio"), *me)) for j in range(HEADS)]).alias("h"))
    return picks.select("key", F.explode("h").alias("h")).select("key", *[f"h.{c}" for c in me]).distinct()


def _across(xs: DataFrame, ys: DataFrame, params: Params) -> DataFrame:
    """Distinct pairs (a, b) of a tile's sets in different components that no bound rules out.

    A pair has a home row at least: two visitors meet in their own band.
    """
    x, y = (d.select("key", *[F.col(c).alias(p + c) for c in ("home", "id", "comp", "n", "pos", "s0", "s1")]) for d, p in ((xs, "x_"), (ys, "y_")))
    met = x.join(y, "key").where(F.col("x_comp") != F.col("y_comp")).where("x_home or y_home").where(_may_link(_columns("x_"), _columns("y_"), params))
    return met.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct()


def _not_ruled_out(pairs: DataFrame, texts: DataFrame, params: Params) -> DataFrame:
    """Pairs (a, b) that signatures of ``WIDE`` bits cannot rule out; made only for the rows that pairs name."""
    need = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    wanted = texts.sparkSession.sparkContext.broadcast(id_filter.build(need))
    names = [f"w{i}" for i in range(WIDE // 64)]
    schema = pa.schema([(c, pa.int64()) for c in ("id", "n", *names)])

    def run(batches):
        for b in batches:
            b = b.filter(pa.array(id_filter.may_hold(wanted.value, b.column(0))))
            rows = [[] for _ in schema]
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = shingle_set(text, params.k)
                for c, v in zip(rows, (i, len(s), *signature(s, WIDE, 20))):
                    c.append(int(v))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], schema=schema)

    made = materialize(texts.mapInArrow(run, ", ".join(f"{c} long" for c in ("id", "n", *names))), "wide")
    x, y = (made.select(F.col("id").alias(k), F.struct("n", *names).alias(f"s{k}")) for k in ("a", "b"))
    differing = sum((F.bit_count(F.col(f"sa.{c}").bitwiseXOR(F.col(f"sb.{c}"))) for c in names), F.lit(0))
    ok = (F.col("sa.n") + F.col("sb.n")) * F.lit(params.q - params.p) >= differing * F.lit(params.p + params.q)
    return pairs.join(x, "a").join(y, "b").where(ok).select("a", "b").distinct()


def _pivots(reps: DataFrame, params: Params) -> DataFrame:
    """Pairs (a, b) of each node with a pivot of the nodes that share a least element, within the size bound."""
    each = reps.select(F.col("rep").alias("id"), "n", F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("m1").alias("m")), F.struct(F.lit(1).alias("which"), F.col("m2").alias("m")))).alias("m")).select("id", "n", "m.*")
    # Written out, so that the rows of a hot group meet it in a join that Spark can split.
    pivots = materialize(each.groupBy("which", "m").agg(F.min(F.struct(F.xxhash64("id"), F.col("id").alias("pivot"), F.col("n").alias("pn"))).alias("p"), F.count(F.lit(1)).alias("size")).where("size > 1").select("which", "m", "p.pivot", "p.pn"), "pivots")
    met = each.join(pivots, ["which", "m"]).where("id <> pivot").where(F.least("n", "pn") * params.q >= F.greatest("n", "pn") * params.p)
    return met.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()


def jaccard_components(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    picked = _picked(docs, id_col, text_col)
    made = materialize(_sized(picked, params.k), "sets")
    rows = made.where("slice is null").select("id", "n", "k1", "k2", "m1", "m2")
    full = rows.where("n > 0 and id is not null")
    # Written out, so that the rows of a hot group meet it in a join that Spark can split.
    reps = materialize(full.groupBy("k1", "k2").agg(F.min("id").alias("rep"), *[F.min(c).alias(c) for c in ("n", "m1", "m2")]), "reps")
    # Copies are members of their representative; ids that repeat with other texts tie these together.
    member = full.join(reps.select("k1", "k2", "rep"), ["k1", "k2"]).select("id", "rep")
    many = member.groupBy("id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi")
    ties = member.join(many, "id").select(F.col("lo").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct()
    texts = picked.where("id is not null")

    first = materialize(_pivots(reps, params), "pairs")
    parts = connected_components(_verified(first, texts, params))

    over = _nodes(texts, reps.select(F.col("rep").alias("id")).distinct(), member.where("id <> rep").select("id"))
    sketch = spark.sparkContext.broadcast(_sketch(made.where("slice is not null")))
    keys = reps.agg(F.coalesce(F.sum(F.col("n") * (params.q - params.p) / params.q + 1), F.lit(0.0)).cast("long")).first()[0]
    marks = spark.sparkContext.broadcast(_marks(over, sketch, keys, params))
    tiles = materialize(_tile_rows(over, sketch, marks, params), "tiles")
    marks.destroy()
    sketch.destroy()

    # Sets that no pivot reached: pairs with some sets of the tile, from other components.
    left = _mixed(tiles, parts)
    second = materialize(_across(left, _heads(left), params).join(first, ["a", "b"], "left_anti"), "pairs")
    done = first.unionByName(second)
    parts = connected_components(_stars(parts).unionByName(_verified(second, texts, params)))

    # What is still apart: all pairs across components that a wide signature cannot rule out.
    left = _mixed(left.drop("comp", "top"), parts)
    # One component may be most of a hot tile: its rows are not paired with each other.
    inside, outside = left.where("comp = top"), left.where("comp <> top")
    rest = _across(outside, inside, params).unionByName(_across(outside, outside, params)).distinct().join(done, ["a", "b"], "left_anti")
    rest = materialize(rest, "pairs")
    if not rest.isEmpty():
        rest = materialize(_not_ruled_out(rest, texts, params), "pairs")
    links = _stars(parts)
    if not rest.isEmpty():
        links = links.unionByName(_verified(rest, texts, params))
    parts = connected_components(links.unionByName(ties))
    by_rep = parts.select(F.col("id").alias("rep"), "component")
    placed = rows.select("id", "n", "k1", "k2").join(reps.select("k1", "k2", "rep"), ["k1", "k2"], "left").join(by_rep, "rep", "left")
    linked = (F.col("n") > 0) & F.col("id").isNotNull()
    return placed.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(linked, F.coalesce("component", "rep")).otherwise(F.col("id")).alias("component_id"))


def keep_one(docs: DataFrame, params: Params) -> DataFrame:
    """The rows of ``docs``, all columns, of the least id in each component; rows with a null id stay."""
    parts = jaccard_components(docs, params)
    gone = materialize(parts.where("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct(), "gone")
    return id_filter.without(docs, gone, "doc_id")
