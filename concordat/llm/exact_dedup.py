"""Exact deduplication by composable polynomial fingerprints.

A text is cut into chunks. Each chunk gets a polynomial hash modulo two primes;
hashes of neighbours combine by length-shifted arithmetic, ``h(xy) = h(x) *
B**len(y) + h(y)``. Texts of more than ``BIG`` bytes are cut into rows, their
chunks dealt to all tasks, hashed there and combined; shorter ones are hashed in
place. Rows with equal fingerprint and length are then compared chunk by chunk,
by position, with the row that would stay (chunks stand for themselves by their
SHA-256, so that no text has to move); rows that differ (a collision) form
groups of their own in a further round.

Every row takes part, those without an id too. Null text counts as empty. Of
equal texts the row with the largest ``doc_id`` stays (a null doc_id is below all
others); of rows that also repeat the doc_id, one stays. Only ``doc_id`` and
``text`` are read, so further columns of any name do no harm. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.llm import id_filter
from concordat.llm.common import join_spread, map_rows, prepare, sha, utf8
from concordat.session import materialize

CHUNK = 1 << 16
#: Texts of more bytes are hashed as rows of chunks, by all tasks.
BIG = 1 << 22
PRIMES = (2147483647, 2147483629)
BASES = (1000003937, 1357924681)


def _powers(base: int, prime: int) -> np.ndarray:
    out = np.empty(CHUNK, np.uint64)
    x = 1
    for i in range(CHUNK):
        out[CHUNK - 1 - i] = x
        x = x * base % prime
    return out


def combine(left: tuple[int, int, int], right: tuple[int, int, int]) -> tuple[int, int, int]:
    """Fingerprint of a concatenation from those of its parts: (hash 1, hash 2, bytes)."""
    n = right[2]
    a, b = ((l * pow(g, n, p) + r) % p for l, r, g, p in zip(left, right, BASES, PRIMES))
    return a, b, left[2] + n


def fingerprinter():
    powers = [_powers(g, p) for g, p in zip(BASES, PRIMES)]

    def chunk_hashes(data: bytes) -> list[tuple[int, int, int]]:
        """One hash triple for each chunk; full chunks are hashed as one matrix product."""
        a = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
        full = len(a) // CHUNK
        out = []
        if full:
            block = a[: full * CHUNK].reshape(full, CHUNK)
            h1, h2 = (block @ w % np.uint64(p) for w, p in zip(powers, PRIMES))
            out = [(int(x), int(y), CHUNK) for x, y in zip(h1, h2)]
        if rest := len(a) - full * CHUNK:
            tail = a[full * CHUNK :]
            out.append((*(int(tail @ w[CHUNK - rest :]) % p for w, p in zip(powers, PRIMES)), rest))
        return out

    def fingerprint(data: bytes) -> tuple[int, int]:
        total = (0, 0, 0)
        for c in chunk_hashes(data):
            total = combine(total, c)
        return total[0] << 31 | total[1], total[2]

    return fingerprint


def _chunk_digests(data: bytes) -> list[bytes] | None:
    """SHA-256 of each chunk; None for a text of one chunk, whose digest is that of the text."""
    return [hashlib.sha256(data[i : i + CHUNK]).digest() for i in range(0, len(data), CHUNK)] if len(data) > CHUNK else None


ROW = "doc_id long, fp long, n_bytes long, text_sha256 string, chunks array<binary>"


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", big: int = BIG) -> DataFrame:
    """doc_id, fp, n_bytes, text_sha256, chunks (digests of the chunks, null for a single one) of every row."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    long = F.octet_length("text") > big

    def start():
        fingerprint = fingerprinter()

        def step(b: pa.RecordBatch) -> dict:
            data = [utf8(x) for x in b.column(1).to_pylist()]
            f = [fingerprint(x) for x in data]
            return {"doc_id": b.column(0), "fp": [x[0] for x in f], "n_bytes": [x[1] for x in f], "text_sha256": [sha(x) for x in data], "chunks": [_chunk_digests(x) for x in data]}

        return step

    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("n_bytes", pa.int64()), ("text_sha256", pa.string()), ("chunks", pa.list_(pa.binary()))])
    return map_rows(picked.where(~long), start, schema, ROW).unionByName(_of_long_texts(picked.where(long)))


def _of_long_texts(texts: DataFrame) -> DataFrame:
    """``fingerprints`` of long texts: chunks of ``CHUNK`` characters become rows that all tasks share."""
    prepare(texts.sparkSession)
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}+"), F.lit(0))  # one pass over the text
    told = texts.withColumn("rid", F.monotonically_increasing_id()).select("rid", "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), F.posexplode(pieces).alias("at", "chunk"))

    def hashed(batches):
        fingerprint = fingerprinter()
        for b in batches:
            data = [utf8(x) for x in b.column(4).to_pylist()]
            f = [fingerprint(x) for x in data]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([x[0] for x in f], pa.int64()), pa.array([x[1] for x in f], pa.int64()), pa.array([hashlib.sha256(x).digest() for x in data], pa.binary())], names=["rid", "doc_id", "text_sha256", "at", "fp", "n_bytes", "digest"])

    parts = told.repartition("rid", "at").mapInArrow(hashed, "rid long, doc_id long, text_sha256 string, at int, fp long, n_bytes long, digest binary")
    whole = parts.groupBy("rid", "doc_id", "text_sha256").agg(F.array_sort(F.collect_list(F.struct("at", "fp", "n_bytes", "digest"))).alias("parts"))

    def joined(batches):
        for b in batches:
            out = [[], [], []]
            for ps in b.column(2).to_pylist():
                total = (0, 0, 0)
                for x in ps:
                    total = combine(total, (x["fp"] >> 31, x["fp"] & ((1 << 31) - 1), x["n_bytes"]))
                for c, v in zip(out, (total[0] << 31 | total[1], total[2], [x["digest"] for x in ps])):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), b.column(1), pa.array(out[2], pa.list_(pa.binary()))], names=["doc_id", "fp", "n_bytes", "text_sha256", "chunks"])

    return whole.select("doc_id", "text_sha256", "parts").mapInArrow(joined, ROW)


KEY = ["fp", "n_bytes", "rnd"]


def _groups(rows: DataFrame) -> DataFrame:
    """KEY, size, keep_id, keep_rid of each group of several rows; numbers only, so that tasks combine them."""
    found = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("doc_id", "rid")).alias("best")).where("size > 1")
    return found.select(*KEY, "size", F.col("best.doc_id").alias("keep_id"), F.col("best.rid").alias("keep_rid"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", big: int = BIG) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``rnd`` is 0 but for texts that collided with another text's fingerprint.
    """
    printed = fingerprints(docs, id_col, text_col, big).withColumns({"rid": F.monotonically_increasing_id(), "rnd": F.lit(0)})
    rows = materialize(printed, "fingerprints")
    total = rows.count()
    at = 0
    while True:
        groups = materialize(_groups(rows.where(F.col("rnd") == at)), "groups")
        model = groups.join(rows.select(F.col("rid").alias("keep_rid"), F.col("text_sha256").alias("keep_sha"), F.col("chunks").alias("keep_chunks")), "keep_rid")
        model = materialize(model.select(*KEY, "size", "keep_sha", "keep_chunks"), "models")
        met = join_spread(rows, model, KEY, "size", total)
        # The digests of the chunks by position; a text of one chunk is its own digest.
        same = F.col("chunks").eqNullSafe(F.col("keep_chunks")) & (F.col("chunks").isNotNull() | (F.col("text_sha256") == F.col("keep_sha")))
        unlike = materialize(met.where(~same).select("rid", F.lit(1).alias("moved")), "unlike")
        if unlike.isEmpty():
            break
        # The row that stays is like itself, so that each round settles some rows of every group.
        rows = materialize(rows.join(unlike, "rid", "left").withColumn("rnd", F.col("rnd") + F.coalesce("moved", F.lit(0))).drop("moved"), "fingerprints")
        at += 1
    groups = groups if at == 0 else materialize(_groups(rows), "groups")
    out = join_spread(rows, groups, KEY, "size", total, "left")
    alone = F.col("keep_rid").isNull()
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("rid") == F.col("keep_rid"))).alias("kept"), "text_sha256",
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that exact dedup keeps: one of each text."""
    found = materialize(exact_dedup(docs), "verdicts")
    by_id = found.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("stay"))
    by_id = materialize(by_id.where("stay < n").select(F.col("doc_id").alias("id"), (F.col("stay") > 0).alias("some")), "gone")
    clear = id_filter.without(docs.where("doc_id is not null"), by_id.select("id"), "doc_id")
    # Told apart by their texts: rows of an id of which some stay and some go, and rows without an id.
    sha, d, w = F.sha2(F.coalesce(F.col("d.text"), F.lit("")).cast("binary"), 256), docs.alias("d"), found.where("kept").select("doc_id", "text_sha256").alias("w")
    some = by_id.where("some").select("id").alias("s")
    mixed = d.join(some, F.col("d.doc_id") == F.col("s.id"), "left_semi").unionByName(docs.where("doc_id is null")).alias("d")
    stay = mixed.join(w, F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (sha == F.col("w.text_sha256")), "left_semi")
    # Where rows repeat both id and text, one of them stays.
    return clear.unionByName(stay.dropDuplicates(["doc_id", "text"]))
