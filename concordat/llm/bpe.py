"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier 1: a minimal perfect hash (hash, displace) over the vocabulary resolves a
pre-token that is one token as a whole. Tier 2: other pre-tokens are merged
with a heap of candidate pairs over doubly linked bytes. The vocabulary file is
a parameter; its tables go to executors as one broadcast, bounded by the
vocabulary (a few MB for 50,000 tokens).

Null text is encoded like empty text: no ids. Repeated rows are encoded each.
Only the id and text columns are read, so other columns may have any name. An
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
from array import array

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.llm.common import map_rows, prepare, sha, utf8

#: Pre-tokens remembered by a Python worker; beyond that the memory starts anew.
MEMO = 400_000
#: Characters of the longest pre-token that is remembered, so that the memory is bounded in bytes.
KEEP = 64


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: lines of base64 token and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


class PerfectHash:
    """Minimal perfect hash of byte strings: n keys, n slots, one displacement a bucket.

    ``slot(key)`` is right for keys of the set; others are told apart by
    comparing the key kept in the slot.
    """

    def __init__(self, keys: list[bytes], per_bucket: int = 4):
        n = self.n = max(1, len(keys))
        r = self.r = max(1, n // per_bucket)
        h = [xxhash.xxh3_64_intdigest(k) for k in keys]
        buckets: list[list[int]] = [[] for _ in range(r)]
        for i, x in enumerate(h):
            buckets[x % r].append(i)
        self.shift = array("q", [0] * r)
        self.order = array("q", [-1] * n)
        used = bytearray(n)
        free = 0
        for b in sorted(range(r), key=lambda b: -len(buckets[b])):
            own = buckets[b]
            if not own:
                break
            if len(own) == 1:  # a lone key takes any free slot, kept as a negative displacement
                while used[free]:
                    free += 1
                self.shift[b] = -free - 1
                used[free] = 1
                self.order[free] = own[0]
                continue
            d = 0
            while True:
                at = [self._at(h[i], d) for i in own]
                if len(set(at)) == len(at) and not any(used[a] for a in at):
                    break
                d += 1
            self.shift[b] = d
            for i, a in zip(own, at):
                used[a] = 1
                self.order[a] = i

    def _at(self, h: int, d: int) -> int:
        return (((h ^ (d * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF) >> 17) % self.n

    def slot(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.r]
        return -d - 1 if d < 0 else self._at(h, d)


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token: lowest rank first, leftmost first among equals."""
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    end = list(range(1, n + 1))  # end[i]: where the part that starts at i ends; 0: merged away
    prev = list(range(-1, n - 1))
    get, push, pop = ranks.get, heapq.heappush, heapq.heappop
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = pop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != stop:
            continue  # one of its parts has changed since
        end[i], end[mid] = stop, 0
        if stop < n:
            prev[stop] = i
            if (r := get(piece[i : end[stop]])) is not None:
                push(heap, (r, i, end[stop]))
        if (p := prev[i]) >= 0 and (r := get(piece[p:stop])) is not None:
            push(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.keys = list(ranks)
        self.hash = PerfectHash(self.keys)
        self._ready()

    def _ready(self) -> None:
        self.split = regex.compile(self.pattern).findall
        order = self.hash.order
        self.slots = [(self.keys[i], self.ranks[self.keys[i]]) if i >= 0 else (None, -1) for i in order]
        self.tokens = {r: k for k, r in self.ranks.items()}
        self.memo: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("ranks", "pattern", "keys", "hash")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._ready()

    def lookup(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "surrogatepass")
        key, rank = self.slots[self.hash.slot(data)]
        return (rank,) if key == data else tuple(merge_bytes(data, self.ranks))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        memo, out = self.memo, []
        if len(memo) > MEMO:
            memo.clear()
        for piece in self.split(text):
            try:
                out += memo[piece]
            except KeyError:
                ids = self.lookup(piece)
                if len(piece) <= KEEP:
                    memo[piece] = ids
                out += ids
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _shared(df: DataFrame, path: str, pattern: str):
    """A broadcast codec. Its size is bounded by the vocabulary file."""
    prepare(df.sparkSession)
    return df.sparkSession.sparkContext.broadcast(Codec(load_ranks(path), pattern))


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``ids`` (array of int) of every row."""
    codec = _shared(df, path, pattern)

    def start():
        c = codec.value
        return lambda b: {"doc_id": b.column(0), "ids": [c.encode(x) for x in b.column(1).to_pylist()]}

    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return map_rows(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), start, schema, "doc_id long, ids array<int>")


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and ``data`` (the bytes) of every row of ids; null ids give empty bytes."""
    codec = _shared(df, path, pattern)

    def start():
        c = codec.value
        return lambda b: {"doc_id": b.column(0), "data": [c.decode(x or ()) for x in b.column(1).to_pylist()]}

    schema = pa.schema([("doc_id", pa.int64()), ("data", pa.binary())])
    return map_rows(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")), start, schema, "doc_id long, data binary")


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256, same (decoded is the text)."""
    codec = _shared(df, path, pattern)

    def start():
        c = codec.value

        def step(b: pa.RecordBatch) -> dict:
            n, ids_sha, out_sha, same = [], [], [], []
            for text in b.column(1).to_pylist():
                ids = c.encode(text)
                data = c.decode(ids)
                n.append(len(ids))
                ids_sha.append(sha(np.array(ids, "<u4").tobytes()))
                out_sha.append(sha(data))
                same.append(data == utf8(text))
            return {"doc_id": b.column(0), "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": out_sha, "same": same}

        return step

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("same", pa.bool_())])
    picked = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(picked, start, schema, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, same boolean")
