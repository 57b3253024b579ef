"""Incremental jobs: cross-run dedup, pending links, snapshot refresh, the identity index.

State lies in RocksDB, by key or by page of keys, so that it may outgrow the memory of executors.
"""

from __future__ import annotations

import time
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import MapState

from concordat.operators import cache as snapshots
from concordat.operators.links import append_index, identity_index
from concordat.session import ship
from concordat.sources.keyed_log import GONE, KeyedLog


def drain(query: StreamingQuery, seconds: float | None = None, every: float = 0.2) -> None:
    """Wait until a query with the trigger ``availableNow`` has used up its input, and stop it.

    A query with time-outs does not end by itself: it goes on with empty batches.
    The first batch that moves no source on tells that the rest was read. With
    ``seconds`` it is an error if that takes longer.
    """
    end = None if seconds is None else time.monotonic() + seconds
    try:
        while query.isActive:
            last = query.lastProgress
            if last and all(s["startOffset"] == s["endOffset"] for s in last["sources"]):
                break
            if end is not None and time.monotonic() >= end:
                raise TimeoutError(f"input is left after {seconds} s")
            time.sleep(every)
        if query.exception():
            raise query.exception()
    finally:
        query.stop()


#: Rows of a frame that a stateful step hands on at once.
FRAME = 10_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _stateful(spark: SparkSession) -> None:
    """Steps with several states a key need the RocksDB store; a session setting that is left as it is where it names one already."""
    ship(spark)
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (spark.conf.get(name, None) or ""):
        spark.conf.set(name, ROCKSDB)


DEDUP = "dedup_key string, line_no long, fingerprint string, dedup string"


class FirstSeen(StatefulProcessor):
    """A key's first fingerprint is remembered; later rows are duplicates of it or conflicts."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "fingerprint string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("line_no", kind="stable")  # a batch's rows of one key
        known = self.first.exists()
        first = self.first.get()[0] if known else pdf.fingerprint.iloc[0]
        same = pdf.fingerprint.eq(first) if first is not None else pdf.fingerprint.isna()
        kinds = same.map({True: "duplicate", False: "conflict"}).to_numpy(copy=True)
        if not known:
            kinds[0] = "first"
        self.first.update((first,))
        yield pd.DataFrame({"dedup_key": key[0], "line_no": pdf.line_no.to_numpy(), "fingerprint": pdf.fingerprint.to_numpy(), "dedup": kinds})

    def close(self) -> None:
        pass


def dedup_stream(rows: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Stream of (dedup_key, line_no, fingerprint) -> the same with ``dedup``, over all batches and runs.

    With ``ttl_ms`` a key that is not seen for so long is forgotten.
    """
    _stateful(rows.sparkSession)
    keyed = rows.select("dedup_key", "line_no", "fingerprint").groupBy("dedup_key")
    return keyed.transformWithStateInPandas(FirstSeen(ttl_ms), DEDUP, "append", "none" if ttl_ms is None else "processingTime")


PENDING = "dataset string, lookup_key string, source_row_id string, status string, resolved_id string"
#: Entries in a part of a page, on average at most.
PART = 2_000


class Parts:
    """A dict kept in a map state, in parts by a hash of its keys (tuples of strings): each part is read or written in one call."""

    def __init__(self, state: MapState, width: int, size: int):
        self.state, self.width, self.size = state, width, size  # columns of a key, entries of a part

    def read(self, part: int) -> dict[tuple, tuple]:
        told = self.state.getValue((part,))
        return {e[: self.width]: e[self.width :] for e in zip(*told)} if told else {}

    def write(self, part: int, entries: dict[tuple, tuple]) -> None:
        if entries:
            self.state.updateValue((part,), tuple(map(list, zip(*[k + v for k, v in entries.items()]))))
        else:
            self.state.removeKey((part,))

    def split(self, keys: Iterable[tuple], parts: int) -> dict[int, list[tuple]]:
        out = defaultdict(list)
        for k in keys:
            out[crc32("\0".join(c or "" for c in k).encode()) & (parts - 1)].append(k)  # parts: a power of two
        return out

    def fit(self, parts: int, entries: int) -> int:
        """Divide each part as often as so many entries need; gives the number of parts."""
        more = parts
        while entries > more * self.size:
            more *= 2
        for part in range(parts if more > parts else 0):
            held = self.read(part)
            split = self.split(held, more)
            for to in split.keys() | ({part} if held else set()):
                self.write(to, {k: held[k] for k in split.get(to, [])})
        return more


class PendingLinks(StatefulProcessor):
    """State of a page of lookup keys of a data set: ids that have arrived, and each request that waits for one, with its attempts and deadline.

    A call to the state costs more than all else that is done for a request, so
    that keys share pages, and a page's entries lie in parts: a batch reads and
    writes the parts that its rows lie in, and, where ids arrive, all requests of
    their pages. A request has the deadline of its first attempt; requests of one
    batch share a timer. Ids are forgotten ``known_ttl_ms`` after they were last seen.
    """

    def __init__(self, ttl_ms: int, max_attempts: int, known_ttl_ms: int | None, part: int):
        self.ttl_ms, self.max_attempts, self.known_ttl_ms, self.part = ttl_ms, max_attempts, known_ttl_ms, part

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sizes = handle.getValueState("sizes", "known_parts int, known long, waiting_parts int, waiting long")
        self.known = Parts(handle.getMapState("known", "part int", "lookup_keys array<string>, ids array<string>, seen array<long>", self.known_ttl_ms), 1, self.part)
        self.waiting = Parts(handle.getMapState("waiting", "part int", "lookup_keys array<string>, rows array<string>, attempts array<int>, deadlines array<long>"), 2, self.part)

    def _told(self, key, links: Iterable[tuple], status: str, found: dict | None = None) -> Iterator[pd.DataFrame]:
        links = sorted(links, key=lambda x: (x[0] or "", x[1]))
        for i in range(0, len(links), FRAME):
            keys, rows = zip(*links[i : i + FRAME])
            ids = [found[k] for k in keys] if found else [None] * len(keys)
            yield pd.DataFrame({"dataset": pd.Series([key[0]] * len(keys), dtype=object), "lookup_key": pd.Series(keys, dtype=object), "source_row_id": pd.Series(rows, dtype=object), "status": status, "resolved_id": pd.Series(ids, dtype=object)})

    def _ids(self, asked: Iterable[tuple], came: dict, now: int, parts: int, held: int) -> tuple[dict, int, int]:
        """Ids of the lookup keys of this batch, those that came noted; parts and number of the ids held then."""
        if self.known_ttl_ms is not None and held + len(came) > parts * self.part:  # parts may have gone by their time to live
            held = sum(len(self.known.read(p)) for p in range(parts))
        parts = self.known.fit(parts, held + len(came))
        ids = {}
        for part, keys in self.known.split({(k,) for k, _ in asked} | {(k,) for k in came}, parts).items():
            noted = self.known.read(part) if held else {}
            before = len(noted)
            if self.known_ttl_ms is not None:
                noted = {k: v for k, v in noted.items() if v[1] + self.known_ttl_ms > now}
            for k in keys:
                found = min((i for i in (came.get(k[0]), noted[k][0] if k in noted else None) if i is not None), default=None)
                if found is not None:
                    ids[k[0]] = found
                if k[0] in came:
                    noted[k] = (found, now)
            if any(k[0] in came for k in keys):
                self.known.write(part, noted)
                held += len(noted) - before
        return ids, parts, held

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        asked, came = Counter(), {}
        for pdf in rows:
            of = pdf.lookup_key.astype(object).where(pdf.lookup_key.notna(), None)
            asks, comes = pdf.asks.notna(), pdf.comes.notna()
            asked.update(zip(of[asks], pdf.asks[asks]))
            for k, i in zip(of[comes], pdf.comes[comes]):
                came[k] = min(i, came.get(k, i))
        now = timerValues.getCurrentProcessingTimeInMs()
        sizes = self.sizes.get() or (1, 0, 1, 0)
        ids, known_parts, known = self._ids(asked, came, now, *sizes[:2])
        done = {a for a in asked if a[0] in ids}
        open_ = [a for a in asked if a[0] not in ids]
        held = sizes[3]
        parts = self.waiting.fit(sizes[2], held + len(open_))
        split, late, timed = self.waiting.split(open_, parts), [], False
        for part in range(parts) if came and held else split:
            waits = self.waiting.read(part) if held else {}
            before = len(waits)
            here = {a for a in waits if a[0] in came}
            done |= here
            waits = {a: v for a, v in waits.items() if a not in here} if here else waits
            for a in split.get(part, []):
                attempts, until = waits.pop(a, (0, None))
                attempts += asked[a]
                if attempts >= self.max_attempts:
                    late.append(a)
                else:
                    waits[a] = (attempts, until or now + self.ttl_ms)
                    timed |= until is None
            if here or part in split:
                self.waiting.write(part, waits)
            held += len(waits) - before
        if (known_parts, known, parts, held) != tuple(sizes):
            self.sizes.update((known_parts, known, parts, held))
        yield from self._told(key, done, "resolved", ids)
        yield from self._told(key, late, "conflict")
        if timed:
            self.handle.registerTimer(now + self.ttl_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, gone = expiredTimerInfo.getExpiryTimeInMs(), []
        known_parts, known, parts, held = self.sizes.get() or (1, 0, 1, 0)
        for part in range(parts if held else 0):
            waits = self.waiting.read(part)
            over = [a for a, (_, until) in waits.items() if until <= now]
            if over:
                self.waiting.write(part, {a: v for a, v in waits.items() if v[1] > now})
                gone += over
        if gone:
            self.sizes.update((known_parts, known, parts, held - len(gone)))
        yield from self._told(key, gone, "expired")

    def close(self) -> None:
        pass


def pending_stream(events: DataFrame, ttl_ms: int = 86_400_000, max_attempts: int = 5, known_ttl_ms: int | None = None, pages: int = 1 << 10) -> DataFrame:
    """Stream of (event: request or identity, dataset, lookup_key, source_row_id, resolved_id) -> links that
    were resolved, ran into a conflict (too many attempts) or expired, each by its own deadline.

    ``pages`` of lookup keys a data set share state; it must stay as it is while a checkpoint is used."""
    _stateful(events.sparkSession)
    asks, comes = F.when(F.col("event") == "request", F.col("source_row_id")), F.when((F.col("event") == "identity") & (F.col("resolved_id") != ""), F.col("resolved_id"))
    page = F.pmod(F.xxhash64("lookup_key"), F.lit(pages)).cast("int")
    keyed = events.select("dataset", page.alias("page"), "lookup_key", asks.alias("asks"), comes.alias("comes")).where("asks is not null or comes is not null").groupBy("dataset", "page")
    return keyed.transformWithStateInPandas(PendingLinks(ttl_ms, max_attempts, known_ttl_ms, PART), PENDING, "append", "processingTime")


def snapshot_log(path: str, pk: str, buckets: int = 64) -> KeyedLog:
    """The snapshot that ``refresh_stream`` keeps, by primary key."""
    return KeyedLog(path, (pk,), (pk,), buckets)


def refresh_batch(log: KeyedLog, pages: DataFrame, version: int, columns, pk: str, order: list[str], deleted, compact_every: int = 0) -> None:
    """One version of a snapshot: the rows that a batch of landed pages inserts or replaces are all that is written.

    Every ``compact_every`` batches the merged rows are written as a base, so that
    readers merge no more batches than that.
    """
    names = [c.name for c in columns]
    items = snapshots.project_items(pages.withColumn("__deleted", deleted), columns, keep=("__deleted", *order)).where("not __deleted and failed is null")
    last = snapshots.last_wins(items, pk, order).select(*names)
    log.append(last.withColumn(GONE, F.lit(False)), version)
    if compact_every and log.pending_deltas(pages.sparkSession) >= compact_every:
        log.compact(pages.sparkSession)


def refresh_stream(pages: DataFrame, log: KeyedLog, columns, pk: str, order: list[str], deleted, checkpoint: str, compact_every: int = 0) -> StreamingQuery:
    """Keep a snapshot up to date from a stream of landed pages: each batch is a version of ``log``; a repeated one replaces itself."""

    def step(batch: DataFrame, batch_id: int) -> None:
        refresh_batch(log, batch, batch_id, columns, pk, order, deleted, compact_every)

    return pages.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_batch(batch: DataFrame, stored: DataFrame, record_id: str, keys) -> DataFrame:
    """New identity-index entries of a batch: those not stored yet."""
    return identity_index(batch, record_id, keys).join(stored, ["lookup_key", "id"], "left_anti")


def index_stream(records: DataFrame, log: KeyedLog, record_id: str, keys, dataset: str, checkpoint: str) -> StreamingQuery:
    """Keep a stored index up to date from a stream of records; a batch reads the buckets its keys lie in and writes its new entries."""

    def step(batch: DataFrame, batch_id: int) -> None:
        append_index(log, identity_index(batch, record_id, keys, dataset), batch_id)

    return records.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
