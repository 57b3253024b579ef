"""Helpers shared by the text operators: words, folds, Arrow batches, digests."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.session import ship

#: Rows of an Arrow batch. Texts may be 100 KB and more, and groups of long near
#: copies follow each other, so that Spark's default of 10,000 rows would not fit
#: in a small executor.
BATCH_ROWS = 250

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The word class: after A-Z are lower-cased, everything but the other ASCII characters,
#: as ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``. Java takes seven times as long for the negated form.
WORD = r"[0-9a-z\x80-\x{10FFFF}]+"

#: Byte table for the same words: lower-case A-Z, blank out ASCII separators.
#: UTF-8 never uses ASCII bytes inside a longer character, so bytes are enough.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def words(text: str | None) -> list[bytes]:
    """Words ``WORD`` of the lower-cased text, as UTF-8 bytes."""
    return utf8(text).translate(WORD_BYTES).split()


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def prepare(spark: SparkSession) -> None:
    """Ship the package and bound Arrow batches before a plan with Python nodes."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def map_rows(df: DataFrame, fn: Callable[[], Callable[[pa.RecordBatch], dict]], schema: pa.Schema, ddl: str) -> DataFrame:
    """``mapInArrow`` with per-task state.

    ``fn`` is called once a task and returns a function from a batch to columns.
    """
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = fn()
        for b in batches:
            yield pa.RecordBatch.from_pydict(step(b), schema=schema)

    return df.mapInArrow(run, ddl)


def learning_fold(col: str = "doc_id"):
    """True for rows that labels may be learnt from: crc32 of the id as text, mod 5, is not 0."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % 5 != 0


def held_out(col: str = "doc_id"):
    return F.coalesce(~learning_fold(col), F.lit(False))


#: A key with more than this share of the rows is hot; there are fewer than ``1 / HOT`` such keys.
HOT = 1 / 1000


def join_spread(rows: DataFrame, side: DataFrame, keys: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """Inner or left join with ``side`` (one row a key, ``size``: how many of the ``total`` rows have it) in which no key is hot.

    Keys with more than ``HOT`` of the rows, fewer than ``1 / HOT`` by that very
    share, are broadcast, so that their rows stay where they are; all others are
    joined as Spark sees fit. ``side`` should be a written table: it is read twice.
    """
    hot = F.col(size) > F.lit(max(total, 1) * HOT)
    few, rest = F.broadcast(side.where(hot)), side.where(~hot)
    return rows.join(few, keys).unionByName(rows.join(few.select(*keys), keys, "left_anti").join(rest, keys, how))
