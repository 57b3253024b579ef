"""A keyed table kept as batches of changes: Parquet files by version and bucket of a key, merged when read.

A batch writes only its own rows, whatever the table holds. A reader who knows
which keys it wants reads the buckets of these keys and no others. ``compact``
writes the merged rows as a base, from which later versions start; ``vacuum``
removes what no version from a given one on needs. A version counts once its log
entry is there, which is written last, so that a batch that failed or is repeated
leaves nothing behind that counts twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column of a batch's rows that take their key out of the table.
GONE = "__gone"


@dataclass(frozen=True)
class KeyedLog:
    """``key``: rows with an equal key replace each other, the latest version wins. ``bucket_by``: columns of the key that readers know."""

    path: str
    key: tuple[str, ...]
    bucket_by: tuple[str, ...] = ()
    buckets: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in self.bucket_by or self.key]), F.lit(self.buckets)).cast("int")

    def touched(self, keys: DataFrame) -> list[int]:
        """Buckets that ``keys`` (the ``bucket_by`` columns) lie in: no more than there are."""
        return sorted(r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect())

    def _entries(self, spark: SparkSession) -> list[tuple[int, str]]:
        """(version, kind) of what was written, in order; one small row each."""
        try:
            log = spark.read.schema("entry int, kind string, v int").parquet(f"{self.path}/log")
        except AnalysisException:
            return []
        return sorted((r.v, r.kind) for r in log.select("v", "kind").collect())

    def versions(self, spark: SparkSession) -> list[int]:
        return sorted({v for v, _ in self._entries(spark)})

    def _write(self, rows: DataFrame, version: int, kind: str) -> None:
        spark = rows.sparkSession
        rows.withColumn("bucket", self.bucket()).hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/kind={kind}/written={version}")
        spark.range(1).select(F.lit(1).alias("entry")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/v={version}/kind={kind}")

    def append(self, rows: DataFrame, version: int) -> None:
        """The rows of a batch, each key once; those with a true ``GONE`` take their key out. A repeated version replaces itself."""
        self._write(rows if GONE in rows.columns else rows.withColumn(GONE, F.lit(False)), version, "delta")

    def _needed(self, spark: SparkSession, version: int | None) -> list[tuple[int, str]]:
        entries = [(v, k) for v, k in self._entries(spark) if version is None or v <= version]
        base = max((v for v, k in entries if k == "base"), default=None)
        return entries if base is None else [(base, "base"), *[(v, k) for v, k in entries if k == "delta" and v > base]]

    def read(self, spark: SparkSession, version: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """The table as of a version (the latest by default), of all buckets or some; None before the first version."""
        needed = self._needed(spark, version)
        if not needed:
            return None
        rows = spark.read.option("basePath", f"{self.path}/data").option("mergeSchema", len(needed) > 1).parquet(*[f"{self.path}/data/kind={k}/written={v}" for v, k in needed])
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))
        values = [c for c in rows.columns if c not in (*self.key, "bucket", "kind", "written")]
        if len(needed) > 1:
            # Tasks keep the latest row of a key before the shuffle.
            last = rows.groupBy(*self.key).agg(F.max_by(F.struct(*values), "written").alias("__last"))
            rows = last.select(*self.key, *[F.col(f"__last.{c}").alias(c) for c in values])
        return rows.where(~F.coalesce(F.col(GONE), F.lit(False))).select(*self.key, *[c for c in values if c != GONE])

    def compact(self, spark: SparkSession) -> int:
        """Write the latest version's rows as a base, and give that version."""
        version = self.versions(spark)[-1]
        self._write(self.read(spark, version).withColumn(GONE, F.lit(False)), version, "base")
        return version

    def pending_deltas(self, spark: SparkSession) -> int:
        """Batches that a reader of the latest version merges."""
        return sum(k == "delta" for _, k in self._needed(spark, None))

    def vacuum(self, spark: SparkSession, keep: int) -> list[str]:
        """Remove files that no version from ``keep`` on needs; gives their folders."""
        entries = self._entries(spark)
        base = max((v for v, k in entries if k == "base" and v <= keep), default=None)
        if base is None:
            return []
        gone = [(v, k) for v, k in entries if v < base or v == base and k == "delta"]
        jvm = spark.sparkContext._jvm
        out = []
        for v, k in gone:  # the log entry first: what it stands for must not be missed
            for folder in (f"{self.path}/log/v={v}/kind={k}", f"{self.path}/data/kind={k}/written={v}"):
                where = jvm.org.apache.hadoop.fs.Path(folder)
                where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
            out.append(f"{k} {v}")
        return out
