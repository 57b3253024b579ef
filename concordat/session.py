"""Session helpers shared by every Spark job of the library."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per application.

    Arrow helpers are pickled by reference, so a Python worker has to import
    them. A worker that can already see the package is unaffected.
    """
    sc = spark.sparkContext
    if getattr(sc, "_concordat_shipped", False):
        return
    out = os.path.join(tempfile.mkdtemp(prefix="concordat-"), "concordat.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, f"{PACKAGE.name}/{p.relative_to(PACKAGE)}")
    sc.addPyFile(out)
    sc._concordat_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. A local master may do
    without and gets a fresh temporary one; a cluster may not. What an application
    writes there lies in a folder of its own, which goes when it ends."""
    sc = spark.sparkContext
    made = getattr(sc, "_concordat_shared", None)
    if made is None:
        made = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not made:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            made = "file://" + tempfile.mkdtemp(prefix="concordat-checkpoint-")
            sc.setCheckpointDir(made)
        made = sc._concordat_shared = f"{made.rstrip('/')}/concordat-{sc.applicationId}-{uuid.uuid4().hex[:8]}"
        _remove_at_stop(spark, made)
    return made


def _remove_at_stop(spark: SparkSession, path: str) -> None:
    """Delete the application's folder when its context stops, or else when Python ends while it still runs."""
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm
    stop = sc.stop

    def clean() -> None:
        try:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the folder may be gone, or the context may have stopped by other means
            pass

    def stop_clean() -> None:
        if sc._jsc is not None:
            clean()
        stop()

    sc.stop = stop_clean


def materialize(df: DataFrame, tag: str = "t") -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back.

    Survives the loss of executors, unlike a local checkpoint, and is smaller
    than an RDD checkpoint.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
