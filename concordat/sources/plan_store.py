"""Plans on disk: items partitioned by operation, a one-row summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEMS = "line_no BIGINT, op STRING, target_id STRING, resource_id STRING, match_key STRING, password STRING, changes MAP<STRING,STRING>"


def write_plan(items: DataFrame, summary: DataFrame, path: str, fmt: str = "json") -> None:
    items.write.mode("overwrite").partitionBy("op").format(fmt).save(f"{path}/items")
    summary.write.mode("overwrite").json(f"{path}/summary")


def read_plan(spark: SparkSession, path: str, schema: str = ITEMS) -> DataFrame:
    """Items with missing fields null, masked passwords removed, and the old name of target_id accepted."""
    df = spark.read.schema(schema).json(f"{path}/items")
    out = df.withColumns({"target_id": F.coalesce("target_id", "resource_id"), "changes": F.coalesce("changes", F.create_map().cast("map<string,string>"))})
    return out.withColumn("password", F.when(F.col("password") != "***", F.col("password"))).drop("resource_id")
