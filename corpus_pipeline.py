"""The training-data pipeline over ``documents``: five filtering and encoding stages.

Each stage works on all rows its predecessor kept; all but the last return the
columns of documents. ``run`` writes each stage's rows as Parquet in the shared
folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from concordat.llm import bpe, decontaminate, exact_dedup, jaccard_join, toxicity
from concordat.llm.queries import BPE_FILE, pattern, vocabulary
from concordat.session import materialize, table

#: Near duplicates of the corpus: five-word shingles, similarity 0.8 or more.
NEAR = jaccard_join.Params(k=5, p=80, q=100)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs, NEAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, vocabulary(BPE_FILE), pattern()).drop("same")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode_bytes),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The first stage is a trained classifier: SQL cannot express it.
ORACLE_SQL = None
