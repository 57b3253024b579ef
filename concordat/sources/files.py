"""Feeds from files: CSV with or without a header, dictionaries, adjacency lists, snapshot pages."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from concordat.functions.text import blank, canonical_scalar, strip
from concordat.session import materialize, ship

RAW = "_raw"


def clean(c):
    """Value without outer space; '' and 'null' in any case are null."""
    s = strip(c)
    return F.when(~F.lower(s).isin("", "null"), s)


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, header: bool = True, sep: str = ",", encoding: str = "UTF-8", multiline: bool = False) -> DataFrame:
    """All-string rows with ``line_no``, ``record_id`` and ``malformed`` (null, or the line).

    With a header, short rows are padded with null and only longer ones are
    malformed; without one any other width is. ``line_no`` is the number of the
    record in its file, the header being 1: a first pass counts the records of
    each input split, the second adds what stands before it. With several files
    numbers go on in the order of their paths. ``multiline``: quoted values may
    hold line breaks, which count once; such files are not split.
    """
    if header and columns is None:
        first = spark.read.option("encoding", encoding).text(path).limit(1).first()
        columns = [c.strip().strip('"').lstrip("﻿") for c in (first[0].split(sep) if first else [])]
    if columns is None:
        width = spark.read.csv(path, sep=sep, encoding=encoding, header=False).columns
        columns = [f"col_{i}" for i in range(len(width))]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns] + [T.StructField(RAW, T.StringType())])
    df = spark.read.csv(path, schema=schema, header=header, sep=sep, encoding=encoding, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord=RAW, enforceSchema=True, multiLine=multiline)
    fields = F.size(F.split(F.regexp_replace(RAW, r'"([^"]|"")*"', ""), re.escape(sep), -1))
    bad = F.when(F.col(RAW).isNotNull() & ((fields > len(columns)) if header else (fields != len(columns))), F.col(RAW))
    split = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__from")]
    out = df.select(*[clean(F.col(f"`{c}`")).alias(c) for c in columns], bad.alias("malformed"), *split, F.monotonically_increasing_id().alias("__at"))
    # A task reads a split from its start to its end, so that ids of its rows follow each other.
    counts = out.groupBy("__file", "__from").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__lo"))
    # One row a split: no more than the file listing itself.
    before = Window.orderBy("__file", "__from").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    out = out.join(F.broadcast(offsets), ["__file", "__from"]).withColumn("line_no", F.col("__at") - F.col("__lo") + F.col("__before") + (2 if header else 1)).drop("__file", "__from", "__at", "__lo", "__before")
    return out.withColumn("record_id", F.concat(F.lit("line:"), F.col("line_no").cast("string")))


#: What a pass over the lines of a split needs to know: whether quotes are open before it, and records that begin before it.
_SPLIT = "file string, from long, lines long, odd int, even_starts long, odd_starts long"


def _line_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int, tuple]]]]:
    """Each batch with its runs of lines of one split: (first line, line after the last, split)."""
    for b in batches:
        where = list(zip(b.column(1).to_pylist(), b.column(2).to_pylist()))
        cuts = [0, *[i for i in range(1, len(where)) if where[i] != where[i - 1]], len(where)]
        yield b, [(i, j, where[i]) for i, j in zip(cuts, cuts[1:]) if j > i]


def _marks(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Quotes of each line, and whether it is not blank: a blank line outside quotes is no record."""
    return pc.count_substring(lines, '"').to_numpy(), pc.not_equal(pc.utf8_trim_whitespace(lines), "").to_numpy(zero_copy_only=False)


def _odd_before(quotes: np.ndarray, carry: int) -> np.ndarray:
    """Are quotes open before each line? ``carry``: before the first."""
    return (np.cumsum(quotes) - quotes + carry) % 2


def _count_splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[tuple, list[int]] = {}
    for b, runs in _line_runs(batches):
        quotes, some = _marks(b.column(0))
        for i, j, split in runs:
            s = seen.setdefault(split, [0, 0, 0, 0])
            odd = _odd_before(quotes[i:j], s[1])
            s[0], s[1] = s[0] + j - i, int((s[1] + quotes[i:j].sum()) % 2)
            s[2], s[3] = s[2] + int(((odd == 0) & some[i:j]).sum()), s[3] + int(((odd == 1) & some[i:j]).sum())
    names = ["file", "from", "lines", "odd", "even_starts", "odd_starts"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    rows = [(*k, *v) for k, v in seen.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def _number_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, list[int]] = {}
    for b, runs in _line_runs(batches):
        quotes, some = _marks(b.column(0))
        record, alone = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, bool)
        opened, before = b.column(4).to_numpy(), b.column(5).to_numpy()
        for i, j, split in runs:
            s = held.setdefault(split, [int(opened[i]), int(before[i])])
            odd = _odd_before(quotes[i:j], s[0])
            record[i:j] = s[1] + np.cumsum((odd == 0) & some[i:j])
            alone[i:j] = (odd == 0) & (quotes[i:j] % 2 == 0)
            s[0], s[1] = int((s[0] + quotes[i:j].sum()) % 2), int(record[j - 1])
        yield pa.RecordBatch.from_arrays([b.column(1), pa.array(record), b.column(3), pa.array(alone), b.column(0)], names=["file", "record", "at", "alone", "line"])


def csv_records(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(file, record, text) of CSV files in which quoted values may hold line breaks, read in splits of any size.

    A first pass counts the quotes of each split's lines; whether quotes are open
    where a split begins, and how many records begin before it, are sums over the
    splits before it. A second pass numbers the records, from 1 in each file.
    Records of one line stay where they are; lines of longer ones come together.
    """
    ship(spark)
    lines = spark.read.option("lineSep", "\n").option("encoding", encoding).text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("from"), F.monotonically_increasing_id().alias("at"))
    splits = materialize(lines.select("value", "file", "from").mapInArrow(_count_splits, _SPLIT).groupBy("file", "from").agg(F.sum("lines").alias("lines"), F.sum("odd").alias("odd"), F.sum("even_starts").alias("even"), F.sum("odd_starts").alias("uneven")), "splits")
    # One row a split: no more than the file listing itself.
    w = Window.partitionBy("file").orderBy("from").rowsBetween(Window.unboundedPreceding, -1)
    opened = splits.withColumn("opened", (F.coalesce(F.sum("odd").over(w), F.lit(0)) % 2).cast("int"))
    starts = F.when(F.col("opened") == 0, F.col("even")).otherwise(F.col("uneven"))
    offsets = opened.withColumn("starts", starts).withColumn("before", F.coalesce(F.sum("starts").over(w), F.lit(0))).select("file", "from", "opened", "before")
    told = lines.join(F.broadcast(offsets), ["file", "from"]).select("value", "file", "from", "at", "opened", "before")
    each = told.mapInArrow(_number_lines, "file string, record long, at long, alone boolean, line string")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"])
    joined = each.where("not alone").groupBy("file", "record").agg(F.array_join(parts, "\n").alias("text"))
    whole = each.where("alone").select("file", "record", F.col("line").alias("text")).unionByName(joined)
    return whole.withColumn("text", F.regexp_replace("text", "\\r$", ""))


def read_csv_split(spark: SparkSession, path: str, columns: list[str] | None = None, header: bool = True, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """``read_csv(multiline=True)`` of files of any size: the same rows and record numbers, but files are split.

    Blank lines are no records. Numbers go on over several files in the order of
    their paths.
    """
    records = csv_records(spark, path, encoding)
    if columns is None:
        first = records.where("record = 1").orderBy("file").select("text").first()
        names = next(csv.reader([first[0]], delimiter=sep)) if first else []
        columns = [c.strip().lstrip("\ufeff") for c in names] if header else [f"col_{i}" for i in range(len(names))]
    body = records.where("record > 1") if header else records
    body = materialize(body.where(F.trim("text") != ""), "records")
    # Records of a file are counted without its header; what lies before a file is one number each.
    per = body.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    before = per.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    schema = ", ".join(f"`{c}` string" for c in columns) + f", {RAW} string"
    made = F.from_csv("text", schema, {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": RAW})
    out = body.join(F.broadcast(before), "file").withColumn("__r", made)
    raw = F.col(f"__r.{RAW}")
    fields = F.size(F.split(F.regexp_replace(raw, r'"([^"]|"")*"', ""), re.escape(sep), -1))
    bad = F.when(raw.isNotNull() & ((fields > len(columns)) if header else (fields != len(columns))), raw)
    out = out.select(*[clean(F.col(f"__r.`{c}`")).alias(c) for c in columns], bad.alias("malformed"), (F.col("record") + F.col("before")).alias("line_no"))
    return out.withColumn("record_id", F.concat(F.lit("line:"), F.col("line_no").cast("string")))


def check_dictionary(df: DataFrame, key: str, required: list[str] = (), norm=None) -> DataFrame:
    """One row of checks: rows, null keys, nulls of each required column, duplicate normalised keys."""
    k = (norm or strip)(F.col(key))
    nulls = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(blank(F.col(key))).alias("null_keys"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in required])
    dup = df.groupBy(k.alias("__k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 and __k is not null").agg(F.count(F.lit(1)).alias("duplicate_keys"))
    return nulls.crossJoin(dup)  # one row each


def refuse_duplicates(df: DataFrame, key: str, norm=None) -> DataFrame:
    """``df``, or an error that names up to five keys that are the same in normal form."""
    k = (norm or strip)(F.col(key))
    some = df.groupBy(k.alias("__k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 and __k is not null").orderBy("__k").limit(5).collect()
    if some:
        raise ValueError(f"duplicate keys: {', '.join(r['__k'] for r in some)}")
    return df


def content_hash(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of small files, to be compared with a manifest."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def adjacency(df: DataFrame, node: str, parent: str, label: str) -> DataFrame:
    """(node_id, parent_id, label), stripped, null markers removed, blank ids dropped, distinct."""
    return df.select(clean(F.col(node).cast("string")).alias("node_id"), clean(F.col(parent).cast("string")).alias("parent_id"), clean(F.col(label).cast("string")).alias("label")).where("node_id is not null").distinct()


def membership(df: DataFrame, column: str) -> DataFrame:
    """Distinct stripped values of a column that are not blank."""
    c = strip(F.col(column).cast("string"))
    return df.select(c.alias("node_id")).where(~blank(F.col("node_id"))).distinct()


def snapshot_pages(spark: SparkSession, path: str, schema: str, fmt: str = "json", page_size: int | None = None, max_pages: int | None = None) -> DataFrame:
    """Items of landed pages with their page (file) name: of all pages, or of the first ``max_pages`` by name.

    ``page_size`` is what a full page holds: a page with fewer items is the last
    one, so that pages after it are left out.
    """
    df = spark.read.format(fmt).schema(schema).load(path).withColumn("page", F.col("_metadata.file_path"))
    if page_size is None and max_pages is None:
        return df
    pages = df.groupBy("page").agg(F.count(F.lit(1)).alias("items"))  # one row a file
    ranked = pages.withColumn("at", F.row_number().over(Window.orderBy("page")))
    if max_pages is not None:
        ranked = ranked.where(F.col("at") <= max_pages)
    if page_size is not None:
        last = ranked.where(F.col("items") < page_size).agg(F.min("at").alias("last"))
        ranked = ranked.crossJoin(last).where(F.col("last").isNull() | (F.col("at") <= F.col("last")))  # one row
    return df.join(F.broadcast(ranked.select("page")), "page", "left_semi")


def hierarchy_source(snapshot: DataFrame, node: str, parent: str, label: str, steps: tuple[tuple, ...] = (("trim",), ("lower",))) -> DataFrame:
    """(node_id, parent_id, label) of a snapshot, deleted rows included, labels in canonical form, sorted by id."""
    text = lambda c: clean(F.col(c).cast("string"))
    out = snapshot.select(text(node).alias("node_id"), text(parent).alias("parent_id"), canonical_scalar(F.col(label).cast("string"), list(steps)).alias("label"))
    return out.where("node_id is not null").orderBy("node_id")


def micro_batches(spark: SparkSession, path: str, schema: str, fmt: str = "json", max_files: int = 1) -> DataFrame:
    """Landed files as a stream of micro-batches of up to ``max_files``; how long one waits is the trigger of the query."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files).load(path)
