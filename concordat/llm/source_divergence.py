"""How the sources of a language differ in their use of terms.

A group is a (lang, source); a language keeps the terms of at least ``MIN_DOCS``
of its documents. With ``count`` occurrences of a term in a group, ``N`` of all
kept ones and ``V`` kept terms, the term's price is ``1 + floor(SCALE * (count +
ADD) / (N + ADD * V))``. Two groups differ by the sum of the absolute differences
of their prices over all kept terms.

Counting: tasks add up a group's terms in memory and pass them on when they hold
``HELD`` of them, so that a frequent term or a large source leaves few rows.
Pairs: a group's counts lie as sorted arrays of (term id, count), in blocks of
``BLOCK`` terms. Each unordered pair of groups is a task of its own: its two
arrays of a block come together and the shorter one gallops through the longer;
terms of both, of one only and of neither are priced. The difference is the same
both ways, so that it counts for both groups. Nothing of a pair grows beyond a
block, and no list holds all terms or all sources.

All arithmetic is in whole numbers, exact while a group has fewer than 9 * 10**15
occurrences. Null text, lang and source count as empty texts. Documents without
terms make groups too; a language that keeps no term has differences of 0.
Repeated rows count each. Only the three columns are read, so that others may
have any name; an empty table gives empty results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concordat.llm.common import prepare, utf8
from concordat.session import materialize

MIN_DOCS, SCALE_STEPS, ADD, TOP = 30, 3, 5, 50
#: Terms that a task holds before it passes their counts on, and terms of a block of a group's array.
HELD, BLOCK = 200_000, 1 << 12
#: Groups of a language whose arrays of a block meet in one task are about so many on each side.
SIDE = 64

#: Byte table: A-Z lower-cased, all other ASCII but a-z a separator.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))

GROUP = ["lang", "source"]


def _emit(held: dict) -> Iterator[pa.RecordBatch]:
    rows = [(lang, source, t, n, docs[t]) for (lang, source), (counts, docs) in held.items() for t, n in counts.items()]
    for i in range(0, len(rows), 50_000):
        lang, source, term, n, d = zip(*rows[i : i + 50_000])
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array([x.decode("utf-8", "surrogatepass") for x in term], pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())], names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of each term of a group: occurrences, and documents that hold it."""
    prepare(docs.sparkSession)

    def count(batches):
        held, size = {}, 0
        for b in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in b.columns)):
                found = utf8(text).translate(TERM_BYTES).split()
                counts, seen = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(counts)
                counts.update(found)
                seen.update(set(found))
                size += len(counts)
                if size > HELD:
                    yield from _emit(held)
                    held, size = {}, 0
        yield from _emit(held)

    parts = _plain(docs).mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return parts.groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def price(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(10**9 * (count + ADD) / (total + ADD * terms))`` in whole numbers, three digits at a time."""
    d, rest, out = total + F.lit(ADD) * terms, count + F.lit(ADD), F.lit(0).cast("long")
    for _ in range(SCALE_STEPS):
        rest = rest * F.lit(1000)
        out, rest = out * F.lit(1000) + F.call_function("div", rest, d), rest % d
    return out + F.lit(1)


def prices(count: np.ndarray, total: int, terms: int) -> np.ndarray:
    """``price`` of an array of counts."""
    d, rest, out = np.int64(total + ADD * terms), count.astype(np.int64) + ADD, np.zeros(len(count), np.int64)
    for _ in range(SCALE_STEPS):
        q, rest = np.divmod(rest * 1000, d)
        out = out * 1000 + q
    return out + 1


def pair_difference(a: tuple, b: tuple, terms: int, size: int) -> int:
    """Sum of price differences over a block of ``size`` terms; ``a`` and ``b``: (sorted ids, counts, occurrences in the group).

    ``terms``: kept terms of the language.
    """
    if len(a[0]) > len(b[0]):
        a, b = b, a
    (ids, counts, total), (long_ids, long_counts, long_total) = a, b
    none, long_none = (int(prices(np.zeros(1, np.int64), t, terms)[0]) for t in (total, long_total))
    own, other = prices(counts, total, terms), prices(long_counts, long_total, terms)
    out, both = int(np.abs(other - none).sum()), 0  # as if all of the longer array were missing in the shorter one
    if len(ids) and len(long_ids):
        at = np.minimum(np.searchsorted(long_ids, ids), len(long_ids) - 1)
        met = long_ids[at] == ids
        both = int(met.sum())
        theirs = other[at[met]]
        out += int((np.abs(own[met] - theirs) - np.abs(theirs - none)).sum() + np.abs(own[~met] - long_none).sum())
    else:
        out += int(np.abs(own - long_none).sum())
    return out + (size - len(ids) - len(long_ids) + both) * abs(none - long_none)


def _tables(docs: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """groups (lang, source, total, terms), kept (lang, term, id, n) and counts (lang, source, id, term, n, lang_n), all written."""
    counts = materialize(term_counts(docs), "term-counts")
    of_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    kept = materialize(of_lang.select("lang", "term", "lang_n"), "kept-terms")
    # Ids rise within a task and tell terms apart. A block is a stretch of one task's rows, so that there are no more tasks than blocks.
    few = max(1, -(-kept.count() // BLOCK))
    kept = materialize(kept.coalesce(few).withColumn("id", F.monotonically_increasing_id()), "kept-terms")
    mine = materialize(counts.join(kept, ["lang", "term"]).select("lang", "source", "id", "term", "n", "lang_n"), "kept-counts")
    terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = mine.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    groups = _plain(docs).select(*GROUP).distinct().join(totals, GROUP, "left").join(terms, "lang", "left").na.fill(0, ["total", "terms", "lang_total"])
    return materialize(groups, "groups"), kept, mine


def _block(size: int) -> Column:
    return F.call_function("div", F.col("id"), F.lit(size)).alias("block")


def source_pairs(groups: DataFrame, kept: DataFrame, counts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lang, source, other, value) for each ordered pair of a language's sources."""
    prepare(groups.sparkSession)
    sizes = kept.groupBy("lang", _block(block)).agg(F.count(F.lit(1)).alias("size"))
    arrays = counts.groupBy("lang", "source", _block(block)).agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("t"))
    # Each group has a row for each of its language's blocks, also where it has no term of a block.
    cells = groups.join(sizes, "lang").join(arrays, ["lang", "source", "block"], "left")
    cells = materialize(cells.select("lang", "block", "size", "terms", "source", "total", F.col("t.id").alias("ids"), F.col("t.n").alias("counts")), "term-arrays")
    # A language's groups are dealt to bands; two bands of a block make a task, however many groups there are.
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    bands = max(1, -(-most // SIDE))
    band, every = F.pmod(F.xxhash64("source"), F.lit(bands)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(bands - 1)))
    left = cells.select("*", band.alias("a"), every.alias("b"))
    right = cells.select("lang", "block", F.col("source").alias("other"), F.col("total").alias("other_total"), F.col("ids").alias("other_ids"), F.col("counts").alias("other_counts"), band.alias("b"), every.alias("a"))
    tasks = left.join(right, ["lang", "block", "a", "b"]).where("source < other").select("lang", "source", "other", "size", "terms", "total", "other_total", "ids", "counts", "other_ids", "other_counts")

    def numbers(col, i) -> np.ndarray:
        v = col[i]
        return v.values.to_numpy() if v.is_valid else np.zeros(0, np.int64)

    def measure(batches):
        for b in batches:
            size, terms, total, other_total = (b.column(i).to_pylist() for i in range(3, 7))
            out = [
                pair_difference((numbers(b.column(7), i), numbers(b.column(8), i), total[i]), (numbers(b.column(9), i), numbers(b.column(10), i), other_total[i]), terms[i], size[i])
                for i in range(b.num_rows)
            ]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.int64())], names=["lang", "source", "other", "value"])

    parts = tasks.mapInArrow(measure, "lang string, source string, other string, value long")
    once = parts.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    both = once.select("lang", F.explode(F.array(F.struct("source", "other"), F.struct(F.col("other").alias("source"), F.col("source").alias("other")))).alias("p"), "value")
    found = both.select("lang", "p.source", "p.other", "value")
    # Languages that keep no term have no block.
    bare = groups.where("terms = 0").select(*GROUP)
    pairs = bare.join(bare.select("lang", F.col("source").alias("other")), "lang").where(F.col("source") != F.col("other"))
    return found.unionByName(pairs.select("lang", "source", "other", F.lit(0).cast("long").alias("value")))


def telling_terms(groups: DataFrame, counts: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, term, value, rank): the terms whose price in a group lies furthest above that in its language."""
    priced = counts.join(groups, GROUP).withColumns({"p": price(F.col("n"), F.col("total"), F.col("terms")), "q": price(F.col("lang_n"), F.col("lang_total"), F.col("terms"))})
    w = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "term")
    above = priced.where("p > q").select(*GROUP, "term", (F.col("p") - F.col("q")).alias("value"))
    return above.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank: all pairs of a language's sources (part ``pair``) and telling terms (part ``term``)."""
    groups, kept, counts = _tables(docs, min_docs)
    w = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    pairs = source_pairs(groups, kept, counts, block).withColumnRenamed("other", "item").withColumn("rank", F.row_number().over(w))
    terms = telling_terms(groups, counts, top).withColumnRenamed("term", "item")
    parts = [d.select(*GROUP, F.lit(part).alias("part"), "item", "value", "rank") for part, d in (("pair", pairs), ("term", terms))]
    return parts[0].unionByName(parts[1])
