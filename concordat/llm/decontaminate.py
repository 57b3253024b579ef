"""Benchmark decontamination as a prefix-filtered set join, on DataFrame functions only.

Benchmark items are cut into windows of ``size`` consecutive words (an item of
fewer words is one window). Words are ordered by rarity over all documents; a
document can only contain a window if it has the window's rarest word, the one
necessary prefix token of a containment join. Document words meet those tokens
by hash join; a positional bound (the window has to start at or after the first
word) and a length bound (and end by the last) come next, then exact comparison
of the document's words with the window.

The windows are broadcast only while their words and item lists have up to
``BROADCAST_WORDS`` entries; beyond that the candidates are shuffled, texts join
them again to be compared, and items are joined to the hits.

Texts are split once a pass: words leave their arrays by ``explode_outer``, since
for ``explode`` Spark first filters by the number of words and splits again for
it. The row of null that a text without words gets meets no key.

Null and empty texts have no words and are never contaminated. Rows of equal id
and text come out as often as they stand in the input; rows that repeat an id
with another text are judged apart. Only the id and text columns are read. With
an empty benchmark nothing is hit; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concordat.llm.common import LOWER, UPPER, WORD, join_spread
from concordat.session import materialize

SIZE = 13
#: Windows of up to so many words and items in all (about 100 bytes each at most) are broadcast.
BROADCAST_WORDS = 500_000


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def windows(benchmark: DataFrame, size: int = SIZE, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(wid, words, item): the windows of each item, distinct; items as strings."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (size - 1)))
    cut = items.select("item", F.explode_outer(F.transform(starts, lambda i: F.slice("w", i, size))).alias("words")).where("size(words) > 0").distinct()
    return cut.select(F.xxhash64(F.array_join("words", " "), F.size("words")).alias("wid"), "words", "item")


def anchors(docs_words: DataFrame, wins: DataFrame, small: bool) -> DataFrame:
    """Each window with its rarest word over all documents and that word's first place (from 0).

    A word that very many windows hold is a hot key: its count reaches them by
    broadcast (see ``join_spread``).
    """
    each = wins.select("wid", F.posexplode("words").alias("at", "word"))
    vocabulary = materialize(each.groupBy("word").agg(F.count(F.lit(1)).alias("uses")), "vocabulary")
    seen = docs_words.select(F.explode_outer("words").alias("word")).join(F.broadcast(vocabulary.select("word")) if small else vocabulary.select("word"), "word", "left_semi")
    counts = vocabulary.join(seen.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word", "left").select("word", "uses", F.coalesce("n", F.lit(0)).alias("n"))
    counts = materialize(counts, "counts")
    ranked = each.join(F.broadcast(counts), "word") if small else join_spread(each, counts, ["word"], "uses", each.count())
    rarest = ranked.groupBy("wid").agg(F.min(F.struct("n", "word", "at")).alias("a"))
    return wins.join(rarest, "wid").select("wid", F.col("a.word").alias("anchor"), F.col("a.at").cast("int").alias("at"), F.col("words").alias("window"), F.size("words").alias("len"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, share: int = 20, id_col: str = "doc_id", text_col: str = "text", broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and share * n_hit >= n_words), items of every row."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    d = d.select("doc_id", F.xxhash64("text").alias("h"), words_of(F.col("text")).alias("words"))
    cut = materialize(windows(benchmark, size), "windows")
    owners = cut.select("wid", "item").distinct()
    # The words of the windows and the entries of their item lists are what would be broadcast.
    small = cut.agg(F.coalesce(F.sum(F.size("words") + 1), F.lit(0))).first()[0] <= broadcast_words
    wins = cut.select("wid", "words").distinct()
    keyed = anchors(d, wins, small)
    if small:
        keyed = keyed.join(owners.groupBy("wid").agg(F.array_sort(F.collect_set("item")).alias("items")), "wid")
    keyed = materialize(keyed, "anchors")
    first = F.col("pos") - F.col("at")
    fits = (first >= 0) & (first + F.col("len") <= F.size("words"))
    found = fits & (F.slice("words", F.greatest(first, F.lit(0)) + 1, F.col("len")) == F.col("window"))
    if small:
        # The row past the last word carries the text's length: each text is read and split once.
        each = d.select("doc_id", "h", "words", F.posexplode(F.concat("words", F.array(F.lit("")))).alias("pos", "word"))
        near = each.join(F.broadcast(keyed), F.col("word") == F.col("anchor"), "left")
        got = near.where((F.col("word") == "") | found).select(
            "doc_id", "h", F.when(F.col("word") == "", F.col("pos")).alias("n_words"), first.alias("start"), (first + F.col("len")).alias("stop"), "items"
        )
    else:
        at = d.select("doc_id", "h", F.posexplode_outer("words").alias("pos", "word")).join(keyed.select("wid", "anchor", "at"), F.col("word") == F.col("anchor"))
        tries = at.where(first >= 0).select("doc_id", "h", "wid", first.alias("start")).distinct()
        checked = (
            d.withColumnsRenamed({"doc_id": "id", "h": "hh"}).join(tries, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("h").eqNullSafe(F.col("hh"))).join(keyed, "wid")
            .where(F.slice("words", F.col("start") + 1, F.col("len")) == F.col("window"))
        )
        checked = materialize(checked.select("doc_id", "h", "wid", "start", (F.col("start") + F.col("len")).alias("stop")).distinct(), "hits")
        none = F.lit(None)
        places = checked.select("doc_id", "h", none.cast("int").alias("n_words"), "start", "stop", none.cast("array<string>").alias("items"))
        # An item counts once a text, however many of its windows occur there.
        named = checked.select("doc_id", "h", "wid").distinct().join(owners, "wid").select("doc_id", "h", "item").distinct()
        items = named.select("doc_id", "h", none.cast("int").alias("n_words"), none.cast("int").alias("start"), none.cast("int").alias("stop"), F.array("item").alias("items"))
        every = d.select("doc_id", "h", F.size("words").alias("n_words"), none.cast("int").alias("start"), none.cast("int").alias("stop"), none.cast("array<string>").alias("items"))
        got = every.unionByName(places).unionByName(items)
    # Words of a union of intervals: what each adds to the furthest end before it.
    w = Window.partitionBy("doc_id", "h").orderBy(F.col("start").asc_nulls_first(), "stop").rowsBetween(Window.unboundedPreceding, -1)
    added = got.withColumn("new", F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(F.max("stop").over(w), F.lit(0)))))
    per = added.groupBy("doc_id", "h").agg(
        F.max("n_words").cast("long").alias("n_words"), F.coalesce(F.sum("new"), F.lit(0)).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.count("n_words").alias("copies"),
    )
    out = per.select(
        "doc_id", "h", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"), "items", "copies",
    )
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copy", "copies")


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated."""
    bad = decontaminate(docs, benchmark).where("contaminated").select("doc_id", "h").distinct().alias("bad")
    d = docs.alias("d")
    return d.join(bad, F.col("d.doc_id").eqNullSafe(F.col("bad.doc_id")) & (F.xxhash64("d.text") == F.col("bad.h")), "left_anti")
