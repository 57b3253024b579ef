"""Matching fed rows to target records: exact rules, fuzzy blocking, source dedup."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concordat.functions import vector
from concordat.functions.text import blank, casefold
from concordat.session import materialize, ship


@dataclass(frozen=True)
class IdentityRule:
    """``source`` over the fed rows equals ``target`` over the snapshot; ``name`` is the identity's name."""

    name: str
    source: Column
    target: Column


def identity_match(df: DataFrame, row_id: str, target: DataFrame, target_id: str, rules: list[IdentityRule], carry: Column | None = None) -> DataFrame:
    """Adds target_ref, match_status (matched, conflict, not_found), identity_rule, identity_value.

    With ``carry``, a column over the target, also ``existing``: its value in the matched record.

    Rules count in order: the first whose key finds one record wins, and one that
    finds several is a conflict unless an earlier one matched. All rules go
    through one exploded join, one shuffle; keys are aggregated on the target
    side first, and blank keys never reach the exchange. Rows that match nothing
    take the first rule with a key as their identity.
    """
    side = None
    held = carry if carry is not None else F.lit(None).cast("string")
    for i, r in enumerate(rules):
        part = target.select(F.lit(i).alias("ord"), r.target.cast("string").alias("key"), F.col(target_id).cast("string").alias("tid"), held.alias("held"))
        side = part if side is None else side.unionByName(part)
    # Whether a key has one record or several is all that matters: min and max tell.
    side = side.where(~blank(F.col("key"))).groupBy("ord", "key").agg(F.min("tid").alias("lo"), F.max("tid").alias("hi"), F.min_by("held", "tid").alias("held"))
    keys = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(r.name).alias("rule"), r.source.cast("string").alias("key")) for i, r in enumerate(rules)])
    tries = df.select(row_id, F.explode(keys).alias("t")).select(row_id, "t.*").where(~blank(F.col("key")))
    hit = F.col("lo").isNotNull()
    per = tries.join(side, ["ord", "key"], "left").groupBy(row_id).agg(
        F.min_by(F.struct("lo", "hi", "rule", "key", "held"), F.when(hit, F.col("ord"))).alias("won"), F.min_by(F.struct("rule", "key"), "ord").alias("own"),
    )
    found = F.col("won.lo").isNotNull()
    clash = found & (F.col("won.lo") != F.col("won.hi"))
    return df.join(per, row_id, "left").withColumns({
        "match_status": F.when(clash, "conflict").when(found, "matched").otherwise("not_found"),
        "target_ref": F.when(found & ~clash, F.col("won.lo")),
        "identity_rule": F.coalesce("won.rule", "own.rule"), "identity_value": F.coalesce("won.key", "own.key"),
    } | ({"existing": F.when(found & ~clash, F.col("won.held"))} if carry is not None else {})).drop("won", "own")


@dataclass(frozen=True)
class Comparator:
    field: str
    kind: str = "exact"  # exact, casefold, similarity
    weight: float = 1.0


def _compare(c: Comparator) -> Column:
    a, b = F.col(f"s_{c.field}").cast("string"), F.col(f"c_{c.field}").cast("string")
    if c.kind == "similarity":
        return vector.similarity(a, b)
    same = casefold(a) == casefold(b) if c.kind == "casefold" else a == b
    return F.coalesce(same, F.lit(False)).cast("double")


def block_candidates(df: DataFrame, row_id: str, target: DataFrame, target_id: str, blocks: list[str], max_candidates: int, fields: list[str]) -> DataFrame:
    """(row_id, cand_id, ord, s_*, c_*): candidates by block keys in order, each id once, capped before scoring.

    The cap is part of the operator: the first ``max_candidates`` by block order
    and id. So a block needs only its first ``max_candidates`` ids: of any earlier
    block's ids fewer than that were taken, or none of this one is. Tasks cut
    blocks before the shuffle, and a hot block never pairs all its rows.
    """
    def keys(d, key_id, name):
        each = F.array(*[F.struct(F.lit(i).alias("ord"), F.col(b).cast("string").alias("key")) for i, b in enumerate(blocks)])
        return d.select(F.col(key_id).alias(name), F.explode(each).alias("k")).select(name, "k.*").where(~blank(F.col("key")))

    of_block = Window.partitionBy("ord", "key").orderBy("cand_id")
    few = keys(target, target_id, "cand_id").withColumn("__n", F.row_number().over(of_block)).where(F.col("__n") <= max_candidates).drop("__n")
    pairs = keys(df, row_id, row_id).join(few, ["ord", "key"])
    first = pairs.groupBy(row_id, "cand_id").agg(F.min("ord").alias("ord"))
    w = Window.partitionBy(row_id).orderBy("ord", "cand_id")
    capped = first.withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= max_candidates)
    source = df.select(row_id, *[F.col(f).alias(f"s_{f}") for f in fields])
    other = target.select(F.col(target_id).alias("cand_id"), *[F.col(f).alias(f"c_{f}") for f in fields])
    return capped.join(source, row_id).join(other, "cand_id")


def score_candidates(pairs: DataFrame, comparators: list[Comparator], digits: int = 4) -> DataFrame:
    """Adds ``score``: the weighted mean of comparators; a null scores 0 and keeps its weight."""
    ship(pairs.sparkSession)
    total = sum(c.weight for c in comparators)
    return pairs.withColumn("score", F.bround(sum((_compare(c) * F.lit(c.weight) for c in comparators), F.lit(0.0)) / F.lit(total), digits))


def _bound(c: Comparator) -> Column:
    """What a comparator's value can't exceed, by built-in functions.

    Of a similarity: the characters that both texts have, each as often as it
    occurs in both, are all that matching blocks can hold.
    """
    if c.kind != "similarity":
        return _compare(c)
    a, b = F.col(f"s_{c.field}").cast("string"), F.col(f"c_{c.field}").cast("string")
    size = F.char_length(a) + F.char_length(b)
    times = lambda s, x: F.char_length(s) - F.char_length(F.replace(s, x, F.lit("")))
    shared = F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0), lambda n, x: n + F.when(x == "", 0).otherwise(F.least(times(a, x), times(b, x))))
    return F.when(a.isNull() | b.isNull(), 0.0).when(size == 0, 1.0).otherwise(F.lit(2.0) * shared / size)


def score_top(pairs: DataFrame, row_id: str, comparators: list[Comparator], top: int, digits: int = 4) -> DataFrame:
    """Pairs with ``score``, as ``score_candidates``, of all that can be among the ``top`` of their row.

    Each row's ``top`` pairs by what their scores can't exceed are scored first.
    Of the others only those go to the comparison of texts that may reach the
    least of these scores; the rest can't be among the best, ties included.
    """
    total = sum(c.weight for c in comparators)
    bound = F.bround(sum((_bound(c) * F.lit(c.weight) for c in comparators), F.lit(0.0)) / F.lit(total), digits)
    w = Window.partitionBy(row_id).orderBy(F.desc("bound"), "ord")
    ranked = materialize(pairs.withColumn("bound", bound).withColumn("__place", F.row_number().over(w)), "bounded")
    first = materialize(score_candidates(ranked.where(F.col("__place") <= top), comparators, digits), "first-scores")
    least = first.groupBy(row_id).agg(F.min("score").alias("__least"))
    more = ranked.where(F.col("__place") > top).join(least, row_id).where(F.col("bound") >= F.col("__least")).drop("__least")
    return first.unionByName(score_candidates(more, comparators, digits)).drop("__place", "bound")


def fuzzy_decision(scored: DataFrame, row_id: str, accept: float, review: float, tie_delta: float = 0.0, top_k: int = 3) -> DataFrame:
    """(row_id, decision, cand_id, score, top): a tie of the two best comes first, then the thresholds."""
    w = Window.partitionBy(row_id).orderBy(F.desc("score"), "ord")
    ranked = scored.withColumns({"rank": F.row_number().over(w), "next": F.lead("score").over(w)})
    kept = ranked.where(F.col("rank") <= max(top_k, 1))
    top = F.transform(F.array_sort(F.collect_list(F.struct("rank", "cand_id", "score"))), lambda x: F.struct(x["cand_id"].alias("cand_id"), x["score"].alias("score")))
    per = kept.groupBy(row_id).agg(F.min_by(F.struct("cand_id", "score", "next"), "rank").alias("best"), top.alias("top"))
    gap = F.col("best.score") - F.col("best.next")
    tie = F.lit(tie_delta > 0) & F.coalesce(gap < tie_delta, F.lit(False))
    decision = F.when(tie, "ambiguous").when(F.col("best.score") >= accept, "matched").when(F.col("best.score") >= review, "review").otherwise("not_found")
    return per.select(row_id, decision.alias("decision"), F.col("best.cand_id").alias("cand_id"), F.col("best.score").alias("score"), "top")


def source_dedup(df: DataFrame, key: str, fingerprint: Column, order: str = "line_no") -> DataFrame:
    """Adds ``dedup``: first, duplicate (content of the first) or conflict (other content). Rows without a key are 'first'.

    Always against the first row of a key, by ``order``, which tells rows apart.
    Firsts are aggregated, which tasks do ahead of the shuffle, and joined back;
    Spark splits the rows of a hot key.
    """
    df = df.withColumn("__f", fingerprint)
    firsts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.min(F.struct(F.col(order).alias("o"), F.col("__f").alias("f"))).alias("__first"))
    out = df.join(firsts, F.col(key) == F.col("__k"), "left")
    state = F.when(F.col("__first").isNull() | (F.col(order) == F.col("__first.o")), "first").when(F.col("__f") == F.col("__first.f"), "duplicate").otherwise("conflict")
    return out.withColumn("dedup", state).drop("__f", "__k", "__first")
