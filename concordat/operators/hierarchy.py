"""Trees: validation, paths by pointer jumping, anchoring verdicts, tie-breaking ladders.

Loops run about log2(depth) rounds; each round is written to the shared folder,
and only counts come to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concordat.functions.text import blank, strip
from concordat.operators.diagnostics import add, diag, with_channels
from concordat.session import materialize


def duplicate_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def missing_parents(nodes: DataFrame) -> DataFrame:
    """Nodes whose parent is no node."""
    ids = nodes.select(F.col("node_id").alias("parent_id"))
    return nodes.where(F.col("parent_id").isNotNull()).join(ids, "parent_id", "left_anti").select("node_id", "parent_id")


def first_nodes(nodes: DataFrame, order: str) -> DataFrame:
    """One row per node id, the first by ``order``."""
    per = nodes.groupBy("node_id").agg(F.min_by(F.struct(*nodes.columns), F.struct(order)).alias("__first"))
    return per.select("__first.*")


def repeated_nodes(nodes: DataFrame, order: str) -> DataFrame:
    """(node_id, kept, dropped): for each row that ``first_nodes`` drops its ``order`` and that of the row that stays."""
    firsts = nodes.groupBy("node_id").agg(F.min(order).alias("kept"))
    return nodes.join(firsts, "node_id").where(F.col(order) != F.col("kept")).select("node_id", "kept", F.col(order).alias("dropped"))


def anchored_nodes(nodes: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The nodes that no verdict drops."""
    return nodes.join(verdicts.where("verdict <> 'anchored'").select("node_id"), "node_id", "left_anti")


def jump(nodes: DataFrame) -> DataFrame:
    """(node_id, top, depth, done): the furthest ancestor reached and steps to it; not done: on or below a cycle.

    Each round doubles the steps. A chain that ends and is longer than two rounds
    reach has nodes at every depth in between, so that as soon as a round settles
    no node, what is open can't end: rounds follow the depth, not the node count.
    """
    cur = materialize(nodes.select("node_id", F.coalesce("parent_id", "node_id").alias("top"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("parent_id").isNull().alias("done")), "jump")
    left = cur.where("not done").count()
    while left:
        up = cur.select(F.col("node_id").alias("top"), F.col("top").alias("__t"), F.col("depth").alias("__d"), F.col("done").alias("__f"))
        nxt = cur.join(up, "top", "left").select(
            "node_id", F.when(F.col("done") | F.col("__t").isNull(), F.col("top")).otherwise(F.col("__t")).alias("top"),
            (F.col("depth") + F.when(F.col("done"), 0).otherwise(F.coalesce("__d", F.lit(0)))).alias("depth"),
            (F.col("done") | F.col("__t").isNull() | F.coalesce("__f", F.lit(False))).alias("done"),
        )
        cur = materialize(nxt, "jump")
        before, left = left, cur.where("not done").count()
        if left == before:
            break
    return cur


def anchor_verdicts(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """(node_id, verdict, broken_at): anchored, missing_parent, unanchored_subtree or cycle.

    A chain of parents ends well at a root or at an id of ``targets`` (node_id).
    ``missing_parent`` is the node whose own parent is not there; what lies below
    it is ``unanchored_subtree``. ``broken_at`` is the absent parent, or, of a
    cycle, the node on it that the smallest node id leading into it enters first.
    """
    known = targets.select(F.col("node_id").alias("parent_id")).distinct().withColumn("__held", F.lit(True))
    ids = nodes.select(F.col("node_id").alias("parent_id")).distinct().withColumn("__node", F.lit(True))
    linked = nodes.select("node_id", "parent_id").join(known, "parent_id", "left").join(ids, "parent_id", "left")
    # A held parent that is no node of the feed makes its child a root; an absent one ends the chain badly.
    fit = linked.select("node_id", "parent_id", F.when(F.col("__node"), F.col("parent_id")).alias("up"), (F.col("parent_id").isNotNull() & F.col("__node").isNull() & F.col("__held").isNull()).alias("broken"))
    held_nodes = targets.select("node_id").distinct().withColumn("__own", F.lit(True))
    fit = materialize(fit.join(held_nodes, "node_id", "left").withColumn("up", F.when(F.col("__own").isNull(), F.col("up"))).withColumn("broken", F.col("broken") & F.col("__own").isNull()).drop("__own"), "anchor")
    reach = jump(fit.select("node_id", F.col("up").alias("parent_id")))
    ends = fit.select(F.col("node_id").alias("top"), "broken", F.col("parent_id").alias("lost"))
    out = reach.join(ends, "top")
    verdict = F.when(~F.col("done"), "cycle").when(~F.col("broken"), "anchored").when(F.col("top") == F.col("node_id"), "missing_parent").otherwise("unanchored_subtree")
    told = out.select("node_id", verdict.alias("verdict"), F.when(F.col("broken") & F.col("done"), F.col("lost")).alias("broken_at"))
    if told.where("verdict = 'cycle'").isEmpty():
        return told
    told = materialize(told, "verdicts")
    entries = _cycle_entries(fit.select("node_id", F.col("up").alias("parent_id")).join(told.where("verdict = 'cycle'").select("node_id"), "node_id", "left_semi"))
    return told.join(entries, "node_id", "left").select("node_id", "verdict", F.coalesce("broken_at", "__entry").alias("broken_at"))


def _cycle_entries(nodes: DataFrame) -> DataFrame:
    """(node_id, __entry) of nodes that all end in cycles: the cycle node that the least node id leading into the same cycle enters first.

    One table doubles each walk: where it is, and the least id it has met. Once a
    round changes no least id and no longer narrows where walks are, the latter
    are the nodes on cycles and the former name each cycle by its least id.
    """
    nodes = materialize(nodes, "cyclic")
    walk, spread = nodes.select("node_id", F.col("parent_id").alias("at"), F.least("node_id", "parent_id").alias("low")), -1
    while True:
        more = walk.select(F.col("node_id").alias("at"), F.col("at").alias("__t"), F.col("low").alias("__l"))
        walk = materialize(walk.join(more, "at").select("node_id", F.col("__t").alias("at"), F.least("low", "__l").alias("low"), (F.col("__l") < F.col("low")).alias("fell")), "walk")
        told = walk.agg(F.count_if("fell").alias("fell"), F.countDistinct("at").alias("spread")).first()
        if not told.fell and told.spread == spread:
            break
        walk, spread = walk.drop("fell"), told.spread
    on = materialize(walk.select(F.col("at").alias("node_id")).distinct(), "on-cycle")
    ring = walk.join(on, "node_id", "left_semi").select("node_id", F.col("low").alias("ring"))
    # The first cycle node of each walk: itself on a cycle, else found by doubling over the nodes that are not.
    mark = on.withColumn("__on", F.lit(True))
    first = nodes.join(mark, "node_id", "left").select("node_id", F.when(F.col("__on"), F.col("node_id")).otherwise(F.col("parent_id")).alias("enter"))
    while True:
        first = materialize(first.join(mark.withColumnRenamed("node_id", "enter"), "enter", "left").select("node_id", "enter", F.col("__on").isNotNull().alias("in")), "enter")
        if first.where("not in").isEmpty():
            break
        hop = first.select(F.col("node_id").alias("enter"), F.col("enter").alias("__e"))
        first = first.join(hop, "enter").select("node_id", F.when(F.col("in"), F.col("enter")).otherwise(F.col("__e")).alias("enter"))
    named = first.join(ring.select(F.col("node_id").alias("enter"), "ring"), "enter")
    pick = named.groupBy("ring").agg(F.min_by("enter", "node_id").alias("__entry"))
    return named.join(pick, "ring").select("node_id", "__entry")


def build_tree(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes or none, problems): any duplicate, missing parent or cycle empties the tree."""
    dup = duplicate_nodes(nodes).select("node_id", F.lit("duplicate").alias("problem"))
    lost = missing_parents(nodes).select("node_id", F.lit("missing_parent").alias("problem"))
    loop = jump(first_nodes(nodes, "parent_id")).where("not done").select("node_id", F.lit("cycle").alias("problem"))
    problems = materialize(dup.unionByName(lost).unionByName(loop).distinct(), "problems")
    return (nodes if problems.isEmpty() else nodes.limit(0)), problems


def path_table(nodes: DataFrame) -> DataFrame:
    """(node_id, path_ids, path, depth, root_id) from root to node, of a tree (node_id, parent_id, label).

    Each round doubles the paths. One that holds a node twice runs through a
    cycle: it ends there, and nodes on or below a cycle have null paths.
    """
    cur = materialize(nodes.select("node_id", F.col("parent_id").alias("up"), F.array("node_id").alias("path_ids"), F.array("label").alias("path")), "paths")
    while not cur.where("up is not null").isEmpty():
        above = cur.select(F.col("node_id").alias("up"), F.col("up").alias("__up"), F.col("path_ids").alias("__i"), F.col("path").alias("__p"))
        none = F.array()
        cur = materialize(
            cur.join(above, "up", "left").select(
                "node_id", F.col("__up").alias("up"), F.when(F.col("__i").isNull(), F.col("path_ids")).otherwise(F.concat("__i", "path_ids")).alias("path_ids"),
                F.when(F.col("__p").isNull(), F.col("path")).otherwise(F.concat("__p", "path")).alias("path"),
            ).withColumn("up", F.when(F.size("path_ids") == F.size(F.array_distinct("path_ids")), F.col("up")))
            .withColumn("path_ids", F.when(F.size("path_ids") == F.size(F.array_distinct("path_ids")), F.col("path_ids"))), "paths",
        )
        # Below a path that broke off nothing can be known either.
        broken = cur.where("path_ids is null").select(F.col("node_id").alias("up")).withColumn("__lost", F.lit(True))
        if not broken.isEmpty():
            cur = materialize(
                cur.join(broken, "up", "left").select("node_id", F.when(F.col("__lost").isNull(), F.col("up")).alias("up"), F.when(F.col("__lost").isNull(), F.col("path_ids")).alias("path_ids"), "path"), "paths",
            )
    cur = cur.withColumn("path", F.when(F.col("path_ids").isNotNull(), F.col("path")))
    return cur.select("node_id", "path_ids", "path", (F.size("path_ids") - 1).alias("depth"), F.get("path_ids", F.lit(0)).alias("root_id"))


def children(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(F.array_sort(F.collect_list("node_id")).alias("children"))


def descendants(paths: DataFrame) -> DataFrame:
    """(node_id, descendant_id, distance) from the path table; order by the id path for pre-order."""
    each = paths.select(F.col("node_id").alias("descendant_id"), F.col("depth").alias("at"), F.posexplode("path_ids").alias("pos", "node_id"), F.col("path_ids").alias("order_path"))
    return each.where("node_id <> descendant_id").select("node_id", "descendant_id", (F.col("at") - F.col("pos")).alias("distance"), "order_path")


def interval_labels(nodes: DataFrame) -> DataFrame:
    """(node_id, lo, hi, depth): an ancestor's open interval holds those of all below it; ``lo`` is pre-order by node id, ``hi`` post-order.

    The tree is walked around: each node is entered and left, and what follows
    each of these steps is known from the node, its first child, its next sibling
    and its parent. Positions on the walk are found by doubling, in about
    log2(nodes) rounds whatever the depth, with no path or list of children.
    Nodes on or below a cycle, or whose parent is no node, have null labels.
    """
    nodes = nodes.select("node_id", "parent_id")
    up = materialize(jump(missing_as_root(nodes)), "reached")
    good = up.where("done").select("node_id", F.col("top").alias("root"))
    sound = missing_parents(nodes).select(F.col("node_id").alias("root"))
    tree = materialize(nodes.join(good.join(sound, "root", "left_anti"), "node_id").drop("root"), "sound")
    # Siblings in order, and the next one, over all parents: ordered parts with the number of rows before each.
    line = numbered(tree, ["parent_id", "node_id"])
    after = line.select((F.col("at") - 1).alias("at"), F.col("node_id").alias("next"), F.col("parent_id").alias("__p"))
    sib = materialize(line.join(after, "at", "left").select("node_id", "parent_id", F.when(F.col("parent_id").eqNullSafe(F.col("__p")), F.col("next")).alias("next")), "siblings")
    kid = tree.where("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(F.min("node_id").alias("kid"))
    step = lambda node, leave: F.struct(node.alias("node"), F.lit(leave).alias("leave"))
    known = sib.join(kid, "node_id", "left")
    enter = F.struct(step(F.col("node_id"), False).alias("s"), F.when(F.col("kid").isNotNull(), step(F.col("kid"), False)).otherwise(step(F.col("node_id"), True)).alias("to"), F.lit(1).alias("rise"))
    leave = F.struct(step(F.col("node_id"), True).alias("s"), F.when(F.col("next").isNotNull(), step(F.col("next"), False)).when(F.col("parent_id").isNotNull(), step(F.col("parent_id"), True)).alias("to"), F.lit(-1).alias("rise"))
    walk = known.select(F.explode(F.array(enter, leave)).alias("w")).select("w.s", "w.to", F.lit(1).cast("long").alias("steps"), F.col("w.rise").cast("long").alias("rise"))
    walk = materialize(walk, "walk")
    # Steps to the end of the walk, and how far it rises from here on.
    while not walk.where("to is not null").isEmpty():
        ahead = walk.select(F.col("s").alias("to"), F.col("to").alias("__to"), F.col("steps").alias("__n"), F.col("rise").alias("__r"))
        walk = materialize(walk.join(ahead, "to", "left").select("s", F.col("__to").alias("to"), (F.col("steps") + F.coalesce("__n", F.lit(0))).alias("steps"), (F.col("rise") + F.coalesce("__r", F.lit(0))).alias("rise")), "walk")
    total = 2 * tree.count()
    at = lambda leave: F.max(F.when(F.col("s.leave") == leave, F.lit(total) - F.col("steps")))
    placed = walk.groupBy(F.col("s.node").alias("node_id")).agg(at(False).alias("lo"), at(True).alias("hi"), (-F.max(F.when(~F.col("s.leave"), F.col("rise")))).alias("depth"))
    return nodes.select("node_id").join(placed, "node_id", "left")


def missing_as_root(nodes: DataFrame) -> DataFrame:
    """The nodes, those whose parent is no node as roots."""
    held = nodes.select(F.col("node_id").alias("parent_id")).distinct().withColumn("__held", F.lit(True))
    return nodes.join(held, "parent_id", "left").select("node_id", F.when(F.col("__held"), F.col("parent_id")).alias("parent_id"))


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``at``, its row number from 0 by ``order``, with no task that holds all rows: parts by range, and what lies before each."""
    parts = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()), "ordered")
    split = F.shiftright("__m", 33)
    counts = parts.groupBy(split.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))  # one row a task
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    return parts.withColumn("__part", split).join(F.broadcast(before), "__part").withColumn("at", F.col("__before") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__m", "__part", "__before")


def is_below(node: str, ancestor: str) -> Column:
    """Does the node of labels ``<node>lo``, ``<node>hi`` lie below that of ``<ancestor>lo``, ``<ancestor>hi``? A comparison of ranges."""
    return (F.col(f"{ancestor}lo") < F.col(f"{node}lo")) & (F.col(f"{node}hi") < F.col(f"{ancestor}hi"))


def descendant_counts(labels: DataFrame) -> DataFrame:
    """(node_id, below): how many nodes lie below each; no join."""
    return labels.where("lo is not null").select("node_id", F.call_function("div", F.col("hi") - F.col("lo") - F.lit(1), F.lit(2)).alias("below"))


def descendants_in(labels: DataFrame, some: DataFrame, stretch: int = 1 << 12) -> DataFrame:
    """(node_id, descendant_id, distance) for the nodes of ``some`` (node_id), in pre-order by ``lo``: a range join by stretches of the walk.

    A node's interval is cut at the stretches it crosses, so that a large one is
    shared by many tasks.
    """
    cut = lambda c: F.call_function("div", F.col(c), F.lit(stretch))
    asked = labels.join(some.select("node_id").distinct(), "node_id").where("lo is not null").select("node_id", F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), F.col("depth").alias("__depth"), F.explode(F.sequence(cut("lo"), cut("hi"))).alias("__s"))
    each = labels.where("lo is not null").select(F.col("node_id").alias("descendant_id"), "lo", "depth", cut("lo").alias("__s"))
    return asked.join(each, "__s").where("lo > __lo and lo < __hi").select("node_id", "descendant_id", (F.col("depth") - F.col("__depth")).alias("distance"), "lo")


def structural_signature(paths: DataFrame) -> DataFrame:
    return paths.withColumn("signature", F.sha2(F.to_json(F.struct("path", "root_id", "depth")), 256))


def profile(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    return paths.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("depth") == 0).alias("roots"), F.max("depth").cast("long").alias("max_depth"))


def readiness(nodes: DataFrame, refreshed_at: Column, now: Column, max_age_seconds: int, revision: Column) -> DataFrame:
    """One row: ready, empty, stale or no_revision."""
    age = F.unix_timestamp(now) - F.unix_timestamp(refreshed_at)
    n = F.count(F.lit(1))
    return nodes.agg(n.alias("nodes")).withColumn("state", F.when(F.col("nodes") == 0, "empty").when(age > max_age_seconds, "stale").when(blank(revision), "no_revision").otherwise("ready"))


def prefix_tree(paths: DataFrame, path: str = "path") -> DataFrame:
    """Nodes of all prefixes of paths: node_id (a hash of the prefix), parent_id, label, depth. Blank segments are dropped."""
    clean = paths.select(F.filter(F.col(path), lambda x: ~blank(x)).alias("p")).where("size(p) > 0")
    ident = lambda a: F.when(F.size(a) > 0, F.sha2(F.to_json(a), 256))
    each = clean.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.slice("p", 1, i))).alias("x")).distinct()
    return each.select(ident(F.col("x")).alias("node_id"), ident(F.slice("x", F.lit(1), F.size("x") - 1)).alias("parent_id"), F.try_element_at("x", F.lit(-1)).alias("label"), (F.size("x") - 1).alias("depth"))


def path_checks(paths: DataFrame, path: str = "path", order: str = "line_no") -> DataFrame:
    """Adds path_state: ok, empty (no segment that is not blank), gaps (some blank), repeated (seen before)."""
    clean = F.filter(F.col(path), lambda x: ~blank(x))
    out = paths.withColumn("__c", clean)
    firsts = out.where(F.size("__c") > 0).groupBy(F.col("__c").alias("__k")).agg(F.min(order).alias("__first"))
    out = out.join(firsts, F.col("__c") == F.col("__k"), "left")
    empty = F.coalesce(F.size("__c") <= 0, F.lit(True))
    state = F.when(empty, "empty").when(F.col(order) != F.col("__first"), "repeated").when(F.size("__c") < F.size(path), "gaps").otherwise("ok")
    return out.withColumn("path_state", state).drop("__c", "__k", "__first")


def ladder(df: DataFrame, row_id: str, segments: str, candidates: DataFrame, paths: DataFrame) -> DataFrame:
    """(row_id, mode, node_id): candidates (row_id, node_id) narrowed by path: whole path, then the last
    two segments, then leaf, root and depth. The first rung with a hit decides; several hits are ambiguous.

    A candidate outside the tree hits no rung.
    """
    each = candidates.join(df.select(row_id, F.col(segments).alias("__s")), row_id).join(paths.select("node_id", "path"), "node_id", "left")
    s, p = F.col("__s"), F.coalesce("path", F.array().cast("array<string>"))
    tail = lambda a: F.slice(a, -2, 2)
    last, head = lambda a: F.try_element_at(a, F.lit(-1)), lambda a: F.get(a, F.lit(0))
    usable = (F.size(s) > 0) & (F.size(p) > 0)
    rungs = {
        "exact_path": usable & (s == p), "last_two": (F.size(s) > 1) & (F.size(p) > 1) & F.when((F.size(s) > 1) & (F.size(p) > 1), tail(s) == tail(p)).otherwise(False),
        "leaf_root_depth": usable & (last(s) == last(p)) & (head(s) == head(p)) & (F.size(s) == F.size(p)),
    }
    hit = {n: F.coalesce(c, F.lit(False)) for n, c in rungs.items()}
    aggs = [F.count_if(c).alias(f"n_{n}") for n, c in hit.items()] + [F.min(F.when(c, F.col("node_id"))).alias(f"id_{n}") for n, c in hit.items()]
    per = each.groupBy(row_id).agg(*aggs)
    mode, node = F.lit(None).cast("string"), F.lit(None).cast("string")
    for n in reversed(list(rungs)):
        mode = F.when(F.col(f"n_{n}") > 1, F.lit(f"{n}:ambiguous")).when(F.col(f"n_{n}") == 1, F.lit(n)).otherwise(mode)
        node = F.when(F.col(f"n_{n}") > 1, F.lit(None).cast("string")).when(F.col(f"n_{n}") == 1, F.col(f"id_{n}").cast("string")).otherwise(node)
    return per.select(row_id, F.coalesce(mode, F.lit("none")).alias("mode"), node.alias("node_id"))


def filter_by_verdict(df: DataFrame, node: Column, verdicts: DataFrame, policy: str = "warn") -> DataFrame:
    """Adds node_verdict, row_ok and a diagnostic: rows of dropped nodes get a warning under 'warn', else an error, and are no longer ok."""
    bad = verdicts.where("verdict <> 'anchored'").select(F.col("node_id").alias("__id"), F.col("verdict").alias("node_verdict"))
    out = df.join(bad, strip(node.cast("string")) == F.col("__id").cast("string"), "left").drop("__id")
    found = [diag("topology", "NODE_DROPPED", None, F.col("node_verdict"), F.col("node_verdict").isNotNull())]
    out = add(with_channels(out), warnings=found) if policy == "warn" else add(with_channels(out), errors=found)
    return out.withColumn("row_ok", F.lit(True) if policy == "warn" else F.col("node_verdict").isNull())
