"""The sync plan: what has to be created, updated or skipped in a target.

feed -> map -> normalize -> match key -> identity match -> fuzzy match -> topology
-> source dedup -> links -> diff -> operation.

Matching is staged: rows that a stage settles are set aside, and only those still
open go through the next, dearer one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concordat.functions.ops import fingerprint
from concordat.operators import diagnostics as dg
from concordat.operators.lookup import match_key
from concordat.operators.links import LinkRule, Waiting, apply_links, link_requests, settle_by_path
from concordat.operators.match import Comparator, IdentityRule, block_candidates, fuzzy_decision, identity_match, score_candidates, score_top, source_dedup
from concordat.operators.resolve import DiffRule, default_rules, field_changes, fill_from_existing, operation, same_content, target_id
from concordat.operators.rules import MapRule, NormalizeRule, SinkField, check_sink, map_rows, normalize_rows
from concordat.session import materialize
from concordat.sources.keyed_log import KeyedLog


@dataclass(frozen=True)
class FuzzyRule:
    """Fuzzy matching of rows that no identity found: ``blocks`` and ``fields`` are (name, column over rows, column over the target)."""

    blocks: tuple[tuple[str, Column, Column], ...]
    fields: tuple[tuple[str, Column, Column], ...]
    comparators: tuple[Comparator, ...]
    accept: float = 0.9
    review: float = 0.75
    tie_delta: float = 0.0
    top_k: int = 3
    max_candidates: int = 20


@dataclass(frozen=True)
class TopologyRule:
    """Position in a tree as a tie-breaker of matches.

    ``segments``: the row's canonical path; ``node``: the target's node id;
    ``paths``: (node_id, path) of the target's tree. ``apply_on``: 'ambiguous_only'
    looks at ambiguous rows with several candidates, 'all_candidates' at all rows
    that have any. A row whose path fits no candidate is ambiguous. ``on_missing``:
    what happens to rows without a path, 'skip' or 'hard_error'.
    """

    segments: Column
    node: Column
    paths: DataFrame
    apply_on: str = "ambiguous_only"
    on_missing: str = "skip"


@dataclass(frozen=True)
class SyncSpec:
    """A data set's rules. ``identity`` rules are over mapped rows and the target."""

    rules: list[MapRule]
    identity: list[IdentityRule]
    diff: list[DiffRule]
    key: list[str]
    target_id: str
    normalize: list[NormalizeRule] = field(default_factory=list)
    sink: list[SinkField] = field(default_factory=list)
    dedup: bool = False
    #: Links between records, and how those that find nothing wait.
    links: list[LinkRule] = field(default_factory=list)
    waiting: Waiting = Waiting()
    #: Fields of the target that a row keeps where it has none of its own; blank ones too with ``fill_blank``.
    fill: list[str] = field(default_factory=list)
    fill_blank: bool = False
    fuzzy: FuzzyRule | None = None
    topology: TopologyRule | None = None
    #: Fields compared as they are where there are no ``diff`` rules; rows of equal content skip the comparison.
    state: list[str] = field(default_factory=list)


def _match(rows: DataFrame, row_id: str, target: DataFrame, spec: SyncSpec, held: Column) -> DataFrame:
    """Adds match_status, match_reason, match_score, target_ref, existing and the identity, stage by stage."""
    rows = identity_match(rows, row_id, target, spec.target_id, spec.identity, carry=held)
    reason = F.when(F.col("match_status") == "matched", "identity_exact").when(F.col("match_status") == "conflict", "identity_conflict").otherwise("identity_not_found")
    rows = rows.withColumns({"match_reason": reason, "match_score": F.when(F.col("match_status") == "matched", 1.0)})
    if spec.fuzzy is None and spec.topology is None:
        return rows
    rows = materialize(rows, "identity")
    every = spec.topology is not None and spec.topology.apply_on == "all_candidates"
    goes_on = F.col("row_ok") & (F.col("match_status") == "not_found") if spec.fuzzy else F.lit(False)
    settled = rows.where(~goes_on)
    pairs = settled.where("match_status = 'matched'").select(row_id, F.col("target_ref").alias("cand_id"), F.lit(1).alias("place"), F.lit(1.0).cast("double").alias("score")) if every else None
    out = settled
    if spec.fuzzy:
        scored = materialize(_score(rows.where(goes_on), row_id, target, spec), "scored")
        fuzzy = _fuzzy(rows.where(goes_on), row_id, target, spec, held, scored)
        ranked = scored.select(row_id, "cand_id", F.row_number().over(Window.partitionBy(row_id).orderBy(F.desc("score"), "ord")).alias("place"), "score")
        pairs = ranked if pairs is None else pairs.unionByName(ranked)
        out = settled.unionByName(fuzzy)
    if spec.topology is None or pairs is None:
        return out
    out = materialize(out, "fuzzy") if spec.fuzzy else out
    seen = F.col("row_ok") & (F.lit(every) & F.col("match_status").isin("matched", "ambiguous", "not_found") | (F.col("match_status") == "ambiguous"))
    return out.where(~seen).unionByName(_place(out.where(seen), row_id, target, spec, held, pairs), allowMissingColumns=True)


def _score(open_: DataFrame, row_id: str, target: DataFrame, spec: SyncSpec) -> DataFrame:
    """(row, candidate) pairs of the fuzzy rule's blocks with their scores."""
    rule = spec.fuzzy
    named = [*rule.blocks, *rule.fields]
    left = open_.select(row_id, *[s.cast("string").alias(n) for n, s, _ in named])
    right = target.select(F.col(spec.target_id).cast("string").alias("__tid"), *[t.cast("string").alias(n) for n, _, t in named])
    found = block_candidates(left, row_id, right, "__tid", [n for n, _, _ in rule.blocks], rule.max_candidates, [n for n, _, _ in rule.fields])
    if spec.topology is None:
        return score_top(found, row_id, list(rule.comparators), max(rule.top_k, 2))
    return score_candidates(found, list(rule.comparators))


def _records(target: DataFrame, spec: SyncSpec, held: Column) -> DataFrame:
    return target.select(F.col(spec.target_id).cast("string").alias("__tid"), held.alias("__held"))


def _fuzzy(open_: DataFrame, row_id: str, target: DataFrame, spec: SyncSpec, held: Column, scored: DataFrame) -> DataFrame:
    rule = spec.fuzzy
    told = fuzzy_decision(scored, row_id, rule.accept, min(rule.review, rule.accept), rule.tie_delta, rule.top_k)
    won = told.where("decision = 'matched'").join(_records(target, spec, held), F.col("cand_id") == F.col("__tid")).select(row_id, F.col("__held"))
    out = open_.drop("match_status", "match_reason", "match_score", "target_ref", "existing").join(told, row_id, "left").join(won, row_id, "left")
    d = F.col("decision")
    status = F.when(d == "matched", "matched").when(d.isin("ambiguous", "review"), "ambiguous").otherwise("not_found")
    reason = F.when(d == "matched", "fuzzy_accept").when(d == "ambiguous", "fuzzy_tie").when(d == "review", "fuzzy_review").when(d == "not_found", "fuzzy_reject").otherwise("fuzzy_no_candidates")
    out = out.withColumns({"match_status": status, "match_reason": reason, "match_score": F.col("score"), "target_ref": F.when(d == "matched", F.col("cand_id")), "existing": F.col("__held")})
    return out.drop("decision", "cand_id", "score", "top", "__held")


def _place(rows: DataFrame, row_id: str, target: DataFrame, spec: SyncSpec, held: Column, pairs: DataFrame) -> DataFrame:
    """Rows with candidates after their position in the tree."""
    rule = spec.topology
    nodes = target.select(F.col(spec.target_id).cast("string").alias("__tid"), rule.node.cast("string").alias("node"), held.alias("__held")).where("node is not null and node <> ''")
    cands = materialize(pairs.join(rows.select(row_id), row_id, "left_semi").join(nodes, F.col("cand_id") == F.col("__tid")).drop("__tid"), "placed")
    # Of candidates of one node the best stands for it.
    best = cands.groupBy(row_id, "node").agg(F.min_by(F.struct("cand_id", "__held", "score"), "place").alias("b"))
    has = pairs.groupBy(row_id).agg(F.count(F.lit(1)).alias("__cands"))
    rows = rows.withColumn("__path", rule.segments).join(has, row_id, "left")
    in_it = (F.coalesce("__cands", F.lit(0)) > (0 if rule.apply_on == "all_candidates" else 1))
    asked = rows.where(in_it & F.col("__path").isNotNull()).select(row_id, F.col(row_id).alias("set"), F.col("__path").alias("path"))
    told = settle_by_path(asked.join(best.select(row_id).distinct(), row_id, "left_semi"), row_id, best.select(F.col(row_id).alias("set"), F.col("node").alias("id")), rule.paths)
    won = told.join(best, (told[row_id] == best[row_id]) & (F.col("node_id") == F.col("node")), "left").select(told[row_id], F.col("mode").alias("__mode"), F.col("b").alias("__won"))
    out = rows.join(won, row_id, "left")
    one, mode = F.col("__won").isNotNull(), F.col("__mode")
    lost = in_it & F.col("__path").isNull() & F.lit(rule.on_missing == "hard_error")
    out = dg.add(out, errors=[dg.diag("match", "TOPOLOGY_PATH_MISSING", None, "the row has no path", lost)])
    status = F.when(one, "matched").when(mode.isNotNull(), "ambiguous").otherwise(F.col("match_status"))
    reason = F.when(one, F.concat(F.lit("topology_"), mode)).when(mode == "none", "topology_no_match").when(mode.isNotNull(), "topology_ambiguous").otherwise(F.col("match_reason"))
    return out.withColumns({
        "match_status": status, "match_reason": reason, "match_score": F.when(one, F.col("__won.score")).otherwise(F.col("match_score")),
        "target_ref": F.when(one, F.col("__won.cand_id")).when(mode.isNull(), F.col("target_ref")), "existing": F.when(one, F.col("__won.__held")).when(mode.isNull(), F.col("existing")),
        "row_ok": F.col("row_ok") & ~lost,
    }).drop("__path", "__cands", "__mode", "__won")


def build_plan(feed: DataFrame, target: DataFrame, spec: SyncSpec, row_id: str = "line_no", index: DataFrame | KeyedLog | None = None, batch: DataFrame | None = None, stored: DataFrame | None = None) -> DataFrame:
    """All rows with op, changes, target_ref, target_id, match_key, row_ok, errors, warnings.

    Matching comes before source dedup, which uses the identity that matched. The
    matched record comes along with the match, so that the target is read once.
    With links, ``index`` holds the stored records by data set (see
    ``links.resolve_links``), ``batch`` those of the current batch, and ``stored``
    the links that wait already. A link that finds nothing, or several records,
    waits or is an error by its rule's policy; a row with a link that waits has no
    operation unless ``spec.waiting`` lets rows go on (see ``pending_requests``).
    """
    rows = map_rows(feed, spec.rules, keep=(row_id,))
    if spec.normalize:
        rows = normalize_rows(rows, spec.normalize)
    if spec.sink:
        rows = check_sink(rows, spec.sink)
    key, err = match_key([F.col(k) for k in spec.key])
    rows = rows.withColumn("match_key", key)
    rows = dg.add(rows, errors=[dg.diag("enrich", "MATCH_KEY_BLANK", None, err, err.isNotNull())])
    rows = rows.withColumn("row_ok", ~dg.has_errors())
    diff = spec.diff or default_rules(spec.state)
    fields = [r.desired for r in diff]
    held = list(dict.fromkeys([r.existing or r.desired for r in diff] + spec.fill))
    rows = _match(rows, row_id, target, spec, F.struct(*held))
    if spec.dedup:
        rows = rows.withColumn("__dk", F.concat_ws(":", "identity_rule", "identity_value"))
        rows = source_dedup(rows, "__dk", fingerprint({f: F.col(f) for f in fields}), row_id).drop("__dk")
    else:
        rows = rows.withColumn("dedup", F.lit("first"))
    if spec.links:
        rows = apply_links(rows, row_id, spec.links, index, batch, spec.waiting, stored)
        rows = rows.withColumn("row_ok", F.col("row_ok") & ~F.col("stopped"))
    else:
        rows = rows.withColumns({"pending": F.lit(False), "stopped": F.lit(False)})
    rows = rows.withColumn("desired", F.struct(*fields))
    if spec.fill:
        merged = fill_from_existing(spec.fill, set(fields), spec.fill_blank)
        rows = rows.withColumn("desired", F.struct(*[merged[f].alias(f) if f in merged else F.col(f"desired.{f}").alias(f) for f in dict.fromkeys(fields + spec.fill)]))
    found = field_changes(diff)
    if not spec.diff:
        found = F.when(same_content(fields), F.create_map().cast("map<string,string>")).otherwise(found)
    rows = rows.withColumn("changes", F.when(F.col("match_status") == "matched", found))
    alive = F.col("row_ok") & (F.col("dedup") == "first") & ~F.col("match_status").isin("conflict", "ambiguous")
    rows = rows.withColumn("target_id", target_id(F.col("match_status"), F.col("target_ref"), F.col("match_key"))[0])
    rows = dg.add(
        rows,
        errors=[
            dg.diag("match", "IDENTITY_CONFLICT", None, "several records have this key", F.col("match_status") == "conflict"),
            dg.diag("resolve", "RESOLVE_AMBIGUOUS", None, "ambiguous match result", F.col("match_status") == "ambiguous"),
            dg.diag("match", "SOURCE_CONFLICT", None, "an earlier row has other values", F.col("dedup") == "conflict"),
        ],
        warnings=[dg.diag("match", "SOURCE_DUPLICATE", None, "an earlier row has the same values", F.col("dedup") == "duplicate")],
    )
    return rows.withColumn("op", F.when(alive, operation(F.col("match_status"), F.col("changes")))).withColumn("row_ok", alive)


def pending_requests(plan: DataFrame, row_id: str = "line_no") -> DataFrame:
    """Requests of a plan's links that wait, for ``pending.upsert_pending``: one a link and row, in the data set of its rule."""
    return link_requests(plan, row_id, F.to_json("desired"))
