"""Links between records: an index of identities by data set, lookups in key order, narrowing, policies.

A rule looks its keys up in its own target data set; the first key that has
candidates decides, several candidates are narrowed by further keys, and what is
still open is settled by the position in a tree, or waits, or is an error, by
policy. Rules count in order: one that reads the field of an earlier rule sees the
id found there, and an error of an earlier rule ends the row.

Keys are aggregated before rows meet them, and narrowing works on distinct
questions (a key and the keys that narrow it) from the rarest key on, so that
neither rows nor ids of a frequent key multiply and no list of a key's ids is made.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions.text import blank
from concordat.operators import diagnostics as dg
from concordat.session import materialize
from concordat.sources.keyed_log import KeyedLog

#: A key of an index: entries of one data set under one name and value.
AT = ["dataset", "lookup_key"]


@dataclass(frozen=True)
class LinkRule:
    """``field`` refers to a record of ``dataset`` found by lookup keys, tried in order.

    ``keys``: (key name, column over the rows, or the name of one). A name that is
    the field of an earlier rule is read as that rule resolved it. ``narrow``:
    groups of such keys that thin out several candidates, in order. ``overrides``:
    a map column, by key name, whose values that are not blank go before the keys'
    own. A field that holds whole numbers is left as it is unless ``target_id`` is
    one of the keys. ``on_unresolved``: 'pending' or 'hard_error', for links that
    find no record or several. ``position``: see ``Position``. ``coerce``: 'int'
    spells ids that are whole numbers as such.
    """

    field: str
    keys: tuple[tuple[str, Column | str], ...]
    narrow: tuple[tuple[tuple[str, Column | str], ...], ...] = ()
    overrides: Column | None = None
    target_id: str | None = None
    dataset: str | None = None
    on_unresolved: str = "pending"
    position: Position | None = None
    coerce: str | None = None

    def __post_init__(self):
        if self.on_unresolved not in ("pending", "hard_error"):
            raise ValueError(f"unknown policy {self.on_unresolved!r}")

    def key(self, name: str, value: Column) -> Column:
        value = value.cast("string")
        if self.overrides is None:
            return value
        other = self.overrides[name].cast("string")
        return F.when(~blank(other), other).otherwise(value)

    def skipped(self, kinds: dict[str, str]) -> bool:
        """Is the field an id already? ``kinds``: types by column name."""
        return kinds.get(self.field) in ("tinyint", "smallint", "int", "bigint") and all(n != self.target_id for n, _ in self.keys)

    def reads(self) -> set[str]:
        """Columns that the keys name."""
        return {v for keys in (self.keys, *self.narrow) for _, v in keys if isinstance(v, str)}


@dataclass(frozen=True)
class Position:
    """Settle several candidates by their place in a tree.

    ``segments``: the row's path column; ``paths``: (node_id, path) of the
    candidates' tree. ``on_ambiguous`` and ``on_missing`` say what happens if
    several nodes fit, or none or the row has no path: pending, hard_error or
    skip, which leaves it to the rule's own policy.
    """

    segments: str
    paths: DataFrame
    on_ambiguous: str = "pending"
    on_missing: str = "skip"

    def __post_init__(self):
        for p in (self.on_ambiguous, self.on_missing):
            if p not in ("pending", "hard_error", "skip"):
                raise ValueError(f"unknown policy {p!r}")


@dataclass(frozen=True)
class Waiting:
    """How links wait: attempts until they become an error (0: no limit), and whether their rows go on without them."""

    max_attempts: int = 0
    allow_partial: bool = False


def link_key_names(rules: list[LinkRule]) -> set[str]:
    """Names of all keys that links are looked up by."""
    return {n for r in rules for keys in (r.keys, *r.narrow) for n, _ in keys}


# The index


def identity_index(records: DataFrame, record_id: str, keys: dict[str, Column], dataset: str | None = None) -> DataFrame:
    """(lookup_key, id), distinct: one entry for each key name and value that is not blank. With ``dataset`` that column too."""
    each = F.array(*[F.struct(F.lit(k).alias("name"), c.cast("string").alias("value")) for k, c in keys.items()])
    flat = records.where(F.col(record_id).isNotNull()).select(F.col(record_id).cast("string").alias("id"), F.explode(each).alias("k"))
    head = [] if dataset is None else [F.lit(dataset).alias("dataset")]
    return flat.where(~blank(F.col("k.value"))).select(*head, F.concat_ws(":", "k.name", "k.value").alias("lookup_key"), "id").distinct()


def lookup_ids(index: DataFrame) -> DataFrame:
    """(lookup_key, ids): sorted ids of a key, as one list. For keys with few ids; see ``key_stats``."""
    return index.groupBy("lookup_key").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def key_stats(index: DataFrame) -> DataFrame:
    """(dataset, lookup_key, n, least): how many ids a key has and the least; nothing grows with a key."""
    return index.groupBy(*[c for c in AT if c in index.columns]).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))


def batch_first(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Both indexes, with data sets or without, as one; any id of the current batch hides the stored ids of its key."""
    cols = [c for c in AT if c in stored.columns and c in batch.columns]
    hidden = batch.select(*cols).distinct()
    return batch.select(*cols, "id").unionByName(stored.select(*cols, "id").join(hidden, cols, "left_anti"))


def for_datasets(batch: DataFrame, rules: list[LinkRule]) -> DataFrame:
    """Batch entries (lookup_key, id) with the data sets of the rules that look for them: all of these where an entry names none."""
    all_ = F.array(*[F.lit(d) for d in sorted({r.dataset or "" for r in rules})])
    named = F.col("dataset") if "dataset" in batch.columns else F.lit(None).cast("string")
    return batch.select(F.explode(F.when(named.isNull(), all_).otherwise(F.array(named))).alias("dataset"), "lookup_key", "id").distinct()


def index_log(path: str, buckets: int = 256) -> KeyedLog:
    """A stored index (dataset, lookup_key, id), bucketed by data set and key."""
    return KeyedLog(path, ("dataset", "lookup_key", "id"), ("dataset", "lookup_key"), buckets)


def append_index(log: KeyedLog, entries: DataFrame, version: int) -> DataFrame:
    """Store a batch's entries (dataset, lookup_key, id) that are new, reading only the buckets they lie in; gives what was stored."""
    spark = entries.sparkSession
    entries = entries.select(*AT, "id").distinct()
    earlier = [v for v in log.versions(spark) if v < version]
    held = log.read(spark, earlier[-1], log.touched(entries)) if earlier else None
    new = materialize(entries if held is None else entries.join(held, [*AT, "id"], "left_anti"), "new-entries")
    log.append(new, version)
    return new


def _index(df: DataFrame, tries: DataFrame, index: DataFrame | KeyedLog, batch: DataFrame | None, rules: list[LinkRule]) -> DataFrame:
    """(dataset, lookup_key, id) of all keys that are tried, those of the batch before stored ones."""
    if isinstance(index, KeyedLog):
        index = index.read(df.sparkSession, buckets=index.touched(tries))
        if index is None:
            index = df.sparkSession.createDataFrame([], "dataset string, lookup_key string, id string")
    if "dataset" not in index.columns:
        index = for_datasets(index, rules) if any(r.dataset for r in rules) else index.withColumn("dataset", F.lit(""))
    return index.select(*AT, "id") if batch is None else batch_first(for_datasets(batch, rules), index)


# Lookups


def _sources(rules: list[LinkRule], i: int, done: set[int]) -> dict[str, Column]:
    """Columns that rule ``i`` reads by name, as the earlier rules ``done`` resolved them."""
    out = {}
    for name in rules[i].reads():
        c = F.col(name).cast("string")
        for j in range(i):
            if rules[j].field == name and j in done:
                c = F.when(F.col(f"{name}__status") == "resolved", F.col(f"{name}__id")).otherwise(c)
        out[name] = c
    return out


def _waves(rules: list[LinkRule]) -> list[list[int]]:
    """Rule numbers in rounds: a rule comes after the earlier rules whose fields it reads."""
    at: dict[int, int] = {}
    for i, r in enumerate(rules):
        at[i] = 1 + max((at[j] for j in range(i) if rules[j].field in r.reads()), default=-1)
    return [[i for i in at if at[i] == w] for w in range(max(at.values(), default=-1) + 1)]


def _lookup_key(rule: LinkRule, name: str, value: Column) -> Column:
    v = rule.key(name, value)
    return F.when(~blank(v), F.concat_ws(":", F.lit(name), v))


def _asked(rule: LinkRule, sources: dict[str, Column]) -> tuple[Column, Column]:
    """(lookup keys of the rule's own keys, in order; lookup keys of each narrowing group, null where one of it is blank)."""
    col = lambda v: sources[v] if isinstance(v, str) else v
    own = F.array_compact(F.array(*[_lookup_key(rule, n, col(v)) for n, v in rule.keys]))
    groups = []
    for keys in rule.narrow:
        g = F.array(*[_lookup_key(rule, n, col(v)) for n, v in keys])
        groups.append(F.when(~F.exists(g, lambda x: x.isNull()), g))
    return own, F.array(*groups).cast("array<array<string>>")


def resolve_links(df: DataFrame, row_id: str, rules: list[LinkRule], index: DataFrame | KeyedLog, batch: DataFrame | None = None) -> DataFrame:
    """Adds <field>__status (resolved, ambiguous, unresolved, none), <field>__id and <field>__keys for each rule.

    ``index``: distinct (dataset, lookup_key, id), or without data sets, or a
    stored index, of which only the buckets of the keys that are tried are read;
    ``batch``: entries of the current batch, which hide stored ones of their key.
    A rule with a position has <field>__position too: how its tree settled
    several candidates, or the policy that holds (pending, hard_error, skip).
    """
    kinds = dict(df.dtypes)
    done: set[int] = set()
    for wave in _waves(rules):
        active, plain = [], {}
        for i in wave:
            rule = rules[i]
            if rule.skipped(kinds):
                none = F.lit(None).cast("array<string>")
                plain |= {f"{rule.field}__status": F.lit("none"), f"{rule.field}__id": F.col(rule.field).cast("string"), f"{rule.field}__keys": none}
                continue
            own, groups = _asked(rule, _sources(rules, i, done))
            if rule.field in kinds:  # a field without a value is no link
                own = F.when(F.col(rule.field).isNotNull(), own).otherwise(F.array().cast("array<string>"))
            plain |= {f"{rule.field}__keys": own, f"{rule.field}__narrow": groups}
            active.append(i)
        df = df.withColumns(plain)
        if active:
            df = _wave(df, row_id, rules, active, index, batch)
        df = df.drop(*[f"{rules[i].field}__narrow" for i in active])
        done |= set(wave)
    return df


def _wave(df: DataFrame, row_id: str, rules: list[LinkRule], active: list[int], index: DataFrame | KeyedLog, batch: DataFrame | None) -> DataFrame:
    key = lambda i: rules[i].dataset or ""
    each = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(key(i)).alias("dataset"), F.col(f"{rules[i].field}__keys").alias("ks")) for i in active])
    tried = df.select(row_id, F.explode(each).alias("t")).select(row_id, "t.rule", "t.dataset", F.posexplode("t.ks").alias("ord", "lookup_key"))
    narrowing = [i for i in active if rules[i].narrow]
    wanted = tried.select(*AT)
    if narrowing and isinstance(index, KeyedLog):
        more = F.flatten(F.array(*[F.transform(F.flatten(F.array_compact(F.col(f"{rules[i].field}__narrow"))), lambda k, i=i: F.struct(F.lit(key(i)).alias("dataset"), k.alias("lookup_key"))) for i in narrowing]))
        wanted = wanted.unionByName(df.select(F.explode(more).alias("k")).select("k.*"))
    entries = _index(df, wanted, index, batch, rules)
    if narrowing or any(rules[i].position for i in active):
        entries = materialize(entries, "entries")
    stats = key_stats(entries)
    for i in active:
        if len(rules[i].keys) == 1:  # nothing to choose from: rows meet the counts of their key where they are
            mine = stats.where(F.col("dataset") == key(i)).select(F.col("lookup_key").alias("__lk"), F.struct("n", "least", "lookup_key").alias(f"__c{i}"))
            df = df.join(mine, F.get(f"{rules[i].field}__keys", F.lit(0)) == F.col("__lk"), "left").drop("__lk")
    several = [i for i in active if len(rules[i].keys) > 1]
    if several:
        hit = F.struct("ord", "n", "least", "lookup_key")
        per = tried.where(F.col("rule").isin(several)).join(stats, AT).groupBy(row_id).agg(*[F.min_by(hit, F.when(F.col("rule") == i, F.col("ord"))).alias(f"__c{i}") for i in several])
        df = df.join(per, row_id, "left")
    for i in active:
        f, c = rules[i].field, F.col(f"__c{i}")
        df = df.withColumns({f"__n{i}": c["n"], f"__one{i}": c["least"], f"__key{i}": c["lookup_key"], f"__set{i}": c["lookup_key"]})
        sets = entries.where(F.col("dataset") == key(i)).select(F.col("lookup_key").alias("set"), "id")
        if rules[i].narrow:
            df, sets = _narrow(df, f, i, len(rules[i].narrow), key(i), entries, sets)
        if rules[i].position:
            df = _settle(df, row_id, f, i, rules[i].position, sets)
        n = F.col(f"__n{i}")
        status = F.when(F.coalesce(F.size(f"{f}__keys"), F.lit(0)) <= 0, "none").when(n.isNull(), "unresolved").when(n == 1, "resolved").otherwise("ambiguous")
        df = df.withColumns({f"{f}__status": status, f"{f}__id": F.when(n == 1, F.col(f"__one{i}"))})
        df = df.drop(f"__c{i}", f"__n{i}", f"__one{i}", f"__key{i}", f"__set{i}")
    return df


def _narrow(df: DataFrame, field: str, i: int, groups: int, dataset: str, entries: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The counts of rows with several candidates after the rule's narrowing groups, in order.

    ``sets`` (set, id) has the candidates of each key of the rule's data set; those
    that groups leave are added to it. What a group asks is which ids the set that
    stands so far and all keys of the group have in common: each such question is
    answered once, however many rows ask it. Candidates come from the smallest of
    these sets, and each other one has to hold them too. A group that leaves none
    is passed over.
    """
    open_ = F.col(f"__n{i}") > 1
    asked = [F.col(f"__key{i}").alias("main"), F.col(f"{field}__narrow").alias("groups")]
    q = df.where(open_).select(*asked, F.col(f"__n{i}").alias("n"), F.col(f"__one{i}").alias("least")).groupBy("main", "groups").agg(F.max("n").alias("n"), F.min("least").alias("least"))
    q = materialize(q.withColumn("set", F.col("main")), "questions")
    mine = entries.where(F.col("dataset") == dataset)
    sizes = key_stats(mine).select(F.col("lookup_key").alias("set"), "n")
    for g in range(0 if q.isEmpty() else groups):
        group = F.get("groups", F.lit(g))
        every = F.when((F.col("n") > 1) & group.isNotNull(), F.array_sort(F.array_distinct(F.concat(F.array("set"), group))))
        q = q.withColumn("all", every)
        step = materialize(q.where("all is not null").select("all").distinct().withColumn("sid", F.monotonically_increasing_id()), "steps")
        flat = step.select("sid", "all", F.explode("all").alias("set")).join(sizes, "set")
        start = flat.groupBy("sid", "all").agg(F.min_by("set", F.struct("n", "set")).alias("rare"), F.count(F.lit(1)).alias("known"))
        start = start.where(F.col("known") == F.size("all")).select("sid", F.col("rare").alias("set"), F.array_except("all", F.array("rare")).alias("rest"))
        found = start.join(sets, "set").select("sid", "id", F.size("rest").alias("m"), F.explode_outer("rest").alias("set"))
        held = found.join(sets.withColumn("__in", F.lit(1)), ["set", "id"], "left").groupBy("sid", "id", "m").agg(F.count("__in").alias("k"))
        left = materialize(held.where("k = m").select("sid", "id"), "narrowed")
        mark = F.concat(F.lit(f"\0{i} {g} "), F.col("sid").cast("string"))  # no lookup key begins so
        cut = left.groupBy("sid").agg(F.count(F.lit(1)).alias("__n"), F.min("id").alias("__l")).join(step, "sid").select("all", mark.alias("__s"), "__n", "__l")
        sets = sets.unionByName(left.select(mark.alias("set"), "id"))
        sizes = sizes.unionByName(cut.select(F.col("__s").alias("set"), F.col("__n").alias("n")))
        q = q.join(cut, "all", "left").select("main", "groups", F.coalesce("__n", "n").alias("n"), F.coalesce("__l", "least").alias("least"), F.coalesce("__s", "set").alias("set"))
        q = materialize(q, "questions")
    told = q.select(F.col("main").alias("__main"), F.col("groups").alias("__groups"), F.col("n").alias("__qn"), F.col("least").alias("__ql"), F.col("set").alias("__qs"))
    out = df.join(told, (F.col(f"__key{i}") == F.col("__main")) & F.col(f"{field}__narrow").eqNullSafe(F.col("__groups")), "left")
    new = open_ & F.col("__qn").isNotNull()
    out = out.withColumns({
        f"__one{i}": F.when(new, F.col("__ql")).otherwise(F.col(f"__one{i}")), f"__set{i}": F.when(new, F.col("__qs")).otherwise(F.col(f"__set{i}")),
        f"__n{i}": F.when(new, F.col("__qn")).otherwise(F.col(f"__n{i}")),
    })
    return out.drop("__main", "__groups", "__qn", "__ql", "__qs"), sets


def _rungs(path: Column) -> Column:
    """What two paths have in common if they meet at a rung: (rung, value); whole path, last two segments, then leaf, root and depth."""
    last, head = F.try_element_at(path, F.lit(-1)), F.get(path, F.lit(0))
    rung = lambda n, v: F.struct(F.lit(n).alias("rung"), v.alias("value"))
    two = F.when(F.size(path) > 1, rung(1, F.slice(path, F.greatest(F.size(path) - 1, F.lit(1)), 2)))
    some = F.array_compact(F.array(rung(0, path), two, rung(2, F.array(last, head, F.size(path).cast("string")))))
    return F.when(F.size(path) > 0, some)


RUNGS = ("exact_path", "last_two", "leaf_root_depth")


def settle_by_path(rows: DataFrame, row_id: str, sets: DataFrame, paths: DataFrame) -> DataFrame:
    """(row_id, mode, node_id) of rows (row_id, set, path): which candidate of the row's set its path singles out.

    ``sets`` (set, id); ``paths`` (node_id, path). Candidates are counted by set
    and by what their path shows at each rung, before rows meet these counts:
    a row with a large set meets three of them.
    """
    spots = sets.join(paths.select(F.col("node_id").cast("string").alias("id"), F.col("path").alias("__p")), "id").select("set", "id", F.explode(_rungs(F.col("__p"))).alias("r"))
    met = spots.select("set", "r.rung", "r.value", "id").groupBy("set", "rung", "value").agg(F.countDistinct("id").alias("n"), F.min("id").alias("one"))
    asked = rows.select(row_id, "set", F.explode(_rungs(F.col("path"))).alias("r")).select(row_id, "set", "r.rung", "r.value")
    best = asked.join(met, ["set", "rung", "value"]).groupBy(row_id).agg(F.min_by(F.struct("rung", "n", "one"), "rung").alias("b"))
    name = F.get(F.array(*map(F.lit, RUNGS)), F.col("b.rung"))
    told = best.select(row_id, F.when(F.col("b.n") > 1, F.concat(name, F.lit(":ambiguous"))).otherwise(name).alias("mode"), F.when(F.col("b.n") == 1, F.col("b.one")).alias("node_id"))
    return rows.select(row_id).join(told, row_id, "left").withColumn("mode", F.coalesce("mode", F.lit("none")))


def _settle(df: DataFrame, row_id: str, field: str, i: int, position: Position, sets: DataFrame) -> DataFrame:
    """Rows with several candidates after their position; adds <field>__position."""
    open_ = F.col(f"__n{i}") > 1
    rows = df.where(open_ & F.col(position.segments).isNotNull()).select(row_id, F.col(f"__set{i}").alias("set"), F.col(position.segments).alias("path"))
    found = settle_by_path(rows, row_id, sets.join(rows.select("set").distinct(), "set", "left_semi"), position.paths)
    out = df.join(found, row_id, "left")
    one = open_ & F.col("node_id").isNotNull()
    why = F.when(one, F.col("mode")).when(open_ & F.endswith(F.coalesce("mode", F.lit("")), F.lit(":ambiguous")), position.on_ambiguous).when(open_, position.on_missing)
    return out.withColumns({
        f"{field}__position": why, f"__one{i}": F.when(one, F.col("node_id")).otherwise(F.col(f"__one{i}")), f"__n{i}": F.when(one, F.lit(1)).otherwise(F.col(f"__n{i}")),
    }).drop("mode", "node_id")


# Policies


def as_id(c: Column) -> Column:
    """An id as whole number text where it is one, else as it is."""
    return F.coalesce(c.try_cast("bigint").cast("string"), c.cast("string"))


def _requests(rules: list[LinkRule], kinds: dict[str, str]) -> list[tuple[int, Column]]:
    """(rule number, request or null) of links that are open: data set, field and the key that decided or the last one tried."""
    out = []
    for i, r in enumerate(rules):
        if not r.skipped(kinds):
            last = F.try_element_at(F.col(f"{r.field}__keys"), F.lit(-1))
            one = F.struct(F.lit(i).alias("rule"), F.lit(r.dataset).cast("string").alias("dataset"), F.lit(r.field).alias("field"), last.alias("lookup_key"))
            out.append((i, F.when(F.col(f"{r.field}__status").isin("unresolved", "ambiguous"), one)))
    return out


def apply_links(df: DataFrame, row_id: str, rules: list[LinkRule], index: DataFrame | KeyedLog, batch: DataFrame | None = None, waiting: Waiting = Waiting(), stored: DataFrame | None = None) -> DataFrame:
    """``resolve_links`` and what follows from it: fields set to ids, ``errors``, ``warnings``, ``pending``, ``stopped``, ``requests``.

    Rules count in order. An open link is an error that ends the row (hard_error),
    or it waits: a warning, a request, and the row stops unless rows may go on
    without it. A request that ``stored`` pending links (dataset, source_row_id,
    field, lookup_key, status, attempts) hold already counts another attempt; at
    the last one it is an error. A row that was stopped stays so, whatever later
    rules find; rules after a hard error, or after a position's wait that stops
    the row, are not looked at.
    """
    kinds = dict(df.dtypes)
    df = dg.with_channels(resolve_links(df, row_id, rules, index, batch))
    asked = _requests(rules, kinds)
    if stored is not None and waiting.max_attempts > 0 and asked:
        held = stored.where("status = 'pending'").select(F.coalesce("dataset", F.lit("")).alias("__d"), F.col("source_row_id").cast("string").alias("__r"), F.col("field").alias("__f"), F.col("lookup_key").alias("__k"), F.col("attempts").alias("__a"))
        flat = df.select(row_id, F.explode(F.array_compact(F.array(*[c for _, c in asked]))).alias("q")).select(row_id, "q.*")
        met = flat.join(held, (F.coalesce("dataset", F.lit("")) == F.col("__d")) & (F.col(row_id).cast("string") == F.col("__r")) & (F.col("field") == F.col("__f")) & (F.col("lookup_key") == F.col("__k")))
        tries = met.groupBy(row_id).agg(F.map_from_entries(F.collect_list(F.struct("rule", "__a"))).alias("__tries"))  # one entry a rule
        df = df.join(tries, row_id, "left")
    else:
        df = df.withColumn("__tries", F.lit(None).cast("map<int,int>"))
    no = F.lit(False)
    ended, stopped, pending, requests = no, no, no, []
    errors, warnings, fields = [], [], {}
    for i, ask in asked:
        r = rules[i]
        f, open_ = r.field, ask.isNotNull()
        policy = F.col(f"{f}__position") if r.position else F.lit(None).cast("string")
        placed = F.coalesce((F.col(f"{f}__status") == "ambiguous") & (policy == "pending"), no)
        hard = ~ended & open_ & (F.coalesce((F.col(f"{f}__status") == "ambiguous") & (policy == "hard_error"), no) | (~placed & F.lit(r.on_unresolved == "hard_error")))
        pend = ~ended & open_ & ~hard
        spent = pend & F.lit(waiting.max_attempts > 0) & (F.coalesce(F.try_element_at("__tries", F.lit(i)), F.lit(0)) + 1 >= waiting.max_attempts)
        reason = F.when(F.col(f"{f}__status") == "ambiguous", "multiple candidates found for link").otherwise("no candidates found for link")
        errors += [dg.diag("resolve", "RESOLVE_CONFLICT", f, reason, hard), dg.diag("resolve", "RESOLVE_MAX_ATTEMPTS", f, "pending max attempts reached", spent)]
        warnings.append(dg.diag("resolve", "RESOLVE_PENDING", f, reason, pend & ~spent))
        requests.append(F.when(pend, ask))
        if f in kinds:
            found = F.col(f"{f}__id")
            fields[f] = F.when(~ended & (F.col(f"{f}__status") == "resolved"), as_id(found) if r.coerce == "int" else found).otherwise(F.col(f).cast("string"))
        stops = spent | (pend & F.lit(not waiting.allow_partial))
        stopped, pending = stopped | hard | stops, pending | pend
        ended = ended | hard | (placed & stops)
    kept = F.array_compact(F.array(*requests)) if requests else F.array().cast("array<struct<rule:int,dataset:string,field:string,lookup_key:string>>")
    df = dg.add(df, errors, warnings)
    return df.withColumns({"pending": pending, "stopped": stopped, "requests": kept} | fields).drop("__tries")


def link_requests(rows: DataFrame, row_id: str, payload: Column) -> DataFrame:
    """The requests of ``apply_links`` for ``pending.upsert_pending``: one a link that waits, in the data set of its rule."""
    each = rows.where(F.size("requests") > 0).select(F.col(row_id).cast("string").alias("source_row_id"), payload.alias("payload"), F.explode("requests").alias("q"))
    return each.select("q.dataset", "source_row_id", "q.field", "q.lookup_key", "payload")
