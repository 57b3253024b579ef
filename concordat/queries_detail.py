"""Queries of single operations, policies and edge cases, with equivalent SQL; registered beside those of ``queries``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from concordat.functions.ops import op, run_chains
from concordat.functions.text import canonical_scalar, collapse
from concordat.operators import cache, diagnostics, hierarchy, links, lookup, match, pending, plan, resolve, rules, topology
from concordat.operators.rules import MapRule, SinkField
from concordat.plans.sync import SyncSpec, build_plan, pending_requests
from concordat.queries import _PLAN, _SOURCE, _TREE, QUERIES, SQL, feed, part_nodes, query, sync_spec, target, tree
from concordat.session import materialize, shared_dir, table
from concordat.sources import files, plan_store
from concordat.streaming import state

_STORED = "dataset string, source_row_id string, field string, lookup_key string, payload string, attempts int, status string, created_at timestamp, last_attempt_at timestamp, expires_at timestamp"


def _fresh(spark, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def _at(text: str):
    return F.lit(text).cast("timestamp")


# Sources


@query("SELECT CAST(row_number() OVER (ORDER BY c_custkey) + 1 AS BIGINT) AS line_no, 'line:' || (row_number() OVER (ORDER BY c_custkey) + 1) AS record_id, CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS c_name FROM customer")
def s4_csv_records(spark, sf):
    """Customers as a CSV feed of several files with a header, nulls spelled out, and its record numbers."""
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, " NULL ").otherwise(F.concat(F.lit(" "), "c_name")).alias("c_name"))
    path = _fresh(spark, "csv")
    c.repartitionByRange(4, "c_custkey").sortWithinPartitions("c_custkey").write.option("header", True).csv(path)
    rows = files.read_csv(spark, path, columns=["c_custkey", "c_name"])
    return rows.where("malformed is null").select("line_no", "record_id", "c_custkey", "c_name")


@query("SELECT CAST(row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS line_no, CAST(o_orderkey AS VARCHAR) AS col_0, o_orderstatus AS col_1, CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey AS VARCHAR) || ';' || o_orderstatus || ';x' END AS malformed FROM orders")
def s2_csv_without_header(spark, sf):
    """Orders without a header and with another separator; every fifth record has a field too many."""
    line = F.concat_ws(";", "o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "x"))
    path = _fresh(spark, "csv")
    table(spark, sf, "orders").repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey").select(line).write.text(path)
    return files.read_csv(spark, path, columns=["col_0", "col_1"], header=False, sep=";").select("line_no", "col_0", "col_1", "malformed")


@query("SELECT node_id, parent_id, lower(label) AS label FROM (SELECT 'r' || r_regionkey AS node_id, NULL AS parent_id, r_name AS label FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer)")
def s9_hierarchy_source(spark, sf):
    snapshot = tree(spark, sf).withColumn("label", F.concat(F.lit(" "), F.upper("label"))).withColumn("deletion_date", F.when(F.col("node_id").like("c%5"), "2024-01-01"))
    return files.hierarchy_source(snapshot, "node_id", "parent_id", "label")


def _pages(spark, sf):
    """Events landed as five pages, of which the third holds half as many items."""
    path = _fresh(spark, "pages")
    e = table(spark, sf, "events").where("event_id % 5 <> 2 or event_id % 2 = 0")
    e.select("event_id", (F.col("event_id") % 5).cast("int").alias("p")).repartition(5, "p").write.partitionBy("p").json(path)
    return path, e


@query("SELECT event_id FROM events WHERE event_id % 5 < 3 AND (event_id % 5 <> 2 OR event_id % 2 = 0)")
def s8_landed_pages(spark, sf):
    """Only the first three of five pages are read."""
    return files.snapshot_pages(spark, _pages(spark, sf)[0], "event_id long", max_pages=3).select("event_id")


@query("SELECT event_id FROM events WHERE event_id % 5 < 2 OR event_id % 5 = 2 AND event_id % 2 = 0")
def s8_short_page(spark, sf):
    """A page that is not full is the last one."""
    path, e = _pages(spark, sf)
    full = e.where("event_id % 5 in (0, 1)").count() // 2 * 9 // 10
    return files.snapshot_pages(spark, path, "event_id long", page_size=full).select("event_id")


@query("SELECT c_custkey, c_name FROM customer")
def s6_refuse_duplicates(spark, sf):
    """A dictionary whose keys are unique in normal form too."""
    c = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit(" "), "c_name").alias("c_name"))
    return files.refuse_duplicates(c, "c_name", norm=lambda k: F.lower(F.trim(k))).select("c_custkey", F.trim("c_name").alias("c_name"))


@query("SELECT event_id, user_id FROM events")
def ts1_micro_batches(spark, sf):
    """Events landed in four files, two of them a batch."""
    src = _fresh(spark, "landed")
    table(spark, sf, "events").select("event_id", "user_id").repartition(4, "event_id").write.parquet(src)
    return _drained(spark, files.micro_batches(spark, src, "event_id long, user_id long", "parquet", max_files=2))


@query(f"SELECT line_no, op, target_ref AS target_id FROM ({_PLAN}) WHERE op <> 'skip'")
def k1_plan_round_trip(spark, sf):
    made = build_plan(feed(spark, sf), target(spark, sf), sync_spec())
    items = plan.plan_items(made).select("line_no", "op", F.col("target_ref").alias("target_id"), F.lit(None).cast("string").alias("resource_id"), "match_key", F.lit("***").alias("password"), "changes")
    path = _fresh(spark, "plan")
    plan_store.write_plan(items, plan.plan_summary(made), path)
    return plan_store.read_plan(spark, path).where("password is null").select("line_no", "op", "target_id")


# Mapping and sink checks


@query("SELECT p_partkey, p_brand || '/' || p_type AS both_, split_part(p_name, ' ', 1) AS head, split_part(p_name, ' ', 2) AS tail, CASE WHEN p_size > 5 THEN CAST(p_size AS VARCHAR) END AS size, p_size > 5 AS row_ok FROM part WHERE p_size > 5 UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, false FROM part WHERE p_size <= 5")
def p2_map_several(spark, sf):
    """Several sources to one target, one source to several targets, required fields."""
    p = table(spark, sf, "part").withColumn("size", F.when(F.col("p_size") > 5, F.col("p_size").cast("string")).otherwise(" "))
    out = rules.map_rows(p, [
        MapRule(("both_",), ("p_brand", "p_type"), (op("concat", sep="/"),)), MapRule(("head", "tail"), ("p_name",), (op("split", sep=" "),)), MapRule(("size",), ("size",), (op("trim"),), required=True),
    ], keep=("p_partkey",))
    return out.select("p_partkey", "both_", "head", "tail", "size", "row_ok")


@query("SELECT c_custkey, c_custkey AS line_no, CASE WHEN c_custkey % 4 <> 0 THEN 'n' || c_nationkey END AS parent, c_name AS by_path, len(list_filter([CASE WHEN c_custkey % 3 <> 0 THEN 'x' END, c_name], lambda v: v IS NOT NULL)) AS n_ref FROM customer")
def p4_meta_and_paths(spark, sf):
    c = table(spark, sf, "customer").withColumn("line_no", F.col("c_custkey"))
    out = rules.with_meta(c, {"parent": F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("n"), "c_nationkey")), "none": F.lit(None)})
    ref = rules.source_ref({"code": F.when(F.col("c_custkey") % 3 != 0, "x").otherwise(" \t ")}, primary=("name", F.col("c_name")))
    return out.select("c_custkey", rules.path_column("row.line_no").alias("line_no"), rules.path_column("meta.parent").alias("parent"), rules.path_column("record.c_name").alias("by_path"), F.size(ref).cast("long").alias("n_ref"))


@query("SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS n_errors, CAST(CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n_warnings FROM events")
def p8_sink_types(spark, sf):
    """Checks of float, bool and required fields, on touched fields only, as errors or as warnings."""
    e = table(spark, sf, "events").select(
        "event_id", F.when(F.col("user_id") % 3 == 0, "n/a").otherwise("1.5").alias("amount"), F.when(F.col("event_id") % 5 == 0, "perhaps").otherwise("Yes").alias("flag"),
        F.when(F.col("event_id") % 7 == 0, " ").otherwise("x").alias("name"), F.lit("never looked at").alias("other"),
    )
    spec = [SinkField("amount", "float"), SinkField("flag", "bool"), SinkField("name", required=True), SinkField("other", "int")]
    out = rules.check_sink(e, spec, touched={"amount", "flag"})
    out = rules.check_sink(out, spec, as_warnings=True, touched={"name"})
    return out.select("event_id", F.size("errors").alias("n_errors"), F.size("warnings").alias("n_warnings"))


@query("SELECT event_id, CASE WHEN user_id % 2 = 0 THEN CAST(user_id AS BIGINT) END AS n, CASE WHEN user_id % 2 = 0 THEN 0 ELSE 1 END AS n_warned, CASE WHEN event_id % 9 = 0 THEN 'due: not of type bigint' END AS failed FROM events")
def p12_projection_policies(spark, sf):
    e = table(spark, sf, "events").withColumn("t", F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string")).otherwise("odd"))
    due = F.when(F.col("event_id") % 9 == 0, "late").otherwise("1")
    out = cache.project_items(e, [
        cache.CacheColumn("n", F.col("t"), "bigint", on_error="warn"), cache.CacheColumn("s", F.col("t"), "bigint", on_error="skip"),
        cache.CacheColumn("z", F.col("t"), "bigint", on_error="set_null"), cache.CacheColumn("due", due, "bigint"),
    ], keep=("event_id",))
    return out.where("s <=> z and s <=> n").select("event_id", "n", F.size("warned").alias("n_warned"), "failed")


@query("SELECT event_id, event_type IN ('click', 'error') AND user_id % 2 = 0 AS gone, user_id % 3 <> 0 AS yes FROM events")
def p14_flags(spark, sf):
    """Deletion by rules of which all must hold, and truth values of several spellings."""
    e = table(spark, sf, "events").withColumn("left_at", F.when(F.col("user_id") % 2 == 0, "2020").otherwise(" None "))
    gone = cache.soft_deleted(any_rules=[("equals", F.col("event_type"), "CLICK"), ("equals", F.col("event_type"), "error")], all_rules=[("not_null", F.col("left_at"))])
    yes = cache.truthy(F.when(F.col("user_id") % 3 == 0, "0.0").when(F.col("user_id") % 3 == 1, " YES ").otherwise("2"))
    return e.select("event_id", gone.alias("gone"), yes.alias("yes"))


@query("""SELECT p_partkey, '{"size":' || CASE WHEN p_size % 2 = 0 THEN '"' || p_size || '"' ELSE '"odd"' END || ',"kind":"part"}' AS shown, CASE WHEN p_size % 2 <> 0 THEN 'size: not of type int' END AS error,
 CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_partkey AS VARCHAR) END AS id, CASE WHEN p_partkey % 3 = 0 THEN 'no target id' END AS id_error FROM part""")
def p17_preview_and_ids(spark, sf):
    p = table(spark, sf, "part").withColumn("size", F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("odd"))
    fields = [plan.PayloadField("size", "size", "int"), plan.PayloadField("size", "kind", default="part")]
    shown, _ = plan.payload(fields, preview=True)
    _, err = plan.payload(fields)
    ident, missing = plan.id_params(F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("\t "), "p_partkey", F.lit(" \n"))).otherwise(" \t"))
    return p.select("p_partkey", shown.alias("shown"), err.alias("error"), ident.alias("id"), missing.alias("id_error"))


@query(f"""WITH v AS (SELECT node_id FROM ({_SOURCE}) WHERE parent_id >= 1000000)
SELECT p_partkey, v.node_id IS NULL AS row_ok, CAST(CASE WHEN v.node_id IS NULL THEN 0 ELSE 1 END AS INTEGER) AS n_errors, CAST(CASE WHEN v.node_id IS NULL THEN 0 ELSE 1 END AS INTEGER) AS n_warnings FROM part LEFT JOIN v ON v.node_id = p_partkey""")
def p20_topology_filter(spark, sf):
    """Rows of dropped nodes under both policies: an error and no row, or a warning."""
    p = table(spark, sf, "part").select("p_partkey")
    lost = hierarchy.missing_parents(part_nodes(spark, sf)).where("parent_id >= 1000000").select(F.col("node_id"), F.lit("missing_parent").alias("verdict"))
    key = F.concat(F.lit(" "), "p_partkey", F.lit("\t"))
    hard = hierarchy.filter_by_verdict(p, key, lost, "hard_error").select("p_partkey", "row_ok", F.size("errors").alias("n_errors"))
    soft = hierarchy.filter_by_verdict(p, key, lost, "warn").where("row_ok").select("p_partkey", F.size("warnings").alias("n_warnings"))
    return hard.join(soft, "p_partkey")


# Operations


@query("""SELECT p_partkey, upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS titled, upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS first_up, p_name || ' Shchuka Alpha e' AS ascii,
 split_part(p_name, ' ', 2) AS given, p_name AS last, p_size % 2 = 0 AS non_ascii, p_size % 3 = 0 AS empty, p_brand || '/$1 x' AS dollar FROM part""")
def f4_more_string_ops(spark, sf):
    p = table(spark, sf, "part")
    chains = {
        "titled": (F.col("p_type"), [op("title")]), "first_up": (F.col("p_name"), [op("upper_first")]), "ascii": (F.concat("p_name", F.lit(" Щука Άλφα é")), [op("transliterate"), op("regex_replace", pattern="Alpha|Alfa", repl="Alpha")]),
        "names": (F.col("p_name"), [op("split_name")]), "comma": (F.concat("p_name", F.lit(", X")), [op("split_name", fields=("last", "first"))]), "non_ascii": (F.when(F.col("p_size") % 2 == 0, "é").otherwise("e"), [op("contains_non_ascii")]),
        "empty": (F.when(F.col("p_size") % 3 == 0, " \t").otherwise("x"), [op("is_blank")]), "dollar": (F.col("p_brand"), [op("regex_replace", pattern="$", repl=r"/$1 \\x".replace("\\\\", ""))]),
    }
    out = run_chains(p, chains)
    return out.select("p_partkey", "titled", "first_up", "ascii", F.col("names.first").alias("given"), F.col("comma.last").alias("last"), "non_ascii", "empty", "dollar")


@query("""SELECT event_id, CASE WHEN user_id % 2 = 0 THEN CAST(user_id + 0.5 AS DOUBLE) END AS num, CASE WHEN user_id % 2 = 0 THEN NULL ELSE 'not a number' END AS num_err, event_type = 'click' AS yes, 'k' AS const, event_type AS copy,
 event_type = 'view' AS same, CASE WHEN event_type = 'view' THEN event_type ELSE 'other' END AS map_each, CAST(1 AS BIGINT) AS n_scalar, event_type AS first_scalar FROM events""")
def f21_more_value_ops(spark, sf):
    e = table(spark, sf, "events")
    chains = {
        "num": (F.when(F.col("user_id") % 2 == 0, F.concat(F.lit(" "), "user_id", F.lit(".5"))).otherwise("1.0d"), [op("to_float")]), "yes": (F.when(F.col("event_type") == "click", "TRUE").otherwise(" false"), [op("to_bool")]),
        "const": (F.col("event_type"), [op("const", value="k")]), "copy": (F.col("event_type"), [op("copy")]), "same": (F.array("event_type", F.lit("view")), [op("equals")]),
        "each": (F.array(F.concat(F.lit(" "), "event_type")), [op("map_each", ops=[op("trim"), op("regex_replace", pattern="^(?!view$).*", repl="other")]), op("last")]),
        "n_scalar": (F.col("event_type"), [op("compact"), op("unique"), op("count")]), "first_scalar": (F.col("event_type"), [op("first")]),
    }
    out = run_chains(e, chains)
    return out.select("event_id", F.when(F.col("num__err").isNull(), F.col("num")).alias("num"), F.col("num__err").alias("num_err"), "yes", "const", "copy", "same", F.col("each").alias("map_each"), F.col("n_scalar").cast("long").alias("n_scalar"), "first_scalar")


@query("""SELECT p_partkey, p_brand AS link, CASE WHEN p_size % 2 = 0 THEN '79' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') END AS mobile, CAST(p_size AS VARCHAR) AS ext, lower(p_name) AS scalar, p_name || ' x' AS collapsed,
 substr(sha256('uuid|' || p_partkey), 1, 8) AS uuid_head, substr(sha256('prefix|' || p_partkey), 1, 8) AS tail, p_brand AS kept FROM part""")
def f31_keys_patterns_and_made_values(spark, sf):
    p = table(spark, sf, "part")
    tokens = F.array(F.concat_ws(" ", F.lit("mob"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("79"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))), F.concat(F.lit("tel:"), F.col("p_size").cast("string"))))
    chains = {
        "link": (F.col("p_brand"), [op("build_link_keys", field="brand", link_type="name")]), "found": (tokens, [op("extract_patterns", patterns={"mobile": r"79\d{9}", "ext": r"\d{1,3}"}, keyed_prefixes=("tel:",))]),
        "made": (F.lit(None).cast("string"), [op("uuid", key="p_partkey")]), "pre": (F.lit(" "), [op("default_prefixed_uuid", prefix="u-", key="p_partkey")]), "kept": (F.col("p_brand"), [op("default_password", salt="s", key="p_partkey")]),
    }
    out = run_chains(p, chains)
    return out.select(
        "p_partkey", F.col("link")["brand"]["name"].alias("link"), "found.mobile", "found.ext", canonical_scalar(F.concat(F.lit(" "), "p_name"), [("trim",), ("lower",)]).alias("scalar"),
        collapse(F.concat(F.lit(" "), "p_name", F.lit("\t \n x "))).alias("collapsed"), F.substring("made", 1, 8).alias("uuid_head"), F.substring("pre", 3, 8).alias("tail"), "kept",
    )


@query("SELECT c_custkey, '***' AS token, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN '***' END AS inner_token FROM customer")
def f49_mask(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("token"), F.struct(F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("TOKEN")).alias("s"))
    out = plan.mask_fields(c, {"Token"})
    return out.select("c_custkey", "token", F.col("s.name").alias("name"), F.col("s.TOKEN").alias("inner_token"))


# Lookups


@query("SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'none' ELSE 'selected' END AS entry_status, c_name AS name, c_nationkey AS nation FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 3 <> 0")
def j4_canonicalize(spark, sf):
    c = table(spark, sf, "customer").where("c_custkey % 3 <> 0")
    out = lookup.canonicalize(table(spark, sf, "orders"), "o_orderkey", F.concat(F.lit(" "), "o_custkey"), c, F.col("c_custkey"), ["c_name", "c_nationkey"])
    return out.select("o_orderkey", "entry_status", F.col("entry.c_name").alias("name"), F.col("entry.c_nationkey").alias("nation"))


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name || ' large' ELSE p_name END AS name FROM part")
def j7_append_when(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", lookup.append_when(F.col("p_name"), F.when(F.col("p_size") != 7, F.col("p_size") > 25), F.lit(" large")).alias("name"))


@query("""SELECT c_custkey, n_name AS always, 'old' AS never, CASE WHEN c_custkey % 2 = 0 THEN n_name ELSE 'old' END AS empty, 'old' AS trusted FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def a2_merge_policies(spark, sf):
    n = table(spark, sf, "nation")
    old = {"always": F.lit("old"), "never": F.lit("old"), "empty": F.when(F.col("c_custkey") % 2 == 0, "").otherwise("old"), "trusted": F.lit("old")}
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", *[v.alias(k) for k, v in old.items()])
    by = {"always": "recompute_always", "never": "never", "empty": "if_empty", "trusted": "if_authoritative"}
    out = lookup.enrich(c, "c_custkey", [lookup.LookupRule(k, F.col("c_nationkey"), n, F.col("n_nationkey"), F.col("n_name"), merge=m) for k, m in by.items()])
    return out.select("c_custkey", *by)


@query("SELECT p_name AS key, list_slice(list_sort(list(CAST(p_partkey AS VARCHAR))), 1, 3) AS values_ FROM part GROUP BY p_name")
def l3_limited_lookup(spark, sf):
    """Candidates of a key up to a limit."""
    p = table(spark, sf, "part")
    keys = p.select(F.col("p_name").alias("key")).distinct()
    found = lookup.lookup(keys, "key", lookup.LookupRule("v", F.col("key"), p, F.col("p_name"), F.col("p_partkey")), limit=3)
    return found.select("key", F.transform("candidates", lambda c: c["value"]).alias("values_"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'own' WHEN c_custkey % 3 = 1 THEN c_name END AS token, CAST(CASE WHEN c_custkey % 3 = 2 THEN 1 ELSE 0 END AS INTEGER) AS n_missing FROM customer")
def j23_hydrate_secrets(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("match_key"), F.when(F.col("c_custkey") % 3 == 0, "own").alias("token"), "c_name")
    held = c.where("c_custkey % 3 = 1").select(F.lit("customer").alias("dataset"), "match_key", F.lit("token").alias("field"), F.col("c_name").alias("value"))
    out = lookup.hydrate_secrets(c, held, "customer", ["token"])
    return out.select("c_custkey", "token", F.size("missing_secrets").alias("n_missing"))


@query("SELECT 'customer' AS dataset, count(*) FILTER (c_custkey % 6 = 0) AS deleted, count(*) FILTER (c_custkey % 2 = 0 AND c_custkey % 3 <> 0) AS kept, count(*) FILTER (c_custkey % 2 <> 0 AND c_custkey % 3 = 0) AS skipped FROM customer")
def r18_retire_secrets(spark, sf):
    c = table(spark, sf, "customer").select(F.lit("customer").alias("dataset"), F.lit("token").alias("field"), F.col("c_custkey").cast("string").alias("match_key"), "c_custkey")
    return lookup.retire_counters(c.where("c_custkey % 2 = 0"), c.where("c_custkey % 3 = 0"))


@query("""SELECT p_partkey, policy, policy = 'error' AND p_size % 2 = 0 OR policy <> 'error' AS runs, CASE WHEN p_size % 2 <> 0 AND policy = 'error' THEN 'odd' END AS error, CASE WHEN p_size % 2 <> 0 AND policy = 'warn' THEN 'odd' END AS warning, CASE WHEN p_size % 2 <> 0 AND policy = 'needs_resolve' THEN 'odd' END AS hint
FROM part CROSS JOIN (VALUES ('error'), ('warn'), ('skip'), ('needs_resolve')) v(policy)""")
def r19_run_policies(spark, sf):
    """What a failure becomes under each policy, and whether a later operation runs on its row: never after errors."""
    p, out = table(spark, sf, "part"), None
    for policy in ("error", "warn", "skip", "needs_resolve"):
        got = lookup.outcome(F.when(F.col("p_size") % 2 != 0, "odd"), policy)
        part = p.select("p_partkey", F.lit(policy).alias("policy"), *[got[c].cast("string").alias(c) for c in ("error", "warning", "hint")])
        out = part if out is None else out.unionByName(part)
    return out.withColumn("runs", lookup.runs("never", F.col("error").isNotNull()))


# Matching and links


@query("""WITH b AS (SELECT a.p_partkey AS row_id, c.p_partkey AS cand_id, min(CASE WHEN a.p_name = c.p_name THEN 0 ELSE 1 END) AS o FROM part a JOIN part c ON (a.p_name = c.p_name OR (a.p_type = c.p_type AND a.p_brand = c.p_brand)) WHERE a.p_partkey % 2 = 0 AND c.p_partkey % 2 = 1 GROUP BY ALL),
r AS (SELECT row_id, cand_id, row_number() OVER (PARTITION BY row_id ORDER BY o, cand_id) AS ord FROM b) SELECT row_id, cand_id, CAST(ord AS INTEGER) AS ord FROM r WHERE ord <= 5""")
def u4_union_of_blocks(spark, sf):
    """Candidates of two block keys: each id once, by the first block that has it, the first five."""
    p = table(spark, sf, "part").withColumn("pair", F.concat_ws("|", "p_type", "p_brand"))
    return match.block_candidates(p.where("p_partkey % 2 = 0").withColumnRenamed("p_partkey", "row_id"), "row_id", p.where("p_partkey % 2 = 1"), "p_partkey", ["p_name", "pair"], 5, []).select("row_id", "cand_id", "ord")


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 AND o_orderkey % 2 = 0 THEN CAST(1 AS VARCHAR) ELSE CAST(o_custkey AS VARCHAR) END AS cust__id, CAST(o_custkey AS VARCHAR) AS done__id, 'none' AS done__status FROM orders""")
def j13_link_overrides(spark, sf):
    """A key from the meta map goes before the field's own; a field that is an id already is left alone."""
    o = table(spark, sf, "orders").withColumn("meta", F.create_map(F.lit("cust"), F.when((F.col("o_custkey") % 5 == 0) & (F.col("o_orderkey") % 2 == 0), "1").otherwise(" ")))
    o = o.select("o_orderkey", "meta", F.col("o_custkey").cast("string").alias("cust"), F.col("o_custkey").alias("done"))
    ids = o.select(F.concat(F.lit("cust:"), "cust").alias("lookup_key"), F.col("cust").alias("id")).unionByName(spark.range(1).select(F.lit("cust:1").alias("lookup_key"), F.lit("1").alias("id"))).distinct()
    both = [links.LinkRule("cust", (("cust", F.col("cust")),), overrides=F.col("meta")), links.LinkRule("done", (("cust", F.col("done")),))]
    return links.resolve_links(o, "o_orderkey", both, ids).select("o_orderkey", "cust__id", "done__id", "done__status")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'resolved' ELSE 'pending' END AS nation__status, CASE WHEN c_custkey % 2 = 0 THEN 'n' || c_nationkey END AS nation__id FROM customer")
def j18_link_by_position(spark, sf):
    """Ambiguous links settled by the position in a tree; the rest becomes pending."""
    c = table(spark, sf, "customer")
    paths = hierarchy.path_table(tree(spark, sf).where("node_id not like 'c%'"))
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    rows = c.join(n, F.col("n_nationkey") == F.col("c_nationkey")).join(r, F.col("r_regionkey") == F.col("n_regionkey"))
    rows = rows.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, topology.locator([F.concat(F.lit(" "), "r_name"), F.lit(" "), F.col("n_name")])).alias("segs"), F.lit("ambiguous").alias("nation__status"), F.lit(None).cast("string").alias("nation__id"))
    cands = c.select("c_custkey", F.explode(F.array(F.concat(F.lit("n"), "c_nationkey"), F.concat(F.lit("n"), (F.col("c_nationkey") + 1) % 25))).alias("node_id"))
    return topology.refine_link(rows, "c_custkey", "nation", "segs", cands, paths).select("c_custkey", "nation__status", "nation__id")


_BOOLS = "CASE WHEN c_custkey % 4 = 0 THEN 'x' END"


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '{"v":"no"}' END AS active, CASE WHEN c_custkey % 5 = 0 THEN '{"v":"' || c_name || '"}' END AS title, CAST(CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n, c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 AS same FROM customer""")
def r5_normalised_diff(spark, sf):
    """Truth values and texts compared in normal form, renamed fields, an ignore list, and the content shortcut."""
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").select(
        "c_custkey", F.struct(F.when(k % 3 == 0, "no").otherwise("yes").alias("active"), F.col("c_name").alias("name"), F.lit("a").alias("free")).alias("desired"),
        F.struct(F.when(k % 2 == 0, " TRUE").otherwise("1").alias("active"), F.when(k % 5 == 0, "other").otherwise(F.concat(F.upper("c_name"), F.lit(" "))).alias("label"), F.lit("b").alias("free")).alias("existing"),
    )
    changes = resolve.field_changes([resolve.DiffRule("active", norm="bool"), resolve.DiffRule("name", "label", "title", "text"), resolve.DiffRule("free")], ignore=frozenset({"free"}))
    out = c.withColumn("ch", changes)
    plain = F.struct((F.size("ch") == 0).alias("s"), F.lit(1).alias("__t"))
    both = out.withColumn("a", plain).withColumn("b", F.struct(F.lit(True).alias("s"), F.lit(2).alias("__t")))
    return both.select("c_custkey", F.try_element_at("ch", F.lit("active")).alias("active"), F.try_element_at("ch", F.lit("title")).alias("title"), F.size("ch").alias("n"), resolve.same_content(["s", "__t"], "a", "b").alias("same"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'stored' ELSE c_name END AS name, 'seg' AS segment, CASE WHEN c_custkey % 3 = 0 THEN 't' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END AS tid, CAST(c_custkey AS VARCHAR) AS num, c_custkey % 3 = 0 AS keeps, CAST(CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END AS INTEGER) AS n_secrets FROM customer""")
def r3_merge_ids_and_secrets(spark, sf):
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").select(
        "c_custkey", F.struct(F.when(k % 2 == 0, " ").otherwise(F.col("c_name")).alias("name")).alias("desired"), F.struct(F.lit("stored").alias("name"), F.lit("seg").alias("segment")).alias("existing"),
        F.when(k % 3 == 0, "matched").otherwise("not_found").alias("st"), F.concat(F.lit("t"), "c_custkey").alias("ref"),
    )
    merged = resolve.fill_from_existing(["name", "segment"], {"name"}, fill_blank=True)
    tid, _ = resolve.target_id(F.col("st"), F.col("ref"), k)
    does = resolve.operation(F.col("st"), F.create_map(F.lit("a"), F.lit("b")))
    life = resolve.secret_lifecycle(does, "ephemeral", ttl_seconds=60)
    return c.select("c_custkey", merged["name"].alias("name"), merged["segment"].alias("segment"), tid.alias("tid"), links.as_id(F.concat(F.lit("0"), "c_custkey")).alias("num"), ((does == "update") & life["delete_on_success"]).alias("keeps"), F.size(resolve.secret_fields(does, on_create=["token"])).alias("n_secrets"))


@query(f"""SELECT line_no, CASE WHEN nation % 5 = 0 THEN NULL ELSE op END AS op, nation % 5 = 0 AS pending, CASE WHEN nation % 5 = 0 THEN 'nation:' || nation END AS wanted, CASE WHEN target_ref IS NULL THEN match_key ELSE target_ref END AS target_id FROM ({_PLAN}) JOIN (SELECT c_custkey + 2 AS line_no, c_nationkey AS nation FROM customer) USING (line_no)""")
def r2_plan_with_links(spark, sf):
    """The sync plan with a link to nations of which a fifth is missing; the requests of rows that wait."""
    spec = sync_spec()
    spec = SyncSpec(spec.rules, spec.identity, spec.diff, spec.key, spec.target_id, links=[links.LinkRule("nation", (("nation", F.col("nation")),))])
    index = links.identity_index(table(spark, sf, "nation").where("n_nationkey % 5 <> 0"), "n_nationkey", {"nation": F.col("n_nationkey")})
    made = materialize(build_plan(feed(spark, sf), target(spark, sf), spec, index=index).select("line_no", "op", "pending", "target_id", "desired", "requests"), "plan")
    asked = pending_requests(made).select(F.col("source_row_id").cast("long").alias("line_no"), F.col("lookup_key").alias("wanted"))
    return made.join(asked, "line_no", "left").select("line_no", "op", "pending", "wanted", "target_id")


@query("""SELECT o.o_orderkey AS line_no, CAST(o.o_orderkey AS VARCHAR) AS match_key, CASE WHEN o.o_orderkey % 10 = 0 THEN 'create' WHEN o.o_orderkey % 7 = 0 THEN 'update' ELSE 'skip' END AS op,
 CASE WHEN o.o_orderkey % 10 <> 0 AND o.o_orderkey % 7 = 0 THEN '{"v":"' || o.o_orderstatus || '"}' END AS status_change FROM orders o""")
def r6_orders_plan(spark, sf):
    """The sync plan over all orders: a tenth is missing in the target, a seventh has another status there."""
    o = table(spark, sf, "orders")
    fed = o.select(F.col("o_orderkey").alias("line_no"), F.concat(F.lit(" "), "o_orderkey").alias("code"), F.concat("o_orderstatus", F.lit(" ")).alias("status"))
    kept = o.where("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("code"), F.when(F.col("o_orderkey") % 7 == 0, "?").otherwise(F.col("o_orderstatus")).alias("status"))
    spec = SyncSpec(
        [MapRule(("code",), ("code",), (op("trim"),), required=True), MapRule(("status",), ("status",), (op("trim"), op("upper")))],
        [match.IdentityRule("code", F.col("code"), F.col("code"))], [resolve.DiffRule("status")], ["code"], "id",
    )
    return build_plan(fed, kept, spec).select("line_no", "match_key", "op", F.try_element_at("changes", F.lit("status")).alias("status_change"))


# Pending links


def _waiting(spark, sf):
    """Every customer waits in two data sets; in the first one its later request has another payload."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("source_row_id"), "c_custkey")
    each = c.select("*", F.explode(F.array(*[F.struct(F.lit(d).alias("dataset"), F.lit(k).alias("lookup_key"), F.lit(t).cast("timestamp").alias("created_at")) for d, k, t in (("a", "k:1", "2024-01-01"), ("a", "k:2", "2024-01-03"), ("b", "k:1", "2024-01-02"))])).alias("w"))
    status = F.when(F.col("c_custkey") % 10 == 0, "resolved").otherwise("pending")
    body = F.when(F.col("c_custkey") % 7 == 0, "junk").otherwise(F.concat(F.lit('{"k":"'), "w.lookup_key", F.lit('"}')))
    return each.select("w.dataset", "source_row_id", F.lit("f").alias("field"), "w.lookup_key", body.alias("payload"), F.lit(1).alias("attempts"), status.alias("status"), "w.created_at", F.col("w.created_at").alias("last_attempt_at"), F.date_add("w.created_at", 2).cast("timestamp").alias("expires_at"))


@query("SELECT dataset, CAST(c_custkey AS VARCHAR) AS source_row_id, k AS lookup_key FROM customer, (VALUES ('a', 'k:2'), ('b', 'k:1')) v(dataset, k) WHERE c_custkey % 10 <> 0")
def w3_latest_payloads(spark, sf):
    return pending.latest_payloads(_waiting(spark, sf)).select("dataset", "source_row_id", "lookup_key")


@query("SELECT dataset, count(*) FILTER (c_custkey % 7 <> 0) AS decoded, count(*) FILTER (c_custkey % 7 = 0) AS invalid FROM customer, (VALUES ('a'), ('b')) v(dataset) WHERE c_custkey % 10 <> 0 GROUP BY dataset")
def u1_replay_counts(spark, sf):
    return pending.replay_counts(_waiting(spark, sf), "k string", "k")


@query("""SELECT dataset, CAST(c_custkey AS VARCHAR) AS source_row_id, k AS lookup_key, CASE WHEN c_custkey % 10 = 0 THEN 'resolved' WHEN k = 'k:1' AND dataset = 'a' THEN 'expired' WHEN c_custkey % 3 = 0 THEN 'resolved' ELSE 'pending' END AS status
FROM customer, (VALUES ('a', 'k:1'), ('a', 'k:2'), ('b', 'k:1')) v(dataset, k) WHERE NOT (c_custkey % 10 = 0 AND k = 'k:1' AND dataset = 'a')""")
def r13_expire_close_purge(spark, sf):
    clean = table(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("source_row_id"))
    out = pending.close_sources(pending.expire(_waiting(spark, sf), _at("2024-01-03 12:00:00")), clean)
    kept = pending.purge(out.where("status <> 'expired'"), _at("2024-01-01 12:00:00")).unionByName(out.where("status = 'expired'"))
    # Rows that were closed just now stay, whenever they were last touched.
    return kept.select("dataset", "source_row_id", "lookup_key", "status")


@query("SELECT CAST(c_custkey AS VARCHAR) AS source_row_id, CAST(1 AS INTEGER) AS n_errors, CAST(1 AS INTEGER) AS n_warnings FROM customer WHERE c_custkey % 10 <> 0")
def r12_report_expired(spark, sf):
    """Expired links as errors and as warnings, by policy; 'skip' says nothing."""
    now, stored = _at("2024-01-03 12:00:00"), _waiting(spark, sf)
    hard = pending.report_expired(stored, now).select("source_row_id", F.size("errors").alias("n_errors"))
    soft = pending.report_expired(stored, now, "report_only").select("source_row_id", F.size("warnings").alias("n_warnings"))
    quiet = pending.report_expired(stored, now, "skip").where("size(errors) + size(warnings) > 0").select("source_row_id")
    return hard.join(soft, "source_row_id").join(quiet, "source_row_id", "left_anti")


# Snapshots


@query("""SELECT CASE WHEN GROUPING(dataset) = 1 THEN NULL ELSE dataset END AS dataset, CAST(sum(inserted) AS BIGINT) AS inserted, CAST(sum(updated) AS BIGINT) AS updated, CAST(0 AS BIGINT) AS failed, CAST(sum(skipped) AS BIGINT) AS skipped FROM (
SELECT 'part' AS dataset, count(*) FILTER (p_partkey % 3 <> 0) AS inserted, count(*) FILTER (p_partkey % 3 = 0) AS updated, 0 AS skipped FROM part
UNION ALL SELECT 'customer', count(*) FILTER (c_custkey % 4 <> 0), 0, count(*) FILTER (c_custkey % 4 = 0) FROM customer) GROUP BY ROLLUP (dataset)""")
def a11_refresh_totals(spark, sf):
    p, c = table(spark, sf, "part").withColumn("ord", F.lit(1)), table(spark, sf, "customer").withColumn("ord", F.lit(1))
    pcols = [cache.CacheColumn("p_partkey", F.col("p_partkey"), "bigint", required=True), cache.CacheColumn("p_name", F.col("p_name"))]
    ccols = [cache.CacheColumn("c_custkey", F.col("c_custkey"), "bigint", required=True), cache.CacheColumn("c_name", F.col("c_name"))]
    old = p.where("p_partkey % 3 = 0").select("p_partkey", "p_name")
    _, a = cache.refresh(old, p, pcols, "p_partkey", ["ord"], F.lit(False))
    _, b = cache.refresh(c.limit(0).select("c_custkey", "c_name"), c, ccols, "c_custkey", ["ord"], F.col("c_custkey") % 4 == 0)
    return cache.refresh_totals({"part": a, "customer": b})


@query("SELECT step, dataset, rows, 0 AS remaining FROM (VALUES (0, 'lineitem'), (1, 'orders'), (2, 'customer')) v(step, dataset) JOIN (SELECT 'lineitem' AS dataset, count(*) AS rows FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'customer', count(*) FROM customer) USING (dataset)")
def k4_clear_in_order(spark, sf):
    parts = {n: table(spark, sf, n) for n in ("customer", "orders", "lineitem", "part")}
    emptied, counts = cache.clear(parts, {"orders": ["customer"], "lineitem": ["orders", "part"], "customer": [], "part": []}, "customer")
    left = [d.agg(F.count(F.lit(1)).alias("remaining")).withColumn("dataset", F.lit(n)) for n, d in emptied.items()]
    return counts.join(left[0].unionByName(left[1]).unionByName(left[2]), "dataset").select("step", "dataset", "rows", "remaining")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey % 2 = 0")
def r22_drift_and_rebuild(spark, sf):
    """A snapshot of an old schema is rebuilt from pages; one of the same schema is kept."""
    p = table(spark, sf, "part").where("p_partkey % 2 = 0").select("p_partkey", "p_name").withColumn("ord", F.lit(1))
    fresh, old = p.drop("ord"), table(spark, sf, "part").select("p_partkey")
    cols = [cache.CacheColumn("p_partkey", F.col("p_partkey"), "bigint", required=True), cache.CacheColumn("p_name", F.col("p_name"))]
    start = cache.rebuilt(fresh, old, cache.schema_hash(old), "rebuild")
    out, _ = cache.refresh(start, p, cols, "p_partkey", ["ord"], F.lit(False))
    same = cache.rebuilt(fresh, fresh, cache.schema_hash(fresh))
    return out.select("p_partkey", "p_name").join(same.select("p_partkey"), "p_partkey", "left_semi")


@query("""SELECT p_name AS node_id, min(p_partkey) OVER (PARTITION BY p_name) AS kept, p_partkey AS dropped FROM part QUALIFY p_partkey > min(p_partkey) OVER (PARTITION BY p_name)""")
def w4_repeated_nodes(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_name").alias("node_id"), "p_partkey")
    firsts = hierarchy.first_nodes(p, "p_partkey").select("node_id", F.col("p_partkey").alias("kept"))
    return hierarchy.repeated_nodes(p, "p_partkey").join(firsts, ["node_id", "kept"])


# Trees


@query(f"""WITH RECURSIVE s AS ({_SOURCE}), up(node_id, cur, k) AS (SELECT node_id, node_id, 0 FROM s UNION ALL SELECT up.node_id, s.parent_id, k + 1 FROM up JOIN s ON s.node_id = up.cur WHERE s.parent_id IS NOT NULL AND k < 41),
ends AS (SELECT node_id, max(k) AS k, arg_max(cur, k) AS cur, arg_max(cur, CASE WHEN k < 41 THEN k END) AS even FROM up GROUP BY node_id),
loops AS (SELECT node_id, least(cur, even) AS ring, (SELECT u.cur FROM up u WHERE u.node_id = e.node_id AND (u.cur % 89 = 0 OR u.cur % 89 = 1) AND least(u.cur, (SELECT parent_id FROM s WHERE s.node_id = u.cur)) = least(cur, even) ORDER BY u.k LIMIT 1) AS enter FROM ends e WHERE k >= 41),
told AS (SELECT ring, arg_min(enter, node_id) AS at FROM loops GROUP BY ring)
SELECT e.node_id, CASE WHEN e.k >= 41 THEN told.at WHEN e.cur >= 1000000 THEN e.cur WHEN e.cur >= (SELECT count(*) FROM part) THEN e.cur END AS broken_at, e.k < 41 AND e.cur < 1000000 AS held FROM ends e LEFT JOIN loops USING (node_id) LEFT JOIN told USING (ring)""")
def h7_broken_at(spark, sf):
    nodes = part_nodes(spark, sf)
    told = materialize(hierarchy.anchor_verdicts(nodes, nodes.limit(0)), "told")
    held = hierarchy.anchored_nodes(nodes, told).select("node_id", F.lit(True).alias("held"))
    return told.join(held, "node_id", "left").select("node_id", "broken_at", F.coalesce("held", F.lit(False)).alias("held"))


@query("SELECT problem, count(*) AS n FROM (SELECT 'duplicate' AS problem FROM (SELECT p_name FROM part GROUP BY p_name HAVING count(*) > 1) UNION ALL SELECT 'missing_parent' FROM (SELECT DISTINCT p_name FROM part WHERE p_size = 1)) GROUP BY problem UNION ALL SELECT 'nodes left', 0")
def h3_build_tree(spark, sf):
    """Any problem empties the tree; parts named alike are duplicates, those of size 1 have a parent that is not there."""
    p = table(spark, sf, "part").select(F.col("p_name").alias("node_id"), F.when(F.col("p_size") == 1, "nobody").alias("parent_id"))
    made, problems = hierarchy.build_tree(p)
    left = made.agg(F.count(F.lit(1)).alias("n")).select(F.lit("nodes left").alias("problem"), "n")
    return problems.groupBy("problem").agg(F.count(F.lit(1)).alias("n")).unionByName(left)


@query(f"""SELECT node_id, sha256('{{"path":["' || replace(path, '/', '","') || '"],"root_id":"' || root_id || '","depth":' || depth || '}}') AS signature FROM ({_TREE})""")
def h6_structural_signature(spark, sf):
    return hierarchy.structural_signature(hierarchy.path_table(tree(spark, sf))).select("node_id", "signature")


@query("SELECT count(*) AS nodes, 'stale' AS state FROM customer UNION ALL SELECT 0, 'empty' UNION ALL SELECT count(*), 'no_revision' FROM customer UNION ALL SELECT count(*), 'ready' FROM customer")
def h8_readiness(spark, sf):
    c, at = table(spark, sf, "customer"), _at("2024-01-01")
    soon, late = _at("2024-01-01 00:10:00"), _at("2024-01-02")
    states = [(c, late, "r1"), (c.limit(0), soon, "r1"), (c, soon, " "), (c, soon, "r1")]
    out = [hierarchy.readiness(d, at, now, 3600, F.lit(rev)) for d, now, rev in states]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(f"SELECT verdict AS reason, count(*) AS n FROM ({SQL['j21_anchoring']}) WHERE verdict <> 'anchored' GROUP BY verdict")
def a12_dropped_by_reason(spark, sf):
    """Nodes dropped for each reason that verdicts know."""
    return topology.dropped_by_reason(QUERIES["j21_anchoring"](spark, sf))


@query(f"SELECT topology_mode, count(*) AS n FROM ({SQL['j17_topology_refinement']}) GROUP BY topology_mode")
def a13_mode_counts(spark, sf):
    """How the positions of ambiguous parts settled them, counted."""
    return topology.mode_counts(QUERIES["j17_topology_refinement"](spark, sf))


# Reports


@query("SELECT c_custkey AS line_no, true AS truncated FROM customer WHERE c_acctbal < 0 ORDER BY c_custkey LIMIT 10")
def l4_report_items(spark, sf):
    """The first ten rows with diagnostics; there are more."""
    c = table(spark, sf, "customer").withColumn("line_no", F.col("c_custkey"))
    rows = diagnostics.add(c, errors=[diagnostics.diag("normalize", "NEGATIVE", "c_acctbal", None, F.col("c_acctbal") < 0)], warnings=[])
    return diagnostics.report_items(diagnostics.with_channels(rows), 10).select("line_no", "truncated")


@query("SELECT c_custkey AS line_no FROM customer WHERE c_custkey <= (SELECT min(c_custkey) FROM customer WHERE c_custkey > 10 AND c_custkey % 17 = 0) ORDER BY c_custkey LIMIT 1000")
def l5_stop_on_error(spark, sf):
    """Items in order up to the first that fails."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("line_no"))
    return plan.first_actions(c, 1000, failed=(F.col("line_no") > 10) & (F.col("line_no") % 17 == 0)).select("line_no")


# Streams, each over all rows of a table, with everything that is available


def _drained(spark, stream):
    """Rows that a stream appends until its input is used up, from files in the shared folder."""
    out, cp = _fresh(spark, "stream"), _fresh(spark, "offsets")
    state.drain(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).outputMode("append").trigger(availableNow=True).start())
    return spark.read.schema(stream.schema).parquet(out)


@query("SELECT CAST(user_id AS VARCHAR) AS dedup_key, event_id AS line_no, CASE WHEN row_number() OVER w = 1 THEN 'first' WHEN event_type = first_value(event_type) OVER w THEN 'duplicate' ELSE 'conflict' END AS dedup FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id % 2, event_id)")
def ts2_dedup_stream(spark, sf):
    """Events in two batches, those with even ids first."""
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("dedup_key"), F.col("event_id").cast("long").alias("line_no"), F.col("event_type").alias("fingerprint"), (F.col("event_id") % 2).alias("half"))
    src = _fresh(spark, "events")
    for half in (0, 1):
        e.where(F.col("half") == half).drop("half").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("dedup_key string, line_no long, fingerprint string").option("maxFilesPerTrigger", 1).parquet(src)
    return _drained(spark, state.dedup_stream(stream)).select("dedup_key", "line_no", "dedup")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS source_row_id, CASE WHEN o_custkey % 2 = 0 THEN 'resolved' ELSE 'conflict' END AS status, CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) END AS resolved_id
FROM orders WHERE o_custkey % 2 = 0 OR o_orderkey % 3 = 0""")
def ts3_pending_stream(spark, sf):
    """Orders ask for customers in a first batch; the even ones arrive in a second; a third of the orders asks again in a third one, which is once too often."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer").where("c_custkey % 2 = 0")
    kinds = "event string, dataset string, lookup_key string, source_row_id string, resolved_id string"
    none = F.lit(None).cast("string")
    ask = o.select(F.lit("request").alias("event"), F.lit("orders").alias("dataset"), F.concat(F.lit("cust:"), "o_custkey").alias("lookup_key"), F.col("o_orderkey").cast("string").alias("source_row_id"), none.alias("resolved_id"))
    come = c.select(F.lit("identity").alias("event"), F.lit("orders").alias("dataset"), F.concat(F.lit("cust:"), "c_custkey").alias("lookup_key"), none.alias("source_row_id"), F.col("c_custkey").cast("string").alias("resolved_id"))
    again = o.where("o_orderkey % 3 = 0 and o_custkey % 2 = 1")
    again = again.select(F.lit("request").alias("event"), F.lit("orders").alias("dataset"), F.concat(F.lit("cust:"), "o_custkey").alias("lookup_key"), F.col("o_orderkey").cast("string").alias("source_row_id"), none.alias("resolved_id"))
    src = _fresh(spark, "links")
    for part in (ask, come, again):
        part.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(src)
    return _drained(spark, state.pending_stream(stream, max_attempts=2)).select("source_row_id", "status", "resolved_id")


@query("SELECT user_id, arg_max(event_type, (event_id % 2, event_id)) AS event_type FROM events GROUP BY user_id")
def ts4_refresh_stream(spark, sf):
    """Events landed in two pages keep a snapshot of the last event type of each user."""
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id")
    src, log = _fresh(spark, "pages"), state.snapshot_log(_fresh(spark, "snapshot"), "user_id")
    for half in (0, 1):
        e.where(F.col("event_id") % 2 == half).coalesce(1).write.mode("append").parquet(src)
    pages = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(src)
    cols = [cache.CacheColumn("user_id", F.col("user_id"), "bigint", required=True), cache.CacheColumn("event_type", F.col("event_type"))]
    state.refresh_stream(pages, log, cols, "user_id", ["event_id"], F.lit(False), _fresh(spark, "offsets")).awaitTermination(600)
    return log.read(spark, 1)


@query("SELECT 'cust:' || o_custkey AS lookup_key, CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderkey % 3 <> 0")
def ts5_index_batch(spark, sf):
    o = table(spark, sf, "orders")
    key = {"cust": F.col("o_custkey")}
    stored = links.identity_index(o.where("o_orderkey % 3 = 0"), "o_orderkey", key)
    return state.index_batch(o, stored, "o_orderkey", key)


# What no other query runs


_KEYED = "sha256('{seed}|' || c_custkey)"


@query(f"""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'kept' ELSE substr('abcdef', CAST(ascii(substr({_KEYED.format(seed="passwordpepper")}, 64, 1)) % 6 AS INTEGER) + 1, 1) || substr({_KEYED.format(seed="passwordpepper")}, 1, 32) END AS secret,
 lpad(CAST(CAST('0x' || substr({_KEYED.format(seed="digits0")}, 1, 12) AS BIGINT) % 1000000000 AS VARCHAR), 9, '0') || substr(lpad(CAST(CAST('0x' || substr({_KEYED.format(seed="digits1")}, 1, 12) AS BIGINT) % 1000000000 AS VARCHAR), 9, '0'), 1, 3) AS digits FROM customer""")
def f42_secrets_and_digits(spark, sf):
    """Made-up secrets and digits follow from the record, so that a repeated run makes the same ones."""
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_custkey").alias("record_id"), F.when(F.col("c_custkey") % 3 == 0, "kept").alias("was"))
    out = run_chains(c, {"secret": (F.col("was"), [op("default_password", salt="pepper")]), "digits": (F.lit(None).cast("string"), [op("random_digits", length=12)])})
    return out.select("c_custkey", "secret", "digits")


@query("SELECT c_custkey, '{\"name\":\"' || c_name || '\",\"nation\":' || c_nationkey || '}' AS state FROM customer")
def p10_desired_state(spark, sf):
    """The fields that are kept, without those that are dropped again."""
    c = table(spark, sf, "customer").withColumnsRenamed({"c_name": "name", "c_nationkey": "nation"})
    return c.select("c_custkey", F.to_json(rules.desired_state(["name", "nation", "c_acctbal"], {"c_acctbal"})).alias("state"))


@query("SELECT split_part(lookup_key, ':', 1) AS name, count(*) AS n FROM (SELECT DISTINCT 'brand:' || p_brand AS lookup_key, p_partkey FROM part UNION ALL SELECT DISTINCT 'size:' || p_size, p_partkey FROM part) GROUP BY name")
def u5_keys_of_rules(spark, sf):
    """An index with the keys that some rule looks for, and no others."""
    wanted = links.link_key_names([links.LinkRule("a", (("brand", "p_brand"),)), links.LinkRule("b", (("brand", "p_brand"),), ((("size", "p_size"),),))])
    every = {"name": F.col("p_name"), "brand": F.col("p_brand"), "size": F.col("p_size"), "type": F.col("p_type")}
    index = links.identity_index(table(spark, sf, "part"), "p_partkey", {k: c for k, c in every.items() if k in wanted})
    return index.groupBy(F.substring_index("lookup_key", ":", 1).alias("name")).agg(F.count(F.lit(1)).alias("n"))
