"""Queries of links and of the staged plan, with equivalent SQL; registered beside those of ``queries``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concordat.functions.ops import op
from concordat.operators import links, match, pending, resolve
from concordat.operators.rules import MapRule
from concordat.plans.sync import FuzzyRule, SyncSpec, TopologyRule, build_plan, pending_requests
from concordat.queries import query
from concordat.session import materialize, shared_dir, table


def _fresh(spark, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def _two_datasets(spark, sf):
    """Customers and suppliers under the same key name; a seventh of the customers and a fifth of the suppliers are missing."""
    c = table(spark, sf, "customer").where("c_custkey % 7 <> 0").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_custkey").alias("k"))
    s = table(spark, sf, "supplier").where("s_suppkey % 5 <> 0").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_suppkey").alias("k"))
    return [links.identity_index(d, "id", {"code": F.col("k")}, dataset=n) for n, d in (("customers", c), ("suppliers", s))]


_APART = """SELECT o_orderkey, c.id AS buyer__id, CASE WHEN c.id IS NULL THEN 'unresolved' ELSE 'resolved' END AS buyer__status, s.id AS seller__id, CASE WHEN s.id IS NULL THEN 'unresolved' ELSE 'resolved' END AS seller__status
FROM orders LEFT JOIN (SELECT c_custkey AS k, 'c' || c_custkey AS id FROM customer WHERE c_custkey % 7 <> 0) c ON c.k = o_custkey
LEFT JOIN (SELECT s_suppkey AS k, 's' || s_suppkey AS id FROM supplier WHERE s_suppkey % 5 <> 0) s ON s.k = o_custkey"""


def _linked(spark, sf, index):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("code"))
    both = [links.LinkRule("buyer", (("code", "code"),), dataset="customers"), links.LinkRule("seller", (("code", "code"),), dataset="suppliers")]
    return links.resolve_links(o, "o_orderkey", both, index).select("o_orderkey", "buyer__id", "buyer__status", "seller__id", "seller__status")


@query(_APART)
def j12_links_by_dataset(spark, sf):
    """Two links under one key name into two data sets."""
    c, s = _two_datasets(spark, sf)
    return _linked(spark, sf, c.unionByName(s))


@query(_APART)
def a3_stored_index(spark, sf):
    """The same from a stored index, filled in three batches of which the last brings entries that are there already."""
    c, s = _two_datasets(spark, sf)
    log = links.index_log(_fresh(spark, "index"), buckets=16)
    for version, entries in enumerate((c, s, c.where("length(id) % 2 = 0"))):
        links.append_index(log, entries, version)
    return _linked(spark, sf, log)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'b' || o_custkey WHEN o_custkey % 7 <> 0 THEN 'c' || o_custkey END AS buyer__id FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 4 = 1""")
def j15_batch_over_stored_index(spark, sf):
    """Records of the current batch answer before stored ones, in every data set they are looked for in."""
    o = table(spark, sf, "orders").where("o_orderkey % 4 in (0, 1)").select("o_orderkey", F.concat_ws("-", "o_custkey", F.col("o_orderkey") % 4).alias("code"))
    c, _ = _two_datasets(spark, sf)
    stored = c.select("dataset", F.explode(F.array(*[F.concat("lookup_key", F.lit(f"-{m}")) for m in (0, 1)])).alias("lookup_key"), "id")
    batch = table(spark, sf, "orders").select(F.concat(F.lit("code:"), "o_custkey", F.lit("-0")).alias("lookup_key"), F.concat(F.lit("b"), "o_custkey").alias("id")).distinct()
    rule = links.LinkRule("buyer", (("code", "code"),), dataset="customers")
    return links.resolve_links(o, "o_orderkey", [rule], stored, batch=batch).select("o_orderkey", "buyer__id")


# What the six kinds of rows of ``r11_link_policies`` come to, without and with rows that go on in part.
_KINDS = """(VALUES (0, '42', false, false, '', 0), (1, 'mgr', true, true, 'RESOLVE_PENDING', 1), (2, 'mgr', true, true, 'RESOLVE_MAX_ATTEMPTS', 1), (3, '99', false, false, '', 0),
 (4, '42', false, false, '', 0), (5, 'mgr', true, true, 'RESOLVE_PENDING', 1)) k(kind, manager, pending, stopped, codes, asked)"""


@query(f"""SELECT c_custkey, mode, CASE WHEN manager = 'mgr' THEN 'mgr' || c_custkey ELSE manager || '0' || c_custkey END AS manager_id, pending, stopped AND NOT (mode = 'partial' AND codes = 'RESOLVE_PENDING') AS stopped, codes, CAST(asked AS INTEGER) AS asked
FROM customer JOIN {_KINDS} ON c_custkey % 6 = kind CROSS JOIN (VALUES ('strict'), ('partial')) m(mode)""")
def r11_link_policies(spark, sf):
    """Links that are found, wait, have waited too often, are answered by the batch, are narrowed to one of two, or stay ambiguous."""
    k = F.col("c_custkey")
    kind = k % 6
    rows = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("mgr"), k).alias("manager_id"), F.concat(F.lit("10-"), k).alias("organization_id"))
    name, org = F.concat(F.lit("match_key:"), "manager_id"), F.concat(F.lit("organization_id:"), "organization_id")
    entry = lambda when, key, n: F.when(when, F.struct(key.alias("lookup_key"), F.concat(F.lit(f"{n}0"), k).alias("id")))
    twice = kind.isin(4, 5)
    stored = rows.select(F.explode(F.array_compact(F.array(entry((kind == 0) | twice, name, 42), entry(twice, name, 43), entry(kind == 4, org, 42)))).alias("e")).select(F.lit("people").alias("dataset"), "e.*")
    batch = rows.where(kind == 3).select(name.alias("lookup_key"), F.concat(F.lit("990"), k).alias("id"))
    waits = rows.where(kind == 2).select(F.lit("people").alias("dataset"), k.cast("string").alias("source_row_id"), F.lit("manager_id").alias("field"), name.alias("lookup_key"), F.lit("pending").alias("status"), F.lit(2).alias("attempts"))
    rule = links.LinkRule("manager_id", (("match_key", "manager_id"),), ((("organization_id", "organization_id"),),), dataset="people", target_id="_ouid", coerce="int")
    out = None
    for mode in ("strict", "partial"):
        done = links.apply_links(rows, "c_custkey", [rule], stored, batch, links.Waiting(3, mode == "partial"), waits)
        codes = F.array_join(F.transform(F.concat("errors", "warnings"), lambda d: d["code"]), ",")
        part = done.select("c_custkey", F.lit(mode).alias("mode"), "manager_id", "pending", "stopped", codes.alias("codes"), F.size("requests").alias("asked"))
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT o_orderkey, CASE WHEN c THEN 'c' || o_custkey ELSE CAST(o_custkey AS VARCHAR) END AS buyer,
 CASE WHEN NOT h AND c AND b THEN 'of-c' || o_custkey ELSE 'none' END AS via, CASE WHEN s THEN 's' || o_custkey ELSE CAST(o_custkey AS VARCHAR) END AS seller,
 h OR NOT (c AND b) AS stopped,
 concat_ws(',', CASE WHEN h THEN 'RESOLVE_CONFLICT:seller' END, CASE WHEN NOT c THEN 'RESOLVE_PENDING:buyer' END, CASE WHEN NOT h AND NOT (c AND b) THEN 'RESOLVE_PENDING:via' END) AS codes
FROM (SELECT *, s_suppkey IS NULL AS h, s_suppkey IS NOT NULL AS s FROM (SELECT o_orderkey, o_custkey, o_custkey % 7 <> 0 AS c, o_custkey % 3 = 0 AS b, s_suppkey FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey AND s_suppkey % 5 <> 0))""")
def r2_rules_in_order(spark, sf):
    """The second rule ends the row where it finds nothing; the third reads what the first one resolved."""
    c, s = _two_datasets(spark, sf)
    of = table(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("of-c"), "c_custkey").alias("id"), F.concat(F.lit("c"), "c_custkey").alias("k"))
    index = c.unionByName(s).unionByName(links.identity_index(of, "id", {"owner": F.col("k")}, dataset="offices"))
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("buyer"), F.col("o_custkey").cast("string").alias("seller"), F.lit("none").alias("via"))
    rules_ = [
        links.LinkRule("buyer", (("code", "buyer"),), dataset="customers"), links.LinkRule("seller", (("code", "seller"),), dataset="suppliers", on_unresolved="hard_error"),
        links.LinkRule("via", (("owner", "buyer"),), dataset="offices"),
    ]
    done = links.apply_links(o, "o_orderkey", rules_, index)
    codes = F.array_join(F.transform(F.concat("errors", "warnings"), lambda d: F.concat_ws(":", d["code"], d["field"])), ",")
    return done.select("o_orderkey", "buyer", "via", "seller", "stopped", codes.alias("codes"))


@query("""WITH i AS (SELECT p_name, p_brand, p_size, CAST(p_partkey AS VARCHAR) AS id FROM part WHERE p_partkey % 13 <> 0),
a AS (SELECT p_name, count(*) AS n, min(id) AS one FROM i GROUP BY ALL), b AS (SELECT p_name, p_brand, count(*) AS n, min(id) AS one FROM i GROUP BY ALL),
c AS (SELECT p_name, p_size, count(*) AS n, min(id) AS one FROM i GROUP BY ALL), d AS (SELECT p_name, p_brand, p_size, count(*) AS n, min(id) AS one FROM i GROUP BY ALL)
SELECT p_partkey, CASE WHEN n IS NULL THEN 'unresolved' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS part__status, CASE WHEN n = 1 THEN one END AS part__id FROM (
 SELECT p.p_partkey, CASE WHEN a.n = 1 THEN a.n WHEN b.n IS NULL THEN coalesce(c.n, a.n) WHEN b.n = 1 THEN b.n ELSE coalesce(d.n, b.n) END AS n,
  CASE WHEN a.n = 1 THEN a.one WHEN b.n IS NULL THEN coalesce(c.one, a.one) WHEN b.n = 1 THEN b.one ELSE coalesce(d.one, b.one) END AS one
 FROM part p LEFT JOIN a USING (p_name) LEFT JOIN b ON b.p_name = p.p_name AND b.p_brand = p.p_brand LEFT JOIN c ON c.p_name = p.p_name AND c.p_size = p.p_size LEFT JOIN d ON d.p_name = p.p_name AND d.p_brand = p.p_brand AND d.p_size = p.p_size)""")
def j14_narrowed_links(spark, sf):
    """Parts found by a name that many share, narrowed by brand, then by size; a group that leaves nothing is passed over."""
    p = table(spark, sf, "part")
    keys = {"name": F.col("p_name"), "brand": F.col("p_brand"), "size": F.col("p_size")}
    index = links.identity_index(p.where("p_partkey % 13 <> 0"), "p_partkey", keys)
    rule = links.LinkRule("part", (("name", "p_name"),), ((("brand", "p_brand"),), (("size", "p_size"),)))
    return links.resolve_links(p, "p_partkey", [rule], index).select("p_partkey", "part__status", "part__id")


@query("""WITH n AS (SELECT 'n' || n_nationkey AS id, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey),
c AS (SELECT c_custkey, lower(n_name) AS leaf, CASE WHEN c_custkey % 3 = 0 THEN 'elsewhere' ELSE lower(r_name) END AS root FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 11 = 0 THEN 'ambiguous' ELSE 'resolved' END AS nation__status, CASE WHEN c_custkey % 11 = 0 THEN 'skip' WHEN c_custkey % 3 = 0 THEN 'skip' ELSE 'exact_path' END AS nation__position,
 CASE WHEN NOT (c_custkey % 3 = 0 OR c_custkey % 11 = 0) THEN n.id END AS nation__id FROM c JOIN n ON lower(n.n_name) = c.leaf""")
def j18_links_by_position(spark, sf):
    """Every customer's key has all nations as candidates; the place in the tree of regions tells them apart, without pairing rows and candidates."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    nations = n.join(r, F.col("r_regionkey") == F.col("n_regionkey"))
    paths = nations.select(F.concat(F.lit("n"), "n_nationkey").alias("node_id"), F.array(F.lower("r_name"), F.lower("n_name")).alias("path"))
    rows = table(spark, sf, "customer").join(nations, F.col("n_nationkey") == F.col("c_nationkey"))
    root = F.when(F.col("c_custkey") % 3 == 0, "elsewhere").otherwise(F.lower("r_name"))
    rows = rows.select("c_custkey", F.lit("x").alias("nation"), F.when(F.col("c_custkey") % 11 != 0, F.array(root, F.lower("n_name"))).alias("segs"))
    index = nations.select(F.lit("any:x").alias("lookup_key"), F.concat(F.lit("n"), "n_nationkey").alias("id"))
    rule = links.LinkRule("nation", (("any", "nation"),), position=links.Position("segs", paths))
    return links.resolve_links(rows, "c_custkey", [rule], index).select("c_custkey", "nation__status", "nation__position", "nation__id")


_STAGES = """WITH c AS (SELECT * FROM (SELECT o.p_partkey AS k, t.p_partkey AS cand, t.p_name AS cname, o.p_type = t.p_type AND o.p_size = t.p_size AS fits, o.p_size = t.p_size AS leaf,
 (CASE WHEN o.p_name = t.p_name THEN 3.0 ELSE 0 END + CASE WHEN lower(o.p_type) = lower(t.p_type) THEN 1.0 ELSE 0 END) / 4 AS score, row_number() OVER (PARTITION BY o.p_partkey ORDER BY CAST(t.p_partkey AS VARCHAR)) AS ord
 FROM part o JOIN part t ON t.p_brand = o.p_brand WHERE t.p_partkey % 3 <> 0 AND (o.p_partkey % 4 = 0 OR o.p_partkey % 3 = 0)) WHERE ord <= 8),
r AS (SELECT *, row_number() OVER w AS rk, lead(score) OVER w AS nxt FROM c WINDOW w AS (PARTITION BY k ORDER BY score DESC, ord)),
b AS (SELECT k, cand, cname, score, CASE WHEN score - nxt < 0.01 THEN 'fuzzy_tie' WHEN score >= 0.9 THEN 'fuzzy_accept' WHEN score >= 0.5 THEN 'fuzzy_review' ELSE 'fuzzy_reject' END AS why FROM r WHERE rk = 1),
f AS (SELECT k, count(*) AS n, count(CASE WHEN fits THEN 1 END) AS fit, min(CASE WHEN fits THEN cand END) AS spot, min(CASE WHEN fits THEN cname END) AS spotname,
 count(CASE WHEN leaf THEN 1 END) AS lfit, min(CASE WHEN leaf THEN cand END) AS lspot, min(CASE WHEN leaf THEN cname END) AS lspotname FROM c GROUP BY k),
d AS (SELECT p_partkey AS k, p_name, CASE WHEN p_partkey % 4 <> 0 AND p_partkey % 3 <> 0 THEN 'identity_exact' WHEN why IS NULL THEN 'fuzzy_no_candidates' WHEN why IN ('fuzzy_tie', 'fuzzy_review') AND n > 1 AND p_partkey % 7 <> 0
 THEN CASE WHEN fit = 1 THEN CASE WHEN p_partkey % 5 = 0 THEN 'topology_last_two' ELSE 'topology_exact_path' END WHEN fit > 1 OR lfit > 1 AND p_partkey % 5 <> 0 THEN 'topology_ambiguous' WHEN lfit = 1 AND p_partkey % 5 <> 0 THEN 'topology_leaf_root_depth' ELSE 'topology_no_match' END ELSE why END AS why,
 cand, cname, CASE WHEN fit = 0 THEN lspot ELSE spot END AS spot, CASE WHEN fit = 0 THEN lspotname ELSE spotname END AS spotname FROM part LEFT JOIN b ON b.k = p_partkey LEFT JOIN f ON f.k = p_partkey),
m AS (SELECT k, p_name, why, CASE WHEN why = 'identity_exact' THEN k WHEN why = 'fuzzy_accept' THEN cand WHEN why IN ('topology_last_two', 'topology_exact_path', 'topology_leaf_root_depth') THEN spot END AS ref,
 CASE WHEN why = 'identity_exact' THEN p_name WHEN why = 'fuzzy_accept' THEN cname WHEN why IN ('topology_last_two', 'topology_exact_path', 'topology_leaf_root_depth') THEN spotname END AS was FROM d)
SELECT k + 2 AS line_no, why AS match_reason, CAST(ref AS VARCHAR) AS target_ref, CASE WHEN ref IS NOT NULL THEN CASE WHEN was = p_name THEN 'skip' ELSE 'update' END WHEN why IN ('fuzzy_reject', 'fuzzy_no_candidates') THEN 'create' END AS op FROM m"""


@query(_STAGES)
def j17_staged_plan(spark, sf):
    """A plan in which identity settles half the parts, and only the others go on to fuzzy matching and then to their place in a tree."""
    return _staged(spark, sf).select("line_no", "match_reason", "target_ref", "op")


def _staged(spark, sf):
    p = table(spark, sf, "part")
    code = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("lost"), "p_partkey")).otherwise(F.col("p_partkey").cast("string"))
    fed = p.select((F.col("p_partkey") + 2).alias("line_no"), code.alias("code"), F.col("p_name").alias("name"), "p_brand", "p_type", F.col("p_size").cast("string").alias("size"), F.col("p_partkey").alias("k"))
    kept = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("name"), "p_brand", "p_type", "p_size")
    paths = kept.select(F.col("id").cast("string").alias("node_id"), F.array(F.lit("parts"), "p_type", F.col("p_size").cast("string")).alias("path"))
    root = F.when(F.col("k") % 5 == 0, "other").otherwise("parts")
    spec = SyncSpec(
        [MapRule((c,), (c,), (op("trim"),) if c != "k" else ()) for c in ("code", "name", "p_brand", "p_type", "size", "k")],
        [match.IdentityRule("code", F.col("code"), F.col("code"))], [resolve.DiffRule("name")], ["code"], "id",
        fuzzy=FuzzyRule(
            (("block", F.col("p_brand"), F.col("p_brand")),), (("name", F.col("name"), F.col("name")), ("kind", F.col("p_type"), F.col("p_type"))),
            (match.Comparator("name", "exact", 3.0), match.Comparator("kind", "casefold", 1.0)), 0.9, 0.5, 0.01, max_candidates=8,
        ),
        topology=TopologyRule(F.when(F.col("k") % 7 != 0, F.array(root, F.col("p_type"), F.col("size"))), F.col("id"), paths),
    )
    return build_plan(fed, kept, spec)


_BRANDS = """SELECT * FROM (SELECT a.p_partkey AS row_id, b.p_partkey AS cand_id, row_number() OVER (PARTITION BY a.p_partkey ORDER BY b.p_partkey) AS ord, round(2.0 * (6 + CASE WHEN a.p_brand = b.p_brand THEN length(a.p_brand) - 6
 WHEN regexp_matches(substr(a.p_brand, 7), '[' || substr(b.p_brand, 7) || ']') THEN 1 ELSE 0 END) / (length(a.p_brand) + length(b.p_brand)), 4) AS score
 FROM part a JOIN part b ON a.p_name = b.p_name WHERE a.p_partkey % 2 = 0 AND b.p_partkey % 2 = 1) WHERE ord <= 20"""


@query(f"SELECT row_id, cand_id, score, CAST(rk AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, ord) AS rk FROM ({_BRANDS})) WHERE rk <= 3")
def j10_best_by_similarity(spark, sf):
    """The three candidates of a name with the most similar brand; bounds keep most pairs away from the text comparison."""
    p = table(spark, sf, "part")
    pairs = match.block_candidates(p.where("p_partkey % 2 = 0").withColumnRenamed("p_partkey", "row_id"), "row_id", p.where("p_partkey % 2 = 1"), "p_partkey", ["p_name"], 20, ["p_brand"])
    scored = match.score_top(pairs, "row_id", [match.Comparator("p_brand", "similarity")], 3)
    w = Window.partitionBy("row_id").orderBy(F.desc("score"), "ord")
    return scored.withColumn("place", F.row_number().over(w)).where("place <= 3").select("row_id", "cand_id", "score", "place")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS source_row_id, lookup_key, dataset, CAST(2 AS INTEGER) AS attempts, 'pending' AS status FROM (
SELECT o_orderkey, o_custkey, 'code:' || o_custkey AS lookup_key, 'customers' AS dataset FROM orders WHERE o_custkey % 7 = 0 UNION ALL
SELECT o_orderkey, o_custkey, 'code:' || o_custkey, 'suppliers' FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey AND s_suppkey % 5 <> 0 WHERE s_suppkey IS NULL)""")
def r11_requests_by_dataset(spark, sf):
    """Two runs of a plan whose links wait in the data set of their rule; each run is another attempt."""
    c, s = _two_datasets(spark, sf)
    o = table(spark, sf, "orders")
    fed = o.select(F.col("o_orderkey").alias("line_no"), F.col("o_orderkey").cast("string").alias("code"), F.col("o_custkey").cast("string").alias("buyer"), F.col("o_custkey").cast("string").alias("seller"))
    rules_ = [links.LinkRule("buyer", (("code", "buyer"),), dataset="customers"), links.LinkRule("seller", (("code", "seller"),), dataset="suppliers")]
    spec = SyncSpec([MapRule((x,), (x,)) for x in ("code", "buyer", "seller")], [match.IdentityRule("code", F.col("code"), F.col("code"))], [resolve.DiffRule("buyer"), resolve.DiffRule("seller")], ["code"], "id", links=rules_)
    kept = o.limit(0).select(F.col("o_orderkey").alias("id"), F.lit("").alias("code"), F.lit("").alias("buyer"), F.lit("").alias("seller"))
    asked = materialize(pending_requests(build_plan(fed, kept, spec, index=c.unionByName(s))), "requests")
    kinds = "dataset string, source_row_id string, field string, lookup_key string, payload string, attempts int, status string, created_at timestamp, last_attempt_at timestamp, expires_at timestamp"
    now, stored = F.lit("2024-01-01").cast("timestamp"), spark.createDataFrame([], kinds)
    for _ in range(2):
        stored = pending.upsert_pending(stored, asked, now, 3600, 5)
    return stored.select("source_row_id", "lookup_key", "dataset", "attempts", "status")
