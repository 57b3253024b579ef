"""Queries that exercise the operators on the driver's tables, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.functions.ops import fingerprint, op, run_chains
from concordat.functions.text import canonical_segments, compare_form, key_digest, percent_bucket, shorten
from concordat.operators import cache, diagnostics, hierarchy, links, lookup, match, pending, plan, resolve, rules
from concordat.operators.rules import MapRule, NormalizeRule, SinkField
from concordat.plans.sync import SyncSpec, build_plan
from concordat.session import table
from concordat.sources import files

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def feed(spark, sf):
    """Customers as a fed file: strings, with line numbers."""
    c = table(spark, sf, "customer")
    return c.select((F.col("c_custkey") + 2).alias("line_no"), F.col("c_custkey").cast("string").alias("code"), "c_name", F.col("c_nationkey").cast("string").alias("nation"), F.col("c_mktsegment").alias("segment"))


def target(spark, sf):
    """The stored state: a tenth of the customers is missing, a seventh has another segment."""
    c = table(spark, sf, "customer").where("c_custkey % 10 <> 0")
    seg = F.when(F.col("c_custkey") % 7 == 0, F.concat("c_mktsegment", F.lit("_OLD"))).otherwise(F.col("c_mktsegment"))
    return c.select(F.col("c_custkey").alias("id"), F.col("c_custkey").cast("string").alias("code"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("string").alias("nation"), seg.alias("segment"))


def sync_spec() -> SyncSpec:
    return SyncSpec(
        rules=[
            MapRule(("code",), ("code",), (op("trim"),), required=True), MapRule(("name",), ("c_name",), (op("trim"),)),
            MapRule(("nation",), ("nation",), (op("to_string"),)), MapRule(("segment",), ("segment",), (op("trim"), op("upper"))),
        ],
        identity=[match.IdentityRule("code", F.col("code"), F.col("code"))],
        diff=[resolve.DiffRule("name", norm="text"), resolve.DiffRule("nation"), resolve.DiffRule("segment")],
        key=["code"], target_id="id",
    )


_TARGET = "(SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN c_mktsegment || '_OLD' ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 10 <> 0)"
_PLAN = f"""SELECT c.c_custkey + 2 AS line_no, CAST(c.c_custkey AS VARCHAR) AS match_key, CAST(t.id AS VARCHAR) AS target_ref,
 CASE WHEN t.id IS NULL THEN 'create' WHEN upper(c.c_mktsegment) = t.segment THEN 'skip' ELSE 'update' END AS op,
 CASE WHEN t.id IS NOT NULL AND upper(c.c_mktsegment) <> t.segment THEN '{{"v":"' || upper(c.c_mktsegment) || '"}}' END AS segment_change
 FROM customer c LEFT JOIN {_TARGET} t ON t.id = c.c_custkey"""


@query(_PLAN)
def r6_sync_plan(spark: SparkSession, sf: str) -> DataFrame:
    out = build_plan(feed(spark, sf), target(spark, sf), sync_spec())
    return out.select("line_no", "match_key", "target_ref", "op", F.try_element_at("changes", F.lit("segment")).alias("segment_change"))


@query(f"""SELECT count(*) AS rows_total, count(*) AS valid, CAST(0 AS BIGINT) AS failed, count(*) FILTER (op = 'create') AS to_create,
 count(*) FILTER (op = 'update') AS to_update, count(*) FILTER (op = 'skip') AS skipped FROM ({_PLAN})""")
def a6_plan_summary(spark, sf):
    return plan.plan_summary(build_plan(feed(spark, sf), target(spark, sf), sync_spec()))


@query(f"SELECT op, count(*) AS n FROM ({_PLAN}) WHERE op <> 'skip' GROUP BY op")
def r16_plan_items(spark, sf):
    return plan.plan_items(build_plan(feed(spark, sf), target(spark, sf), sync_spec())).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH f AS (
 SELECT c_custkey + 2 AS line_no, c_custkey AS k, c_mktsegment AS seg FROM customer
 UNION ALL SELECT c_custkey + 1000000000, c_custkey, c_mktsegment FROM customer WHERE c_custkey % 50 = 0
 UNION ALL SELECT c_custkey + 2000000000, c_custkey, c_mktsegment || 'X' FROM customer WHERE c_custkey % 70 = 0)
SELECT line_no, k, CASE WHEN row_number() OVER w = 1 THEN 'first' WHEN seg = first_value(seg) OVER w THEN 'duplicate' ELSE 'conflict' END AS dedup
FROM f WINDOW w AS (PARTITION BY k ORDER BY line_no)""")
def w1_source_dedup(spark, sf):
    c = table(spark, sf, "customer").select((F.col("c_custkey") + 2).alias("line_no"), F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"))
    same = c.where("k % 50 = 0").withColumn("line_no", F.col("k") + 1000000000)
    other = c.where("k % 70 = 0").select((F.col("k") + 2000000000).alias("line_no"), "k", F.concat("seg", F.lit("X")).alias("seg"))
    return match.source_dedup(c.unionByName(same).unionByName(other), "k", fingerprint({"seg": F.col("seg")})).select("line_no", "k", "dedup")


@query("""SELECT p_partkey, upper(p_name) AS up, regexp_replace(p_brand, '[^0-9]', '', 'g') AS digits, regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') AS alnum,
 substr(p_name, 3, 4) AS sub, upper(substr(p_name, 1, 1)) || lower(substr(p_name, 2)) AS cap, NULLIF(trim(regexp_replace('  ' || p_name || '  x ', '\\s+', ' ', 'g')), '') AS trimmed,
 regexp_extract(p_brand, '#([0-9]+)', 1) AS num, regexp_replace(p_type, 'O', '0', 'g') AS zeros, split_part(p_name, ' ', 1) AS first_word, p_name || '-' || p_type AS joined,
 CASE WHEN length(regexp_replace(p_brand, '[^0-9]', '', 'g')) = 2 THEN substr(p_brand, 7, 1) || '/' || substr(p_brand, 8, 1) END AS masked FROM part""")
def f1_string_ops(spark, sf):
    p = table(spark, sf, "part")
    c = F.col
    chains = {
        "up": (c("p_name"), [op("upper")]), "digits": (c("p_brand"), [op("digits_only")]), "alnum": (c("p_brand"), [op("strip_non_alnum")]),
        "sub": (c("p_name"), [op("substring", start=2, length=4)]), "cap": (c("p_name"), [op("capitalize")]),
        "trimmed": (F.concat(F.lit("  "), c("p_name"), F.lit("  x ")), [op("trim")]), "num": (c("p_brand"), [op("regex_extract", pattern="#([0-9]+)", group=1)]),
        "zeros": (c("p_type"), [op("regex_replace", pattern="O", repl="0")]), "first_word": (c("p_name"), [op("split", sep=" "), op("first")]),
        "joined": (F.array("p_name", "p_type"), [op("concat", sep="-")]), "masked": (c("p_brand"), [op("digits_only"), op("format_mask", mask="#/#")]),
    }
    out = run_chains(p, chains)
    return out.select("p_partkey", *[n for n in chains if n != "masked"], F.when(F.col("masked__err").isNull(), F.col("masked")).alias("masked"))


@query("""SELECT event_id, TRY_CAST(regexp_extract(props, ':\\s*([0-9]+)', 1) AS BIGINT) AS k, user_id % 2 = 0 AS even, CAST(user_id AS VARCHAR) AS user_text,
 CASE event_type WHEN 'click' THEN 'C' WHEN 'view' THEN 'V' WHEN 'purchase' THEN 'P' END AS code, coalesce(NULLIF(event_type, 'error'), 'none') AS kind,
 event_type NOT IN ('error', 'signup') AS ok_type FROM events""")
def f20_number_ops(spark, sf):
    e = table(spark, sf, "events")
    chains = {
        "k": (F.col("props"), [op("regex_extract", pattern=r":\s*([0-9]+)", group=1), op("to_int")]),
        "even": (F.when(F.col("user_id") % 2 == 0, "Yes").otherwise("No"), [op("parse_bool")]), "user_text": (F.format_string("%06d", F.col("user_id")), [op("int_if_digits")]),
        "code": (F.col("event_type"), [op("map_dict", mapping={"click": "C", "view": "V", "purchase": "P"})]),
        "kind": (F.array(F.nullif(F.col("event_type"), F.lit("error"))), [op("coalesce", default="none")]),
        "ok_type": (F.array("event_type"), [op("reject_regex", pattern="error|signup", full=True), op("count")]),
    }
    return run_chains(e, chains).select("event_id", "k", "even", "user_text", "code", "kind", (F.col("ok_type") > 0).alias("ok_type"))


@query("""SELECT p_partkey, p_brand || '|' || p_type AS key, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END AS picked, p_name AS last_kv, len(list_distinct([p_brand, p_type, p_brand])) AS n_unique,
 list_filter([p_brand, p_type, p_name], lambda x: regexp_matches(x, '^[A-Z]')) AS upper_first FROM part""")
def f27_array_ops(spark, sf):
    p = table(spark, sf, "part")
    text = F.concat(F.lit("name=old;NAME = "), F.col("p_name"), F.lit(";x"))
    chains = {
        "key": (F.array("p_brand", F.lit(" "), "p_type"), [op("build_delimited_key")]),
        "picked": (F.array(F.when(F.col("p_size") % 2 == 0, "").otherwise("g"), F.col("p_name")), [op("pick_when_blank", guard_index=0, value_index=1)]),
        "kv": (text, [op("parse_kv_pairs", keys=("name",))]), "n_unique": (F.array("p_brand", "p_type", "p_brand"), [op("unique"), op("count")]),
        "upper_first": (F.array("p_brand", "p_type", "p_name"), [op("filter_regex", pattern="^[A-Z]", flags="ascii")]),
    }
    out = run_chains(p, chains)
    return out.select("p_partkey", "key", F.coalesce("picked", "p_type").alias("picked"), F.col("kv.name").alias("last_kv"), F.col("n_unique").cast("long").alias("n_unique"), "upper_first")


@query("""SELECT p_partkey, lower(p_brand) || '/' || lower(p_type) || '/' || CAST(p_size AS VARCHAR) AS path, lower(p_name) AS cmp,
 CASE WHEN length(p_name) > 8 THEN substr(p_name, 1, 5) || '...' ELSE p_name END AS short FROM part""")
def f46_canonical_text(spark, sf):
    p = table(spark, sf, "part")
    segs = F.array(F.concat(F.lit(" "), "p_brand"), F.concat("p_type", F.lit("\t")), F.lit(" "), F.col("p_size").cast("string"))
    path = F.array_join(canonical_segments(segs, [("trim",), ("lower",)], drop_blank=True), "/")
    return p.select("p_partkey", path.alias("path"), compare_form(F.concat(F.lit(" "), "p_name")).alias("cmp"), shorten(F.col("p_name"), 8).alias("short"))


@query("SELECT o_orderkey, CAST(('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT % 100 AS BIGINT) AS bucket, substr(sha256('s' || o_orderkey), 1, 12) AS digest FROM orders")
def f52_bucket_cover(spark, sf):
    k = F.col("o_orderkey").cast("string")
    return table(spark, sf, "orders").select("o_orderkey", percent_bucket(k).alias("bucket"), key_digest(k, "s").alias("digest"))


@query("""SELECT c_custkey, n_name AS nation, r_name AS region, CASE WHEN n_name IS NULL THEN 'none' ELSE 'selected' END AS nation__status
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 5 <> 0 LEFT JOIN region ON r_regionkey = n_regionkey""")
def j3_dictionary_lookup(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf, "nation").where("n_nationkey % 5 <> 0")
    r = table(spark, sf, "region")
    by_nation = n.join(r, F.col("r_regionkey") == F.col("n_regionkey"))
    return lookup.enrich(c, "c_custkey", [
        lookup.LookupRule("nation", F.col("c_nationkey"), n, F.col("n_nationkey"), F.col("n_name")),
        lookup.LookupRule("region", F.col("nation"), by_nation, F.col("n_name"), F.col("r_name")),
    ]).select("c_custkey", "nation", "region", "nation__status")


@query("""SELECT p_partkey, CASE WHEN n = 1 THEN 'selected' ELSE 'ambiguous' END AS status FROM part JOIN (SELECT p_name, count(*) AS n FROM part GROUP BY p_name) USING (p_name)""")
def a1_candidate_decision(spark, sf):
    p = table(spark, sf, "part")
    out = lookup.enrich(p, "p_partkey", [lookup.LookupRule("found", F.col("p_name"), p, F.col("p_name"), F.col("p_partkey"))])
    return out.select("p_partkey", F.col("found__status").alias("status"))


@query("SELECT o_orderkey, o_custkey % 13 <> 0 AS known FROM orders")
def j5_exists(spark, sf):
    held = table(spark, sf, "customer").where("c_custkey % 13 <> 0")
    return lookup.exists_in(table(spark, sf, "orders"), F.col("o_custkey"), held, F.col("c_custkey"), "known").select("o_orderkey", "known")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN s_name WHEN s_suppkey % 2 <> 0 THEN s_name || '-1' ELSE s_name || '-2' END AS value, false AS value__conflict FROM supplier""")
def j6_unique_value(spark, sf):
    s = table(spark, sf, "supplier")
    taken = s.where("s_suppkey % 3 = 0").select(F.col("s_name").alias("v")).unionByName(s.where("s_suppkey % 6 = 0").select(F.concat("s_name", F.lit("-1")).alias("v")))
    return lookup.unique_value(s, "s_suppkey", F.col("s_name"), ["-1", "-2"], taken, F.col("v")).select("s_suppkey", "value", "value__conflict")


@query("""WITH t AS (SELECT p_name, min(p_partkey) AS lo, max(p_partkey) AS hi FROM part WHERE p_partkey % 3 <> 0 GROUP BY p_name)
SELECT p.p_partkey, CASE WHEN p.p_partkey % 3 <> 0 THEN 'matched' WHEN t.lo IS NULL THEN 'not_found' WHEN CAST(t.lo AS VARCHAR) = CAST(t.hi AS VARCHAR) THEN 'matched' ELSE 'conflict' END AS match_status,
 CASE WHEN p.p_partkey % 3 <> 0 OR t.lo IS NULL THEN 'id' ELSE 'name' END AS identity_rule FROM part p LEFT JOIN t USING (p_name)""")
def j8_identity_match(spark, sf):
    p = table(spark, sf, "part")
    rules_ = [match.IdentityRule("id", F.col("p_partkey"), F.col("p_partkey")), match.IdentityRule("name", F.col("p_name"), F.col("p_name"))]
    return match.identity_match(p, "p_partkey", p.where("p_partkey % 3 <> 0"), "p_partkey", rules_).select("p_partkey", "match_status", "identity_rule")


_FUZZY = """WITH pairs AS (SELECT a.p_partkey AS row_id, b.p_partkey AS cand_id, (CASE WHEN a.p_name = b.p_name THEN 3.0 ELSE 0 END + CASE WHEN lower(a.p_brand) = lower(b.p_brand) THEN 1.0 ELSE 0 END) / 4 AS score,
 row_number() OVER (PARTITION BY a.p_partkey ORDER BY b.p_partkey) AS ord FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_size = b.p_size WHERE a.p_partkey % 2 = 0 AND b.p_partkey % 2 = 1),
capped AS (SELECT * FROM pairs WHERE ord <= 20), ranked AS (SELECT *, row_number() OVER w AS rk, lead(score) OVER w AS nxt FROM capped WINDOW w AS (PARTITION BY row_id ORDER BY score DESC, ord))"""


@query(_FUZZY + """ SELECT row_id, CASE WHEN score - nxt < 0.05 THEN 'ambiguous' WHEN score >= 0.7 THEN 'matched' WHEN score >= 0.2 THEN 'review' ELSE 'not_found' END AS decision, cand_id, score FROM ranked WHERE rk = 1""")
def j11_fuzzy_match(spark, sf):
    p = table(spark, sf, "part").withColumn("block", F.concat_ws("|", "p_type", F.col("p_size").cast("string")))
    pairs = match.block_candidates(p.where("p_partkey % 2 = 0").withColumnRenamed("p_partkey", "row_id"), "row_id", p.where("p_partkey % 2 = 1"), "p_partkey", ["block"], 20, ["p_name", "p_brand"])
    scored = match.score_candidates(pairs, [match.Comparator("p_name", "exact", 3.0), match.Comparator("p_brand", "casefold", 1.0)])
    return match.fuzzy_decision(scored, "row_id", 0.7, 0.2, 0.05).select("row_id", "decision", "cand_id", "score")


@query()
def j10_similarity_scores(spark, sf):
    """Candidates scored by text similarity; checked against difflib in the tests."""
    p = table(spark, sf, "part").withColumn("block", F.concat_ws("|", "p_type", F.col("p_size").cast("string")))
    pairs = match.block_candidates(p.where("p_partkey % 2 = 0").withColumnRenamed("p_partkey", "row_id"), "row_id", p.where("p_partkey % 2 = 1"), "p_partkey", ["block"], 20, ["p_name"])
    return match.score_candidates(pairs, [match.Comparator("p_name", "similarity")]).select("row_id", "cand_id", "score")


@query("""WITH ids AS (SELECT p_name, p_brand, list(CAST(p_partkey AS VARCHAR)) AS ids FROM part WHERE p_partkey % 13 <> 0 GROUP BY ALL),
n AS (SELECT p_name, count(*) AS n FROM part WHERE p_partkey % 13 <> 0 GROUP BY p_name)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN s_suppkey IS NULL THEN 'unresolved' ELSE 'resolved' END AS supplier__status, CAST(s_suppkey AS VARCHAR) AS supplier__id,
 CASE WHEN n.n IS NULL THEN 'unresolved' WHEN n.n = 1 OR len(ids.ids) = 1 THEN 'resolved' ELSE 'ambiguous' END AS part__status
FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem) l JOIN part p ON p.p_partkey = l.l_partkey
LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey AND s.s_suppkey % 13 <> 0
LEFT JOIN n ON n.p_name = p.p_name LEFT JOIN ids ON ids.p_name = p.p_name AND ids.p_brand = p.p_brand""")
def j12_link_resolution(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    p, s = table(spark, sf, "part"), table(spark, sf, "supplier")
    rows = li.join(p, F.col("p_partkey") == F.col("l_partkey")).withColumn("rid", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    parts = links.identity_index(p.where("p_partkey % 13 <> 0"), "p_partkey", {"name": F.col("p_name"), "name_brand": F.concat_ws("|", "p_name", "p_brand")})
    sup = links.identity_index(s.where("s_suppkey % 13 <> 0"), "s_suppkey", {"supp": F.col("s_suppkey")})
    rules_ = [
        links.LinkRule("supplier", (("supp", F.col("l_suppkey")),)),
        links.LinkRule("part", (("name", F.col("p_name")),), ((("name_brand", F.concat_ws("|", "p_name", "p_brand")),),)),
    ]
    out = links.resolve_links(rows, "rid", rules_, parts.unionByName(sup))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "supplier__status", "supplier__id", "part__status")


@query("""SELECT 'brand:' || p_brand AS lookup_key, CAST(p_partkey AS VARCHAR) AS id FROM part WHERE p_brand <> 'Brand#1' OR p_size > 25""")
def j15_batch_first(spark, sf):
    p = table(spark, sf, "part")
    batch = links.identity_index(p.where("p_brand = 'Brand#1' and p_size > 25"), "p_partkey", {"brand": F.col("p_brand")})
    stored = links.identity_index(p, "p_partkey", {"brand": F.col("p_brand")})
    return links.batch_first(batch, stored)


@query("SELECT 'cust:' || o_custkey AS lookup_key, list_sort(list(DISTINCT CAST(o_orderkey AS VARCHAR))) AS ids FROM orders GROUP BY o_custkey")
def a3_identity_index(spark, sf):
    o = table(spark, sf, "orders")
    return links.lookup_ids(links.identity_index(o, "o_orderkey", {"cust": F.col("o_custkey")}))


@query("""SELECT user_id, event_id, event_type, count AS sightings FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY user_id) AS count FROM events) WHERE rn = 1""")
def w5_last_wins(spark, sf):
    return cache.last_wins(table(spark, sf, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "sightings")


_NEW = "(SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events WHERE event_id % 3 = 0 GROUP BY user_id)"
_OLD = "(SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events WHERE event_id % 3 <> 0 AND user_id % 4 <> 0 GROUP BY user_id)"


@query(f"SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(n.event_type, o.event_type) AS event_type, CASE WHEN o.user_id IS NULL THEN 'inserted' WHEN n.user_id IS NULL THEN 'kept' ELSE 'updated' END AS change FROM {_OLD} o FULL JOIN {_NEW} n ON o.user_id = n.user_id")
def k3_upsert(spark, sf):
    e = table(spark, sf, "events")
    pick = lambda d: cache.last_wins(d, "user_id", ["event_id"]).select("user_id", "event_type")
    return cache.upsert(pick(e.where("event_id % 3 <> 0 and user_id % 4 <> 0")), pick(e.where("event_id % 3 = 0")), "user_id")


@query(f"""WITH n AS (SELECT user_id, count(*) AS c FROM events WHERE event_id % 3 = 0 AND event_type <> 'error' GROUP BY user_id), o AS (SELECT DISTINCT user_id FROM events WHERE event_id % 3 <> 0 AND user_id % 4 <> 0)
SELECT (SELECT count(*) FROM events WHERE event_id % 3 = 0 AND event_type = 'error') AS skipped, CAST(0 AS BIGINT) AS failed, count(*) FILTER (o.user_id IS NULL) AS inserted,
 CAST(coalesce(sum(c - CASE WHEN o.user_id IS NULL THEN 1 ELSE 0 END), 0) AS BIGINT) AS updated FROM n LEFT JOIN o USING (user_id)""")
def r21_cache_refresh(spark, sf):
    e = table(spark, sf, "events")
    old = cache.last_wins(e.where("event_id % 3 <> 0 and user_id % 4 <> 0"), "user_id", ["event_id"]).select("user_id", "event_type", "value")
    cols = [cache.CacheColumn("user_id", F.col("user_id"), "bigint", required=True), cache.CacheColumn("event_type", F.col("event_type")), cache.CacheColumn("value", F.col("value"), "double")]
    _, counts = cache.refresh(old, e.where("event_id % 3 = 0"), cols, "user_id", ["event_id"], cache.soft_deleted(any_rules=[("equals", F.col("event_type"), "error")]))
    return counts


@query("""SELECT p_partkey FROM (SELECT *, first_value(p_partkey) OVER (PARTITION BY p_name ORDER BY p_partkey) AS owner FROM part) WHERE owner <> p_partkey""")
def w7_unique_violations(spark, sf):
    p = table(spark, sf, "part")
    return cache.unique_violations(p.withColumn("ord", F.col("p_partkey")), "p_partkey", "p_name", "ord").select("p_partkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%widget' AND p_brand IN ('Brand#1', 'Brand#2') AND p_type = 'PROMO'")
def p15_find(spark, sf):
    return cache.find(table(spark, sf, "part"), equals={"p_type": "PROMO"}, like={"p_name": "%WIDGET"}, within={"p_brand": ["Brand#1", "Brand#2"]}).select("p_partkey", "p_name")


@query("SELECT dataset, count(*) AS rows FROM (SELECT 'customer' AS dataset FROM customer UNION ALL SELECT 'part' FROM part UNION ALL SELECT 'supplier' FROM supplier) GROUP BY ROLLUP (dataset)")
def a10_cache_status(spark, sf):
    return cache.status_by_dataset({n: table(spark, sf, n) for n in ("customer", "part", "supplier")})


def tree(spark, sf):
    """Regions, nations and customers as one tree of text ids."""
    r = table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lower("r_name").alias("label"))
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node_id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.lower("n_name").alias("label"))
    c = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node_id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"), F.lower("c_name").alias("label"))
    return r.unionByName(n).unionByName(c)


_TREE = """SELECT 'r' || r_regionkey AS node_id, lower(r_name) AS path, CAST(0 AS INTEGER) AS depth, 'r' || r_regionkey AS root_id FROM region
UNION ALL SELECT 'n' || n_nationkey, lower(r_name) || '/' || lower(n_name), 1, 'r' || r_regionkey FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT 'c' || c_custkey, lower(r_name) || '/' || lower(n_name) || '/' || lower(c_name), 2, 'r' || r_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"""


@query(_TREE)
def h4_paths(spark, sf):
    return hierarchy.path_table(tree(spark, sf)).select("node_id", F.array_join("path", "/").alias("path"), "depth", "root_id")


@query("""SELECT 'r' || n_regionkey AS node_id, 'n' || n_nationkey AS descendant_id, CAST(1 AS INTEGER) AS distance FROM nation
UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 1 FROM customer UNION ALL SELECT 'r' || n_regionkey, 'c' || c_custkey, 2 FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def h5_descendants(spark, sf):
    return hierarchy.descendants(hierarchy.path_table(tree(spark, sf))).drop("order_path")


_SOURCE = "SELECT p_partkey AS node_id, CASE WHEN p_partkey = 0 THEN NULL WHEN p_partkey % 97 = 0 THEN 1000000 + p_partkey WHEN p_partkey % 89 = 0 THEN p_partkey + 1 WHEN p_partkey % 89 = 1 AND p_partkey > 1 THEN p_partkey - 1 ELSE p_partkey // 2 END AS parent_id FROM part"


@query(f"""WITH RECURSIVE s AS ({_SOURCE}), up(node_id, cur, k) AS (SELECT node_id, node_id, 0 FROM s UNION ALL SELECT up.node_id, s.parent_id, k + 1 FROM up JOIN s ON s.node_id = up.cur WHERE s.parent_id IS NOT NULL AND k < 40),
last AS (SELECT node_id, max(k) AS k, arg_max(cur, k) AS cur FROM up GROUP BY node_id)
SELECT node_id, CASE WHEN k >= 40 THEN 'cycle' WHEN cur < 1000000 THEN 'anchored' WHEN k = 1 THEN 'missing_parent' ELSE 'unanchored_subtree' END AS verdict FROM last""")
def j21_anchoring(spark, sf):
    k = F.col("p_partkey")
    parent = F.when(k == 0, None).when(k % 97 == 0, k + 1000000).when(k % 89 == 0, k + 1).when((k % 89 == 1) & (k > 1), k - 1).otherwise(F.floor(k / 2))
    nodes = table(spark, sf, "part").select(k.alias("node_id"), parent.cast("long").alias("parent_id"))
    return hierarchy.anchor_verdicts(nodes, nodes.limit(0)).select("node_id", "verdict")


_PREFIX = "SELECT {c} AS label, CAST({d} AS INTEGER) AS depth, sha256('[' || {n} || ']') AS node_id, {p} AS parent_id FROM (SELECT DISTINCT {k} FROM part)"
_JSON = [f"""'"' || {c} || '"'""" for c in ("p_brand", "p_type", "p_size")]


@query(" UNION ALL ".join(
    _PREFIX.format(c=f"CAST({c} AS VARCHAR)", d=i, n=" || ',' || ".join(_JSON[: i + 1]), p="sha256('[' || " + " || ',' || ".join(_JSON[:i]) + " || ']')" if i else "NULL", k=", ".join(("p_brand", "p_type", "p_size")[: i + 1]))
    for i, c in enumerate(("p_brand", "p_type", "p_size"))
))
def h1_prefix_tree(spark, sf):
    p = table(spark, sf, "part").select(F.array("p_brand", "p_type", F.lit(" "), F.col("p_size").cast("string")).alias("path"))
    return hierarchy.prefix_tree(p)


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'exact_path' WHEN c_custkey % 3 = 1 THEN 'last_two' ELSE 'none' END AS mode, CASE WHEN c_custkey % 3 <> 2 THEN 'n' || c_nationkey END AS node_id FROM customer""")
def j16_path_ladder(spark, sf):
    c = table(spark, sf, "customer")
    paths = hierarchy.path_table(tree(spark, sf).where("node_id not like 'c%'"))
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    named = c.join(n, F.col("n_nationkey") == F.col("c_nationkey")).join(r, F.col("r_regionkey") == F.col("n_regionkey"))
    full = F.array(F.lower("r_name"), F.lower("n_name"))
    segs = F.when(F.col("c_custkey") % 3 == 0, full).when(F.col("c_custkey") % 3 == 1, F.concat(F.array(F.lit("world")), full)).otherwise(F.array(F.lit("x"), F.lower("n_name")))
    rows = named.select("c_custkey", segs.alias("segs"))
    cands = c.select("c_custkey", F.concat(F.lit("n"), "c_nationkey").alias("node_id"))
    return hierarchy.ladder(rows, "c_custkey", "segs", cands, paths)


@query("SELECT c_custkey, CASE WHEN c_nationkey % 5 = 0 THEN '***' ELSE c_name END AS c_name, CASE WHEN c_nationkey % 5 = 0 THEN c_name END AS secret FROM customer")
def r17_secret_split(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", F.when(F.col("c_nationkey") % 5 == 0, F.col("c_name")).alias("token"), F.col("c_custkey").cast("string").alias("match_key"))
    rows, side = lookup.split_secrets(c, ["token"], "customer")
    back = rows.join(side.select("match_key", F.col("value").alias("secret")), "match_key", "left")
    return back.select("c_custkey", F.when(F.col("secret").isNotNull(), "***").otherwise(F.col("c_name")).alias("c_name"), "secret")


@query("""SELECT CASE WHEN c_nationkey % 2 = 0 AND c_custkey % 11 <> 0 THEN 'create' WHEN c_custkey % 11 = 0 THEN 'failed' ELSE 'update' END AS outcome, CASE WHEN c_custkey % 11 = 0 THEN 'name: missing' END AS error, count(*) AS n FROM customer GROUP BY ALL""")
def a16_dry_run(spark, sf):
    c = table(spark, sf, "customer").select(F.when(F.col("c_custkey") % 11 != 0, F.col("c_name")).alias("name"), F.when(F.col("c_nationkey") % 2 == 0, "create").otherwise("update").alias("op"))
    _, err = plan.payload([plan.PayloadField("name", "name", required=True)])
    return plan.dry_run(c, err)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, '{"qty":"' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '","flag":"' || CASE WHEN l_returnflag = 'R' THEN 'yes' ELSE 'no' END || '"}' AS body FROM lineitem""")
def p16_payload(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("bigint").alias("qty"), (F.col("l_returnflag") == "R").alias("returned"), F.lit(" ").alias("note"))
    body, _ = plan.payload([plan.PayloadField("qty", "qty", "int"), plan.PayloadField("returned", "flag", "bool", true_as="yes", false_as="no"), plan.PayloadField("note", "note", conditional=True)])
    return li.select("l_orderkey", "l_linenumber", "l_partkey", body.alias("body"))


@query("""SELECT stage, severity, count(*) AS n FROM (SELECT 'normalize' AS stage, 'error' AS severity FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'map', 'warning' FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY ROLLUP (stage, severity)""")
def a8_report_counts(spark, sf):
    c = table(spark, sf, "customer")
    rows = diagnostics.add(c, errors=[diagnostics.diag("normalize", "NEGATIVE", "c_acctbal", None, F.col("c_acctbal") < 0)], warnings=[diagnostics.diag("map", "BUILDING", "c_mktsegment", None, F.col("c_mktsegment") == "BUILDING")])
    return diagnostics.report_counts(rows)


@query("""SELECT count(*) AS rows_total, count(*) FILTER (p_size <= 5) AS failed, count(*) FILTER (p_size > 5) AS ok, CAST(0 AS BIGINT) AS with_warnings FROM part""")
def a7_stage_stats(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") > 5, F.col("p_size").cast("string")).otherwise("small").alias("size"))
    return diagnostics.stage_stats(rules.check_sink(p, [SinkField("size", "int", required=True)]), "normalize")


@query("SELECT p_partkey, lower(p_name) AS name, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS BIGINT) END AS size, p_size % 2 = 0 AS row_ok FROM part")
def p6_normalize(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.lit(" "), "p_name").alias("name"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("n/a").alias("size"))
    out = rules.normalize_rows(p, [NormalizeRule("name", (op("trim"), op("lower"))), NormalizeRule("size", (op("to_int"),))])
    return out.select("p_partkey", "name", "size", (F.size("errors") == 0).alias("row_ok"))


_PENDING = "SELECT DISTINCT l_suppkey AS s FROM lineitem"


@query(f"SELECT CASE WHEN s % 2 = 0 THEN 'resolved' ELSE 'pending' END AS status, count(*) AS n FROM ({_PENDING}) GROUP BY ALL")
def j22_wake_pending(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s")).distinct()
    req = li.select(F.lit("lineitem").alias("dataset"), F.col("s").cast("string").alias("source_row_id"), F.lit("supplier").alias("field"), F.concat(F.lit("supp:"), "s").alias("lookup_key"), F.lit("{}").alias("payload"))
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    kinds = "dataset string, source_row_id string, field string, lookup_key string, payload string, attempts int, status string, created_at timestamp, last_attempt_at timestamp, expires_at timestamp"
    stored = pending.upsert_pending(spark.createDataFrame([], kinds), req, now, 3600, 5)
    here = table(spark, sf, "supplier").where("s_suppkey % 2 = 0").select(F.lit("lineitem").alias("dataset"), F.concat(F.lit("supp:"), "s_suppkey").alias("lookup_key"))
    return pending.wake(stored, here).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS node_id FROM lineitem")
def s10_membership(spark, sf):
    return files.membership(table(spark, sf, "lineitem"), "l_partkey")


@query("""SELECT c_custkey, n_name AS nation FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def j2_canonical_lookup(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    key = c.join(n.select("n_nationkey", F.lower("n_name").alias("low")), F.col("n_nationkey") == F.col("c_nationkey"))
    key = key.select("c_custkey", F.concat(F.lit("  "), "low", F.lit("\t")).alias("k"))
    rule = lookup.LookupRule("nation", F.col("k"), n, F.col("n_name"), F.col("n_name"))
    found = lookup.canonical_lookup(key, "c_custkey", rule, compare_form, limit=2)
    return found.select("c_custkey", lookup.decide(F.col("candidates"))["value"].alias("nation"))


@query("""SELECT CASE WHEN GROUPING(l_returnflag) = 1 THEN NULL ELSE l_returnflag END AS dictionary, count(*) FILTER (l_partkey % 3 <> 0) AS hits, count(*) FILTER (l_partkey % 3 = 0) AS misses, CAST(0 AS BIGINT) AS errors FROM lineitem GROUP BY ROLLUP (l_returnflag)""")
def a15_lookup_counters(spark, sf):
    held = table(spark, sf, "part").where("p_partkey % 3 <> 0")
    found = lookup.exists_in(table(spark, sf, "lineitem"), F.col("l_partkey"), held, F.col("p_partkey"), "hit")
    return lookup.lookup_counters(found, "l_returnflag", F.col("hit"))


@query("""SELECT count(*) AS rows, CAST(0 AS BIGINT) AS null_keys, count(*) FILTER (p_size > 40) AS null_size, (SELECT count(*) FROM (SELECT p_name FROM part GROUP BY p_name HAVING count(*) > 1)) AS duplicate_keys FROM part""")
def s5_dictionary_checks(spark, sf):
    p = table(spark, sf, "part").select("p_name", F.when(F.col("p_size") <= 40, F.col("p_size")).alias("size"))
    return files.check_dictionary(p, "p_name", ["size"])


@query("SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS node_id, CASE WHEN c_nationkey <> 0 THEN CAST(c_nationkey AS VARCHAR) END AS parent_id, c_name AS label FROM customer")
def s7_adjacency(spark, sf):
    n = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_nationkey") == 0, " NULL ").otherwise(F.col("c_nationkey").cast("string")).alias("p"), F.concat(F.lit(" "), "c_name").alias("l"))
    return files.adjacency(n.unionByName(n), "c_custkey", "p", "l")


@query(f"SELECT node_id, parent_id FROM ({_SOURCE}) WHERE parent_id >= 1000000 OR parent_id >= (SELECT count(*) FROM part)")
def j20_orphans(spark, sf):
    return hierarchy.missing_parents(part_nodes(spark, sf))


def part_nodes(spark, sf):
    """Parts as a source tree with absent parents and two-node cycles."""
    k = F.col("p_partkey")
    parent = F.when(k == 0, None).when(k % 97 == 0, k + 1000000).when(k % 89 == 0, k + 1).when((k % 89 == 1) & (k > 1), k - 1).otherwise(F.floor(k / 2))
    return table(spark, sf, "part").select(k.alias("node_id"), parent.cast("long").alias("parent_id"))


@query("SELECT p_name AS node_id, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def a5_duplicate_nodes(spark, sf):
    return hierarchy.duplicate_nodes(table(spark, sf, "part").select(F.col("p_name").alias("node_id")))


@query("""SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) AS nodes, (SELECT count(*) FROM region) AS roots, CAST(2 AS BIGINT) AS max_depth""")
def a14_tree_profile(spark, sf):
    nodes = tree(spark, sf)
    return hierarchy.profile(nodes, hierarchy.path_table(nodes))


@query("SELECT 'n' || c_nationkey AS node_id, list_sort(list('c' || c_custkey)) AS children FROM customer GROUP BY c_nationkey")
def l6_children(spark, sf):
    return hierarchy.children(tree(spark, sf).where("node_id like 'c%'"))


@query("""SELECT p_partkey AS line_no, CASE WHEN p_size % 10 = 0 AND p_partkey % 2 = 0 THEN 'empty' WHEN row_number() OVER (PARTITION BY CASE WHEN p_size % 10 = 0 AND p_partkey % 2 = 0 THEN 'e' ELSE p_brand || '/' || p_type END ORDER BY p_partkey) > 1 THEN 'repeated' WHEN p_partkey % 2 = 0 THEN 'gaps' ELSE 'ok' END AS path_state FROM part""")
def h2_path_checks(spark, sf):
    p = table(spark, sf, "part")
    none = (F.col("p_size") % 10 == 0) & (F.col("p_partkey") % 2 == 0)
    path = F.when(none, F.array(F.lit(" "), F.lit(None).cast("string"))).when(F.col("p_partkey") % 2 == 0, F.array("p_brand", F.lit(""), "p_type")).otherwise(F.array("p_brand", "p_type"))
    return hierarchy.path_checks(p.select(F.col("p_partkey").alias("line_no"), path.alias("path"))).select("line_no", "path_state")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) || '|' || o_orderstatus END AS match_key FROM orders")
def r1_match_key(spark, sf):
    o = table(spark, sf, "orders")
    cust = F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey").cast("string")).otherwise(" ")
    key, _ = lookup.match_key([cust, F.concat(F.lit(" "), "o_orderstatus")])
    return o.select("o_orderkey", key.alias("match_key"))


@query(f"SELECT line_no, op FROM ({_PLAN}) WHERE op <> 'skip' ORDER BY line_no LIMIT 25")
def l5_first_actions(spark, sf):
    items = plan.plan_items(build_plan(feed(spark, sf), target(spark, sf), sync_spec()))
    return plan.first_actions(items, 25).select("line_no", "op")


@query("""SELECT CASE WHEN count(*) FILTER (p_size <= 5) = 0 THEN 'SUCCESS' WHEN count(*) FILTER (p_size <= 5) < count(*) THEN 'PARTIAL' ELSE 'FAILED' END AS status,
 round(100.0 * count(*) FILTER (p_size <= 5) / count(*), 3) AS fail_rate, round(100.0 * count(*) FILTER (p_size <= 5) / count(*), 3) > 5 AS fail_rate_alert FROM part""")
def a9_run_status(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") > 5, F.col("p_size").cast("string")).otherwise("small").alias("size"))
    s = diagnostics.stage_stats(rules.check_sink(p, [SinkField("size", "int", required=True)]), "normalize")
    return plan.rates(s, {"fail_rate": ("failed", "rows_total")}, {"fail_rate": 5.0}).select(diagnostics.run_status(F.col("rows_total"), F.col("failed")).alias("status"), "fail_rate", "fail_rate_alert")


@query("""SELECT row_id, cand_id, CAST(rk AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, ord) AS rk FROM (""" + _FUZZY + """ SELECT row_id, cand_id, ord, score FROM capped)) WHERE rk <= 2""")
def l1_top_candidates(spark, sf):
    p = table(spark, sf, "part").withColumn("block", F.concat_ws("|", "p_type", F.col("p_size").cast("string")))
    pairs = match.block_candidates(p.where("p_partkey % 2 = 0").withColumnRenamed("p_partkey", "row_id"), "row_id", p.where("p_partkey % 2 = 1"), "p_partkey", ["block"], 20, ["p_name", "p_brand"])
    scored = match.score_candidates(pairs, [match.Comparator("p_name", "exact", 3.0), match.Comparator("p_brand", "casefold", 1.0)])
    top = match.fuzzy_decision(scored, "row_id", 0.7, 0.2, 0.05, top_k=2)
    return top.select("row_id", F.posexplode("top").alias("pos", "t")).select("row_id", "t.cand_id", (F.col("pos") + 1).alias("rank"))


@query("""SELECT user_id, CASE WHEN sum(value) FILTER (event_type = 'error') IS NULL THEN false ELSE true END AS deleted FROM events GROUP BY user_id""")
def p13_soft_delete(spark, sf):
    e = table(spark, sf, "events").withColumn("d", cache.soft_deleted(any_rules=[("equals", F.col("event_type"), "ERROR")]))
    return e.groupBy("user_id").agg(F.bool_or("d").alias("deleted"))


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P'""")
def u1_replay(spark, sf):
    o = table(spark, sf, "orders")
    waiting = pending.encode(o.where("o_orderstatus = 'P'").select("o_orderkey", "o_custkey"), ["o_orderkey", "o_custkey"])
    at = F.lit("2024-01-01").cast("timestamp")
    stored = waiting.select(F.lit("orders").alias("dataset"), F.col("o_orderkey").cast("string").alias("source_row_id"), F.lit("cust").alias("field"), F.lit("k").alias("lookup_key"), "payload", F.lit("pending").alias("status"), at.alias("created_at"), at.alias("last_attempt_at"))
    return pending.replay(o.where("o_orderstatus <> 'P'").select("o_orderkey", "o_custkey"), stored, "o_orderkey long, o_custkey long", "o_orderkey").select("o_orderkey", "o_custkey")


@query("""WITH t AS (SELECT p_name, min(p_partkey) AS lo, count(*) AS n FROM part GROUP BY p_name)
SELECT p_partkey, CASE WHEN n = 1 THEN 'matched' WHEN p_partkey % 2 = 0 THEN 'matched' ELSE 'ambiguous' END AS match_status, CASE WHEN n > 1 AND p_partkey % 2 = 0 THEN 'exact_path' END AS topology_mode FROM part JOIN t USING (p_name)""")
def j17_topology_refinement(spark, sf):
    from concordat.operators import topology

    p = table(spark, sf, "part")
    n = p.groupBy("p_name").agg(F.count(F.lit(1)).alias("n"))
    rows = p.join(n, "p_name").select("p_partkey", F.when(F.col("n") == 1, "matched").otherwise("ambiguous").alias("match_status"), F.when(F.col("n") == 1, F.col("p_partkey").cast("string")).alias("target_ref"), F.when(F.col("p_partkey") % 2 == 0, topology.locator([F.lit(" Parts "), F.col("p_partkey")])).alias("segs"))
    paths = p.select(F.col("p_partkey").cast("string").alias("node_id"), F.array(F.lit("parts"), F.col("p_partkey").cast("string")).alias("path"))
    # Each row's candidates: itself and its neighbour.
    cands = p.select("p_partkey", F.explode(F.array(F.col("p_partkey").cast("string"), (F.col("p_partkey") + 1).cast("string"))).alias("node_id"))
    return topology.refine_match(rows, "p_partkey", "segs", cands, paths).select("p_partkey", "match_status", "topology_mode")
