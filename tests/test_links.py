"""Links by data set, narrowing, policies, staged matching, bounded similarity."""

import random
from difflib import SequenceMatcher
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from concordat.functions.ops import op
from concordat.operators import links, match, resolve
from concordat.operators.rules import MapRule
from concordat.plans.sync import SyncSpec, build_plan, pending_requests

ENTRY = "dataset string, lookup_key string, id string"
MGR = links.LinkRule("manager_id", (("match_key", "manager_id"),), ((("organization_id", "organization_id"),),), dataset="people", target_id="_ouid", coerce="int")


def linked(spark, entries, batch=(), waiting=links.Waiting(), stored=None):
    rows = spark.createDataFrame([("r1", "mgr", "10")], "rid string, manager_id string, organization_id string")
    index = spark.createDataFrame([("people", k, i) for k, i in entries], ENTRY)
    batch = spark.createDataFrame(list(batch), "lookup_key string, id string") if batch else None
    r = links.apply_links(rows, "rid", [MGR], index, batch, waiting, stored).first()
    return SimpleNamespace(id=r.manager_id, stopped=r.stopped, pending=r.pending, codes=[d.code for d in r.errors + r.warnings], asked=len(r.requests))


def test_six_kinds_of_links(spark):
    key = "match_key:mgr"
    assert vars(linked(spark, [(key, "42")])) == {"id": "42", "stopped": False, "pending": False, "codes": [], "asked": 0}
    assert vars(linked(spark, [])) == {"id": "mgr", "stopped": True, "pending": True, "codes": ["RESOLVE_PENDING"], "asked": 1}
    assert vars(linked(spark, [], waiting=links.Waiting(1))) == {"id": "mgr", "stopped": True, "pending": True, "codes": ["RESOLVE_MAX_ATTEMPTS"], "asked": 1}
    assert vars(linked(spark, [], waiting=links.Waiting(0, True))) == {"id": "mgr", "stopped": False, "pending": True, "codes": ["RESOLVE_PENDING"], "asked": 1}
    assert linked(spark, [], [(key, "99")]).id == "99" and linked(spark, [(key, "42")], [(key, "99")]).id == "99"
    assert linked(spark, [(key, "42"), (key, "43"), ("organization_id:10", "42")]).id == "42"
    both = linked(spark, [(key, "42"), (key, "43")])
    assert both.codes == ["RESOLVE_PENDING"] and both.id == "mgr"  # several records wait too, by default


def test_a_stop_is_not_taken_back(spark):
    """Attempts are used up for the first rule; the second one waits in part and must not let the row go on."""
    rows = spark.createDataFrame([("r1", "a", "b")], "rid string, x string, y string")
    stored = spark.createDataFrame([("d", "r1", "x", "k:a", "pending", 4)], "dataset string, source_row_id string, field string, lookup_key string, status string, attempts int")
    rules = [links.LinkRule(f, (("k", f),), dataset="d") for f in ("x", "y")]
    r = links.apply_links(rows, "rid", rules, spark.createDataFrame([], ENTRY), waiting=links.Waiting(5, True), stored=stored).first()
    assert r.stopped and [d.code for d in r.errors] == ["RESOLVE_MAX_ATTEMPTS"] and [d.code for d in r.warnings] == ["RESOLVE_PENDING"] and len(r.requests) == 2


@pytest.mark.parametrize("policy,codes,stopped,seen", [("pending", ["RESOLVE_PENDING"], True, False), ("hard_error", ["RESOLVE_CONFLICT"], True, False), ("skip", ["RESOLVE_PENDING"], True, True)])
def test_policies_of_positions(spark, policy, codes, stopped, seen):
    """A position's wait or error ends the row; skip leaves it to the rule, after which later rules are still looked at."""
    rows = spark.createDataFrame([("r1", "a", "b", ["root", "leaf"]), ("r2", "a", "b", ["root", "one"])], "rid string, x string, y string, path array<string>")
    paths = spark.createDataFrame([("1", ["root", "leaf"]), ("2", ["root", "leaf"]), ("3", ["root", "one"])], "node_id string, path array<string>")
    index = spark.createDataFrame([("d", "k:a", i) for i in "123"] + [("d", "k:b", "7")], ENTRY)
    rules = [links.LinkRule("x", (("k", "x"),), dataset="d", position=links.Position("path", paths, on_ambiguous=policy)), links.LinkRule("y", (("k", "y"),), dataset="d")]
    got = {r.rid: r for r in links.apply_links(rows, "rid", rules, index).collect()}
    assert got["r2"].x == "3" and got["r2"].y == "7" and not got["r2"].stopped
    assert [d.code for d in got["r1"].errors + got["r1"].warnings] == codes and got["r1"].stopped is stopped and (got["r1"].y == "7") is seen


def test_equal_keys_of_two_datasets_stay_apart(spark, tmp_path):
    rows = spark.createDataFrame([(1, "X")], "rid int, code string")
    index = spark.createDataFrame([("orgs", "code:X", "o1"), ("people", "code:X", "p1")], ENTRY)
    rules = [links.LinkRule(d, (("code", "code"),), dataset=d) for d in ("orgs", "people", "cars")]
    for held in (index, links.index_log(str(tmp_path / "index"))):
        if held is not index:
            links.append_index(held, index, 0)
        r = links.resolve_links(rows, "rid", rules, held).first()
        assert (r.orgs__id, r.people__id, r.cars__status) == ("o1", "p1", "unresolved")


def test_a_second_run_reads_the_buckets_it_touches(spark, tmp_path):
    log = links.index_log(str(tmp_path / "index"), buckets=32)
    entries = lambda lo, hi: spark.range(lo, hi).select(F.lit("d").alias("dataset"), F.concat(F.lit("k:"), "id").alias("lookup_key"), F.col("id").cast("string").alias("id"))
    links.append_index(log, entries(0, 2000), 0)
    assert links.append_index(log, entries(1990, 2005), 1).count() == 5
    wanted = entries(7, 9).select("dataset", "lookup_key")
    some = log.read(spark, buckets=log.touched(wanted))
    buckets = {f.split("bucket=")[1].split("/")[0] for f in some.inputFiles()}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert 1 <= len(log.touched(wanted)) <= 2 and "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    assert log.read(spark).count() == 2005 and len(buckets) == 32  # all files are known, the filter prunes them
    rows = spark.createDataFrame([(1, "7"), (2, "2004"), (3, "9999")], "rid int, k string")
    got = links.resolve_links(rows, "rid", [links.LinkRule("f", (("k", "k"),), dataset="d")], log).collect()
    assert {r.rid: r.f__id for r in got} == {1: "7", 2: "2004", 3: None}


def narrowed(ids, main, groups):
    """The rule as it is written down: intersect group by group, keep what stood where nothing is left."""
    left = set(ids.get(main, ()))
    if len(left) > 1:
        for g in groups:
            if any(k is None for k in g):
                continue
            some = left.copy()
            for k in g:
                some &= ids.get(k, set())
            left = some or left
            if len(left) == 1:
                break
    return left


def test_narrowing_equals_intersections(spark):
    rnd = random.Random(1)
    ids = {f"{n}:{v}": {str(rnd.randint(0, 60)) for _ in range(rnd.choice([0, 1, 2, 40]))} for n in "abcd" for v in range(6)}
    index = spark.createDataFrame([(k, i) for k, s in ids.items() for i in s], "lookup_key string, id string")
    rows = [(r, *[str(rnd.choice([0, 0, 0, 1, 2, 3, 4, 5, 9])) if rnd.random() < 0.9 else None for _ in "abcd"]) for r in range(400)]
    df = spark.createDataFrame(rows, "rid int, a string, b string, c string, d string")
    rule = links.LinkRule("f", (("a", "a"),), ((("b", "b"), ("c", "c")), (("d", "d"),), (("b", "b"),)))
    got = {r.rid: (r.f__status, r.f__id) for r in links.resolve_links(df, "rid", [rule], index).collect()}
    for r, a, b, c, d in rows:
        key = lambda n, v: None if v is None else f"{n}:{v}"
        left = narrowed(ids, key("a", a), [[key("b", b), key("c", c)], [key("d", d)], [key("b", b)]]) if a is not None else None
        want = ("none", None) if a is None else ("unresolved", None) if not left else ("resolved", min(left)) if len(left) == 1 else ("ambiguous", None)
        assert got[r] == want


def test_narrowing_of_a_hot_key_makes_no_pairs(spark):
    """A third of all rows and of all ids share one key; each row's second key is rare."""
    n = 60_000
    index = spark.range(n).select(F.explode(F.array(F.when(F.col("id") % 3 == 0, "name:hot").otherwise(F.concat(F.lit("name:"), "id")), F.concat(F.lit("code:"), "id"))).alias("lookup_key"), F.col("id").cast("string").alias("id"))
    rows = spark.range(n).select(F.col("id").alias("rid"), F.when(F.col("id") % 3 == 1, "hot").otherwise(F.concat(F.lit(""), F.col("id"))).alias("name"), (F.col("id") - F.col("id") % 3).cast("string").alias("code"))
    rule = links.LinkRule("f", (("name", "name"),), ((("code", "code"),),))
    got = links.resolve_links(rows, "rid", [rule], index).groupBy("f__status").count().collect()
    assert {r.f__status: r["count"] for r in got} == {"resolved": n * 2 // 3, "unresolved": n // 3}


def test_best_scores_equal_difflib(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdeé🎉 ") for _ in range(rnd.randint(0, 14)))
    rows = [(r, c, c, word() if c else None, word()) for r in range(40) for c in range(12)] + [(99, 0, 0, None, None)]
    pairs = spark.createDataFrame(rows, "rid int, cand_id int, ord int, s_x string, c_x string")
    score = lambda a, b: 0.0 if a is None or b is None else SequenceMatcher(None, a, b).ratio()
    for c in match.score_candidates(pairs, [match.Comparator("x", "similarity")]).withColumn("b", match._bound(match.Comparator("x", "similarity"))).collect():
        assert c.b >= score(c.s_x, c.c_x) - 1e-9
    top = match.score_top(pairs, "rid", [match.Comparator("x", "similarity")], 3).collect()
    assert len(top) < len(rows) * 0.8  # the bounds kept pairs away from the comparison
    for r in {x[0] for x in rows}:
        want = sorted((-score(a, b), o) for i, _, o, a, b in rows if i == r)[:3]
        got = sorted((-x.score, x.ord) for x in top if x.rid == r)[:3]
        assert [o for _, o in got] == [o for _, o in sorted((round(s, 4), o) for s, o in want)] or [round(s, 3) for s, _ in got] == [round(s, 3) for s, _ in want]


def test_only_open_rows_reach_the_fuzzy_stage(spark):
    from concordat.queries_links import _staged

    plan = _staged(spark, "/root/testdata/sf0.001")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in text and "match_status" in text.split("PushedFilters", 1)[1]


def test_plan_with_partial_links_and_plain_state(spark):
    """Rows may go on without a link; without diff rules fields are compared as they are."""
    fed = spark.createDataFrame([(1, "a", "m1"), (2, "b", "m2"), (3, "c", "m1")], "line_no int, code string, boss string")
    target = spark.createDataFrame([("t1", "a", "11"), ("t2", "b", "m2")], "id string, code string, boss string")
    index = spark.createDataFrame([("people", "name:m1", "11")], ENTRY)
    spec = SyncSpec([MapRule((c,), (c,), (op("trim"),)) for c in ("code", "boss")], [match.IdentityRule("code", F.col("code"), F.col("code"))], [], ["code"], "id", state=["code", "boss"],
                    links=[links.LinkRule("boss", (("name", "boss"),), dataset="people")], waiting=links.Waiting(0, True))
    plan = build_plan(fed, target, spec, index=index)
    assert {r.line_no: (r.op, r.pending, r.desired.boss) for r in plan.collect()} == {1: ("skip", False, "11"), 2: ("skip", True, "m2"), 3: ("create", False, "11")}
    assert [(r.dataset, r.source_row_id, r.lookup_key) for r in pending_requests(plan).collect()] == [("people", "2", "name:m2")]
    spec = SyncSpec(spec.rules, spec.identity, [resolve.DiffRule("boss")], spec.key, "id", links=[links.LinkRule("boss", (("name", "boss"),), dataset="people", on_unresolved="hard_error")])
    assert {r.line_no: (r.op, [d.code for d in r.errors]) for r in build_plan(fed, target, spec, index=index).collect()} == {1: ("skip", []), 2: (None, ["RESOLVE_CONFLICT"]), 3: ("create", [])}
