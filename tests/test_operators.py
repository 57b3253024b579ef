from pyspark.sql import functions as F

from concordat.operators import cache, hierarchy, links, lookup, match, pending, plan, resolve, rules
from concordat.functions.ops import op
from concordat.plans.sync import SyncSpec, build_plan
from concordat.sources import files, plan_store


def test_map_rules_and_missing_columns(spark):
    df = spark.createDataFrame([(1, " A b ", "x;y"), (2, None, "z")], "line_no int, name string, parts string")
    out = rules.map_rows(df, [
        rules.MapRule(("n",), ("name",), (op("trim"),), required=True), rules.MapRule(("p", "q"), ("parts",), (op("split", sep=";"),)),
    ], keep=("line_no",)).orderBy("line_no").collect()
    assert (out[0].n, out[0].p, out[0].q, out[0].row_ok) == ("A b", "x", "y", True)
    assert (out[1].n, out[1].p, out[1].row_ok, out[1].errors[0].code) == (None, None, False, "REQUIRED_FIELD_MISSING")
    bad = rules.map_rows(df, [rules.MapRule(("n",), ("nope",))]).first()
    assert bad.errors[0].code == "SOURCE_COLUMN_MISSING" and not bad.row_ok


def test_normalize_warn_keeps_partial_value(spark):
    df = spark.createDataFrame([(1, " 12x ")], "line_no int, v string")
    r = rules.normalize_rows(df, [rules.NormalizeRule("v", (op("trim"), op("format_mask", mask="##")), "warn")]).first()
    assert r.v == "12x" and r.warnings and not r.errors


def test_fuzzy_tie_precedes_thresholds(spark):
    rows = [(1, "a", 1, 0.9), (1, "b", 2, 0.89), (2, "a", 1, 0.9), (3, "a", 1, 0.5), (4, "a", 1, 0.1), (4, "b", 2, 0.1)]
    df = spark.createDataFrame(rows, "row_id int, cand_id string, ord int, score double")
    got = {r.row_id: r.decision for r in match.fuzzy_decision(df, "row_id", 0.8, 0.4, 0.05).collect()}
    assert got == {1: "ambiguous", 2: "matched", 3: "review", 4: "ambiguous"}
    assert match.fuzzy_decision(df, "row_id", 0.8, 0.4, 0.0).where("row_id = 1").first().decision == "matched"


def test_dedup_null_keys_stay(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, "a"), (3, "k", "a"), (4, "k", "b"), (5, "k", "a")], "line_no int, k string, v string")
    got = [r.dedup for r in match.source_dedup(df, "k", F.col("v")).orderBy("line_no").collect()]
    assert got == ["first", "first", "first", "conflict", "duplicate"]


def test_links_narrowing(spark):
    ids = spark.createDataFrame([("n:x", "1"), ("n:x", "2"), ("b:x1", "2"), ("b:zz", "9")], "lookup_key string, id string")
    df = spark.createDataFrame([(1, "x", "x1"), (2, "x", "zz"), (3, "q", "x1"), (4, None, None)], "rid int, n string, b string")
    rule = links.LinkRule("f", (("n", F.col("n")),), ((("b", F.col("b")),),))
    got = {r.rid: (r.f__status, r.f__id) for r in links.resolve_links(df, "rid", [rule], ids).collect()}
    assert got == {1: ("resolved", "2"), 2: ("ambiguous", None), 3: ("unresolved", None), 4: ("none", None)}


def test_pending_life(spark):
    now, later = F.lit("2024-01-01").cast("timestamp"), F.lit("2024-02-01").cast("timestamp")
    kinds = "dataset string, source_row_id string, field string, lookup_key string, payload string, attempts int, status string, created_at timestamp, last_attempt_at timestamp, expires_at timestamp"
    req = spark.createDataFrame([("d", "1", "f", "k:1", '{"a":1}'), ("d", "2", "f", "k:2", "junk")], "dataset string, source_row_id string, field string, lookup_key string, payload string")
    s = pending.upsert_pending(spark.createDataFrame([], kinds), req, now, 60, 2)
    assert {r.attempts for r in s.collect()} == {1}
    s2 = pending.upsert_pending(s, req.where("source_row_id = '1'"), now, 60, 2)
    assert {r.source_row_id: r.status for r in s2.collect()} == {"1": "conflict", "2": "pending"}
    assert {r.status for r in pending.expire(s, later).collect()} == {"expired"}
    assert pending.purge(pending.expire(s, later), later).count() == 0
    assert pending.replay(spark.createDataFrame([(7,)], "a int"), s, "a int", "a").orderBy("a").collect()[0].a == 1


def test_tree_problems_and_cycle(spark):
    nodes = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "x"), ("m", "gone"), ("n", "m")], "node_id string, parent_id string")
    got = {r.node_id: (r.verdict, r.broken_at) for r in hierarchy.anchor_verdicts(nodes, nodes.limit(0)).collect()}
    assert got == {"a": ("anchored", None), "b": ("anchored", None), "c": ("anchored", None), "x": ("cycle", "x"), "y": ("cycle", "x"), "z": ("cycle", "x"), "m": ("missing_parent", "gone"), "n": ("unanchored_subtree", "gone")}
    held = spark.createDataFrame([("gone",)], "node_id string")
    assert hierarchy.anchor_verdicts(nodes, held).where("node_id = 'n'").first().verdict == "anchored"
    paths = hierarchy.path_table(nodes.withColumn("label", F.upper("node_id")))  # ends, and knows no path through a cycle
    assert {r.node_id: r.path for r in paths.collect() if r.node_id in "abcxyz"} == {"a": ["A"], "b": ["A", "B"], "c": ["A", "B", "C"], "x": None, "y": None, "z": None}
    tree, problems = hierarchy.build_tree(nodes)
    assert tree.count() == 0 and {r.problem for r in problems.collect()} == {"cycle", "missing_parent"}


def test_csv_rows(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('﻿id,name\n1, Ann \n2,null\n3\n4,"a ""b""",extra\n', encoding="utf-8")
    rows = files.read_csv(spark, str(p)).orderBy("line_no").collect()
    assert [(r.id, r.name, r.malformed is not None) for r in rows] == [("1", "Ann", False), ("2", None, False), ("3", None, False), ("4", 'a "b"', True)]
    assert rows[0].record_id == "line:2"
    q = tmp_path / "b.csv"
    q.write_text("1;x\n2;y\n")
    assert files.read_csv(spark, str(q), header=False, sep=";").columns[:2] == ["col_0", "col_1"]


def test_dictionary_checks(spark):
    df = spark.createDataFrame([("a", "1"), (" a", None), (None, "2")], "k string, v string")
    r = files.check_dictionary(df, "k", ["v"]).first()
    assert (r.rows, r.null_keys, r.null_v, r.duplicate_keys) == (3, 1, 1, 1)


def test_plan_round_trip(spark, tmp_path):
    items = spark.createDataFrame([(1, "create", None, "r1", "***"), (2, "update", "t2", None, "pw")], "line_no long, op string, target_id string, resource_id string, password string")
    plan_store.write_plan(items, items.agg(F.count(F.lit(1)).alias("n")), str(tmp_path / "p"))
    got = {r.line_no: (r.op, r.target_id, r.password) for r in plan_store.read_plan(spark, str(tmp_path / "p")).collect()}
    assert got == {1: ("create", "r1", None), 2: ("update", "t2", "pw")}


def test_mask_and_payload_preview(spark):
    df = spark.createDataFrame([({"Password": "x", "a": "1"}, "s", 1)], "m map<string,string>, token string, n int")
    r = plan.mask_fields(df, {"password", "TOKEN"}).first()
    assert r.m == {"Password": "***", "a": "1"} and r.token == "***"
    body, err = plan.payload([plan.PayloadField("v", "v", "int")])
    shown, _ = plan.payload([plan.PayloadField("v", "v", "int")], preview=True)
    r = spark.createDataFrame([("x",)], "v string").select(body.alias("b"), err.alias("e"), shown.alias("s")).first()
    assert r.e == "v: not of type int" and r.s == '{"v":"x"}'


def test_end_to_end_plan(spark):
    feed = spark.createDataFrame([(2, "1", "Ann"), (3, "2", "Bob"), (4, "3", "Cy"), (5, "4", "Dee"), (6, "1", "Ann"), (7, " ", "No")], "line_no long, code string, n string")
    target = spark.createDataFrame([(11, "1", "ann"), (12, "2", "Rob"), (14, "4", "Dee"), (15, "4", "Dee")], "id long, code string, name string")
    spec = SyncSpec(
        [rules.MapRule(("code",), ("code",), (op("trim"),), required=True), rules.MapRule(("name",), ("n",))],
        [match.IdentityRule("code", F.col("code"), F.col("code"))], [resolve.DiffRule("name", norm="text")], ["code"], "id", dedup=True,
    )
    got = {r.line_no: (r.op, r.match_status, r.dedup) for r in build_plan(feed, target, spec).collect()}
    assert got[2] == ("skip", "matched", "first") and got[3] == ("update", "matched", "first") and got[4] == ("create", "not_found", "first")
    assert got[5][:2] == (None, "conflict") and got[6] == (None, "matched", "duplicate") and got[7][0] is None


def test_hydrate_and_uniqueness(spark):
    items = spark.createDataFrame([("k1", None), ("k2", None)], "match_key string, pw string")
    secrets = spark.createDataFrame([("d", "k1", "pw", "s")], "dataset string, match_key string, field string, value string")
    got = {r.match_key: (r.pw, r.missing_secrets) for r in lookup.hydrate_secrets(items, secrets, "d", ["pw"]).collect()}
    assert got == {"k1": ("s", []), "k2": (None, ["pw"])}
    df = spark.createDataFrame([(1, "a", "9"), (2, "b", "8")], "rid int, base string, own string")
    taken = spark.createDataFrame([("a", "9"), ("b", "1"), ("b1", "1")], "v string, owner string")
    got = {r.rid: (r.value, r.value__conflict) for r in lookup.unique_value(df, "rid", F.col("base"), ["1"], taken, F.col("v"), F.col("owner"), F.col("own")).collect()}
    assert got == {1: ("a", False), 2: (None, True)}


def test_soft_delete_and_projection(spark):
    raw = spark.createDataFrame([(1, "x", "NULL"), (2, "y", "2020"), (None, "z", None)], "id int, a string, gone string")
    assert [r.d for r in raw.select(cache.soft_deleted(any_rules=[("not_null", F.col("gone"))]).alias("d")).collect()] == [False, True, False]
    out = cache.project_items(raw, [cache.CacheColumn("id", F.col("id"), "bigint", required=True), cache.CacheColumn("n", F.col("a"), "int", on_error="set_null")]).collect()
    assert [r.failed for r in out] == [None, None, "id: missing"]


def test_scalars_count_as_arrays_of_one(spark):
    from concordat.functions.ops import run_chains

    df = spark.createDataFrame([(1, "a"), (2, None), (3, " ")], "record_id int, v string")
    names = ("first", "last", "compact", "unique", "count")
    out = run_chains(df, {n: (F.col("v"), [op(n)]) for n in names} | {"at": (F.col("v"), [op("at", index=1)])}).orderBy("record_id").collect()
    assert [tuple(r[n] for n in (*names, "at")) for r in out] == [("a", "a", ["a"], ["a"], 1, None), (None, None, [], [], 0, None), (" ", " ", [], [" "], 1, None)]


def test_text_helpers(spark):
    from concordat.functions import ops, text

    df = spark.createDataFrame([("abcdef",)], "v string")
    assert [df.select(text.shorten(F.col("v"), n).alias("s")).first().s for n in (0, 2, 3, 4, 5, 6)] == ["", "ab", "abc", "a...", "ab...", "abcdef"]
    letters = [chr(i) for i in range(1, 0x2000) if not 0x13A0 <= i < 0x1400 and chr(i) not in "\u1c89\u1c8a"]
    got = spark.createDataFrame([(c,) for c in letters], "c string").select("c", text.casefold(F.col("c")).alias("f")).collect()
    assert [r.c for r in got if r.f != r.c.casefold()] == []
    assert ops.java_replacement("$5 \\1 \\g<n>") == "\\$5 $1 ${n}"


def test_dictionary_refusal_and_pages(spark, tmp_path):
    import pytest

    df = spark.createDataFrame([("a",), (" a",), ("b",)], "k string")
    with pytest.raises(ValueError, match="duplicate keys: a"):
        files.refuse_duplicates(df, "k")
    assert files.refuse_duplicates(df.where("k <> ' a'"), "k").count() == 2
    for name, n in (("p1", 2), ("p2", 1), ("p3", 2)):
        (tmp_path / f"{name}.json").write_text("".join(f'{{"id":{i}}}\n' for i in range(n)))
    read = lambda **a: files.snapshot_pages(spark, str(tmp_path), "id long", **a).count()
    assert (read(), read(max_pages=1), read(page_size=2), read(page_size=2, max_pages=1)) == (5, 2, 3, 2)


def test_csv_records_with_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1,"a\nb"\n2,c\n')
    rows = files.read_csv(spark, str(tmp_path / "a.csv"), multiline=True).orderBy("line_no").collect()
    assert [(r.line_no, r.id, r.name) for r in rows] == [(2, "1", "a\nb"), (3, "2", "c")]


def test_providers_and_clearing(spark):
    import pytest

    p = lookup.Providers()
    p.register("numbers", lambda n: spark.range(n))
    assert p.get("numbers", n=3).count() == 3
    with pytest.raises(ValueError):
        p.get("letters")
    parts, parents = {n: spark.range(2) for n in ("a", "b")}, {"b": ["a"], "a": []}
    with pytest.raises(ValueError, match="needed by b"):
        cache.clear(parts, parents, "a", cascade=False)
    emptied, counts = cache.clear(parts, parents)
    assert list(emptied) == ["b", "a"] and {r.dataset: r.rows for r in counts.collect()} == {"a": 2, "b": 2}
    assert links.link_key_names([links.LinkRule("f", (("n", F.col("n")),), ((("b", F.col("b")),),))]) == {"n", "b"}


def test_shared_folder_goes_with_its_application(spark):
    from concordat import session

    assert spark.sparkContext.applicationId in session.shared_dir(spark)


def test_clear_order_and_sweep_interval(spark):
    from datetime import datetime

    one = spark.range(3)
    emptied, counts = cache.clear({n: one for n in ("customer", "orders", "lineitem", "part")}, {"orders": ["customer"], "lineitem": ["orders", "part"], "customer": [], "part": []}, "customer")
    assert list(emptied) == ["lineitem", "orders", "customer"] and [r.step for r in counts.orderBy("step").collect()] == [0, 1, 2]
    assert pending.due(datetime(2024, 1, 1), datetime(2024, 1, 2), 3600) and not pending.due(datetime(2024, 1, 1), datetime(2024, 1, 1), 3600) and pending.due(None, datetime(2024, 1, 1), 1)
