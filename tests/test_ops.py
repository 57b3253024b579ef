import pytest
from pyspark.sql import functions as F

from concordat.functions.ops import OPS, Op, OpRegistry, op, run_chains


def run(spark, value, *ops, kind="string"):
    df = spark.createDataFrame([(1, value)], f"record_id int, v {kind}")
    r = run_chains(df, {"out": (F.col("v"), list(ops))}).first()
    return r["out"], r["out__err"]


CASES = [
    ("  a \t b ", [op("trim")], "a b"), ("   ", [op("trim")], None), (None, [op("trim")], None), ("ÄB", [op("lower")], "äb"), ("straße", [op("upper")], "STRASSE"),
    ("o'neil mc-donald 3rd", [op("title")], "O'Neil Mc-Donald 3Rd"), ("hELLO", [op("capitalize")], "Hello"), ("hELLO", [op("upper_first")], "HELLO"),
    ("Щука ёж", [op("transliterate")], "Shchuka ezh"), ("Æon é", [op("transliterate")], "Aeon e"), (" x ", [op("to_string")], "x"),
    ("abcdef", [op("substring", start=1, length=3)], "bcd"), ("abcdef", [op("substring", start=-2)], "ef"), ("a.b.c", [op("split", sep="."), op("at", index=-1)], "c"),
    ("+7 (913) 12", [op("digits_only")], "791312"), ("--", [op("digits_only")], None), ("a-b_c1", [op("strip_non_alnum")], "abc1"), ("é", [op("contains_non_ascii")], True),
    ("no 12", [op("regex_extract", pattern=r"(?P<n>\d+)", group=1)], "12"), ("no", [op("regex_extract", pattern=r"(\d+)", group=1)], None), ("x1", [op("regex_extract", pattern=r"\d", group=3)], None),
    ("a1b2", [op("regex_replace", pattern=r"([a-z])(\d)", repl=r"\2\1")], "1a2b"), ("12345678901", [op("format_mask", mask="###-###-### ##")], "123-456-789 01"), (" ", [op("is_blank")], True),
    (" +1_000 ", [op("to_int")], 1000), ("1e3", [op("to_float")], 1000.0), ("TRUE", [op("to_bool")], True), ("y", [op("parse_bool")], True), ("", [op("parse_bool")], None),
    ("007", [op("int_if_digits")], "7"), ("7a", [op("int_if_digits")], "7a"), ("x", [op("map_dict", mapping={"X": "1"}, casefold=True)], "1"), ("q", [op("map_dict", mapping={"x": "1"})], None),
    ("a", [op("const", value="k")], "k"),
]


@pytest.mark.parametrize("value,ops,want", CASES)
def test_scalar_ops(spark, value, ops, want):
    assert run(spark, value, *ops) == (want, None)


@pytest.mark.parametrize("value,ops", [("5.7", [op("to_int")]), ("", [op("to_int")]), ("1.0d", [op("to_float")]), ("yes", [op("to_bool")]), ("perhaps", [op("parse_bool")]), ("123", [op("format_mask", mask="##")])])
def test_errors_stop_a_chain(spark, value, ops):
    _, err = run(spark, value, *ops)
    assert err


def test_value_before_the_failing_op_is_kept(spark):
    assert run(spark, " 12a ", op("trim"), op("format_mask", mask="##"), op("upper")) == ("12a", "value does not fill the mask")


def test_array_ops(spark):
    arr = "array<string>"
    assert run(spark, [None, " ", "b"], op("coalesce", default="d"), kind=arr) == ("b", None)
    assert run(spark, [None, " "], op("coalesce", default="d"), kind=arr) == ("d", None)
    assert run(spark, [" ", "v"], op("pick_when_blank"), kind=arr) == ("v", None)
    assert run(spark, [" a ", None, "b"], op("build_delimited_key"), kind=arr) == ("a|b", None)
    assert run(spark, [" a ", None], op("build_delimited_key", strict=True), kind=arr)[1]
    assert run(spark, ["a", " ", None], op("compact"), kind=arr) == (["a"], None)
    assert run(spark, None, op("compact"), kind=arr) == ([], None)
    assert run(spark, ["b", "a", "b"], op("unique"), kind=arr) == (["b", "a"], None)
    assert run(spark, None, op("count"), kind=arr) == (0, None)
    assert run(spark, ["1", " 2"], op("map_each", ops=[op("to_int")]), kind=arr) == ([1, 2], None)
    assert run(spark, ["1", "x"], op("map_each", ops=[op("to_int")]), kind=arr)[1]
    assert run(spark, ["ab", "b"], op("filter_regex", pattern="b", full=True), kind=arr) == (["b"], None)
    assert run(spark, [None, None], op("equals"), kind=arr) == (True, None)
    assert run(spark, [None, "a", "b"], op("concat", sep="-"), kind=arr) == ("a-b", None)
    assert run(spark, [None, None], op("concat", sep="-"), kind=arr) == (None, None)


def test_names_pairs_and_patterns(spark):
    assert tuple(run(spark, "Ivanov, Ivan Petrovich", op("split_name"))[0]) == ("Ivanov", "Ivan", "Petrovich")
    assert tuple(run(spark, "Ivanov Ivan", op("split_name"))[0]) == ("Ivanov", "Ivan", None)
    assert tuple(run(spark, "A = 1; b=2;a=3;junk", op("parse_kv_pairs", keys=("a", "b", "c")))[0]) == ("3", "2", None)
    assert run(spark, "junk", op("parse_kv_pairs", keys=("a",)))[0] is None
    got = run(spark, ["mob 79131234567 tel:101 x", "tel:102"], op("extract_patterns", patterns={"mobile": r"7\d{10}", "ext": r"\d{3}"}, keyed_prefixes=("tel:",)), kind="array<string>")[0]
    assert tuple(got) == ("79131234567", "102")


def test_generated_values_are_stable(spark):
    for o in (op("uuid"), op("default_prefixed_uuid", prefix="u-"), op("default_password", salt="s"), op("random_digits", length=12)):
        a, b = run(spark, None, o), run(spark, None, o)
        assert a == b and a[0]
    assert len(run(spark, None, op("random_digits", length=12))[0]) == 12
    assert run(spark, "kept", op("default_password", salt="s"))[0] == "kept"


def test_registry():
    r = OpRegistry()
    r.register("a", lambda c: c)
    with pytest.raises(ValueError):
        r.register("a", lambda c: c)
    with pytest.raises(ValueError):
        r.get("b")
    with pytest.raises(ValueError):
        OPS.apply(Op("parse_bool", {"true_values": ("x",), "false_values": ("X",)}), None)


def test_title_and_spellings(spark):
    """As str.title, whatever the letters; kana and Hangul are spelled out."""
    from concordat.functions import text, vector

    some = ["o'neil mc-donald", "ЖУК жук", "ßeta", "ﬁne", "a漢b", "ΣΑΣ ΟΔΟΣ", "", "ǆ x", "éa É", "x1y 2z", "they're", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in some], "x string").select(text.title(F.col("x"))).collect()]
    assert got == [None if x is None else x.title() for x in some]
    assert vector.to_ascii("カタカナ ひらがな し つ 한국 Привет") == "katakana hiragana shi tsu hangug Privet"
