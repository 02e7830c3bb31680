import json

import pytest
from pyspark.sql import functions as F

from clausula.functions import documents as D
from clausula.functions import scalars as S


def values(spark, rows, column, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in rows], schema).select(column).collect()]


def test_names(spark):
    assert values(spark, ["Foo  Bar!", "--", "a_b", "é"], S.slug("x")) == ["Foo-Bar", None, "a-b", None]
    assert values(spark, ["foo bar"], S.diagnostic_code(F.lit("p.q"), "x", F.lit("f"), F.lit("max"))) == ["P_Q_FOO_BAR_F_MAX"]
    assert values(spark, ["Foo", "--"], S.mint_identity(F.lit("p"), F.lit("type"), "x")) == ["ix://p/type/Foo", None]
    assert values(spark, ["ab", "1a", "a-b"], S.member_segment("x")) == ["ab", None, None]
    assert values(spark, ["ix://p/a", "ix://p", "p/a"], S.is_identity("x")) == [True, False, False]


def test_versions(spark):
    order = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.2.0", "1.10.0"]
    df = spark.createDataFrame([(v,) for v in reversed(order)], "x string")
    assert [r.x for r in df.orderBy(S.version_key("x")).collect()] == order
    assert values(spark, ["1.0.0", "01.0.0", "1.0", "1.0.0-01", "1.0.0+b.1"], S.is_semver("x")) == [True, False, False, False, True]
    cases = [("1.2.3", "^1.2.1", True), ("2.0.0", "^1.2.1", False), ("1.2.0", "^1.2.1", False), ("0.2.9", "^0.2.3", True), ("0.3.0", "^0.2.3", False), ("0.0.3", "^0.0.3", True), ("0.0.4", "^0.0.3", False), ("1.3.0-rc.1", "^1.2.1", False), ("1.2.1-rc.2", "^1.2.1-rc.1", True), ("1.2.1", "1.2.1", True), ("1.2.2", "1.2.1", False), ("x", "^1.0.0", False)]
    got = spark.createDataFrame([c[:2] for c in cases], "v string, r string").select(S.satisfies("v", "r")).collect()
    assert [r[0] for r in got] == [c[2] for c in cases]
    wide = "99999999999999999999999"
    df = spark.createDataFrame([(f"{wide}.0.0",), ("2.0.0",), (f"1{wide}.0.0",), (f"2.0.0-{wide}",)], "x string")
    assert [r.x for r in df.orderBy(S.version_key("x")).collect()] == [f"2.0.0-{wide}", "2.0.0", f"{wide}.0.0", f"1{wide}.0.0"]
    assert values(spark, [f"{wide}.1.2"], S.parse_version("x")["major"]) == [None] and values(spark, [f"{wide}.1.2"], S.satisfies("x", F.lit(f"^{wide}.0.0"))) == [True]


def test_numbers(spark):
    assert values(spark, [S.I128_MAX, S.I128_MIN_ABS, "-" + S.I128_MIN_ABS, "-0", "01", "5"], S.fits_i128("x")) == [True, False, True, False, False, True]
    ints = ["-100", "-20", "-3", "0", "7", "12", "99999999999999999999999999999999999999999"]
    df = spark.createDataFrame([(v,) for v in reversed(ints)], "x string")
    assert [r.x for r in df.orderBy(S.integer_key("x")).collect()] == ints
    assert values(spark, ["1.50", "0.5", "-0.25", "1.", "00.5", "1e3", "-0"], S.is_canonical_decimal("x")) == [False, True, True, False, False, False, False]
    assert values(spark, ["001.500", "-0.0", "10", "+3.10", "0.50"], S.normal_decimal("x")) == ["1.5", "0", "10", "3.1", "0.5"]
    assert values(spark, ["123.45", "1234.5", "0.123"], S.within_decimal("x", 5, 2)) == [True, False, False]
    assert values(spark, ["6/4", "5/1", "-3/9", "0/7", "1/0", "x"], S.canonical_rational("x")) == ["3/2", "5", "-1/3", "0", None, None]
    assert values(spark, ["100", "1.0E2", "0.010", "-0", "1e-2"], F.to_json(S.number_parts("x"))) == ['{"sign":1,"digits":"1","exponent":2}', '{"sign":1,"digits":"1","exponent":2}', '{"sign":1,"digits":"1","exponent":-2}', '{"sign":0,"digits":"","exponent":0}', '{"sign":1,"digits":"1","exponent":-2}']
    assert values(spark, ["9007199254740991", "9007199254740993", "0.1", "0.123456789012345678"], S.exact_number_kind("x")) == [None, "INEXACT_INTEGER", None, "INEXACT_NUMBER"]
    spelled = {"9007199254740992": None, "-9007199254740992": None, "9007199254740993": "INEXACT_INTEGER", "12345678901234567890.0": "INEXACT_INTEGER", "1e400": "INEXACT_INTEGER", "1e-400": "INEXACT_NUMBER", "0.30000000000000004": None, "0.30000000000000001": "INEXACT_NUMBER", "1e15": None, "0": None, "-0.0": None, "0.1": None}
    assert values(spark, list(spelled), S.exact_number_kind("x")) == list(spelled.values())
    got = values(spark, [f"[{x}]" for x in spelled], D.inexact_numbers("x"))
    assert got == [[f"{k} /0"] if k else [] for k in spelled.values()]
    assert values(spark, ["1" * 400, "[" * 100_000 + "]" * 100_000, "[1.50]"], D.canonical_json("x")) == [None, None, "[1.5]"]


def test_formats_and_times(spark):
    assert values(spark, ["2024-02-29", "2023-02-29", "2024-2-9"], S.matches_format("x", "date")) == [True, False, False]
    assert values(spark, ["2024-01-01T00:00:00Z", "2024-01-01T25:00:00Z", "2024-01-01 00:00:00"], S.matches_format("x", "date-time")) == [True, False, False]
    assert values(spark, ["123E4567-e89b-12d3-a456-426614174000", "123e4567e89b12d3a456426614174000"], S.matches_format("x", "uuid")) == [True, False]
    assert values(spark, ["P1D", "PT1.5S", "P", "PT", "P1Y2M"], S.matches_format("x", "duration")) == [True, True, False, False, True]
    assert [int(v) for v in values(spark, ["1970-01-01T00:00:01.123456789Z", "1970-01-01T01:00:00+01:00"], S.date_time_instant("x"))] == [1123456789, 0]
    assert [int(v) for v in values(spark, ["1970-01-02"], S.date_instant("x"))] == [86400 * 10**9]
    assert values(spark, ["P1DT2H3M4.5S", "P1W", "P1Y"], S.duration_micros("x")) == [93784500000, 604800000000, None]
    assert values(spark, ["YWI=", "YWI", "YQ==", "YR==", ""], S.base64_octets("x")) == [2, None, 1, None, 0]


def test_pointers(spark):
    assert values(spark, ["a/b~c"], S.pointer_escape("x")) == ["a~1b~0c"]
    assert values(spark, ["/a~1b/c~0", ""], S.pointer_split("x")) == [["a/b", "c~"], []]
    assert values(spark, ["/a/b", ""], S.pointer_ancestors("x")) == [["", "/a", "/a/b"], [""]]
    assert values(spark, ["ab\ncd"], F.struct(S.line_of("x", F.lit(4)), S.column_of("x", F.lit(4)))) == [(2, 2)]


def test_documents(spark):
    assert values(spark, ['{"b":1.0,"a":[1e21,0.000001,1e-7,"é\\u0000"],"\\ud83d\\ude00":null,"ﬁ":true}', "x"], D.canonical_json("x")) == ['{"a":[1e+21,0.000001,1e-7,"é\\u0000"],"b":1,"😀":null,"ﬁ":true}', None]
    assert values(spark, ['{"a":1,"b":{"c":1,"c":2}}', '{"a":1}', "nope"], D.repeats_member("x")) == [True, False, None]
    assert values(spark, ['{"a":[1,{"b":null}]}'], D.node_count("x")) == [5]
    ops = [{"op": "add", "path": "/t/-", "value": 3}, {"op": "replace", "path": "/t/0", "value": 9}, {"op": "remove", "path": "/u"}, {"op": "add", "path": "/n$i", "value": "$i of $n", "x-repeat": 2}, {"op": "move", "from": "/t", "path": "/s"}, {"op": "test", "path": "/s/1", "value": 2}]
    df = spark.createDataFrame([('{"t":[1,2],"u":0}', json.dumps(ops)), ('{"t":[1]}', '[{"op":"remove","path":"/x"}]')], "t string, o string")
    assert [r[0] for r in df.select(D.patched("t", "o")).collect()] == ['{"n0":"0 of 2","n1":"1 of 2","s":[9,2,3]}', None]
    assert values(spark, ["é"], F.char_length(D.normal_form("x", "NFC"))) == [1]
    at = spark.createDataFrame([('{"a/b":[7]}', "/a~1b/0"), ("{}", "/x")], "t string, p string").select(D.at_pointer("t", "p")).collect()
    assert [r[0] for r in at] == ["7", None]
    with pytest.raises(ValueError):
        D.number_text(float("inf"))


def test_more_documents(spark):
    assert values(spark, ["a(b", "(?<y>a)\\k<y>", "\\u{1F600}", "[z-a]", None], D.pattern_compiles("x")) == [False, True, True, False, None]
    text = '{"a": [1,\n  {"b": "x\\n"}],\n "a": 2, "c":[ 3 , 4 ]}'
    at = spark.createDataFrame([(text, "/c/1"), (text, "/a"), (text, ""), (text, "/c/2"), (text, "/z")], "t string, p string").select(D.position("t", "p")).collect()
    assert [r[0] for r in at] == ["3:20", "3:7", "1:1", None, None]
    assert D.next_float32(1.0) > 1.0 > D.next_float32(1.0, False) and D.next_float32(0.0) > 0
    order = ["a", "\U0001F600", "\uFB01"]
    assert [r.x for r in spark.createDataFrame([(v,) for v in reversed(order)], "x string").orderBy(S.utf16_key("x")).collect()] == order
    assert values(spark, ["1.0", "2"], S.enum_member_equals("x", ["1", "3.50"], "decimal")) == [True, False]
    assert values(spark, ["3.5"], S.enum_member_equals("x", ["1", "3.50"], "decimal")) == [True]
