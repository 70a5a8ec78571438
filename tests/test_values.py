"""Operators, conversions and library functions against plain Python, traps included."""

import itertools

import pytest
from pyspark.sql import functions as F

from rillstone.engine import engine_session
from rillstone.functions import values as V
from rillstone.sources import codec
from rillstone.types import BOOL, BYTES, DATE, F64, I64, INTERVAL, JSON, NONE, STRING, TIME, TIMESTAMP, Type, TypeProblem, array, dict_of, optional, record, row_schema, spark_type


def run(spark, types, rows, *make):
    """Evaluate functions of typed columns over rows; returns a list of tuples."""
    own = engine_session(spark)
    t = record(types)
    order = [n for n, _ in t.fields]
    df = own.createDataFrame([tuple(r[n] for n in order) for r in rows], row_schema(t))
    vals = {n: V.Val(x, lambda n=n: F.col(n)) for n, x in t.fields}
    made = [m(vals) for m in make]
    return [tuple(r) for r in df.select(*[m.col.alias(f"c{i}") for i, m in enumerate(made)]).collect()]


LOW, HIGH = -(1 << 63), (1 << 63) - 1


def test_integers_wrap_and_divide_towards_zero(spark):
    rows = [dict(a=HIGH, b=1), dict(a=LOW, b=-1), dict(a=-7, b=2), dict(a=5, b=0)]
    got = run(spark, {"a": I64, "b": I64}, rows, *[lambda v, op=op: V.arithmetic(op, v["a"], v["b"]) for op in "+-*/%"])
    wrap = V.wrap
    want = []
    for r in rows:
        a, b = r["a"], r["b"]
        q = None if not b else wrap(abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1))
        want.append((wrap(a + b), wrap(a - b), wrap(a * b), q, None if not b else a - b * (abs(a) // abs(b)) * (1 if (a < 0) == (b < 0) else -1)))
    assert got == want


def test_float_division_by_zero_is_absent(spark):
    assert run(spark, {"a": F64, "b": F64}, [dict(a=1.0, b=0.0), dict(a=7.5, b=2.0)], lambda v: V.arithmetic("/", v["a"], v["b"]), lambda v: V.arithmetic("%", v["a"], v["b"])) == [(None, None), (3.75, 1.5)]


def test_absence_compares(spark):
    o = optional(I64)
    rows = [dict(a=x, b=y) for x, y in itertools.product([None, 1, 2], repeat=2)]
    key = lambda x: (x is not None, x or 0)
    ops = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: key(a) < key(b), "<=": lambda a, b: key(a) <= key(b), ">": lambda a, b: key(a) > key(b), ">=": lambda a, b: key(a) >= key(b)}
    got = run(spark, {"a": o, "b": o}, rows, *[lambda v, op=op: V.compare(op, v["a"], v["b"]) for op in ops])
    assert got == [tuple(f(r["a"], r["b"]) for f in ops.values()) for r in rows]


def test_slices_are_pythons(spark):
    xs = [10, 11, 12, 13]
    bounds = [None, -6, -2, 0, 1, 3, 9]
    rows = [dict(a=xs, i=i, j=j, k=k) for i in bounds for j in bounds for k in (-3, -1, 0, 1, 2)]
    got = run(spark, {"a": array(I64), "i": optional(I64), "j": optional(I64), "k": I64}, rows, lambda v: V.slice_of(v["a"], v["i"], v["j"], v["k"]))
    assert [x for x, in got] == [xs[r["i"] : r["j"] : r["k"]] if r["k"] else [] for r in rows]


@pytest.mark.parametrize(
    ("t", "texts"),
    [
        (BOOL, {"true": True, "t": None, "TRUE": None}), (I64, {"5": 5, " 5": None, "+7": 7, "-0": 0, "1.0": None, str(HIGH): HIGH, str(HIGH + 1): None}),
        (F64, {"1.5": 1.5, "1e3": 1000.0, "x": None, "inf": None, "1e999": None}), (TIME, {"14:30:00.5": 52200500000, "24:00:00": None, "1:00:00": None}),
        (INTERVAL, {"P1DT1H1M1.5S": 90061500000, "-PT1H": -3600000000, "PT0S": 0, "P1M": None, "P": None, "PT30H": 108000000000}),
    ],
)
def test_parsing_is_strict(spark, t, texts):
    got = run(spark, {"s": STRING}, [dict(s=s) for s in texts], lambda v: V.cast(v["s"], optional(t)))
    assert [x for x, in got] == list(texts.values())


def test_dates_have_one_spelling(spark):
    texts = ["2024-01-15", "2024-1-15", "2024-13-45", "2024", "2024-02-30"]
    got = run(spark, {"s": STRING}, [dict(s=s) for s in texts], lambda v: V.cast(v["s"], optional(DATE)), lambda v: V.cast(v["s"], optional(TIMESTAMP)))
    assert [str(d) for d, _ in got] == ["2024-01-15", "None", "None", "None", "None"]
    assert str(got[0][1]) == "2024-01-15 00:00:00"


def test_text_forms(spark):
    floats = {1.0: "1.0", 1e7: "10000000.0", 1.5e20: "1.5e20", 0.0001: "0.0001", 1e-7: "1e-7", -12345678.25: "-12345678.25", 0.1: "0.1", 123456789012.0: "123456789012.0"}
    assert [x for x, in run(spark, {"x": F64}, [dict(x=x) for x in floats], lambda v: V.cast(v["x"], STRING))] == list(floats.values())
    spans = [0, 1, -3600000000, 90061500000, 108000000000, 86400000000]
    assert [x for x, in run(spark, {"x": INTERVAL}, [dict(x=x) for x in spans], lambda v: V.cast(v["x"], STRING))] == [codec.interval_text(x) for x in spans]
    clocks = [0, 52200500000, 86399999999]
    assert [x for x, in run(spark, {"x": TIME}, [dict(x=x) for x in clocks], lambda v: V.cast(v["x"], STRING))] == [codec.time_text(x) for x in clocks]


def test_float_to_integer_has_a_strict_bound(spark):
    xs = [2.0**63, -(2.0**63), 1e300, float("nan"), 3.9, -3.9]
    assert [x for x, in run(spark, {"x": F64}, [dict(x=x) for x in xs], lambda v: V.cast(v["x"], optional(I64)))] == [None, LOW, None, None, 3, -3]


def test_floor_of_large_doubles_and_half_away_rounding(spark):
    assert run(spark, {"x": F64}, [dict(x=1e300), dict(x=-2.5), dict(x=2.5)], *[lambda v, f=f: V.BUILTINS[f](v["x"]) for f in ("floor", "ceil", "round")]) == [(1e300,) * 3, (-3.0, -2.0, -3.0), (2.0, 3.0, 3.0)]


def test_trim_strips_all_white_space(spark):
    assert run(spark, {"s": STRING}, [dict(s="\t  a b \n")], lambda v: V.BUILTINS["trim"](v["s"])) == [("a b",)]


def test_dicts_are_sorted_and_keep_the_last(spark):
    got = run(spark, {"a": I64}, [dict(a=1)], lambda v: V.make_dict([(V.lit("b"), v["a"]), (V.lit("a"), v["a"]), (V.lit("b"), V.lit(9))]))
    assert [(e["key"], e["value"]) for e in got[0][0]] == [("a", 1), ("b", 9)]


def test_dict_lookup(spark):
    d = [dict(d=[("a", 1), ("b", 2)])]
    t = {"d": dict_of(STRING, I64)}
    assert run(spark, t, d, lambda v: V.get(v["d"], V.lit("b")), lambda v: V.get(v["d"], V.lit("z")), lambda v: V.keys(v["d"]), lambda v: V.length(v["d"])) == [(2, None, ["a", "b"], 2)]


def test_documents(spark):
    docs = ['{"k":5,"f":5.0,"s":"x\\"y","n":null,"a":[1,2],"o":{"b":true}}']
    one = lambda key, t: lambda v: V.cast(V.get(v["d"], V.Val(STRING, None, key)), optional(t))
    got = run(spark, {"d": JSON}, [dict(d=docs[0])], one("k", I64), one("k", F64), one("f", I64), one("f", F64), one("s", STRING), one("s", I64), one("n", I64), one("a", array(I64)), one("o", record({"b": BOOL})), one("zz", JSON), one("n", JSON))
    assert got == [(5, 5.0, None, 5.0, 'x"y', None, None, [1, 2], (True,), None, "null")]


def test_documents_are_built_canonically(spark):
    t = record({"b": I64, "a": array(optional(F64)), "s": STRING})
    got = run(spark, {"r": t}, [dict(r=([1.0, None], 2, 'q"'))], lambda v: V.cast(v["r"], JSON))
    assert got == [('{"a":[1.0,null],"b":2,"s":"q\\""}',)]


def test_dynamics_are_exact(spark):
    got = run(spark, {"n": I64, "d": DATE}, [dict(n=5, d=codec.parse_date("2024-01-15"))], lambda v: V.cast(v["n"], Type("dynamic")), lambda v: V.cast(V.cast(v["n"], Type("dynamic")), optional(F64)), lambda v: V.cast(V.cast(v["d"], Type("dynamic")), optional(DATE)), lambda v: V.cast(V.cast(v["d"], Type("dynamic")), optional(STRING)))
    assert [str(x) for x in got[0]] == ['{"i64":5}', "None", "2024-01-15", "None"]


def test_temporal_arithmetic(spark):
    hour = 3600000000
    rows = [dict(d=codec.parse_date("2024-03-01"), t=hour, ts=codec.parse_timestamp("2024-03-01 01:00:00"), iv=x) for x in (30 * hour, -hour, -30 * hour)]
    got = run(spark, {"d": DATE, "t": TIME, "ts": TIMESTAMP, "iv": INTERVAL}, rows, *[lambda v, n=n: V.arithmetic("+", v[n], v["iv"]) for n in ("d", "t", "ts")])
    assert [(str(a), b, str(c)) for a, b, c in got] == [("2024-03-02", 7 * hour, "2024-03-02 07:00:00"), ("2024-03-01", 0, "2024-03-01 00:00:00"), ("2024-02-29", 19 * hour, "2024-02-28 19:00:00")]


def test_bytes(spark):
    rows = [dict(a=bytearray(b"\x0f\xf0"), b=bytearray(b"\xff\x3c")), dict(a=bytearray(b"a"), b=bytearray(b"ab"))]
    got = run(spark, {"a": BYTES, "b": BYTES}, rows, *[lambda v, f=f: V.BUILTINS[f](v["a"], v["b"]) for f in ("bytes_and", "bytes_or", "bytes_xor", "bytes_concat")])
    assert got[0] == (b"\x0f\x30", b"\xff\xfc", b"\xf0\xcc", b"\x0f\xf0\xff\x3c") and got[1][:3] == (None, None, None)
    texts = run(spark, {"s": STRING}, [dict(s="0aFF"), dict(s="abc"), dict(s="zz")], lambda v: V.BUILTINS["from_hex"](v["s"]))
    assert texts == [(b"\x0a\xff",), (None,), (None,)]


@pytest.mark.parametrize(
    "make",
    [
        lambda a, f, o: V.arithmetic("+", a, f), lambda a, f, o: V.arithmetic("+", a, V.lit(1.5)), lambda a, f, o: V.arithmetic("+", o, a), lambda a, f, o: V.invert(a), lambda a, f, o: V.cast(f, I64),
        lambda a, f, o: V.cast(a, DATE), lambda a, f, o: V.compare("<", V.Val(JSON, None), V.Val(JSON, None)), lambda a, f, o: V.choose(a, a, a), lambda a, f, o: V.make_array([a, f]), lambda a, f, o: V.get_field(a, "x"),
    ],
)
def test_type_rules(make):
    with pytest.raises(TypeProblem):
        make(V.Val(I64, None), V.Val(F64, None), V.Val(optional(I64), None))


def test_literals_adapt():
    assert V.arithmetic("*", V.Val(F64, None), V.lit(2)).type == F64
    assert V.choose(V.Val(BOOL, None), V.Val(I64, None), V.lit(None)).type == optional(I64)
    assert V.lit(None).type == NONE and spark_type(array(I64)).simpleString() == "array<bigint>"
