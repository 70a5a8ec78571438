"""The rule language: programs over rows, transactions, and rejected programs."""

import pytest

from rillstone.plans.rule_check import check
from rillstone.plans.rule_run import evaluate
from rillstone.streaming.rule_session import RuleSession
from rillstone.types import Diagnostic

Q = "q :: relation(a: i64, s: string, o: optional(i64))\nq(a:, s:, o:) <- input\n"
ROWS = [(1, "x", 5), (2, "x", None), (3, "yé", 7)]


def ask(spark, program, rows=ROWS, out="out"):
    df = spark.createDataFrame(rows, "a long, s string, o long")
    return sorted((tuple(r) for r in evaluate(spark, Q + program, {"q": df})[out].collect()), key=repr)


GOOD = {
    "filter": ("out(a: x) <-\n    q(a: x)\n    x >= 2", [(2,), (3,)]),
    "a repeated variable joins columns": ("out(a: x) <- q(a: x, o: x)", []),
    "absence narrows away, in any order": ("out(a: x, t: t) <-\n    q(a: x, o: v)\n    t := v + 1\n    v :: i64", [(1, 6), (3, 8)]),
    "absence is a value": ("out(a: x) <-\n    q(a: x, o: v)\n    v = NONE", [(2,)]),
    "set semantics": ("out(s: s) <- q(s: s)", [("x",), ("yé",)]),
    "a partial step drops the row": ("out(a: x, d: 6 / y) <-\n    q(a: x)\n    y := x - 2", [(1, -6), (3, 6)]),
    "competing matches must agree": ("out(a: x) <-\n    q(a: x)\n    y := x * x\n    y := x + x", [(2,)]),
    "assignments, not rows": ("out(t: s) <-\n    q(s: n)\n    s := sum<k>\n    k := string:length(n)", [(3,)]),
    "a bound variable multiplies": ("out(t: sum<k>) <-\n    q(a: _a, s: n)\n    k := string:length(n)", [(4,)]),
    "a group by variables": ("out(n: string:length(s), c: count<>) <- q(a: _a, s: s)", [(1, 2), (2, 1)]),
    "absent values are skipped": ("out(s: s, t: sum<o>, m: min<o>) <- q(a: _a, s: s, o: o)", [("x", 5, 5), ("yé", 7, 7)]),
    "after the aggregate": ("out(s: s, t: u) <-\n    q(a: a, s: s)\n    t := sum<a>\n    u := t * 10\n    t >= 3", [("x", 30), ("yé", 30)]),
    "argmax": ("out(v: argmax<s, by: a>, w: argmin<a, by: s>) <- q(a: a, s: s)", [("yé", 1)]),
    "negation": ("r(s: s) <-\n    q(s: s, o: o)\n    o = NONE\nout(a: x) <-\n    q(a: x, s: s)\n    not r(s: s)", [(3,)]),
    "negation of the existential": ("out(a: x) <-\n    q(a: x)\n    not q(a: x, o: 5)", [(2,), (3,)]),
    "a proposition": ("ok :: relation()\nok() <- q(o: 7)\nout(a: x) <-\n    q(a: x)\n    ok()\n    not none()\nnone :: relation()\nnone() <- q(o: 8)", [(1,), (2,), (3,)]),
    "unions": ("out(v: x) <- q(a: x)\nout(v: x) <-\n    q(o: x)\n    x :: i64\nout(v: 9) <- q(a: 1)", [(1,), (2,), (3,), (5,), (7,), (9,)]),
    "unnest with an index": ("out(i: i, v: v) <-\n    q(a: 1, s: s)\n    (i, v) := *[s, s]", [(0, "x"), (1, "x")]),
    "unnest without": ("out(v: v, n: count<>) <-\n    q(a: 1, s: s)\n    (v) := *[s, s]", [("x", 1)]),
    "unnest a dict": ("out(k: k, v: v) <-\n    q(a: 3, s: s)\n    (k, v) := **{b: 1, a: string:length(s)}", [("a", 2), ("b", 1)]),
    "array patterns": ("out(x: x, n: array:length(r)) <-\n    q(a: a)\n    [x, *r] := [a, a, a]\nout(x: x, n: 0) <-\n    q(a: a)\n    [x] := [a, a]", [(1, 2), (2, 2), (3, 2)]),
    "dict patterns": ("out(x: x, more: dict:length(e)) <-\n    q(a: a)\n    {k: x, **e} := {k: a, z: a}", [(1, 1), (2, 1), (3, 1)]),
    "subscripts": ("out(a: a, v: xs[a], w: xs[0:2][-1:][0]) <-\n    q(a: a)\n    xs := [10, 11, a]", [(1, 11, 11), (2, 2, 11)]),
    "text": ('out(u: string:upper(s) ++ "!", n: string:length(s)) <- q(s: s)', [("X!", 1), ("YÉ!", 2)]),
    "powers wrap": ("out(p: integer:pow(a, exponent: 3), m: integer:max(a, 2), g: integer:sign(0 - a)) <- q(a: a)", [(1, 2, -1), (27, 3, -1), (8, 2, -1)]),
    "ground rules": ("out :: relation(v: i64)\nout(v: n) <- n := 6 * 7", [(42,)]),
    "facts": ("f :: relation(a: i64, n: f64)\nf(a: 1, n: 2)\nf(a: 1, n: 2)\nout(n: n) <-\n    f(a: x, n: n)\n    q(a: x)", [(2.0,)]),
    "documents": ('out(a: a, n: n) <-\n    q(a: a)\n    d := dynamic:of(a)\n    d :: i64\n    n := d + 1', [(1, 2), (2, 3), (3, 4)]),
    "intervals": ('out(t: temporal:total_hours(d - e)) <-\n    q(a: 1)\n    d := temporal:timestamp("2024-01-03 06:00:00")\n    e := temporal:timestamp(date: temporal:date(year: 2024, month: 1, day: 1), time: temporal:time(hour: 1, minute: 0))', [(53,)]),
    "mutual recursion": ("n(v: 0) <- q(a: 1)\nn(v: w) <-\n    m(v: x)\n    w := x + 1\n    w < 7\nm(v: w) <-\n    n(v: x)\n    w := x + 1\nout(v: v) <- n(v: v)\n n2 :: relation(v: i64)".replace("\n n2 :: relation(v: i64)", "").replace("n(v: 0) <- q(a: 1)", "n :: relation(v: i64)\nn(v: 0) <- q(a: 1)"), [(0,), (2,), (4,), (6,)]),
}


@pytest.mark.parametrize("name", GOOD)
def test_programs(spark, name):
    program, want = GOOD[name]
    assert ask(spark, program) == sorted(want, key=repr)


BAD = {
    "unbound head": "out(a: y) <- q(a: x)", "only negated": "out(a: x) <-\n    q(a: x)\n    not q(a: z)", "unbound filter": "out(a: x) <-\n    q(a: x)\n    z > 1", "unknown relation": "out(a: x) <- nope(a: x)", "unknown column": "out(a: x) <- q(b: x)",
    "two types": "out(a: x) <- q(a: x, s: x)", "a conflicting rule": "out(v: x) <- q(a: x)\nout(v: x) <- q(s: x)", "against the spec": "out :: relation(v: string)\nout(v: x) <- q(a: x)", "missing column": "out :: relation(v: i64, w: i64)\nout(v: x) <- q(a: x)",
    "negation in a cycle": "out(a: x) <-\n    q(a: x)\n    not out(a: x)", "aggregation in a cycle": "out(a: x) <- q(a: x)\nout(a: s) <-\n    out(a: x)\n    s := sum<x>", "outside the group": "out(s: s) <-\n    q(a: x)\n    s := sum<x>\n    s > x", "an aggregate of an aggregate": "out(s: t) <-\n    q(a: x)\n    s := sum<x>\n    t := max<s>",
    "an atom reads an aggregate": "out(s: s) <-\n    q(a: x)\n    s := sum<x>\n    q(o: s)", "sum of texts": "out(s: sum<x>) <- q(s: x)", "open literals": "f(a: 1)", "no such assertion": "out(a: x) <-\n    q(a: x)\n    x :: string", "mixed groups": "out(a: x) <-\n    q(a: x)\n    s ++ s + s = s", "chained comparison": "out(a: x) <-\n    q(a: x)\n    1 < x < 3",
    "a unary beside a binary": "out(a: x) <-\n    q(a: x)\n    x > -1 + 2", "not as a filter": "out(a: x) <-\n    q(a: x)\n    not x", "the wildcard elsewhere": "out(a: _) <- q(a: x)", "a reserved name": "sum(a: x) <- q(a: x)", "a column twice": "out(a: x, a: x) <- q(a: x)", "no callable": "out(a: string:nope(x)) <- q(s: x)",
    "no such shape": "out(a: array:at(x, 1)) <-\n    q(a: a)\n    x := [a]", "order on arrays": "out(a: a) <-\n    q(a: a)\n    [a] < [a]", "NONE has no order": "out(a: a) <-\n    q(a: a, o: o)\n    o < NONE", "input and derived": "q(a: 1, s: \"x\", o: 1)", "a record pattern is exact": "out(x: x) <-\n    q(a: a)\n    record(x:) := record(x: a, y: a)",
    "by is required": "out(v: argmin<a>) <- q(a: a)", "count takes nothing": "out(v: count<a>) <- q(a: a)", "i64 is no document": "out :: relation(d: json)\nout(d: a) <- q(a: a)", "optional of optional": "t :: relation(a: optional(optional(i64)))", "a bad escape": 'out(a: x) <-\n    q(s: x)\n    x = "\\z"',
}


@pytest.mark.parametrize("name", BAD)
def test_rejected(name):
    with pytest.raises(Diagnostic) as e:
        check(Q + BAD[name])
    assert e.value.line >= 1


TC = "edge :: relation(src: i64, dst: i64)\nedge(src:, dst:) <- input\npath(src: x, dst: y) <- edge(src: x, dst: y)\npath(src: x, dst: y) <-\n    path(src: x, dst: z)\n    edge(src: z, dst: y)\n"


def test_transactions_report_changes(spark):
    s = RuleSession(spark, TC, ["path"])
    e = lambda *xs: s.rows("edge", [(w, {"src": a, "dst": b}) for w, a, b in xs])
    got = s.collect(s.step({"edge": e((1, 1, 2), (1, 2, 3), (-1, 9, 9))}))["path"]
    assert sorted((w, r["src"], r["dst"]) for w, r in got) == [(1, 1, 2), (1, 1, 3), (1, 2, 3)]
    got = s.collect(s.step({"edge": e((-1, 2, 3), (1, 9, 9))}))["path"]  # the assertion pays off a debt
    assert sorted((w, r["src"], r["dst"]) for w, r in got) == [(-1, 1, 3), (-1, 2, 3)]
    assert s.collect(s.step({})) == {"path": []}


def test_offsets_of_an_input(spark):
    s = RuleSession(spark, 'log :: relation(x: string, p: i64, o: i64)\nlog(x:, p:, o:) <- input partition_as: "p", offset_as: "o"\nfirst(x: x, o: o) <- log(x: x, o: o)\n', ["first"])
    s.step({"log": s.rows("log", [(1, {"x": "a"}), (1, {"x": "b"}), (-1, {"x": "a"})])})
    got = s.collect(s.step({"log": s.rows("log", [(1, {"x": "a"})])}))["first"]
    assert got == [[1, {"x": "a", "o": 3}]]
