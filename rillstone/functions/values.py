"""Typed values over Spark columns: operators, conversions and library functions.

A ``Val`` is a type and a column that is built when it is asked for, so programs
are checked without a Spark session.  All is expressed with built-in functions;
sessions run with ANSI mode off, where integers wrap and division by zero is null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import (
    BOOL, BYTES, DATE, DYNAMIC, F64, FLOAT, I64, INT, INTERVAL, JSON, NONE, OPEN, SCALARS, STRING, TIME, TIMESTAMP, UNIT, Type, TypeProblem,
    array, dict_of, is_open, is_optional, optional, record, settle, spark_type, strip, unify,
)

DAY = 86_400_000_000
UNITS = {"days": DAY, "hours": 3_600_000_000, "minutes": 60_000_000, "seconds": 1_000_000, "microseconds": 1}


@dataclass(frozen=True)
class Val:
    """A typed value; ``literal`` holds a numeric literal, which takes its type from context."""

    type: Type
    build: Callable[[], Column]
    literal: object = None

    @property
    def col(self) -> Column:
        return self.build()


def lit(value: object) -> Val:
    """A literal of the languages: absence, a truth value, a number or a text."""
    if value is None:
        return Val(NONE, lambda: F.lit(None))
    if isinstance(value, bool):
        return Val(BOOL, lambda: F.lit(value))
    if isinstance(value, int):
        return Val(INT, lambda: F.lit(wrap(value)).cast("long"), value)
    if isinstance(value, float):
        return Val(FLOAT, lambda: F.lit(value), value)
    return Val(STRING, lambda: F.lit(value))


def wrap(n: int) -> int:
    return (n + (1 << 63)) % (1 << 64) - (1 << 63)


def fit(v: Val, t: Type) -> Val:
    """``v`` as a value of ``t``, which it must be assignable to: literals, empty containers and absence take the type."""
    if v.type == t:
        return v
    got = unify(v.type, t)
    if got != t and not (is_open(t) and unify(got, t) == got):
        raise TypeProblem(f"expected `{t}`, found `{v.type}`")
    t = got if is_open(t) else t
    if v.literal is not None and strip(t) == F64:
        return Val(t, lambda: F.lit(float(v.literal)))
    if is_open(v.type) or v.type == NONE:
        if not is_open(t):
            return Val(t, lambda: v.col.cast(spark_type(t)), v.literal)
        return Val(t, v.build, v.literal)
    return Val(t, v.build)


def settled(v: Val) -> Val:
    return fit(v, settle(v.type))


def meet(a: Val, b: Val) -> tuple[Val, Val, Type]:
    """Two values under their common type (each keeps its own optionality)."""
    t = unify(a.type, b.type)
    if t not in (INT, FLOAT) and is_open(t):
        t = unify(t, t)
    one = lambda v: fit(v, optional(strip(t)) if is_optional(v.type) else strip(t))
    return one(a), one(b), t


def make_record(fields: dict[str, Val]) -> Val:
    if not fields:
        return Val(UNIT, lambda: F.lit(True))
    order = sorted(fields)
    t = record({n: fields[n].type for n in order})
    return Val(t, lambda: F.struct(*[fields[n].col.cast(spark_type(fields[n].type)).alias(n) for n in order]))


def get_field(v: Val, name: str) -> Val:
    if v.type.name != "record":
        raise TypeProblem(f"`{v.type}` has no fields")
    t = v.type.field(name)
    if t is None:
        raise TypeProblem(f"unknown field `{name}` of `{v.type}`")
    return Val(t, lambda: v.col.getField(name))


def make_array(items: list[Val]) -> Val:
    if not items:
        return Val(array(OPEN), lambda: F.array())
    t = items[0].type
    for x in items[1:]:
        t = unify(t, x.type)
    fitted = [fit(x, t) for x in items]
    return Val(array(t), lambda: F.array(*[x.col for x in fitted]))


def canonical_entries(entries: Column) -> Column:
    """Entries sorted by key, of equal keys the last."""
    kept = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda later: later["key"].eqNullSafe(e["key"])))
    return F.array_sort(kept, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))


def make_dict(entries: list[tuple[Val, Val]]) -> Val:
    if not entries:
        return Val(dict_of(OPEN, OPEN), lambda: F.array())
    kt, vt = entries[0][0].type, entries[0][1].type
    for k, v in entries[1:]:
        kt, vt = unify(kt, k.type), unify(vt, v.type)
    kt = settle(kt)
    if kt not in SCALARS:
        raise TypeProblem(f"a dict key must be a scalar, not `{kt}`")
    pairs = [(fit(k, kt), fit(v, vt)) for k, v in entries]
    return Val(dict_of(kt, vt), lambda: canonical_entries(F.array(*[F.struct(k.col.alias("key"), v.col.alias("value")) for k, v in pairs])))


def dict_from(a: Val) -> Val:
    t = a.type.args[0] if a.type.name == "array" else None
    if t is None or t.name != "record" or [n for n, _ in t.fields] != ["key", "value"]:
        raise TypeProblem("dict() needs an array of record(key:, value:)")
    if t.field("key") not in SCALARS:
        raise TypeProblem(f"a dict key must be a scalar, not `{t.field('key')}`")
    return Val(dict_of(t.field("key"), t.field("value")), lambda: canonical_entries(a.col))


# ---- operators -------------------------------------------------------------


def definite(v: Val, what: str) -> None:
    if is_optional(v.type):
        raise TypeProblem(f"{what} needs a definite value, not `{v.type}`")


def equal(a: Val, b: Val) -> Val:
    a, b, _ = meet(a, b)
    if is_optional(a.type) or is_optional(b.type):
        return Val(BOOL, lambda: a.col.eqNullSafe(b.col))
    return Val(BOOL, lambda: a.col == b.col)


def less(a: Val, b: Val) -> Val:
    """``a < b``, where absence comes before every value."""
    a, b, t = meet(a, b)
    if settle(strip(t)) not in SCALARS:
        raise TypeProblem(f"`{strip(t)}` has no order")
    if is_optional(a.type) or is_optional(b.type):
        return Val(BOOL, lambda: F.coalesce(a.col < b.col, a.col.isNull() & b.col.isNotNull()))
    return Val(BOOL, lambda: a.col < b.col)


def invert(v: Val) -> Val:
    definite(v, "`not`")
    if v.type != BOOL:
        raise TypeProblem(f"`not` needs a bool, not `{v.type}`")
    return Val(BOOL, lambda: ~v.col)


def logic(op: str, a: Val, b: Val) -> Val:
    for x in (a, b):
        definite(x, f"`{op}`")
        if x.type != BOOL:
            raise TypeProblem(f"`{op}` needs bools, not `{x.type}`")
    return Val(BOOL, lambda: (a.col & b.col) if op == "and" else (a.col | b.col))


def compare(op: str, a: Val, b: Val) -> Val:
    if op in ("==", "="):
        return equal(a, b)
    if op == "!=":
        e = equal(a, b)
        return Val(BOOL, lambda: ~e.col)
    x = less(a, b) if op in ("<", ">=") else less(b, a)
    return x if op in ("<", ">") else Val(BOOL, lambda: ~x.col)


def micros_of(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp without time zone; sessions are pinned to UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def _temporal(op: str, a: Val, b: Val) -> Val | None:
    x, y = a.type, b.type
    if op == "+" and x == INTERVAL and y in (DATE, TIME, TIMESTAMP):
        a, b, x, y = b, a, y, x
    if op not in ("+", "-") or not {x, y} & {DATE, TIME, TIMESTAMP, INTERVAL}:
        return None
    sign = 1 if op == "+" else -1
    if x == y == INTERVAL:
        return Val(INTERVAL, lambda: a.col + b.col if sign > 0 else a.col - b.col)
    if x == y and op == "-":
        return Val(INTERVAL, {TIME: lambda: a.col - b.col, DATE: lambda: F.datediff(a.col, b.col).cast("long") * DAY, TIMESTAMP: lambda: micros_of(a.col) - micros_of(b.col)}[x])
    if y == INTERVAL:
        return Val(x, {
            TIME: lambda: F.pmod(a.col + sign * b.col, F.lit(DAY)),
            # a date shifts by whole days, towards zero
            DATE: lambda: F.date_add(a.col, (sign * int_div(b.col, F.lit(DAY))).cast("int")),
            TIMESTAMP: lambda: from_micros(micros_of(a.col) + sign * b.col),
        }[x])
    raise TypeProblem(f"`{x} {op} {y}` has no meaning")


def int_div(a: Column, b: Column) -> Column:
    """Integer division towards zero; null by zero."""
    return F.call_function("div", a, b)


def arithmetic(op: str, a: Val, b: Val) -> Val:
    """+ - * / %: operands of one numeric type; integers wrap; / and % are optional."""
    for x in (a, b):
        definite(x, f"`{op}`")
    if (t := _temporal(op, a, b)) is not None:
        return t
    a, b, t = meet(a, b)
    if t not in (I64, F64, INT, FLOAT):
        raise TypeProblem(f"`{op}` needs numbers, not `{t}`")
    if t in (INT, FLOAT) and op not in ("/", "%") and a.literal is not None and b.literal is not None:
        value = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y}[op](a.literal, b.literal)
        return lit(wrap(value) if t == INT else float(value))
    t = settle(t)
    a, b = fit(a, t), fit(b, t)
    if op in ("/", "%"):
        if t == F64:
            zero = lambda: F.when(b.col == 0.0, None)
            return Val(optional(F64), lambda: zero().otherwise(a.col / b.col if op == "/" else a.col % b.col))
        return Val(optional(I64), lambda: int_div(a.col, b.col) if op == "/" else a.col % b.col)
    return Val(t, {"+": lambda: a.col + b.col, "-": lambda: a.col - b.col, "*": lambda: a.col * b.col}[op])


def negate(v: Val) -> Val:
    definite(v, "unary `-`")
    if v.literal is not None:
        return lit(wrap(-v.literal) if isinstance(v.literal, int) else -v.literal)
    if v.type not in (I64, F64, INTERVAL):
        raise TypeProblem(f"unary `-` needs a number, not `{v.type}`")
    return Val(v.type, lambda: -v.col)


# ---- text forms ------------------------------------------------------------


def f64_text(x: Column) -> Column:
    """The shortest text that reads back, with plain digits from 1e-5 up to below 1e16: ``1.0``, ``0.0001``, ``1e22``."""
    s = F.abs(x).cast("string")
    digits = F.regexp_replace(F.regexp_replace(F.regexp_extract(s, r"^([0-9.]+)E", 1), r"\.", ""), "0+$", "")
    digits = F.when(digits == "", F.lit("0")).otherwise(digits)
    e = F.regexp_extract(s, r"E(-?[0-9]+)$", 1).cast("int")
    n = F.length(digits)
    large = F.concat(F.substring(F.rpad(digits, 17, "0"), F.lit(1), e + 1), F.lit("."), F.when(n > e + 1, F.substring(digits, e + 2, n)).otherwise(F.lit("0")))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
    short = F.concat(F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(F.lit("")), F.lit("e"), e.cast("string"))
    text = F.when(~s.contains("E"), s).when((e >= 0) & (e < 16), large).when((e < 0) & (e >= -5), small).otherwise(short)
    sign = F.when(x.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit(""))
    return F.when(F.isnan(x), F.lit("NaN")).when(F.abs(x) == float("inf"), F.concat(sign, F.lit("inf"))).otherwise(F.concat(sign, text))


def _fraction(us: Column) -> Column:
    return F.when(us == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.regexp_replace(F.lpad(us.cast("string"), 6, "0"), "0+$", "")))


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def time_text(us: Column) -> Column:
    s = int_div(us, F.lit(1_000_000))
    return F.concat(_two(int_div(s, F.lit(3600))), F.lit(":"), _two(int_div(s, F.lit(60)) % 60), F.lit(":"), _two(s % 60), _fraction(us % 1_000_000))


def date_text(d: Column) -> Column:
    return d.cast("string")


def timestamp_text(ts: Column) -> Column:
    us = micros_of(ts)
    return F.concat(date_text(ts.cast("date")), F.lit(" "), time_text(F.pmod(us, F.lit(DAY))))


def interval_text(iv: Column) -> Column:
    """ISO 8601: ``P1DT1H1M1.5S``, ``-PT1H``, ``PT0S``."""
    us = F.abs(iv)
    days, rest = int_div(us, F.lit(DAY)), us % DAY
    hours, minutes, left = int_div(rest, F.lit(UNITS["hours"])), int_div(rest, F.lit(UNITS["minutes"])) % 60, rest % UNITS["minutes"]
    some = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))).otherwise(F.lit(""))
    seconds = F.when(left > 0, F.concat(int_div(left, F.lit(1_000_000)).cast("string"), _fraction(left % 1_000_000), F.lit("S"))).otherwise(F.lit(""))
    clock = F.concat(some(hours, "H"), some(minutes, "M"), seconds)
    text = F.concat(F.lit("P"), some(days, "D"), F.when(clock == "", F.lit("")).otherwise(F.concat(F.lit("T"), clock)))
    return F.when(iv == 0, F.lit("PT0S")).otherwise(F.concat(F.when(iv < 0, F.lit("-")).otherwise(F.lit("")), text))


def _part(s: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(s, pattern, group)


_DATE, _TIME = r"([0-9]{4})-([0-9]{2})-([0-9]{2})", r"([0-9]{2}):([0-9]{2}):([0-9]{2})(?:\.([0-9]{1,9}))?"
_SPAN = r"^(-?)P(?:([0-9]+)D)?(?:T(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9]+)(?:\.([0-9]{1,9}))?S)?)?$"


def parse_date(s: Column) -> Column:
    return F.when(s.rlike(f"^{_DATE}$"), F.try_to_date(s, "yyyy-MM-dd"))


def _clock(s: Column, pattern: str, at: int) -> Column:
    h, m, sec = (_part(s, pattern, at + k).cast("long") for k in range(3))
    us = F.rpad(F.substring(_part(s, pattern, at + 3), 1, 6), 6, "0").cast("long")
    return F.when((h < 24) & (m < 60) & (sec < 60), ((h * 60 + m) * 60 + sec) * 1_000_000 + us)


def parse_time(s: Column) -> Column:
    p = f"^{_TIME}$"
    return F.when(s.rlike(p), _clock(s, p, 1))


def parse_timestamp(s: Column) -> Column:
    p = f"^{_DATE} {_TIME}$"
    day = F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd")
    whole = F.unix_date(day).cast("long") * DAY
    return F.when(s.rlike(f"^{_DATE}$"), from_micros(whole)).when(s.rlike(p), from_micros(whole + _clock(s, p, 4)))


def parse_interval(s: Column) -> Column:
    n = lambda k: F.coalesce(_part(s, _SPAN, k).cast("long"), F.lit(0))
    us = n(2) * DAY + n(3) * UNITS["hours"] + n(4) * UNITS["minutes"] + n(5) * 1_000_000 + F.rpad(F.substring(_part(s, _SPAN, 6), 1, 6), 6, "0").cast("long")
    ok = s.rlike(_SPAN) & ~s.rlike(r"^-?P$|T$")
    return F.when(ok, F.when(s.startswith("-"), -us).otherwise(us))


# ---- documents and dynamics ------------------------------------------------


def quoted(s: Column) -> Column:
    """A text as JSON."""
    return F.to_json(s.cast("variant"))


def _key_text(t: Type, c: Column) -> Column:
    if t == BYTES:
        return F.concat(F.lit("base64:"), F.base64(c))
    return c if t == STRING else to_text(t, c)


def to_text(t: Type, c: Column) -> Column:
    if t == F64:
        return f64_text(c)
    form = {DATE: date_text, TIME: time_text, TIMESTAMP: timestamp_text, INTERVAL: interval_text}.get(t)
    return form(c) if form else c.cast("string")


def _object(parts: list[tuple[str, Column]]) -> Column:
    out = [F.lit("{")]
    for k, (name, c) in enumerate(sorted(parts)):
        out += [F.lit(("," if k else "") + '"' + name.replace("\\", "\\\\").replace('"', '\\"') + '":'), c]
    return F.concat(*out, F.lit("}"))


def to_document(t: Type, c: Column) -> Column:
    """A value as canonical JSON text; absence is null."""
    if t.name == "optional":
        return F.coalesce(to_document(t.args[0], c), F.lit("null"))
    if t == JSON:
        return c
    if t in (BOOL, I64):
        return c.cast("string")
    if t == F64:
        return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit("null")).otherwise(f64_text(c))
    if t == STRING:
        return quoted(c)
    if t.name == "array":
        return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: to_document(t.args[0], x)), ","), F.lit("]"))
    if t.name == "record":
        return _object([(n, to_document(x, c.getField(n))) for n, x in t.fields]) if t.fields else F.lit("{}")
    if t.name == "dict" and t.args[0] == STRING:
        return F.concat(F.lit("{"), F.array_join(F.transform(c, lambda e: F.concat(quoted(e["key"]), F.lit(":"), to_document(t.args[1], e["value"]))), ","), F.lit("}"))
    if t.name == "dict":
        return F.concat(F.lit("{"), F.array_join(F.transform(c, lambda e: F.concat(quoted(_key_text(t.args[0], e["key"])), F.lit(":"), to_document(t.args[1], e["value"]))), ","), F.lit("}"))
    raise TypeProblem(f"a document holds what JSON holds, so no `{t}`; convert it to text first")


def _kind(doc: Column) -> Column:
    return F.substring(doc, 1, 1)


def from_document(t: Type, doc: Column) -> Column:
    """The value that a document holds, if it is exactly of that type; else null."""
    if t.name == "optional":
        return F.when(doc != "null", from_document(t.args[0], doc))
    if t == JSON:
        return doc
    if t == BOOL:
        return F.when(doc.isin("true", "false"), doc == "true")
    if t == I64:
        return F.when(doc.rlike("^-?[0-9]{1,18}$"), doc.cast("long")).when(doc.rlike("^-?[0-9]{1,37}$"), _exact_long(doc))
    if t == F64:
        return F.when(doc.rlike(r"^-?[0-9]"), doc.cast("double"))
    if t == STRING:
        return F.when(_kind(doc) == '"', F.try_variant_get(F.try_parse_json(doc), "$", "string"))
    if t.name == "array":
        items = F.transform(F.try_variant_get(F.try_parse_json(doc), "$", "array<variant>"), lambda x: F.to_json(x))
        return F.when(_kind(doc) == "[", _all_of(t.args[0], items))
    if t.name == "record":
        if not t.fields:
            return F.when(doc.isNotNull(), F.lit(True))
        got = {n: (x, from_document(x, member(doc, n))) for n, x in t.fields}
        ok = F.lit(True)
        for x, c in got.values():
            ok = ok & (F.lit(True) if x.name == "optional" else c.isNotNull())
        return F.when(ok, F.struct(*[c.alias(n) for n, (_, c) in got.items()]))
    if t.name == "dict":
        pairs = F.map_entries(F.try_variant_get(F.try_parse_json(doc), "$", "map<string,variant>"))
        made = F.transform(pairs, lambda e: F.struct(from_key(t.args[0], e["key"]).alias("key"), from_document(t.args[1], F.to_json(e["value"])).alias("value")))
        bad = F.exists(made, lambda e: e["key"].isNull() | (F.lit(False) if t.args[1].name == "optional" else e["value"].isNull()))
        return F.when((_kind(doc) == "{") & ~bad, canonical_entries(made))
    raise TypeProblem(f"a document holds no `{t}`; read its text and convert that")


def _exact_long(text: Column) -> Column:
    """A decimal integer of any length as a 64-bit one, null beyond its range."""
    n = text.cast("decimal(38,0)")
    return F.when((n >= F.lit("-9223372036854775808").cast("decimal(38,0)")) & (n <= F.lit("9223372036854775807").cast("decimal(38,0)")), n.cast("long"))


def _all_of(t: Type, items: Column) -> Column:
    if t.name == "optional":
        return F.transform(items, lambda x: from_document(t, x))
    made = F.transform(items, lambda x: from_document(t, x))
    return F.when(~F.exists(made, lambda x: x.isNull()), made)


def from_key(t: Type, text: Column) -> Column:
    """A dict key from its text."""
    if t == STRING:
        return text
    if t == BYTES:
        return F.when(text.startswith("base64:"), F.try_to_binary(F.substring(text, F.lit(8), F.length(text)), F.lit("base64")))
    return from_text(t, text)


def member(doc: Column, key: str | int) -> Column:
    """A member of a document by name or index, as a document; null if there is none."""
    name = str(key).replace("\\", "\\\\").replace("'", "\\'")
    path = f"$[{key}]" if isinstance(key, int) else f"$['{name}']"
    if isinstance(key, int) and key < 0:
        return F.lit(None).cast("string")
    v = F.try_variant_get(F.try_parse_json(doc), path, "variant")
    kind = F.schema_of_variant(v)
    raw = F.get_json_object(doc, path)  # keeps 5.0 apart from 5
    return F.when(v.isNull(), None).when(kind == "STRING", F.to_json(v)).when(kind == "VOID", F.lit("null")).otherwise(F.coalesce(raw, F.to_json(v)))


def from_text(t: Type, s: Column) -> Column:
    """A value from text in its one spelling; null if the text isn't one."""
    if t == BOOL:
        return F.when(s.isin("true", "false"), s == "true")
    if t == I64:
        return F.when(s.rlike("^[+-]?[0-9]{1,37}$"), _exact_long(s))
    if t == F64:
        x = F.when(s.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), s.cast("double"))
        return F.when(F.abs(x) < float("inf"), x)
    return {DATE: parse_date, TIME: parse_time, TIMESTAMP: parse_timestamp, INTERVAL: parse_interval}[t](s)


_TAGS = {BOOL: "bool", I64: "i64", F64: "f64", STRING: "string", BYTES: "bytes", DATE: "date", TIME: "time", TIMESTAMP: "timestamp", INTERVAL: "interval"}


def to_dynamic(t: Type, c: Column) -> Column:
    """A value with its type tag, as canonical JSON text."""
    if t == DYNAMIC:
        return c
    if t.name == "optional":
        return F.coalesce(to_dynamic(t.args[0], c), F.lit("null"))
    tagged = lambda tag, body: F.concat(F.lit(f'{{"{tag}":'), body, F.lit("}"))
    if t == JSON:
        return tagged("json", c)
    if t == BYTES:
        return tagged("bytes", quoted(F.base64(c)))
    if t in _TAGS:
        return tagged(_TAGS[t], to_document(t, c) if t in (BOOL, I64, F64, STRING) else quoted(to_text(t, c)))
    if t.name == "array":
        return tagged("array", F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: to_dynamic(t.args[0], x)), ","), F.lit("]")))
    if t.name == "record":
        return tagged("map", _object([(n, to_dynamic(x, c.getField(n))) for n, x in t.fields]) if t.fields else F.lit("{}"))
    return tagged("map", F.concat(F.lit("{"), F.array_join(F.transform(c, lambda e: F.concat(quoted(_key_text(t.args[0], e["key"])), F.lit(":"), to_dynamic(t.args[1], e["value"]))), ","), F.lit("}")))


def from_dynamic(t: Type, d: Column) -> Column:
    """The value that a dynamic holds, if it holds that type; else null."""
    if t == DYNAMIC:
        return d
    if t.name == "optional":
        return F.when(d != "null", from_dynamic(t.args[0], d))
    body = lambda tag: F.when(d.startswith(f'{{"{tag}":'), F.substring(d, F.lit(len(tag) + 5), F.length(d) - len(tag) - 5))
    if t == JSON:
        return body("json")
    if t == BYTES:
        return F.try_to_binary(from_document(STRING, body("bytes")), F.lit("base64"))
    if t in _TAGS:
        b = body(_TAGS[t])
        return from_document(t, b) if t in (BOOL, I64, F64, STRING) else from_text(t, from_document(STRING, b))
    if t.name == "array":
        items = F.transform(F.try_variant_get(F.try_parse_json(body("array")), "$", "array<variant>"), lambda x: F.to_json(x))
        made = F.transform(items, lambda x: from_dynamic(t.args[0], x))
        return made if t.args[0].name == "optional" else F.when(~F.exists(made, lambda x: x.isNull()), made)
    if t.name == "record":
        inner = body("map")
        got = [(n, x, from_dynamic(x, member(inner, n))) for n, x in t.fields]
        ok = inner.isNotNull()
        for _, x, c in got:
            ok = ok & (F.lit(True) if x.name == "optional" else c.isNotNull())
        return F.when(ok, F.struct(*[c.alias(n) for n, _, c in got]) if got else F.lit(True))
    pairs = F.map_entries(F.try_variant_get(F.try_parse_json(body("map")), "$", "map<string,variant>"))
    made = F.transform(pairs, lambda e: F.struct(from_key(t.args[0], e["key"]).alias("key"), from_dynamic(t.args[1], F.to_json(e["value"])).alias("value")))
    return F.when(~F.exists(made, lambda e: e["key"].isNull() | e["value"].isNull()), canonical_entries(made))


def _holds(t: Type) -> bool:
    """Whether a document can hold the type."""
    return t in (BOOL, I64, F64, STRING, JSON) or t.name in ("optional", "array") and _holds(t.args[0]) or t.name == "record" and all(_holds(x) for _, x in t.fields) or t.name == "dict" and t.args[0] not in (BYTES, DATE, TIME, TIMESTAMP, INTERVAL) and _holds(t.args[1])


def _convert(a: Type, b: Type) -> tuple[bool, Callable[[Column], Column]]:
    """(total, conversion) from one type of present values to another."""
    if a == b:
        return True, lambda c: c
    if b == DYNAMIC:
        return True, lambda c: to_dynamic(a, c)
    if a == DYNAMIC:
        return False, lambda c: from_dynamic(b, c)
    if b == JSON and _holds(a):
        return True, lambda c: to_document(a, c)
    if a == JSON and _holds(b):
        return b == UNIT, lambda c: from_document(b, c)
    if JSON in (a, b):
        raise TypeProblem(f"a document holds no `{b if a == JSON else a}`: go through text, as in cast(cast(x, string), json)")
    if (a, b) == (I64, F64):
        return True, lambda c: c.cast("double")
    if (a, b) == (F64, I64):
        # the range is checked with a strict upper bound: 2**63 itself doesn't fit
        return False, lambda c: F.when((c >= -(2.0**63)) & (c < 2.0**63), c.cast("long"))
    if b == STRING and a in (BOOL, I64, F64, DATE, TIME, TIMESTAMP, INTERVAL):
        return True, lambda c: to_text(a, c)
    if a == STRING and b in (BOOL, I64, F64, DATE, TIME, TIMESTAMP, INTERVAL):
        return False, lambda c: from_text(b, c)
    if (a, b) == (TIMESTAMP, DATE):
        return True, lambda c: c.cast("date")
    if (a, b) == (TIMESTAMP, TIME):
        return True, lambda c: F.pmod(micros_of(c), F.lit(DAY))
    raise TypeProblem(f"no conversion from `{a}` to `{b}`")


def cast(v: Val, t: Type) -> Val:
    """``cast(v, t)``: exactly ``t``, which must be optional where the conversion can fail or ``v`` be absent."""
    try:
        if is_open(v.type):
            return fit(v, t)
    except TypeProblem:
        if v.literal is None:
            raise
        v = settled(v)
    if is_optional(v.type) and not is_optional(t):
        raise TypeProblem(f"an absent value needs an optional target: cast(…, optional({t}))")
    total, convert = _convert(strip(v.type), strip(t))
    if not total and not is_optional(t):
        raise TypeProblem(f"this conversion can fail: write cast(…, optional({t}))")
    return Val(t, lambda: convert(v.col))


# ---- library ---------------------------------------------------------------


def _need(v: Val, *types: Type) -> Val:
    definite(v, "this function")
    v = settled(v) if v.literal is not None and not (v.type == INT and F64 in types and I64 not in types) else v
    if v.literal is not None and F64 in types:
        v = fit(v, F64)
    if v.type not in types:
        raise TypeProblem(f"expected {' or '.join(f'`{t}`' for t in types)}, found `{v.type}`")
    return v


def _space(s: Column, left: bool = True, right: bool = True) -> Column:
    ends = [p for p, on in ((r"^\p{IsWhite_Space}+", left), (r"\p{IsWhite_Space}+$", right)) if on]
    return F.regexp_replace(s, "|".join(ends), "")


def _whole(v: Val, how: Callable[[Column], Column]) -> Val:
    v = _need(v, I64, F64)
    if v.type == I64:
        return v
    return Val(F64, lambda: F.when(F.abs(v.col) < 2.0**52, how(v.col).cast("double")).otherwise(v.col))


def slice_of(a: Val, start: Val, stop: Val, step: Val) -> Val:
    """Python's slice; a step of 0 selects nothing."""
    if a.type.name != "array":
        raise TypeProblem(f"slice needs an array, not `{a.type}`")
    bounds = [fit(x, optional(I64)) for x in (start, stop)]
    step = _need(step, I64)

    def build() -> Column:
        n, st = F.size(a.col).cast("long"), step.col
        lo, hi = F.when(st > 0, F.lit(0)).otherwise(F.lit(-1)), F.when(st > 0, n).otherwise(n - 1)
        clamp = lambda b, default: F.when(b.isNull(), default).otherwise(F.greatest(lo, F.least(hi, F.when(b < 0, b + n).otherwise(b))))
        s, e = clamp(bounds[0].col, F.when(st > 0, F.lit(0)).otherwise(n - 1)), clamp(bounds[1].col, F.when(st > 0, n).otherwise(F.lit(-1)))
        some = ((st > 0) & (s < e)) | ((st < 0) & (s > e))
        last = F.when(st > 0, e - 1).otherwise(e + 1)
        at = F.sequence(s, last, st)
        return F.when(some, F.transform(at, lambda i: F.get(a.col, i.cast("int")))).otherwise(F.filter(a.col, lambda _: F.lit(False)))

    return Val(a.type, build)


def element(a: Val, i: Val) -> Val:
    i = _need(i, I64)
    return Val(optional(a.type.args[0]), lambda: F.when(i.col < 1 << 31, F.get(a.col, i.col.cast("int"))))


def lookup(d: Val, k: Val) -> Val:
    k = fit(k, d.type.args[0])
    return Val(optional(d.type.args[1]), lambda: F.get(F.filter(d.col, lambda e: e["key"].eqNullSafe(k.col)), F.lit(0))["value"])


def navigate(doc: Val, key: Val) -> Val:
    """A member of a document; the key must be a literal."""
    if not isinstance(key.literal, (str, int)):
        raise TypeProblem("a document is navigated by a literal key or index")
    return Val(optional(JSON), lambda: member(doc.col, key.literal))


def get(x: Val, k: Val) -> Val:
    if strip(x.type) == JSON:
        return navigate(x, k)
    definite(x, "`get`")
    if x.type.name == "dict":
        return lookup(x, k)
    if x.type.name == "array":
        return element(x, k)
    raise TypeProblem(f"get reads a document, a dict or an array, not `{x.type}`")


def keys(x: Val) -> Val:
    definite(x, "`keys`")
    if x.type == JSON:
        return Val(optional(array(STRING)), lambda: F.array_sort(F.json_object_keys(x.col)))
    if x.type.name != "dict":
        raise TypeProblem(f"keys reads a document or a dict, not `{x.type}`")
    return Val(array(x.type.args[0]), lambda: F.transform(x.col, lambda e: e["key"]))


def length(x: Val) -> Val:
    definite(x, "`length`")
    if x.type == STRING:
        return Val(I64, lambda: F.length(x.col).cast("long"))
    if x.type.name in ("array", "dict"):
        return Val(I64, lambda: F.size(x.col).cast("long"))
    raise TypeProblem(f"length reads a string, an array or a dict, not `{x.type}`")


def contains(a: Val, x: Val) -> Val:
    if a.type.name != "array":
        raise TypeProblem(f"contains reads an array, not `{a.type}`")
    x = fit(x, unify(a.type.args[0], x.type))
    return Val(BOOL, lambda: F.exists(a.col, lambda e: e.eqNullSafe(x.col)))


def choose(c: Val, a: Val, b: Val) -> Val:
    if c.type != BOOL:
        raise TypeProblem(f"if needs a bool condition, not `{c.type}`")
    t = unify(a.type, b.type)
    a, b = fit(a, t), fit(b, t)
    return Val(t, lambda: F.when(c.col, a.col).otherwise(b.col))


def coalesce(x: Val, y: Val) -> Val:
    if not is_optional(x.type):
        raise TypeProblem(f"coalesce needs an optional value, not `{x.type}`")
    t = unify(strip(x.type) if x.type != NONE else y.type, y.type)
    y = fit(y, t)
    return Val(t, lambda: F.coalesce(x.col, y.col))


def _bytewise(op: str, a: Val, b: Val) -> Val:
    """Bytewise and, or, xor of equally long payloads, over their hex digits."""
    a, b = _need(a, BYTES), _need(b, BYTES)
    table = "0123456789ABCDEF"
    out = {k: [f(x, y) for x in range(16) for y in range(16)] for k, f in (("and", lambda x, y: x & y), ("or", lambda x, y: x | y), ("xor", lambda x, y: x ^ y))}[op]
    digits = "".join(table[x] for x in out)

    def build() -> Column:
        pairs = F.zip_with(F.split(F.hex(a.col), ""), F.split(F.hex(b.col), ""), lambda x, y: F.substring(F.lit(digits), (F.position(x, F.lit(table)) - 1) * 16 + F.position(y, F.lit(table)), F.lit(1)))
        return F.when(F.octet_length(a.col) == F.octet_length(b.col), F.unhex(F.array_join(pairs, "")))

    return Val(optional(BYTES), build)


def _time_part(v: Val, how: Callable[[Column], Column]) -> Val:
    v = _need(v, TIME, TIMESTAMP)
    return Val(I64, lambda: how(v.col if v.type == TIME else F.pmod(micros_of(v.col), F.lit(DAY))))


def _date_part(v: Val, how: Callable[[Column], Column]) -> Val:
    v = _need(v, DATE, TIMESTAMP)
    return Val(I64, lambda: how(v.col).cast("long"))


def make_time(h: Val, m: Val, s: Val, us: Val) -> Val:
    h, m, s, us = (_need(x, I64) for x in (h, m, s, us))
    return Val(optional(TIME), lambda: F.when(h.col.between(0, 23) & m.col.between(0, 59) & s.col.between(0, 59) & us.col.between(0, 999_999), ((h.col * 60 + m.col) * 60 + s.col) * 1_000_000 + us.col))


def make_date(y: Val, m: Val, d: Val) -> Val:
    y, m, d = (_need(x, I64) for x in (y, m, d))
    return Val(optional(DATE), lambda: F.when(y.col.between(-9999, 9999) & m.col.between(1, 12) & d.col.between(1, 31), F.make_date(y.col.cast("int"), m.col.cast("int"), d.col.cast("int"))))


def make_timestamp(d: Val, t: Val) -> Val:
    d, t = _need(d, DATE), _need(t, TIME)
    return Val(TIMESTAMP, lambda: from_micros(F.unix_date(d.col).cast("long") * DAY + t.col))


def _one(types: tuple[Type, ...], result, how) -> Callable[..., Val]:
    def run(v: Val) -> Val:
        v = _need(v, *types)
        return Val(result or v.type, lambda: how(v.col))

    return run


def _two_of(t: Type, result: Type, how) -> Callable[..., Val]:
    def run(a: Val, b: Val) -> Val:
        a, b = _need(a, t), _need(b, t)
        return Val(result, lambda: how(a.col, b.col))

    return run


def _entries(d: Val) -> Val:
    if d.type.name != "dict":
        raise TypeProblem(f"dict_entries reads a dict, not `{d.type}`")
    return Val(array(record({"key": d.type.args[0], "value": d.type.args[1]})), d.build)


#: The functions of the stream language by name; each checks its arguments' types.
BUILTINS: dict[str, Callable[..., Val]] = {
    "coalesce": coalesce, "if": choose, "abs": _one((I64, F64), None, F.abs), "floor": lambda v: _whole(v, F.floor), "ceil": lambda v: _whole(v, F.ceil), "round": lambda v: _whole(v, F.round),
    "length": length, "concat": _two_of(STRING, STRING, F.concat), "lower": _one((STRING,), STRING, F.lower), "upper": _one((STRING,), STRING, F.upper), "trim": _one((STRING,), STRING, _space),
    "get": get, "keys": keys, "dict_entries": _entries, "contains": contains, "slice": slice_of, "make_date": make_date, "make_time": make_time, "make_timestamp": make_timestamp,
    "timestamp_from_micros": _one((I64,), TIMESTAMP, from_micros), "epoch_micros": _one((TIMESTAMP,), I64, micros_of), "epoch_days": _one((DATE,), I64, lambda c: F.unix_date(c).cast("long")),
    "year": lambda v: _date_part(v, F.year), "month": lambda v: _date_part(v, F.month), "day": lambda v: _date_part(v, F.day),
    "hour": lambda v: _time_part(v, lambda c: int_div(c, F.lit(UNITS["hours"]))), "minute": lambda v: _time_part(v, lambda c: int_div(c, F.lit(UNITS["minutes"])) % 60),
    "second": lambda v: _time_part(v, lambda c: int_div(c, F.lit(1_000_000)) % 60), "microsecond": lambda v: _time_part(v, lambda c: c % 1_000_000),
    "make_interval": _one((I64,), INTERVAL, lambda c: c), "octet_length": _one((BYTES,), I64, lambda c: F.octet_length(c).cast("long")), "bytes_concat": _two_of(BYTES, BYTES, F.concat),
    "bytes_and": lambda a, b: _bytewise("and", a, b), "bytes_or": lambda a, b: _bytewise("or", a, b), "bytes_xor": lambda a, b: _bytewise("xor", a, b),
    "to_base64": _one((BYTES,), STRING, F.base64), "to_hex": _one((BYTES,), STRING, lambda c: F.lower(F.hex(c))), "to_utf8": _one((BYTES,), optional(STRING), lambda c: F.try_validate_utf8(c.cast("string"))),
    "from_base64": _one((STRING,), optional(BYTES), lambda c: F.try_to_binary(c, F.lit("base64"))), "from_hex": _one((STRING,), optional(BYTES), lambda c: F.when(c.rlike("^([0-9a-fA-F]{2})*$"), F.unhex(c))),
    "from_utf8": _one((STRING,), BYTES, lambda c: c.cast("binary")),
} | {f"total_{u}": _one((INTERVAL,), I64, lambda c, n=n: int_div(c, F.lit(n))) for u, n in UNITS.items()}
