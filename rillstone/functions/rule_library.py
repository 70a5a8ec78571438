"""The rule language's library: namespaced functions over typed values.

A function takes values (positional, then by keyword) and a list of guards; a
partial one adds a condition without which the row isn't derived, and its result
is definite.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import BOOL, DATE, DYNAMIC, F64, I64, INTERVAL, SCALARS, STRING, TIME, TIMESTAMP, Type, TypeProblem, array, settle, strip, unify
from . import values as V
from .values import Val

Guards = list[Callable[[], Column]]


def partial(v: Val, guards: Guards) -> Val:
    """A value that may have no answer: rows without one are dropped."""
    guards.append(lambda: v.col.isNotNull())
    return Val(strip(v.type), v.build)


def _plain(f: Callable[..., Val]) -> Callable[..., Val]:
    return lambda guards, *args: f(*args)


def _part(f: Callable[..., Val]) -> Callable[..., Val]:
    return lambda guards, *args: partial(f(*args), guards)


def _same(types: tuple[Type, ...], how) -> Callable[..., Val]:
    return _plain(V._one(types, None, how))


def _pair(t: Type, result: Type, how) -> Callable[..., Val]:
    return _plain(V._two_of(t, result, how))


def _array(v: Val) -> Type:
    if v.type.name != "array":
        raise TypeProblem(f"expected an array, found `{v.type}`")
    return v.type.args[0]


def _dict(v: Val) -> Type:
    if v.type.name != "dict":
        raise TypeProblem(f"expected a dict, found `{v.type}`")
    return v.type


def _at(guards: Guards, a: Val, i: Val) -> Val:
    t = _array(a)
    i = V._need(i, I64)
    guards.append(lambda: (i.col >= 0) & (i.col < F.size(a.col)))
    return Val(t, V.element(a, i).build)


def _dict_get(guards: Guards, d: Val, k: Val) -> Val:
    t = _dict(d)
    k = V.fit(k, t.args[0])
    guards.append(lambda: F.exists(d.col, lambda e: e["key"].eqNullSafe(k.col)))
    return Val(t.args[1], V.lookup(d, k).build)


def _slice(guards: Guards, a: Val, start: Val | None = None, stop: Val | None = None, step: Val | None = None) -> Val:
    return V.slice_of(a, start or V.lit(None), stop or V.lit(None), step or V.lit(1))


def _interval(guards: Guards, **parts: Val) -> Val:
    fitted = {u: V._need(v, I64) for u, v in parts.items() if v is not None}

    def build() -> Column:
        total = F.lit(0).cast("long")
        for u, v in fitted.items():
            total = total + v.col * V.UNITS[u]
        return total

    return Val(INTERVAL, build)


def _date(guards: Guards, x: Val) -> Val:
    if x.type == STRING:
        return partial(V.cast(x, Type("optional", (DATE,))), guards)
    return V.cast(x, DATE) if x.type == TIMESTAMP else _no(x)


def _time(guards: Guards, x: Val) -> Val:
    if x.type == STRING:
        return partial(V.cast(x, Type("optional", (TIME,))), guards)
    return V.cast(x, TIME) if x.type == TIMESTAMP else _no(x)


def _timestamp(guards: Guards, x: Val) -> Val:
    if x.type == STRING:
        return partial(V.cast(x, Type("optional", (TIMESTAMP,))), guards)
    return V.BUILTINS["timestamp_from_micros"](x)


def _no(x: Val):
    raise TypeProblem(f"no variant takes `{x.type}`")


def _clock(guards: Guards, hour: Val, minute: Val, second: Val | None = None, microsecond: Val | None = None) -> Val:
    return partial(V.make_time(hour, minute, second or V.lit(0), microsecond or V.lit(0)), guards)


def _string_slice(guards: Guards, s: Val, start: Val | None = None, stop: Val | None = None, step: Val | None = None) -> Val:
    s = V._need(s, STRING)
    letters = Val(array(STRING), lambda: F.filter(F.split(s.col, ""), lambda c: c != ""))
    out = _slice(guards, letters, start, stop, step)
    return Val(STRING, lambda: F.array_join(out.col, ""))


def _string_at(guards: Guards, s: Val, i: Val) -> Val:
    s, i = V._need(s, STRING), V._need(i, I64)
    guards.append(lambda: (i.col >= 0) & (i.col < F.length(s.col)))
    return Val(STRING, lambda: F.substring(s.col, (i.col + 1).cast("int"), F.lit(1)))


def _index_of(guards: Guards, s: Val, sub: Val) -> Val:
    s, sub = V._need(s, STRING), V._need(sub, STRING)
    guards.append(lambda: F.position(sub.col, s.col) > 0)
    return Val(I64, lambda: F.position(sub.col, s.col).cast("long") - 1)


def _split(guards: Guards, s: Val, d: Val) -> Val:
    s, d = V._need(s, STRING), V._need(d, STRING)
    quoted = lambda: F.concat(F.lit("\\Q"), F.replace(d.col, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return Val(array(STRING), lambda: F.when(d.col == "", F.array(s.col)).otherwise(F.split(s.col, quoted(), -1)))


def _array_of(how) -> Callable[..., Val]:
    def run(guards: Guards, a: Val) -> Val:
        _array(a)
        return Val(a.type, lambda: how(a.col))

    return run


def _with_item(how, front: bool = False) -> Callable[..., Val]:
    def run(guards: Guards, a: Val, x: Val) -> Val:
        t = unify(_array(a), x.type)
        x = V.fit(x, t)
        return Val(array(t), lambda: how(a.col, x.col))

    return run


def _array_index(guards: Guards, a: Val, x: Val) -> Val:
    x = V.fit(x, _array(a))
    at = lambda: F.array_position(a.col, x.col)
    guards.append(lambda: at() > 0)
    return Val(I64, lambda: at().cast("long") - 1)


def _array_sort(guards: Guards, a: Val, desc: Val | None = None) -> Val:
    if strip(_array(a)) not in SCALARS:
        raise TypeProblem(f"`{a.type.args[0]}` has no order")
    up = lambda: F.sort_array(a.col, asc=True)
    if desc is None:
        return Val(a.type, up)
    if desc.type != BOOL:
        raise TypeProblem("desc: is a boolean")
    return Val(a.type, lambda: F.when(desc.col, F.sort_array(a.col, asc=False)).otherwise(up()))


def _extreme(how) -> Callable[..., Val]:
    def run(guards: Guards, a: Val) -> Val:
        if _array(a) not in SCALARS:
            raise TypeProblem(f"`{a.type.args[0]}` has no order")
        return partial(Val(a.type.args[0], lambda: how(a.col)), guards)

    return run


def _concat_arrays(guards: Guards, a: Val, b: Val) -> Val:
    t = unify(a.type, b.type)
    a, b = V.fit(a, t), V.fit(b, t)
    _array(a)
    return Val(t, lambda: F.concat(a.col, b.col))


def _flatten(guards: Guards, a: Val) -> Val:
    inner = _array(a)
    if inner.name != "array":
        raise TypeProblem(f"expected an array of arrays, found `{a.type}`")
    return Val(inner, lambda: F.flatten(a.col))


def _dict_part(what: str) -> Callable[..., Val]:
    def run(guards: Guards, d: Val) -> Val:
        t = _dict(d)
        return Val(array(t.args[0 if what == "key" else 1]), lambda: F.transform(d.col, lambda e: e[what]))

    return run


def _has(guards: Guards, d: Val, k: Val) -> Val:
    k = V.fit(k, _dict(d).args[0])
    return Val(BOOL, lambda: F.exists(d.col, lambda e: e["key"].eqNullSafe(k.col)))


def without(d: Val, keys: Val) -> Val:
    keys = V.fit(keys, array(_dict(d).args[0]))
    return Val(d.type, lambda: F.filter(d.col, lambda e: ~F.exists(keys.col, lambda k: k.eqNullSafe(e["key"]))))


def _merge(guards: Guards, a: Val, b: Val) -> Val:
    t = unify(a.type, b.type)
    _dict(a), _dict(b)
    return Val(t, lambda: V.canonical_entries(F.concat(V.fit(a, t).col, V.fit(b, t).col)))


def _sign(v: Val) -> Val:
    v = V._need(v, I64)
    return Val(I64, lambda: F.signum(v.col).cast("long"))


def _int_pow(guards: Guards, x: Val, n: Val) -> Val:
    """Exact power by squaring the 6 low bits and more: wraps like the other integer operators; a negative exponent has no answer."""
    x, n = V._need(x, I64), V._need(n, I64)
    guards.append(lambda: n.col >= 0)

    def build() -> Column:
        bits = F.sequence(F.lit(0), F.lit(62))
        start = F.struct(F.lit(1).cast("long").alias("r"), x.col.alias("b"))
        step = lambda s, k: F.struct(F.when(F.call_function("shiftright", n.col, k).bitwiseAND(1) == 1, s["r"] * s["b"]).otherwise(s["r"]).alias("r"), (s["b"] * s["b"]).alias("b"))
        return F.aggregate(bits, start, step)["r"]

    return Val(I64, build)


def _dynamic(guards: Guards, x: Val) -> Val:
    return V.cast(V.fit(x, settle(x.type)), DYNAMIC)


B = V.BUILTINS
_TEXT_TEST = lambda how: _pair(STRING, BOOL, how)

#: name -> list of (positional count, required keywords, optional keywords, function).
LIBRARY: dict[str, list[tuple[int, tuple[str, ...], tuple[str, ...], Callable[..., Val]]]] = {
    "boolean:not": [(1, (), (), _plain(V.invert))],
    "integer:abs": [(1, (), (), _same((I64,), F.abs))], "integer:sign": [(1, (), (), _plain(_sign))], "integer:pow": [(1, ("exponent",), (), _int_pow)],
    "integer:min": [(2, (), (), _pair(I64, I64, F.least))], "integer:max": [(2, (), (), _pair(I64, I64, F.greatest))],
    "float:abs": [(1, (), (), _same((F64,), F.abs))], "float:floor": [(1, (), (), lambda g, x: B["floor"](V._need(x, F64)))], "float:ceil": [(1, (), (), lambda g, x: B["ceil"](V._need(x, F64)))],
    "float:round": [(1, (), (), lambda g, x: B["round"](V._need(x, F64)))], "float:sign": [(1, (), (), _same((F64,), F.signum))], "float:sqrt": [(1, (), (), _same((F64,), F.sqrt))],
    "float:pow": [(1, ("exponent",), (), _pair(F64, F64, F.pow))], "float:min": [(2, (), (), _pair(F64, F64, F.least))], "float:max": [(2, (), (), _pair(F64, F64, F.greatest))],
    "string:length": [(1, (), (), lambda g, x: V.length(V._need(x, STRING)))], "string:concat": [(2, (), (), _plain(B["concat"]))], "string:lower": [(1, (), (), _plain(B["lower"]))], "string:upper": [(1, (), (), _plain(B["upper"]))],
    "string:trim": [(1, (), (), _plain(B["trim"]))], "string:ltrim": [(1, (), (), _same((STRING,), lambda c: V._space(c, right=False)))], "string:rtrim": [(1, (), (), _same((STRING,), lambda c: V._space(c, left=False)))],
    "string:at": [(1, ("index",), (), _string_at)], "string:slice": [(1, (), ("start", "stop", "step"), _string_slice)],
    "string:starts_with": [(1, ("prefix",), (), _TEXT_TEST(lambda a, b: a.startswith(b)))], "string:ends_with": [(1, ("suffix",), (), _TEXT_TEST(lambda a, b: a.endswith(b)))], "string:contains": [(1, ("sub",), (), _TEXT_TEST(lambda a, b: a.contains(b)))],
    "string:index_of": [(1, ("sub",), (), _index_of)], "string:replace": [(1, ("from", "to"), (), lambda g, s, a, b: Val(STRING, lambda: F.replace(V._need(s, STRING).col, V._need(a, STRING).col, V._need(b, STRING).col)))], "string:split": [(1, ("delimiter",), (), _split)],
    "array:length": [(1, (), (), lambda g, a: (_array(a), V.length(a))[1])], "array:at": [(1, ("index",), (), _at)], "array:slice": [(1, (), ("start", "stop", "step"), _slice)], "array:contains": [(1, ("element",), (), _plain(V.contains))],
    "array:index_of": [(1, ("element",), (), _array_index)], "array:concat": [(2, (), (), _concat_arrays)], "array:append": [(1, ("element",), (), _with_item(F.array_append))], "array:prepend": [(1, ("element",), (), _with_item(F.array_prepend))],
    "array:reverse": [(1, (), (), _array_of(F.reverse))], "array:sort": [(1, (), ("desc",), _array_sort)], "array:distinct": [(1, (), (), _array_of(F.array_distinct))], "array:flatten": [(1, (), (), _flatten)],
    "array:min": [(1, (), (), _extreme(F.array_min))], "array:max": [(1, (), (), _extreme(F.array_max))],
    "dict:length": [(1, (), (), lambda g, d: (_dict(d), V.length(d))[1])], "dict:get": [(1, ("key",), (), _dict_get)], "dict:has": [(1, ("key",), (), _has)], "dict:keys": [(1, (), (), _dict_part("key"))], "dict:values": [(1, (), (), _dict_part("value"))],
    "dict:entries": [(1, (), (), _plain(V._entries))], "dict:from_entries": [(1, (), (), _plain(V.dict_from))], "dict:without": [(1, ("keys",), (), _plain(without))], "dict:merge": [(2, (), (), _merge)],
    "bytes:length": [(1, (), (), _plain(B["octet_length"]))], "bytes:concat": [(2, (), (), _plain(B["bytes_concat"]))], "bytes:and": [(2, (), (), _part(B["bytes_and"]))], "bytes:or": [(2, (), (), _part(B["bytes_or"]))], "bytes:xor": [(2, (), (), _part(B["bytes_xor"]))],
    "bytes:to_base64": [(1, (), (), _plain(B["to_base64"]))], "bytes:from_base64": [(1, (), (), _part(B["from_base64"]))], "bytes:to_hex": [(1, (), (), _plain(B["to_hex"]))], "bytes:from_hex": [(1, (), (), _part(B["from_hex"]))],
    "bytes:to_string": [(1, (), (), _part(B["to_utf8"]))], "bytes:from_string": [(1, (), (), _plain(B["from_utf8"]))],
    "dynamic:of": [(1, (), (), _dynamic)],
    "temporal:date": [(1, (), (), _date), (0, ("year", "month", "day"), (), lambda g, y, m, d: partial(V.make_date(y, m, d), g))],
    "temporal:time": [(1, (), (), _time), (0, ("hour", "minute"), ("second", "microsecond"), _clock)],
    "temporal:timestamp": [(1, (), (), _timestamp), (0, ("date", "time"), (), _plain(V.make_timestamp)), (0, ("epoch_microseconds",), (), _plain(B["timestamp_from_micros"]))],
    "temporal:years": [(1, (), (), _plain(B["year"]))], "temporal:months": [(1, (), (), _plain(B["month"]))], "temporal:days": [(1, (), (), _plain(B["day"]))],
    "temporal:hours": [(1, (), (), _plain(B["hour"]))], "temporal:minutes": [(1, (), (), _plain(B["minute"]))], "temporal:seconds": [(1, (), (), _plain(B["second"]))], "temporal:microseconds": [(1, (), (), _plain(B["microsecond"]))],
    "temporal:epoch_micros": [(1, (), (), _plain(B["epoch_micros"]))],
    "temporal:interval": [(0, (), ("days", "hours", "minutes", "seconds", "microseconds"), lambda g, *v: _interval(g, **dict(zip(("days", "hours", "minutes", "seconds", "microseconds"), v))))],
} | {f"temporal:total_{u}": [(1, (), (), _plain(B[f"total_{u}"]))] for u in V.UNITS}


def call(name: str, positional: list[Val], keywords: dict[str, Val], guards: Guards) -> Val:
    """Call a function by its shape: how many positional arguments and which keywords; then types decide."""
    variants = LIBRARY.get(name)
    if variants is None:
        raise TypeProblem(f"there is no callable `{name}`")
    for count, required, optionals, f in variants:
        if count == len(positional) and set(required) <= set(keywords) <= {*required, *optionals}:
            return f(guards, *positional, *[keywords[k] for k in required], *[keywords.get(k) for k in optionals])
    shape = ", ".join([*["_"] * len(positional), *[f"{k}:" for k in keywords]])
    raise TypeProblem(f"`{name}` has no variant with the shape ({shape})")

