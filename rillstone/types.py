"""The value types of both languages, and the Spark types that hold them.

Absence is a value, not SQL's unknown: ``optional(T)`` is a nullable column, and
comparisons on it always decide.  Types without a Spark counterpart have an
encoding: time and interval are microseconds, a dict is an array of entries
sorted by key, a document is canonical JSON text, a dynamic is canonical JSON
text with type tags, and the record without fields is the constant true.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as S


class Diagnostic(Exception):
    """A rejected program: which pass refused it, why, and where (line and column from 1)."""

    def __init__(self, step: str, message: str, line: int = 0, column: int = 0):
        super().__init__(f"{step} error at {line}:{column}: {message}")
        self.step, self.message, self.line, self.column = step, message, line, column


class TypeProblem(Exception):
    """A type rule that doesn't hold; callers add the place."""


@dataclass(frozen=True)
class Type:
    """A type: its name, argument types, and (of a record) fields sorted by name."""

    name: str
    args: tuple[Type, ...] = ()
    fields: tuple[tuple[str, Type], ...] = ()

    def __str__(self) -> str:
        if self.name == "record":
            return f"record({', '.join(f'{n}: {t}' for n, t in self.fields)})"
        if self.name == "int?":
            return "an integer literal"
        if self.name == "float?":
            return "a float literal"
        return f"{self.name}({', '.join(map(str, self.args))})" if self.args else self.name

    @property
    def item(self) -> Type:
        return self.args[-1]

    def field(self, name: str) -> Type | None:
        return dict(self.fields).get(name)


BOOL, I64, F64, STRING, BYTES, DATE, TIME, TIMESTAMP, INTERVAL, JSON, DYNAMIC = (Type(n) for n in ("bool", "i64", "f64", "string", "bytes", "date", "time", "timestamp", "interval", "json", "dynamic"))
#: Types that context settles: absence, numeric literals, and the element of an empty container.
NONE, INT, FLOAT, OPEN = Type("none"), Type("int?"), Type("float?"), Type("open")
SCALARS = frozenset((BOOL, I64, F64, STRING, BYTES, DATE, TIME, TIMESTAMP, INTERVAL))
NAMED = {t.name: t for t in (*SCALARS, JSON, DYNAMIC)} | {"boolean": BOOL}


def optional(t: Type) -> Type:
    return t if t.name in ("optional", "none") else Type("optional", (t,))


def array(t: Type) -> Type:
    return Type("array", (t,))


def dict_of(k: Type, v: Type) -> Type:
    return Type("dict", (k, v))


def record(fields) -> Type:
    return Type("record", (), tuple(sorted(dict(fields).items())))


UNIT = record({})


def strip(t: Type) -> Type:
    """The type of a present value."""
    return t.args[0] if t.name == "optional" else t


def is_optional(t: Type) -> bool:
    return t.name in ("optional", "none")


def is_open(t: Type) -> bool:
    return t.name in ("none", "int?", "float?", "open") or any(map(is_open, t.args)) or any(is_open(x) for _, x in t.fields)


def unify(a: Type, b: Type) -> Type:
    """The one type that two values meet under; nothing is converted implicitly."""
    if a == b:
        return a
    if OPEN in (a, b):
        return b if a == OPEN else a
    if NONE in (a, b):
        return optional(b if a == NONE else a)
    if "optional" in (a.name, b.name):
        return optional(unify(strip(a), strip(b)))
    for x, y in ((a, b), (b, a)):
        if x == INT and y in (I64, F64, FLOAT) or x == FLOAT and y == F64:
            return y
    if a.name == b.name and a.name in ("array", "dict"):
        return Type(a.name, tuple(unify(x, y) for x, y in zip(a.args, b.args)))
    if a.name == b.name == "record" and [n for n, _ in a.fields] == [n for n, _ in b.fields]:
        return record({n: unify(t, b.field(n)) for n, t in a.fields})
    raise TypeProblem(f"`{a}` and `{b}` do not meet: there is no implicit conversion")


def settle(t: Type) -> Type:
    """A type with literals at their own types; anything else that is open is refused."""
    if t == INT:
        return I64
    if t == FLOAT:
        return F64
    if t in (NONE, OPEN):
        raise TypeProblem("nothing here says what type this value has; annotate it or put a typed value beside it")
    if t.name == "record":
        return record({n: settle(x) for n, x in t.fields})
    return Type(t.name, tuple(map(settle, t.args))) if t.args else t


def check_type(t: Type) -> Type:
    """Refuse optional of optional and dict keys that are no scalars."""
    if t.name == "optional" and t.args[0].name == "optional":
        raise TypeProblem("optional(optional(T)) is not a type: absence does not nest")
    if t.name == "dict" and t.args[0] not in SCALARS:
        raise TypeProblem(f"a dict key must be a scalar, not `{t.args[0]}`")
    for x in (*t.args, *(x for _, x in t.fields)):
        check_type(x)
    return t


_SPARK = {
    "bool": S.BooleanType(), "i64": S.LongType(), "f64": S.DoubleType(), "string": S.StringType(), "bytes": S.BinaryType(), "date": S.DateType(),
    "time": S.LongType(), "timestamp": S.TimestampNTZType(), "interval": S.LongType(), "json": S.StringType(), "dynamic": S.StringType(), "none": S.NullType(),
}


def spark_type(t: Type) -> S.DataType:
    """The Spark type of a column that holds values of ``t``."""
    if t.name == "optional":
        return spark_type(t.args[0])
    if t.name == "record":
        return S.StructType([S.StructField(n, spark_type(x)) for n, x in t.fields]) if t.fields else S.BooleanType()
    if t.name == "array":
        return S.ArrayType(spark_type(t.args[0]))
    if t.name == "dict":
        return S.ArrayType(S.StructType([S.StructField("key", spark_type(t.args[0])), S.StructField("value", spark_type(t.args[1]))]))
    return _SPARK[settle(t).name]


def row_schema(t: Type) -> S.StructType:
    """The schema of a relation whose rows are records of type ``t``."""
    return S.StructType([S.StructField(n, spark_type(x)) for n, x in t.fields])
