"""Operators on weighted sets: DataFrames with a value ``v``, a weight ``w`` and, if keyed, a key ``k``.

A batch may hold a row several times; its weight is the sum.  Linear operators
work on rows as they are.  Those that look at weights consolidate first, with a
map-side combined aggregation.  Keys compare by ``<=>``, as absence equals absence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import I64, Type, is_optional, strip

W = "w"


def cells(df: DataFrame) -> list[str]:
    return [c for c in ("k", "v") if c in df.columns]


def consolidate(df: DataFrame) -> DataFrame:
    """One row for each value, without those whose weights cancel."""
    return df.groupBy(*cells(df)).agg(F.sum(W).alias(W)).where(F.col(W) != 0)


def mapped(df: DataFrame, value: Column, key: Column | None = None) -> DataFrame:
    return df.select(*([key.alias("k")] if key is not None else []), value.alias("v"), W)


def exploded(df: DataFrame, values: Column, keyed: bool = False) -> DataFrame:
    """A row for each element; of a keyed stream, elements are records of key and value."""
    rows = df.select(F.explode(values).alias("e"), W)
    return rows.select(F.col("e.key").alias("k"), F.col("e.value").alias("v"), W) if keyed else rows.select(F.col("e").alias("v"), W)


def paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns k, a, b, w: the equi-join of two keyed sets; weights multiply."""
    l, r = left.select(F.col("k").alias("k"), F.col("v").alias("a"), F.col(W).alias("wa")), right.select(F.col("k").alias("kb"), F.col("v").alias("b"), F.col(W).alias("wb"))
    return l.join(r, F.col("k").eqNullSafe(F.col("kb"))).select("k", "a", "b", (F.col("wa") * F.col("wb")).alias(W))


def keys_held(df: DataFrame) -> DataFrame:
    """The keys with a row of positive weight."""
    return consolidate(df).where(F.col(W) > 0).select(F.col("k").alias("kb")).distinct()


def antijoin(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(keys_held(right), F.col("k").eqNullSafe(F.col("kb")), "left_anti")


def with_keys(df: DataFrame, keys: DataFrame, column: str = "k") -> DataFrame:
    """The rows whose key is among ``keys`` (one column ``key``, distinct)."""
    return df.join(keys, F.col(column).eqNullSafe(F.col("key")), "left_semi")


def distinct(df: DataFrame) -> DataFrame:
    return consolidate(df).where(F.col(W) > 0).withColumn(W, F.lit(1).cast("long"))


def negated(df: DataFrame) -> DataFrame:
    return df.withColumn(W, -F.col(W))


def added(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def weighted_count(df: DataFrame) -> DataFrame:
    return consolidate(df).select(F.col("v").alias("k"), F.col(W).alias("v"), F.lit(1).cast("long").alias(W))


def aggregated(df: DataFrame, how: str, value: Column, t: Type, by: Column | None = None) -> DataFrame:
    """Fold each key's values: ``value`` (of type ``t``, a column over ``v``) with weights; absent ones are skipped.

    A key reports if it has any row.  ``argmin`` and ``argmax`` give the value of
    the extreme ``by``, the smallest value among equals.
    """
    rows = consolidate(df).select("k", W, value.alias("x"), *([by.alias("y")] if by is not None else []))
    x, there = F.col("x"), F.col("x").isNotNull()
    count = F.sum(F.when(there, F.col(W)).otherwise(F.lit(0)))
    if how == "argmax":
        top = rows.groupBy("k").agg(F.max("y").alias("m"))
        top = top.withColumnRenamed("k", "kb")
        near = rows.join(top, F.col("k").eqNullSafe(F.col("kb")), "left")
        out = near.groupBy("k").agg(F.min(F.when(F.col("y") == F.col("m"), F.struct("x"))).getField("x").alias("v"))
    else:
        one = {
            "count": lambda: count,
            "sum": lambda: F.sum(x * F.col(W)),
            "avg": lambda: F.call_function("div", F.sum(x * F.col(W)), count) if strip(t) == I64 else F.sum(x * F.col(W)) / count,
            "min": lambda: F.min("x"),
            "max": lambda: F.max("x"),
            "argmin": lambda: F.min(F.when(F.col("y").isNotNull(), F.struct("y", "x"))).getField("x"),
        }[how]()
        out = rows.groupBy("k").agg(one.alias("v"))
    if how in ("sum", "avg") and not is_optional(t):
        out = out.where(F.col("v").isNotNull())  # weights that cancel leave no value to report
    return out.select("k", "v", F.lit(1).cast("long").alias(W))



