"""Transactions over a program of the rule language.

Inputs accumulate weighted rows, debts included; a relation holds the rows whose
total is positive.  A step computes the requested relations anew over the
accumulated inputs and reports the rows that entered (weight 1) and left (-1).
Inputs with an offset column keep their log, and rows carry the offset that began
their stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..engine import engine_session
from ..plans.rule_check import check
from ..plans.rule_run import Relation, Runner
from ..sources import codec
from ..store import Scratch
from ..types import record, row_schema
from .session import WEIGHT, segments


class RuleSession:
    """A running program of rules."""

    def __init__(self, spark: SparkSession, source: str, outputs: list[str]):
        self.spark, self.checked = engine_session(spark), check(source)
        for name in outputs:
            if name not in self.checked.types:
                raise KeyError(f"no relation `{name}`")
        self.outputs, self.scratch = outputs, Scratch(self.spark)
        self.totals: dict[str, DataFrame | None] = dict.fromkeys(self.checked.inputs)
        self.seen: dict[str, DataFrame | None] = dict.fromkeys(outputs)
        self.next_offset: dict[tuple[str, int], int] = {}

    def rows(self, relation: str, changes: list[tuple[int, dict]], *, partition: int = 0, offset: int | None = None) -> DataFrame:
        """Weighted JSON rows as a batch; runtime columns are filled here and refused in the rows."""
        types = self.checked.types[relation]
        options = dict(self.checked.inputs[relation].options)
        part, off = options.get("partition_as"), options.get("offset_as")
        given = record({c: t for c, t in types.items() if c not in (part, off)})
        out = []
        for weight, row in changes:
            values = dict(zip([n for n, _ in given.fields], codec.decode_row(given, row)))
            if part:
                values[part] = partition
            if off:
                at = self.next_offset.get((relation, partition), 0) if offset is None else offset
                values[off], self.next_offset[relation, partition] = at, at + 1
            out.append((*[values[c] for c in types], weight))
        fields = {f.name: f for f in row_schema(record(types)).fields}
        return self.spark.createDataFrame(out, S.StructType([*[fields[c] for c in types], S.StructField(WEIGHT, S.LongType())]))

    def step(self, batches: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
        """One transaction; returns each output's changes, its columns and ``_w``."""
        runner = Runner(self.spark, self.checked)
        inputs: dict[str, Relation] = {}
        for name, df in (batches or {}).items():
            weight = F.col(WEIGHT).cast("long") if WEIGHT in df.columns else F.lit(1).cast("long")
            cols = list(self.checked.types[name])
            new = df.select(*[F.col(f.name).cast(f.dataType) for f in row_schema(record(self.checked.types[name])).fields], weight.alias("w")).select(*cols, "w")
            both = new if self.totals[name] is None else self.totals[name].unionByName(new)
            self.totals[name] = self.scratch.keep(both.groupBy(*cols).agg(F.sum("w").alias("w")).where("w <> 0"))
        for name, total in self.totals.items():
            if total is None:
                continue
            off = dict(self.checked.inputs[name].options).get("offset_as")
            cols = list(self.checked.types[name])
            if off:
                rest = [c for c in cols if c != off]
                live = segments(total.withColumnRenamed(off, "offset") if off != "offset" else total, rest).withColumnRenamed("offset", off)
                inputs[name] = Relation(live.select(*cols), True)
            else:
                inputs[name] = Relation(total.where("w > 0").select(*cols), True)
        found = runner.run(inputs)
        out = {}
        for name in self.outputs:
            now = found[name]
            now_df = self.scratch.keep(now.df if now.unique else now.df.distinct())
            before = self.seen[name]
            entered = now_df if before is None else _without(now_df, before)
            parts = [entered.withColumn(WEIGHT, F.lit(1))]
            if before is not None:
                parts.append(_without(before, now_df).withColumn(WEIGHT, F.lit(-1)))
            out[name] = reduce(lambda a, b: a.unionByName(b), parts)
            self.seen[name] = now_df
        return out

    def snapshot(self, name: str) -> DataFrame:
        """The relation's rows after the last transaction."""
        return self.seen[name]

    def collect(self, changes: dict[str, DataFrame]) -> dict[str, list]:
        """Changes as lists of [weight, row]; for small results."""
        out = {}
        for name, df in changes.items():
            types = self.checked.types[name]
            out[name] = [[r[WEIGHT], {c: codec.encode(t, r[c]) for c, t in types.items()}] for r in df.collect()]
        return out


def _without(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` that aren't in ``b``; absence equals absence."""
    cols = a.columns
    other = b.select(*[F.col(c).alias(f"__{c}") for c in cols])
    return a.join(other, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in cols]), "left_anti")
