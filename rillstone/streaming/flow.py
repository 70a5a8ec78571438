"""Evaluation of stream graphs on DataFrames, as totals and as changes.

A stream is a sequence of changes, one a transaction.  ``total(n, lag)`` is the
sum of node n's changes up to ``lag`` transactions ago, ``change(n, lag)`` the
change of that transaction.  Linear operators map changes to changes.  A join's
change is (change of l) x (total of r) + (earlier total of l) x (change of r).
Aggregates, distinct and antijoin recompute the keys that occur in the change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..operators import zset as Z
from ..plans.stream_check import Graph, Node
from ..plans.stream_syntax import Shape
from ..store import Scratch
from ..types import spark_type

LINEAR = {"map", "filter", "flat_map", "map_index", "flat_map_index", "neg", "plus", "minus", "sum"}
MONOTONE = LINEAR - {"neg", "minus"} | {"join", "join_index", "distinct", "variable", "constant", "input", "empty"}


def batch_schema(shape: Shape) -> S.StructType:
    fields = [S.StructField("k", spark_type(shape.key))] if shape.key is not None else []
    return S.StructType([*fields, S.StructField("v", spark_type(shape.value)), S.StructField("w", S.LongType())])


class Flow:
    """Results of one moment; ``leaf(node, lag, kind)`` gives inputs and variables, or None if empty."""

    def __init__(self, graph: Graph, spark: SparkSession, leaf, scratch: Scratch, *, fixed: dict[int, DataFrame] | None = None, start: int = 0, incremental: bool = True):
        self.graph, self.spark, self.leaf, self.scratch = graph, spark, leaf, scratch
        self.fixed, self.start, self.incremental = fixed, start, incremental
        self.memo: dict[tuple, DataFrame | None] = {}

    def node(self, n: int) -> Node:
        return self.graph.nodes[n]

    def empty(self, n: int) -> DataFrame:
        return self.spark.createDataFrame([], batch_schema(self.node(n).shape))

    def total(self, n: int, lag: int = 0) -> DataFrame | None:
        """None stands for an empty batch."""
        return self._get("total", n, lag)

    def change(self, n: int, lag: int = 0) -> DataFrame | None:
        return self._get("change", n, lag)

    def _get(self, kind: str, n: int, lag: int):
        if self.fixed is not None and n in self.fixed:  # outer streams don't change within a fixpoint
            return self.fixed[n] if kind == "total" else None
        if lag > self.start and self.fixed is None:
            return None
        key = (kind, n, lag)
        if key not in self.memo:
            self.memo[key] = getattr(self, f"_{kind}")(n, self.node(n), lag)
        return self.memo[key]

    def _total(self, n: int, node: Node, lag: int):
        op = node.op
        if op in ("input", "variable", "integral"):
            return self.leaf(n, lag, "total")
        if op == "constant":
            return self._constant(node)
        if op == "empty":
            return None
        if op == "delay":
            return self.total(node.inputs[0], lag + 1)
        if op == "differentiate":
            return self.change(node.inputs[0], lag)
        if op == "integrate":
            return self.leaf(n, lag, "total")
        if op == "fixpoint":
            return self._loop(n, node, lag)
        return self.apply(node, [self.total(i, lag) for i in node.inputs])

    def _change(self, n: int, node: Node, lag: int):
        op, ins = node.op, node.inputs
        if op in ("input", "variable"):
            return self.leaf(n, lag, "change")
        if op == "constant":
            return self._constant(node) if lag == self.start else None
        if op == "empty":
            return None
        if op == "delay":
            return self.change(ins[0], lag + 1)
        if op == "differentiate":
            return self.less(self.change(ins[0], lag), self.change(ins[0], lag + 1))
        if op == "integrate":
            return self.total(ins[0], lag)
        if op in LINEAR:
            return self.apply(node, [self.change(i, lag) for i in ins])
        if lag == self.start and self.fixed is None:
            return self.total(n, lag)
        if op in ("join", "join_index") and self.incremental:
            parts = [self.apply(node, [self.change(ins[0], lag), self.total(ins[1], lag)]), self.apply(node, [self.total(ins[0], lag + 1), self.change(ins[1], lag)])]
            parts = [p for p in parts if p is not None]
            return Z.added(*parts) if parts else None
        if op in ("distinct", "aggregate", "antijoin", "weighted_count") and self.incremental:
            return self._affected(node, lag)
        return self.less(self.total(n, lag), self.total(n, lag + 1))

    def less(self, a: DataFrame | None, b: DataFrame | None) -> DataFrame | None:
        if b is None:
            return a
        return Z.negated(b) if a is None else Z.consolidate(Z.added(a, Z.negated(b)))

    def _affected(self, node: Node, lag: int):
        """Recompute only the keys (of distinct and counts: the rows) that the inputs' changes touch."""
        changes = [c for c in (self.change(i, lag) for i in node.inputs) if c is not None]
        if not changes:
            return None
        by = F.struct(*Z.cells(changes[0])) if node.op in ("distinct", "weighted_count") else F.col("k")
        keys = Z.added(*[c.select(by.alias("key")) for c in changes]).distinct()

        def near(d: DataFrame | None) -> DataFrame | None:
            if d is None:
                return None
            return Z.with_keys(d.withColumn("__key", by), keys, "__key").drop("__key")

        now, then = ([near(self.total(i, x)) for i in node.inputs] for x in (lag, lag + 1))
        return self.less(self.apply(node, now), self.apply(node, then))

    def apply(self, node: Node, ins: list[DataFrame | None]) -> DataFrame | None:
        """The operator on whole batches."""
        op, info = node.op, node.info
        if op in ("plus", "sum", "minus"):
            if op == "minus" and ins[1] is not None:
                ins = [ins[0], Z.negated(ins[1])]
            some = [x for x in ins if x is not None]
            return Z.added(*some) if some else None
        if ins[0] is None:
            return None
        s = ins[0]
        if op in ("join", "join_index"):
            if ins[1] is None:
                return None
            rows = Z.paired(s, ins[1])
            return Z.mapped(rows, info.col) if op == "join" else Z.mapped(rows, info.col.getField("value"), info.col.getField("key"))
        if op == "antijoin":
            return s if ins[1] is None else Z.antijoin(s, ins[1])
        if op == "map":
            return Z.mapped(s, info.col)
        if op == "map_index":
            return Z.mapped(s, info.col.getField("value"), info.col.getField("key"))
        if op == "filter":
            return s.where(info.col)
        if op in ("flat_map", "flat_map_index"):
            return Z.exploded(s, info.col, op == "flat_map_index")
        if op == "neg":
            return Z.negated(s)
        if op == "distinct":
            return Z.distinct(s)
        if op == "weighted_count":
            return Z.weighted_count(s)
        how, value, by = info
        return Z.aggregated(s, how, value.col, value.type, None if by is None else by.col)

    def _constant(self, node: Node) -> DataFrame:
        one = self.spark.range(1)
        rows = [one.select(v.col.cast(spark_type(node.shape.value)).alias("v"), F.lit(1).cast("long").alias("w")) for v in node.info]
        return Z.consolidate(Z.added(*rows)) if len(rows) > 1 else rows[0]

    # -- recursion

    def _loop(self, n: int, node: Node, lag: int):
        label, loop = node.info
        key = ("loop", tuple(v for _, v, _ in loop), lag)
        if key not in self.memo:
            self.memo[key] = self._iterate(node, loop, lag)
        return self.memo[key][label]

    def _body(self, roots: list[int], stop: set[int]) -> set[int]:
        seen: set[int] = set()
        todo = list(roots)
        while todo:
            x = todo.pop()
            if x not in seen and x not in stop:
                seen.add(x)
                todo += self.node(x).inputs
        return seen

    def _iterate(self, node: Node, loop, lag: int) -> dict[str, DataFrame]:
        """Rounds from empty until no recursive stream changes; monotone bodies see only the last round's new rows."""
        fixed = {i: self.total(i, lag) for i in node.inputs}
        fixed = {i: None if d is None else self.scratch.keep_round(d, 0)[0] for i, d in fixed.items()}
        variables = {v: label for label, v, _ in loop}
        body = self._body([b for *_, b in loop], set(fixed) | set(variables))
        monotone = all(self.node(x).op in MONOTONE for x in body)
        none = {label: self.empty(v) for label, v, _ in loop}
        old, now, new = dict(none), dict(none), dict(none)
        first, rounds = True, 0
        sizes: dict[str, int | None] = {label: 0 for label, *_ in loop}
        while True:
            state = {"total": (dict(now), dict(old)), "change": (dict(new), dict(none))}

            def leaf(n, k, kind, state=state):
                return state[kind][min(k, 1)][variables[n]]

            inner = Flow(self.graph, self.spark, leaf, self.scratch, fixed=fixed, start=-1, incremental=True)
            more: dict[str, DataFrame] = {}
            grown: dict[str, DataFrame] = {}
            for label, v, b in loop:
                got = inner.change(b) if monotone and not first else inner.total(b)
                got = self.empty(v) if got is None else Z.distinct(got)
                cells = Z.cells(got)
                was = now[label]
                if monotone:
                    more[label], sizes[label] = self.scratch.keep_round(got.join(was.select(*[F.col(c).alias(f"was_{c}") for c in cells]), [F.col(c).eqNullSafe(F.col(f"was_{c}")) for c in cells], "left_anti").select(*cells, "w"), sizes[label])
                    grown[label] = was.unionByName(more[label])
                else:
                    grown[label] = self.scratch.keep(got)
                    more[label] = Z.consolidate(Z.added(grown[label], Z.negated(was)))
                    sizes[label] = 0 if more[label].isEmpty() else None
            first = False
            if not any(n is None or n for n in sizes.values()):
                return now
            rounds += 1
            if monotone and rounds % 8 == 0:
                grown = {k: self.scratch.keep_round(d, sizes[k])[0] for k, d in grown.items()}
            old, now, new = now, grown, more
