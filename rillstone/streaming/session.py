"""Transactions over a program of the stream language.

A session keeps each input's accumulated rows, with debts: a retraction that
comes before its assertion is remembered.  A step adds a batch to every input,
brings all requested outputs up to date and returns what changed.  Accumulated
rows are tables in the shared folder, so lineage doesn't grow with steps.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..engine import engine_session
from ..operators import zset as Z
from ..plans.stream_check import check
from ..sources import codec
from ..store import Scratch
from ..types import Type, record, row_schema, spark_type
from .flow import Flow, batch_schema

WEIGHT = "_w"


def segments(log: DataFrame, row: list[str]) -> DataFrame:
    """Rows with the offset that began their current positive segment.

    ``log`` has columns ``row``, ``offset`` and w.  A row is in if its total is
    positive; its offset is the last at which the running total crossed from 0 or
    less to above.
    """
    each = log.groupBy(*row, "offset").agg(F.sum("w").alias("w"))
    w = Window.partitionBy(*row).orderBy("offset")
    run = each.withColumn("after", F.sum("w").over(w)).withColumn("before", F.col("after") - F.col("w"))
    start = F.max(F.when((F.col("before") <= 0) & (F.col("after") > 0), F.col("offset")))
    return run.groupBy(*row).agg(start.alias("offset"), F.sum("w").alias("w")).where(F.col("w") > 0).withColumn("w", F.lit(1).cast("long"))


class StreamSession:
    """A running program: ``step`` or ``begin``/``push``/``commit``, and the changes of the named outputs."""

    def __init__(self, spark: SparkSession, source: str, outputs: list[str], *, incremental: bool = True):
        self.spark = engine_session(spark)
        self.source, self.graph = source, check(source)
        for name in outputs:
            if name not in self.graph.names:
                raise KeyError(f"no stream `{name}`")
        self.outputs, self.incremental = outputs, incremental
        self.scratch = Scratch(self.spark)
        #: By table, the last micro-batch of a stream that went in.
        self.fed: dict[str, int] = {}
        self.time = -1
        self.inputs = {i: n for i, n in enumerate(self.graph.nodes) if n.op == "input"}
        self.integrals = {i: n for i, n in enumerate(self.graph.nodes) if n.op == "integrate"}
        self.depth = 1 + sum(n.op in ("delay", "differentiate") for n in self.graph.nodes)
        self.totals: dict[int, list[DataFrame | None]] = {i: [] for i in (*self.inputs, *self.integrals)}
        self.batches: dict[int, list[DataFrame | None]] = {i: [] for i in self.inputs}
        self.logs: dict[int, DataFrame | None] = dict.fromkeys(self.inputs)
        self.next_offset: dict[tuple[str, int], int] = {}
        self.pending: dict[str, list[DataFrame]] | None = None

    # -- input

    def table_type(self, table: str) -> Type:
        return self.graph.tables[table]

    def _columns(self, table: str) -> tuple[Type, str | None, str | None]:
        info = next(n.info for n in self.inputs.values() if n.info[0] == table)
        return self.graph.tables[table], info[1], info[2]

    def rows(self, table: str, changes: list[tuple[int, dict]], *, partition: int = 0, offset: int | None = None) -> DataFrame:
        """Weighted JSON rows as a batch; runtime columns are filled here, and refused in the rows."""
        t, part, off = self._columns(table)
        given = record({n: x for n, x in t.fields if n not in (part, off)})
        out = []
        for weight, row in changes:
            values = dict(zip([n for n, _ in given.fields], codec.decode_row(given, row) if given.fields else ()))
            if part:
                values[part] = partition
            if off:
                at = self.next_offset.get((table, partition), 0) if offset is None else offset
                if offset is not None and at < self.next_offset.get((table, partition), 0) - 1:
                    raise codec.BadRow("offsets only increase within a partition")
                values[off] = at
                self.next_offset[table, partition] = at + 1
            out.append((*[values[n] for n, _ in t.fields], weight))
        return self.spark.createDataFrame(out, S.StructType([*row_schema(t).fields, S.StructField(WEIGHT, S.LongType())]))

    def _batch(self, table: str, df: DataFrame) -> DataFrame:
        """Columns v and w of a DataFrame with the table's columns, and weights in ``_w`` (1 if it has none)."""
        t = self.graph.tables[table]
        weight = F.col(WEIGHT).cast("long") if WEIGHT in df.columns else F.lit(1).cast("long")
        return df.select(F.struct(*[F.col(n).cast(spark_type(x)).alias(n) for n, x in t.fields]).alias("v"), weight.alias("w"))

    # -- transactions

    def begin(self) -> None:
        if self.pending is not None:
            raise RuntimeError("a transaction is already open")
        self.pending = {}

    def push(self, table: str, df: DataFrame) -> None:
        """Add rows to the open transaction; nothing is computed before ``commit``."""
        if self.pending is None:
            raise RuntimeError("no transaction is open")
        self.pending.setdefault(table, []).append(df)

    def commit(self) -> dict[str, DataFrame]:
        if self.pending is None:
            raise RuntimeError("no transaction is open")
        batches = {t: Z.added(*[self._batch(t, d) for d in dfs]) for t, dfs in self.pending.items()}
        self.pending = None
        return self._advance(batches)

    def step(self, tables: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
        """One transaction; returns the change of each output (k, v, w)."""
        if self.pending is not None:
            raise RuntimeError("a transaction is open")
        return self._advance({t: self._batch(t, d) for t, d in (tables or {}).items()})

    def state(self) -> tuple:
        """What a transaction changes, for ``reset``."""
        return self.time, {i: list(x) for i, x in self.totals.items()}, {i: list(x) for i, x in self.batches.items()}, dict(self.logs)

    def reset(self, state: tuple) -> None:
        """Take back the transactions since ``state``, and one that is open."""
        self.time, self.totals, self.batches, self.logs = state
        self.pending = None

    def _advance(self, batches: dict[str, DataFrame]) -> dict[str, DataFrame]:
        before = self.state()
        try:
            return self._advanced(batches)
        except Exception:
            self.reset(before)
            raise

    def _advanced(self, batches: dict[str, DataFrame]) -> dict[str, DataFrame]:
        self.time += 1
        for i, node in self.inputs.items():
            table, part, off = node.info
            batch = batches.get(table)
            before = self.totals[i][0] if self.totals[i] else None
            if batch is None:
                total, change = before, None
            elif off:
                rows = [n for n, _ in node.shape.value.fields if n != off]
                flat = batch.select(*[F.col("v")[n].alias(n) for n in rows], F.col("v")[off].alias("offset"), "w")
                log = flat if self.logs[i] is None else self.logs[i].unionByName(flat)
                self.logs[i] = self.scratch.keep(log.groupBy(*rows, "offset").agg(F.sum("w").alias("w")).where("w <> 0"))
                value = F.struct(*[(F.col("offset") if n == off else F.col(n)).alias(n) for n, _ in node.shape.value.fields])
                total = self.scratch.keep(segments(self.logs[i], rows).select(value.alias("v"), "w"))
                change = self.scratch.keep(total if before is None else Z.consolidate(Z.added(total, Z.negated(before))))
            else:
                change = self.scratch.keep(Z.consolidate(batch))
                total = change if before is None else self.scratch.keep(Z.consolidate(Z.added(before, change)))
            self._shift(self.totals[i], total)
            self._shift(self.batches[i], change)
        flow = self.flow()
        for i, node in self.integrals.items():
            add, before = flow.total(node.inputs[0]), self.totals[i][0] if self.totals[i] else None
            parts = [d for d in (before, add) if d is not None]
            self._shift(self.totals[i], self.scratch.keep(Z.consolidate(Z.added(*parts))) if parts else None)
        out = {}
        for name in self.outputs:
            n = self.graph.names[name]
            change = flow.change(n)
            out[name] = self.spark.createDataFrame([], batch_schema(self.graph.nodes[n].shape)) if change is None else Z.consolidate(change)
        return out

    def _shift(self, kept: list, new) -> None:
        kept.insert(0, new)
        del kept[self.depth + 1 :]

    def _leaf(self, n: int, lag: int, kind: str):
        kept = (self.totals if kind == "total" else self.batches)[n]
        return kept[lag] if lag < len(kept) else None

    def flow(self) -> Flow:
        return Flow(self.graph, self.spark, self._leaf, self.scratch, start=self.time, incremental=self.incremental)

    def snapshot(self, name: str) -> DataFrame:
        """The accumulated rows of a stream, after the last transaction."""
        n = self.graph.names[name]
        total = self.flow().total(n)
        return self.spark.createDataFrame([], batch_schema(self.graph.nodes[n].shape)) if total is None else Z.consolidate(total)

    # -- results as JSON, checkpoints

    def collect(self, changes: dict[str, DataFrame]) -> dict[str, list]:
        """Changes as lists of [weight, row] or [weight, key, value]; for small results, as in tests and egress."""
        out = {}
        for name, df in changes.items():
            shape = self.graph.nodes[self.graph.names[name]].shape
            rows = df.collect()
            out[name] = [[r["w"], *([codec.encode(shape.key, r["k"])] if shape.key is not None else []), codec.encode(shape.value, r["v"])] for r in rows]
        return out

    def digest(self) -> str:
        return hashlib.sha256(self.source.encode()).hexdigest()

    def checkpoint(self, path: str) -> None:
        """Write the state and a manifest that names the program, the time and the offsets."""
        tables: dict[str, str] = {}
        for kind, store in (("total", self.totals), ("batch", self.batches)):
            for i, kept in store.items():
                for lag, df in enumerate(kept):
                    if df is not None:
                        tables[f"{kind}-{i}-{lag}"] = "x"
                        df.write.mode("overwrite").parquet(f"{path}/{kind}-{i}-{lag}")
        for i, df in self.logs.items():
            if df is not None:
                tables[f"log-{i}-0"] = "x"
                df.write.mode("overwrite").parquet(f"{path}/log-{i}-0")
        manifest = {"program": self.digest(), "time": self.time, "tables": sorted(tables), "offsets": [[t, p, n] for (t, p), n in self.next_offset.items()], "kept": {str(i): len(k) for i, k in self.totals.items()}, "fed": self.fed}
        self.spark.createDataFrame([(json.dumps(manifest),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")

    @classmethod
    def restore(cls, spark: SparkSession, source: str, outputs: list[str], path: str, **settings) -> StreamSession:
        """A session that continues from a checkpoint of the same program; another program is refused."""
        own = cls(spark, source, outputs, **settings)
        manifest = json.loads("".join(r[0] for r in own.spark.read.text(f"{path}/manifest").collect()))
        if manifest["program"] != own.digest():
            raise ValueError("the checkpoint is of another program")
        own.time, own.fed = manifest["time"], manifest.get("fed", {})
        own.next_offset = {(t, p): n for t, p, n in manifest["offsets"]}
        have = set(manifest["tables"])
        load = lambda name: own.spark.read.parquet(f"{path}/{name}") if name in have else None
        for i, n in manifest["kept"].items():
            own.totals[int(i)] = [load(f"total-{i}-{lag}") for lag in range(n)]
            if int(i) in own.batches:
                own.batches[int(i)] = [load(f"batch-{i}-{lag}") for lag in range(n)]
        for i in own.logs:
            own.logs[i] = load(f"log-{i}-0")
        return own


def evaluate(spark: SparkSession, source: str, tables: dict[str, DataFrame], outputs: list[str]) -> dict[str, DataFrame]:
    """The outputs of one transaction in which ``tables`` arrive, lazily: no state is kept."""
    s = StreamSession(spark, source, outputs)
    s.time = 0
    for i, node in s.inputs.items():
        df = tables.get(node.info[0])
        batch = None if df is None else s._batch(node.info[0], df)
        s.totals[i], s.batches[i] = [batch], [batch]
    flow = s.flow()
    for i, node in s.integrals.items():
        s.totals[i] = [flow.total(node.inputs[0])]
    out = {}
    for name in outputs:
        n = s.graph.names[name]
        got = flow.change(n)
        out[name] = s.spark.createDataFrame([], batch_schema(s.graph.nodes[n].shape)) if got is None else got
    return out


