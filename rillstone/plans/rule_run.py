"""Rules as DataFrames.

A rule is a chain of joins on all shared variables with its filters, matches,
unnests and anti-joins in between; Catalyst pushes filters and columns down to
the scans and picks the joins.  Atoms that bind nothing are semi-joins.  Before
an aggregate, assignments are made distinct, unless they are known to be: every
atom names all columns of a relation without repeated rows.  Recursive relations
are computed semi-naively, each round from the last round's new rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import engine_session
from ..functions import values as V
from ..store import Scratch
from ..types import BOOL, BYTES, DATE, F64, I64, STRING, TIMESTAMP, Type, is_optional, row_schema, record, settle, spark_type, strip
from .rule_check import Checked, Exprs, Plan, Step, assign, bindings, binds, check, narrow, reads
from .rule_syntax import Agg, Assertion, Atom, Filter, Match, Unnest

UNIT = "__unit"


@dataclass(frozen=True)
class Relation:
    """Rows of a relation; ``unique`` if none is repeated, ``key`` columns that tell rows apart."""

    df: DataFrame
    unique: bool = False
    key: frozenset[str] | None = None


def both(a: Column, b: Column, null_safe: bool) -> Column:
    return a.eqNullSafe(b) if null_safe else a == b


class Runner(Exprs):
    """Builds DataFrames for the checked rules over given relations."""

    def __init__(self, spark: SparkSession, checked: Checked):
        self.spark, self.checked = spark, checked
        self.scratch = Scratch(spark)
        self.relations: dict[str, Relation] = {}

    # -- one rule

    def rule(self, p: Plan, lookup) -> Relation:
        """The rows that a rule derives; ``lookup(atom, k)`` gives the relation of the k-th step."""
        df: DataFrame | None = None
        env: dict[str, V.Val] = {}
        unique = True
        for k, s in enumerate(p.steps):
            df, kept = self.step(df, env, s, k, lookup)
            unique = unique and kept
        df = self.ground(df)
        if p.aggregates:
            df, env = self.fold(df, env, p, unique)
            for k, s in enumerate(p.after):
                df, _ = self.step(df, env, s, len(p.steps) + k, lookup)
        types = self.checked.types[p.rule.relation]
        guards: list = []
        out = [(col, assign(self.infer(e, env, guards), types[col])) for col, e in p.rule.args]
        df = self.guarded(df, guards)
        plain = self.determined({e.value for _, e in p.rule.args if e.kind == "name"}, p, lookup)
        whole = plain >= set(p.group) if p.aggregates else unique and plain >= {v for v in p.bound if env[v].literal is None}
        if not out:
            return Relation(df.select(F.lit(True).alias(UNIT)).limit(1), True)
        return Relation(df.select(*[v.col.cast(spark_type(types[c])).alias(c) for c, v in out]), whole)

    def determined(self, names: set[str], p: Plan, lookup) -> set[str]:
        """The variables whose values follow from those of ``names``: by keys of atoms and by matches."""
        follows: list[tuple[set[str], set[str]]] = []
        for k, s in enumerate(p.steps):
            st = s.statement
            if isinstance(st, Atom) and not st.negated:
                key = lookup(st, k).key
                args = {c: e for c, e in st.args if e is not None}
                if key is not None and key <= set(args):
                    follows.append((set().union(*[reads(args[c]) for c in key]), {e.value for e in args.values() if e.kind == "name"}))
            elif isinstance(st, Match):
                given = {st.target.names[0]} if isinstance(st.target, Unnest) and len(st.target.names) == 2 else set()
                if given or not isinstance(st.target, Unnest):
                    follows.append((reads(st.value) | given, set(binds(st.target))))
        out = set(names)
        while more := [to for given, to in follows if given <= out and not to <= out]:
            out = out.union(*more)
        return out

    def ground(self, df: DataFrame | None) -> DataFrame:
        return self.spark.range(1).select(F.lit(True).alias(UNIT)) if df is None else df

    def guarded(self, df: DataFrame, guards: list) -> DataFrame:
        for g in guards:
            df = df.where(g())
        guards.clear()
        return df

    def step(self, df, env: dict[str, V.Val], s: Step, k: int, lookup):
        st = s.statement
        if isinstance(st, Atom):
            return self.atom(df, env, st, s.new, lookup(st, k))
        df = self.ground(df)
        guards: list = []
        if isinstance(st, Filter):
            v = self.infer(st.test, env, guards)
            return self.guarded(df, guards).where(v.col), True
        if isinstance(st, Assertion):
            got = narrow(env[st.name], st.type, guards)
            df = self.guarded(df, guards)
            if got is not env[st.name] and got.literal is None:
                df = df.withColumn(st.name, got.col)
                got = V.Val(got.type, lambda: F.col(st.name))
            env[st.name] = got
            return df, True
        return self.match(df, env, st, s.new)

    def match(self, df: DataFrame, env: dict[str, V.Val], st: Match, new: set[str]):
        guards: list = []
        v = self.infer(st.value, env, guards)
        pairs = list(bindings(st.target, v, guards))
        df = self.guarded(df, guards)
        unique = True
        if isinstance(st.target, Unnest):
            indexed = len(st.target.names) == 2
            unique = indexed or st.target.marker == "**"
            v = V.fit(v, settle(v.type))
            df = df.select("*", F.posexplode(v.col).alias("__i", "__e") if indexed and st.target.marker == "*" else F.explode(v.col).alias("__e"))
        fresh: dict[str, V.Val] = {}
        for name, got in pairs:
            if name in new and name not in env and name not in fresh:
                fresh[name] = got
            else:
                df = df.where(V.equal((env | fresh)[name], got).col)
        cols = {n: g for n, g in fresh.items() if g.literal is None}
        df = df.select("*", *[g.col.alias(n) for n, g in cols.items()]).drop("__i", "__e")
        for n, g in fresh.items():
            env[n] = V.Val(g.type, lambda n=n: F.col(f"`{n}`")) if n in cols else g
        return df, unique

    def atom(self, df, env: dict[str, V.Val], st: Atom, new: set[str], rel: Relation):
        types = self.checked.types[st.relation]
        named = [(c, e) for c, e in st.args if e is not None]
        r = rel.df.select(*[F.col(c).alias(f"__{k}") for k, (c, _) in enumerate(named)]) if named else rel.df.select(F.lit(True).alias("__0"))
        bound: dict[str, str] = {}
        joins: list[tuple[V.Val, str, Type]] = []
        guards: list = []
        for k, (c, e) in enumerate(named):
            t, at = types[c], f"__{k}"
            here = V.Val(t, lambda at=at: F.col(at))
            if e.kind == "name" and e.value in new:
                if e.value in bound:
                    r = r.where(V.equal(here, V.Val(t, lambda x=bound[e.value]: F.col(x))).col)
                else:
                    bound[e.value] = at
                continue
            v = self.infer(e, env, guards)
            if not reads(e) or v.literal is not None:
                r = r.where(V.equal(here, v).col)
            else:
                joins.append((v, at, t))
        unique = rel.unique and (len(named) == len(types) or rel.key is not None and rel.key <= {c for c, _ in named})
        if df is None and not st.negated and not joins:
            df = r.select(*[F.col(at).alias(n) for n, at in bound.items()]) if bound else r.select(F.lit(True).alias(UNIT)).limit(1)
            unique = unique or not bound
        else:
            df = self.guarded(self.ground(df), guards)
            keys = [v for v, *_ in joins]
            df = df.select("*", *[v.col.alias(f"__key{k}") for k, v in enumerate(keys)])
            cond = [both(F.col(f"__key{k}"), F.col(at), is_optional(v.type) or is_optional(t)) for k, (v, at, t) in enumerate(joins)]
            on = reduce(lambda a, b: a & b, cond) if cond else F.lit(True)
            if not joins and not bound or st.negated and not joins:
                r = r.select(F.lit(True).alias("__0")).limit(1)
            if st.negated:
                df, unique = df.join(r, on, "left_anti"), True
            elif not bound:
                df, unique = df.join(r, on, "left_semi") if joins else df.crossJoin(r), True
            else:
                df = df.join(r, on, "inner") if joins else df.crossJoin(r)
            held = [c for c in df.columns if not c.startswith("__") or c == UNIT]
            df = df.select(*[F.col(f"`{c}`") for c in held], *[F.col(at).alias(n) for n, at in bound.items()]) if not st.negated else df.select(*[F.col(f"`{c}`") for c in held])
        for n, at in bound.items():
            c = named[int(at[2:])][0]
            env[n] = V.Val(types[c], lambda n=n: F.col(f"`{n}`"))
        return df, unique

    # -- aggregates

    def fold(self, df: DataFrame, env: dict[str, V.Val], p: Plan, unique: bool):
        held = [v for v in p.bound if env[v].literal is None]
        if not unique:
            df = df.select(*[F.col(f"`{v}`") for v in held] or [F.lit(True).alias(UNIT)]).distinct()
        guards: list = []
        args = []
        for name, a in p.aggregates:
            x = V.settled(self.infer(a.arg, env, guards)) if a.arg else None
            y = V.settled(self.infer(a.by, env, guards)) if a.by else None
            args.append((name, a, x, y))
        df = self.guarded(df, guards)
        group = [v for v in p.group if env[v].literal is None]
        # aggregates' inputs are the only other columns that the shuffle carries
        df = df.select(*[F.col(f"`{v}`") for v in group], *[x.col.alias(f"__x{k}") for k, (_, _, x, _) in enumerate(args) if x], *[y.col.alias(f"__y{k}") for k, (*_, y) in enumerate(args) if y])
        keys = [F.col(f"`{v}`") for v in group] or [F.lit(1).alias("__g")]
        late = [k for k, (_, a, _, y) in enumerate(args) if a.how == "argmax" and strip(y.type) in (STRING, BYTES)]
        if late:
            tops = df.groupBy(*keys).agg(*[F.max(f"__y{k}").alias(f"__m{k}") for k in late])
            names = group or ["__g"]
            tops = tops.select(*[F.col(f"`{c}`").alias(f"__t{i}") for i, c in enumerate(names)], *[f"__m{k}" for k in late])
            left = df if group else df.select("*", F.lit(1).alias("__g"))
            df = left.join(tops, reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"__t{i}")) for i, c in enumerate(names)]))
        out = df.groupBy(*keys).agg(*[self.one(a, k, x, y, k in late).alias(name) for k, (name, a, x, y) in enumerate(args)])
        after = {v: env[v] for v in p.group}
        for name, a, x, y in args:
            t = I64 if a.how == "count" else x.type
            after[name] = V.Val(Type("optional", (strip(t),)) if y is not None and is_optional(y.type) else t, lambda name=name: F.col(f"`{name}`"))
        return out, after

    def one(self, a: Agg, k: int, x, y, late: bool) -> Column:
        c, b = F.col(f"__x{k}"), F.col(f"__y{k}")
        if a.how == "count":
            return F.count(F.lit(1))
        if a.how == "avg":
            return F.call_function("div", F.sum(c), F.count(c)) if strip(x.type) == I64 else F.sum(c) / F.count(c)
        if a.how in ("sum", "min", "max"):
            return {"sum": F.sum, "min": F.min, "max": F.max}[a.how](c)
        if late:
            return F.min(F.when(b == F.col(f"__m{k}"), F.struct(c.alias("v")))).getField("v")
        key = b if a.how == "argmin" else reversed_order(strip(y.type), b)
        return F.min(F.when(b.isNotNull(), F.struct(key.alias("k"), c.alias("v")))).getField("v")

    # -- relations

    def rows(self, name: str, df: DataFrame) -> DataFrame:
        types = self.checked.types[name]
        return df.select(*[F.col(c).cast(spark_type(t)).alias(c) for c, t in types.items()])

    def empty(self, name: str) -> DataFrame:
        types = self.checked.types[name]
        return self.spark.createDataFrame([], row_schema(record(types)) if types else f"{UNIT} boolean").select(*(types or [UNIT]))

    def union(self, name: str, parts: list[Relation]) -> Relation:
        if not parts:
            return Relation(self.empty(name), True)
        df = reduce(lambda a, b: a.unionByName(b), [r.df for r in parts])
        return Relation(df, True) if len(parts) == 1 and parts[0].unique else Relation(df.distinct(), True)

    def run(self, inputs: dict[str, Relation]) -> dict[str, Relation]:
        """All relations, stratum by stratum; inputs that aren't given are empty."""
        for name in self.checked.inputs:
            got = inputs.get(name)
            self.relations[name] = Relation(self.empty(name), True) if got is None else Relation(self.rows(name, got.df), got.unique, got.key)
        for comp in self.checked.strata:
            if set(comp) & self.checked.recursive:
                self.iterate(comp)
            elif comp[0] not in self.checked.inputs:
                self.relations[comp[0]] = self.union(comp[0], [self.rule(p, lambda a, _: self.relations[a.relation]) for p in self.checked.plans.get(comp[0], [])])
        return self.relations

    def iterate(self, comp: list[str]) -> None:
        inside = set(comp)
        at = lambda p: [k for k, s in enumerate(p.steps) if isinstance(s.statement, Atom) and s.statement.relation in inside]
        plans = {r: [(p, at(p)) for p in self.checked.plans.get(r, [])] for r in comp}
        parts: dict[str, list[DataFrame]] = {}
        new: dict[str, DataFrame] = {}
        sizes: dict[str, int | None] = {}
        for r in comp:
            start = self.union(r, [self.rule(p, lambda a, _: self.relations[a.relation]) for p, ks in plans[r] if not ks])
            new[r], sizes[r] = self.scratch.keep_round(start.df, 0)
            parts[r] = [new[r]]
        while True:
            full = {r: reduce(lambda a, b: a.unionByName(b), ds) for r, ds in parts.items()}
            fresh: dict[str, DataFrame] = {}
            later: dict[str, int | None] = {}
            for r in comp:
                derived = []
                for p, ks in plans[r]:
                    # an occurrence without new rows derives nothing
                    for k in [k for k in ks if sizes[p.steps[k].statement.relation] != 0]:  # each occurrence in turn reads the new rows, the others all rows

                        def lookup(a, j, k=k):
                            if a.relation not in inside:
                                return self.relations[a.relation]
                            return Relation(new[a.relation] if j == k else full[a.relation], True)

                        derived.append(self.rule(p, lookup))
                if not derived:
                    fresh[r], later[r] = self.empty(r), 0
                    continue
                df = self.union(r, derived).df
                types = self.checked.types[r]
                was = full[r].select(*[F.col(c).alias(f"__{c}") for c in full[r].columns])
                on = reduce(lambda a, b: a & b, [both(F.col(c), F.col(f"__{c}"), is_optional(types.get(c, BOOL))) for c in full[r].columns])
                fresh[r], later[r] = self.scratch.keep_round(df.join(was, on, "left_anti"), sizes[r])
            sizes = later
            if not any(n is None or n for n in sizes.values()):
                break
            new = fresh
            for r in comp:
                parts[r].append(fresh[r])
                if len(parts[r]) > 16:  # many small tables are rewritten as one
                    parts[r] = [self.scratch.keep(reduce(lambda a, b: a.unionByName(b), parts[r]))]
        for r in comp:
            self.relations[r] = Relation(reduce(lambda a, b: a.unionByName(b), parts[r]), True)


def reversed_order(t: Type, c: Column) -> Column:
    """A column whose ascending order is the descending one of ``c``."""
    if t == F64:
        return F.struct((~F.isnan(c)).alias("n"), (-c).alias("x"))
    if t == BOOL:
        return ~c
    whole = F.unix_date(c).cast("long") if t == DATE else V.micros_of(c) if t == TIMESTAMP else c
    return F.bitwise_not(whole)


def evaluate(spark: SparkSession, source: str, tables: dict[str, DataFrame], *, keys: dict[str, tuple[str, ...]] | None = None) -> dict[str, DataFrame]:
    """All relations of a program over input ``tables`` (by relation name), lazily.

    ``keys`` names columns of inputs that tell their rows apart.  Other inputs are
    taken as sets all the same, at the cost of a distinct where repeated rows could
    be seen.
    """
    runner = Runner(engine_session(spark), check(source))
    own = runner.spark
    keys = keys or {}
    given = {n: Relation(_adopt(own, df), n in keys, frozenset(keys[n]) if n in keys else None) for n, df in tables.items()}
    out = runner.run(given)
    return {n: r.df if r.unique else r.df.distinct() for n, r in out.items()}


def _adopt(own: SparkSession, df: DataFrame) -> DataFrame:
    """The same plan in another session of the application."""
    return df if df.sparkSession is own else DataFrame(own._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, df._jdf.logicalPlan()), own)
