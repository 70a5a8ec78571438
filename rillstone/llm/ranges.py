"""Dealing documents into ranges of their ids with DataFrame functions only."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most bounds that the driver gets and that stand in a plan, whatever the number of rows.
MAX_BOUNDS = 4096


def _longs(values: list[int]) -> Column:
    """The values as one array literal (the parser's constant is folded)."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


@dataclass
class Ranges:
    """Ranges of ids by their upper ends, which are ids that occur; ``parts`` of each range are told apart by interpolation."""

    bounds: list[int]
    low: int = 0
    parts: list[int] | None = None

    @property
    def n(self) -> int:
        return max(1, sum(self.parts) if self.parts else len(self.bounds))

    def coarse(self, key: Column) -> Column:
        """Index of the range that holds ``key`` (the number of bounds below it), by binary search in the JVM; null for null."""
        if not self.bounds:
            return F.lit(None).cast("int")
        steps = [1 << k for k in reversed(range(max(1, math.ceil(math.log2(len(self.bounds) + 1)))))]
        table = _longs(self.bounds)
        found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda low, step: F.when(F.get(table, low + step - 1) < key, low + step).otherwise(low))
        return F.when(key.isNotNull(), F.least(found, F.lit(len(self.bounds) - 1)))

    def upper(self, coarse: Column) -> Column:
        """The upper end of a range."""
        return F.get(_longs(self.bounds), coarse)

    def fine(self, key: Column, coarse: Column) -> Column:
        """Index of the part that holds ``key``; ascending with it."""
        if not self.bounds or not self.parts:
            return coarse
        before, first = [0], [self.low]
        for n, top in zip(self.parts, self.bounds):
            before.append(before[-1] + n)
            first.append(top + 1)
        n, low, top = (F.get(_longs(x), coarse).cast("double") for x in (self.parts, first[:-1], self.bounds))
        inside = F.floor(n * (key.cast("double") - low) / (top - low + 1))
        return (F.get(_longs(before[:-1]), coarse) + F.greatest(F.lit(0), F.least(inside, n.cast("long") - 1))).cast("int")


def id_ranges(docs: DataFrame, id_col: str, parts: int) -> Ranges:
    """Up to ``parts`` (``MAX_BOUNDS`` at most) ranges with about as many rows each; none if no row has an id."""
    parts = max(1, min(parts, MAX_BOUNDS))
    key = F.col(id_col).cast("long")
    cut = F.percentile_approx(key, F.array(*[F.lit(k / parts) for k in range(1, parts)]), max(1000, 20 * parts)) if parts > 1 else F.array()
    cuts, low, top = docs.agg(cut, F.min(key), F.max(key)).first()
    return Ranges([], 0) if top is None else Ranges(sorted({*(cuts or []), top}), low)


def even_ranges(docs: DataFrame, id_col: str, size: Column, most: int) -> Ranges:
    """Ranges of ids, cut further so that a part has about ``most`` of ``size``; the driver gets a row for each range.

    Inside a range ids are taken as spread evenly; rows of one id stay together.
    """
    n, total = docs.agg(F.count(F.lit(1)), F.sum(size)).first()
    out = id_ranges(docs.select(id_col), id_col, min(n, -(-int(total or 0) // most)))
    if out.bounds:
        key = F.col(id_col).cast("long")
        sums = dict(docs.where(key.isNotNull()).groupBy(out.coarse(key).alias("r")).agg(F.sum(size).alias("s")).collect())
        ends = [out.low - 1, *out.bounds]
        out.parts = [max(1, min(ends[r + 1] - ends[r], -(-int(sums.get(r) or 0) // most))) for r in range(len(out.bounds))]
    return out


def input_size(docs: DataFrame, text_col: str) -> tuple[int, int]:
    """(rows, bytes of text)."""
    n, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(text_col).cast("long"))).first()
    return int(n), int(size or 0)
