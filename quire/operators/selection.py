"""The rows from place m to place n of an order, without bringing n rows into one task.

Counts of ever finer ranges of the key tell where the m-th and the n-th row lie.  Rows
between the two ranges are kept by a filter, as they stand; only rows of the two ranges
at the edges are put in order.  What a step gathers is one count per range.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDGE_ROWS = 10_000  # rows that one task may put in order
PREFIX = 2  # characters by which the ranges of a text become finer
TEXT_STEPS = 12


@dataclass(frozen=True)
class Key:
    """One column of the order; nulls are last if descending, else first, as Spark has it."""

    column: Column
    descending: bool = False
    text: bool = True

    def order(self) -> Column:
        return self.column.desc_nulls_last() if self.descending else self.column.asc_nulls_first()

    def ranges(self) -> list[Column]:
        """Values that cut the column into ever finer ranges."""
        if not self.text:
            return [self.column]
        return [F.substring(self.column, 1, PREFIX * k) for k in range(1, TEXT_STEPS + 1)] + [self.column]


@dataclass(frozen=True)
class _Edge:
    before: int  # rows before the range
    rows: int  # rows in it
    path: tuple  # the values that lead to it


def _sorted(counts: list, descending: bool) -> list:
    known = sorted((c for c in counts if c[0] is not None), key=lambda c: c[0], reverse=descending)
    nulls = [c for c in counts if c[0] is None]
    return known + nulls if descending else nulls + known


def _edge(df: DataFrame, steps: list[tuple[Column, bool]], place: int, total: int) -> _Edge:
    """The range that the row at ``place`` (from 1) lies in."""
    before, rows, path = 0, total, []
    for value, descending in steps:
        if rows <= EDGE_ROWS:
            break
        inside = reduce(Column.__and__, (s.eqNullSafe(F.lit(v)) for (s, _), v in zip(steps, path, strict=False)), F.lit(True))
        counts = df.filter(inside).groupBy(value.alias("v")).agg(F.count("*").alias("n")).collect()
        for v, n in _sorted([(r["v"], r["n"]) for r in counts], descending):
            if before + n >= place:
                path.append(v)
                rows = n
                break
            before += n
    return _Edge(before, rows, tuple(path))


def _after(steps: list[tuple[Column, bool]], path: tuple, strictly_after: bool) -> Column:
    """Whether a row stands behind (or else before) the range of ``path``."""
    found, same = F.lit(False), F.lit(True)
    for (value, descending), v in zip(steps, path, strict=False):
        if v is None:  # last if descending, else first
            beyond = F.lit(False) if strictly_after == descending else value.isNotNull()
        else:
            larger = value > F.lit(v) if strictly_after != descending else value < F.lit(v)
            null_beyond = strictly_after == descending
            beyond = F.coalesce(larger, F.lit(null_beyond))
        found = found | (same & beyond)
        same = same & value.eqNullSafe(F.lit(v))
    return found


def in_order(df: DataFrame, keys: list[Key], n: int, offset: int = 0) -> DataFrame:
    """Rows ``offset + 1`` to ``offset + n`` of ``df`` ordered by ``keys``; how they are arranged is left open.

    Up to EDGE_ROWS rows are taken by Spark's own top-k.  The keys should tell rows
    apart; of rows with equal keys any may be taken.
    """
    order = [k.order() for k in keys]
    if n <= 0:
        return df.limit(0)
    if offset + n <= EDGE_ROWS:
        ordered = df.orderBy(*order)
        return ordered.offset(offset).limit(n) if offset else ordered.limit(n)
    total = df.count()
    if offset >= total:
        return df.limit(0)
    if offset == 0 and n >= total:
        return df
    last = min(total, offset + n)
    steps = [(value, k.descending) for k in keys for value in k.ranges()]
    low, high = _edge(df, steps, offset + 1, total), _edge(df, steps, last, total)
    inside = [~_after(steps, e.path, True) & ~_after(steps, e.path, False) for e in (low, high)]
    if low.path == high.path:
        return df.filter(inside[0]).orderBy(*order).offset(offset - low.before).limit(last - offset)
    # One path may lead on from the other, so the middle is what is in neither.
    middle = df.filter(_after(steps, low.path, True) & _after(steps, high.path, False))
    first = df.filter(inside[0]).orderBy(*order).offset(offset - low.before) if offset > low.before else df.filter(inside[0])
    rest = df.filter(inside[1])
    if last - high.before < high.rows:
        rest = rest.orderBy(*order).limit(last - high.before)
    return first.unionByName(middle).unionByName(rest)
