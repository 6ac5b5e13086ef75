"""Exact quantiles by narrowing brackets: aggregations only, no sort, no value map.

Each round takes approximate quantiles slightly below and above the wanted
rank (partial aggregation, small state), which brackets the exact value, and
counts what lies below, on and between them.  Either the rank falls on one of
the two values, which settles it however many rows share that value, or the
bracket shrinks several hundredfold.  Once few rows are left, their distinct
values are counted and the ranks read off.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY = 2_000
MARGIN = 2.0 / ACCURACY
FINISH_ROWS = 100_000


@dataclass
class _Bracket:
    """Open interval that holds the value of one 0-based rank."""

    column: str
    rank: int
    low: float = -math.inf
    high: float = math.inf
    below: int = 0          # rows at or below `low`
    inside: int = 0
    value: float | None = None

    def holds(self) -> Column:
        return (F.col(self.column) > F.lit(self.low)) & (F.col(self.column) < F.lit(self.high))


def _count_inside(src: DataFrame, brackets: list[_Bracket]) -> None:
    aggs = []
    for i, b in enumerate(brackets):
        aggs += [F.count_if(F.col(b.column) <= F.lit(b.low)).alias(f"l{i}"),
                 F.count_if(b.holds()).alias(f"n{i}")]
    row = src.agg(*aggs).first()
    for i, b in enumerate(brackets):
        b.below, b.inside = row[f"l{i}"], row[f"n{i}"]


def _narrow(src: DataFrame, brackets: list[_Bracket]) -> None:
    """One round: approximate quantiles around the rank, then exact counts at them."""
    aggs = []
    for i, b in enumerate(brackets):
        at = (b.rank - b.below) / max(b.inside, 1)
        around = [max(at - MARGIN, 0.0), min(at + MARGIN, 1.0)]
        aggs.append(F.percentile_approx(F.when(b.holds(), F.col(b.column)), around, ACCURACY)
                    .alias(f"q{i}"))
    picked = src.agg(*aggs).first()
    counts = []
    for i, b in enumerate(brackets):
        x, (q1, q2) = F.col(b.column), picked[f"q{i}"]
        counts += [F.count_if(b.holds() & (x < q1)).alias(f"a{i}"),
                   F.count_if(x == q1).alias(f"b{i}"),
                   F.count_if((x > q1) & (x < q2)).alias(f"c{i}"),
                   F.count_if(x == q2).alias(f"d{i}")]
    row = src.agg(*counts).first()
    for i, b in enumerate(brackets):
        q1, q2 = picked[f"q{i}"]
        parts = [(b.low, q1, row[f"a{i}"]), (q1, q1, row[f"b{i}"]), (q1, q2, row[f"c{i}"])]
        if q2 > q1:
            parts.append((q2, q2, row[f"d{i}"]))
        at = b.below
        for low, high, n in parts:
            if at <= b.rank < at + n:
                if low == high:
                    b.value = low
                b.low, b.high, b.below, b.inside = low, high, at, n
                break
            at += n
        else:
            b.low, b.inside, b.below = q2, b.inside - (at - b.below), at


def _finish(src: DataFrame, brackets: list[_Bracket]) -> None:
    """Count the distinct values inside each interval and read off the ranks.

    Neighbouring ranks mostly share an interval, which is then counted once.
    Only rows inside some interval go into the grouping.
    """
    spans: dict[tuple, list[_Bracket]] = {}
    for b in brackets:
        spans.setdefault((b.column, b.low, b.high), []).append(b)
    ones = [group[0] for group in spans.values()]
    below = [0] * len(ones)
    if any(b.low > -math.inf for b in ones):
        row = src.agg(*[F.count_if(F.col(b.column) <= F.lit(b.low)).alias(f"l{i}")
                        for i, b in enumerate(ones)]).first()
        below = [row[f"l{i}"] for i in range(len(ones))]
    items = F.array(*[
        F.struct(F.lit(i).alias("span"), F.when(b.holds(), F.col(b.column)).alias("value"))
        for i, b in enumerate(ones)])
    found = src.where(reduce(or_, [b.holds() for b in ones])) \
        .select(F.explode(items).alias("s")).select("s.*").where("value is not null") \
        .groupBy("span", "value").agg(F.count(F.lit(1)).alias("n"))
    counts: dict[int, dict] = {}
    for r in found.collect():
        counts.setdefault(r["span"], {})[r["value"]] = r["n"]
    for i, group in enumerate(spans.values()):
        at = below[i]
        for value, n in sorted(counts.get(i, {}).items()):
            for b in group:
                if at <= b.rank < at + n:
                    b.value = value
            at += n
        if any(b.value is None for b in group):
            raise ArithmeticError(f"rank outside its bracket in {group[0].column}")


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                    finish_rows: int = FINISH_ROWS) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation between ranks, nulls left out.

    Returns {column: [value per prob]}, None where a column has no values.
    """
    src = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    wide = sorted({min(max(x, 0.0), 1.0) for p in probs for x in (p - 2 * MARGIN, p + 2 * MARGIN)})
    row = src.agg(*[a for i, c in enumerate(columns) for a in (
        F.count(c).alias(f"n{i}"),
        F.percentile_approx(c, wide, ACCURACY).alias(f"q{i}"))]).first()
    brackets: dict[tuple[str, int], _Bracket] = {}
    expected = 0.0
    for i, c in enumerate(columns):
        n = row[f"n{i}"]
        for p in probs if n else []:
            near = dict(zip(wide, row[f"q{i}"]))
            for rank in {math.floor(p * (n - 1)), math.ceil(p * (n - 1))}:
                b = brackets.setdefault((c, rank), _Bracket(c, rank, inside=n))
                if n > ACCURACY and p > 2 * MARGIN:
                    b.low = math.nextafter(near[p - 2 * MARGIN], -math.inf)
                if n > ACCURACY and p < 1 - 2 * MARGIN:
                    b.high = math.nextafter(near[p + 2 * MARGIN], math.inf)
                expected += min(n, max(ACCURACY, n * 6 * MARGIN))
    todo = list(brackets.values())
    if expected > finish_rows:
        _count_inside(src, todo)
        share = finish_rows / len(todo)
        while wide_ones := [b for b in todo if b.value is None and b.inside > share]:
            _narrow(src, wide_ones)
    todo = [b for b in todo if b.value is None]
    if todo:
        _finish(src, todo)
    out: dict[str, list[float | None]] = {c: [] for c in columns}
    for i, c in enumerate(columns):
        for p in probs:
            at = p * (row[f"n{i}"] - 1)
            if row[f"n{i}"] == 0:
                out[c].append(None)
                continue
            lo, hi = (brackets[(c, r)].value for r in (math.floor(at), math.ceil(at)))
            out[c].append(lo + (hi - lo) * (at - math.floor(at)))
    return out
