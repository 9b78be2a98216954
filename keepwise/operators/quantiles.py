"""Exact quantiles without gathering a column's distinct values in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Up to this many distinct values are ranked in one window.
SMALL = 20_000
# percentile_approx is off by at most 1/ACCURACY of the ranks.
ACCURACY = 10_000


def exact_quantiles(
    df: DataFrame,
    columns: dict[str, Column],
    probs: list[float],
    small: int = SMALL,
    totals: dict[str, int] | None = None,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles per named column, NULLs left out.

    Intervals around the wanted ranks are narrowed with ``percentile_approx`` and exact counts, one
    scan per round for all columns, until at most ``small`` distinct values remain in each; columns
    of fewer values need no round. What remains is counted by value and ranked exactly, in one query for
    all intervals. ``totals`` are the columns' non-NULL counts, where the caller has them.
    """
    data = df.select([c.cast("double").alias(name) for name, c in columns.items()])
    if totals is None:
        totals = data.agg(*[F.count(name).alias(name) for name in columns]).first().asDict()
    targets = []
    for name in columns:
        for p in probs:
            position = (totals[name] - 1) * p
            if totals[name]:
                targets.append(_Target(name, p, math.floor(position), math.ceil(position), position))
    _narrow(data, targets, totals, small)
    intervals: dict[tuple, list[_Target]] = {}
    for t in targets:
        intervals.setdefault((t.name, t.low, t.high), []).append(t)
    values = _values(data, list(intervals.values()))
    return {name: [values.get((name, p)) for p in probs] for name in columns}


class _Target:
    """A wanted rank pair and the value interval [low, high] known to hold it."""

    def __init__(self, name, prob, first, last, position):
        self.name, self.prob, self.position = name, prob, position
        self.first, self.last = first, last
        self.low, self.high, self.below, self.inside = None, None, 0, None

    def within(self, low, high) -> Column:
        column = F.col(self.name)
        if low is None:
            return column.isNotNull()
        return (column >= low) & (column <= high)


def _narrow(data: DataFrame, targets: list[_Target], totals: dict, small: int) -> None:
    for target in targets:
        target.inside = totals[target.name]
    open_targets = [t for t in targets if totals[t.name] > small]
    while open_targets:
        asked = []
        for i, t in enumerate(open_targets):
            margin = 2 / ACCURACY
            start = max(0.0, (t.first - t.below) / t.inside - margin)
            end = min(1.0, (t.last - t.below + 1) / t.inside + margin)
            value = F.when(t.within(t.low, t.high), F.col(t.name))
            asked.append(F.percentile_approx(value, [start, end], ACCURACY).alias(f"t{i}"))
        bounds = data.agg(*asked).first()
        counts = []
        for i, t in enumerate(open_targets):
            low, high = bounds[i]
            counts.append(F.count_if(F.col(t.name) < low).alias(f"b{i}"))
            counts.append(F.count_if(t.within(low, high)).alias(f"n{i}"))
            distinct = F.approx_count_distinct(F.when(t.within(low, high), F.col(t.name)))
            counts.append(distinct.alias(f"d{i}"))
        row = data.agg(*counts).first()
        still_open = []
        for i, t in enumerate(open_targets):
            low, high = bounds[i]
            below, inside = row[f"b{i}"], row[f"n{i}"]
            if not below <= t.first <= t.last < below + inside:
                raise ArithmeticError(f"quantile bracket lost for {t.name}")
            shrunk = (low, high) != (t.low, t.high)
            t.low, t.high, t.below, t.inside = low, high, below, inside
            if shrunk and row[f"d{i}"] > small:
                still_open.append(t)
        open_targets = still_open


def _values(data: DataFrame, intervals: list[list[_Target]]) -> dict[tuple, float]:
    """The wanted quantiles of all intervals, from one ranking with the interval as key."""
    out = {(x.name, x.prob): x.low for group in intervals for x in group if x.low is not None and x.low == x.high}
    intervals = [group for group in intervals if (group[0].name, group[0].prob) not in out]
    if not intervals:
        return out
    first = [group[0] for group in intervals]
    entries = [
        F.when(t.within(t.low, t.high), F.struct(F.lit(i).alias("interval"), F.col(t.name).alias("value")))
        for i, t in enumerate(first)
    ]
    long = data.select(F.inline(F.filter(F.array(*entries), lambda e: e.isNotNull())))
    counts = long.groupBy("interval", "value").agg(F.count("*").alias("n"))
    # At most ``small`` rows an interval in a window.
    inside = F.sum("n").over(Window.partitionBy("interval").orderBy("value"))
    below = F.get(F.array(*[F.lit(t.below).cast("long") for t in first]), F.col("interval"))
    ranked = counts.select("interval", "value", "n", (inside + below).alias("seen"))
    ranks = F.array(
        *[F.array(*[F.struct(F.lit(x.first).cast("long").alias("first"), F.lit(x.last).cast("long").alias("last")) for x in group]) for group in intervals]
    )
    hit = F.exists(
        F.get(ranks, F.col("interval")),
        lambda r: (F.col("seen") > r["first"]) & (F.col("seen") - F.col("n") <= r["last"]),
    )
    hits = ranked.filter(hit).collect()
    for i, group in enumerate(intervals):
        found = sorted((r["seen"], r["n"], r["value"]) for r in hits if r["interval"] == i)
        for x in group:
            values = [value for seen, n, value in found if seen > x.first and seen - n <= x.last]
            out[x.name, x.prob] = values[0] + (values[-1] - values[0]) * (x.position - x.first)
    return out
