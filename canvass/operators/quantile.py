"""Exact order statistics and linear-interpolated quantiles that stay bounded at any scale.

Spark's exact ``percentile`` merges every distinct value of a group into one
task: an out-of-memory risk for a continuous column over billions of rows. Here
each wanted rank is searched by narrowing a value range, for all columns and ranks
at once:

* one aggregate gives each column's count, minimum and maximum;
* a range of at most ``slice_rows`` rows is sorted in one task and its ranks are read off;
* a larger range is cut at approximate quantiles of its own values (equi-depth, so any
  spread of values shrinks alike), its rows are counted by piece in one partially-aggregated
  ``groupBy``, and the piece with the rank is the next range. A value at a cut is a piece of its
  own, so a value that holds most rows ends the search at once.

There is no other way out of the loop: every round leaves a piece with fewer rows, and nothing
larger than ``slice_rows`` rows is ever gathered. The result doesn't depend on ``slice_rows``.

The interpolation is Spark's: (hi_rank - h) * v_lo + (h - lo_rank) * v_hi, h = (n - 1) p.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.functions.guards import collect_bounded

MAX_COLUMNS = 10_000
SLICE_ROWS = 1_000_000
CUTS = 64


def _clean(long_df: DataFrame) -> DataFrame:
    return long_df.select("column", F.col("x").cast("double").alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))


@dataclass
class _Search:
    """The range that still holds one rank (0-based) of a column."""

    column: str
    rank: int
    low: float
    high: float
    below: int  # values under ``low``
    rows: int
    value: float | None = None

    @property
    def range(self) -> tuple[str, float, float]:
        return self.column, self.low, self.high


def _inside(base: DataFrame, ranges: list[tuple[str, float, float]], extra: list[Column] | None = None) -> DataFrame:
    """Rows of ``base`` with each range (``r.i``, its number) that holds them."""
    structs = [
        F.struct(F.lit(i).alias("i"), F.lit(c).alias("c"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), *([extra[i].alias("more")] if extra else []))
        for i, (c, lo, hi) in enumerate(ranges)
    ]
    held = F.filter(F.array(*structs), lambda r: (r["c"] == F.col("column")) & (F.col("x") >= r["lo"]) & (F.col("x") <= r["hi"]))
    return base.select("x", F.explode(held).alias("r"))


def _read_off(base: DataFrame, searches: list[_Search]) -> None:
    """Sort each small range once and read all its ranks."""
    by_range: dict[tuple, list[_Search]] = {}
    for s in searches:
        by_range.setdefault(s.range, []).append(s)
    wanted = [F.array(*[F.lit(s.rank - s.below + 1) for s in group]) for group in by_range.values()]
    rows = _inside(base, list(by_range), wanted)
    found = rows.groupBy(F.col("r.i").alias("i"), F.col("r.more").alias("ranks")).agg(F.sort_array(F.collect_list("x")).alias("v"))
    found = found.select("i", F.transform("ranks", lambda k: F.element_at("v", k)).alias("values"))
    values = {r["i"]: r["values"] for r in collect_bounded(found, len(by_range), "order statistics")}
    for i, group in enumerate(by_range.values()):
        for s, v in zip(group, values[i]):
            s.value = float(v)


def _narrow(base: DataFrame, searches: list[_Search], cuts: int) -> None:
    """Replace each large range by its piece that holds the rank."""
    ranges = list(dict.fromkeys(s.range for s in searches))
    depth = [k / cuts for k in range(1, cuts)]
    marks = _inside(base, ranges).groupBy(F.col("r.i").alias("i")).agg(F.percentile_approx("x", depth, 100 * cuts).alias("q"))
    at = {r["i"]: sorted(set(r["q"])) for r in collect_bounded(marks, len(ranges), "range cuts")}
    rows = _inside(base, ranges, [F.array(*[F.lit(float(q)) for q in at[i]]) for i in range(len(ranges))])
    piece = 2 * F.size(F.filter("r.more", lambda q: q < F.col("x"))) + F.array_contains("r.more", F.col("x")).cast("int")
    counted = rows.groupBy(F.col("r.i").alias("i"), piece.alias("piece")).agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")
    )
    pieces: dict[tuple, list] = {}
    for r in sorted(collect_bounded(counted, 2 * cuts * len(ranges), "range pieces"), key=lambda r: (r["i"], r["piece"])):
        pieces.setdefault(ranges[r["i"]], []).append(r)
    for s in searches:
        below = s.below
        for r in pieces[s.range]:
            if below + r["n"] > s.rank:
                s.low, s.high, s.below, s.rows = float(r["low"]), float(r["high"]), below, r["n"]
                break
            below += r["n"]


def order_statistics(
    long_df: DataFrame, probs: Sequence[float], slice_rows: int = SLICE_ROWS, cuts: int = CUTS
) -> dict[tuple[str, float], tuple[float, float, float]]:
    """For each ``(column, prob)`` of a ``(column, x)`` table: the two neighbouring values of the quantile and the
    weight of the upper one. Columns without values are left out."""
    base = _clean(long_df)
    stats = base.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    sizes = {r["column"]: r for r in collect_bounded(stats, MAX_COLUMNS, "quantile columns")}
    searches: dict[tuple[str, int], _Search] = {}
    for c, r in sizes.items():
        for p in probs:
            h = (r["n"] - 1) * float(p)
            for rank in {math.floor(h), math.ceil(h)}:
                searches.setdefault((c, rank), _Search(c, rank, float(r["low"]), float(r["high"]), 0, r["n"]))
    while open_ := [s for s in searches.values() if s.value is None]:
        small = []
        for s in open_:
            if s.low == s.high:
                s.value = s.low
            elif s.rows <= slice_rows:
                small.append(s)
        if small:
            _read_off(base, small)
        if large := [s for s in open_ if s.value is None]:
            _narrow(base, large, cuts)
    out = {}
    for c, r in sizes.items():
        for p in probs:
            h = (r["n"] - 1) * float(p)
            lo, hi = math.floor(h), math.ceil(h)
            out[(c, p)] = (searches[(c, lo)].value, searches[(c, hi)].value, h - lo)
    return out


def interpolated(low: float, high: float, weight: float) -> float:
    return low if weight == 0 else (1 - weight) * low + weight * high


def exact_quantiles(long_df: DataFrame, probs: Sequence[float], slice_rows: int = SLICE_ROWS, cuts: int = CUTS) -> dict[tuple[str, float], float]:
    """Exact quantiles of ``x`` per ``column`` of a ``(column, x)`` table: ``{(column, prob): value}``. A column without values
    has no entries."""
    return {k: interpolated(*v) for k, v in order_statistics(long_df, probs, slice_rows, cuts).items()}


def column_quantiles(df: DataFrame, column: str, probs: Sequence[float], **kw) -> list[float | None]:
    """Exact quantiles of one column of ``df`` (None without values)."""
    long_df = df.select(F.lit(column).alias("column"), F.col(f"`{column}`").alias("x"))
    q = exact_quantiles(long_df, probs, **kw)
    return [q.get((column, p)) for p in probs]
