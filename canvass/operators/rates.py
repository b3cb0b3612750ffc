"""Rates of a 0/1 outcome per group.

Every rate is ``avg(label) * 100`` with ``count`` in one partially-aggregated
``groupBy``; a hot group is merged from per-task partials, never gathered
into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.functions.guards import collect_bounded
from canvass.functions.scalars import right_closed_band
from canvass.operators.multiselect import MULTI_SEP, explode_trimmed

from canvass.fixed import CAREER_EDGES, EXPERIENCE_EDGES, TOP_OPTIONS

# display labels of the bands
EXPERIENCE_BANDS = ["junior (0-3)", "mid (4-10)", "senior (11+)"]
CAREER_BANDS = ["0-2", "3-5", "6-10", "11-15", "16-20", "21-30", "30+"]
OVERALL = "all"


def rate_by_group(df: DataFrame, group: str, label: str, min_n: int = 0) -> DataFrame:
    """A2: rate (percent) and n per group, keeping groups with ``n >= min_n``."""
    agg = df.groupBy(group).agg(
        (F.avg(F.col(label).cast("double")) * 100.0).alias("rate"),
        F.count(F.col(label)).alias("n"),
    )
    return agg.filter(F.col("n") >= min_n) if min_n > 0 else agg


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` most frequent values of ``column`` (ties by value)."""
    return (
        df.groupBy(column)
        .agg(F.count(F.lit(1)).alias("cnt"))
        .orderBy(F.col("cnt").desc(), F.col(column).asc())
        .limit(n)
    )


def rate_by_option_and_band(
    df: DataFrame,
    cell: str,
    label: str,
    number: str,
    top_n: int = TOP_OPTIONS,
    edges: Sequence[float] = EXPERIENCE_EDGES,
    bands: Sequence[str] = EXPERIENCE_BANDS,
    sep: str = MULTI_SEP,
) -> DataFrame:
    """A3 + M9: rate per option overall and per band of ``number``.

    Options are the trimmed tokens of ``cell``; only the ``top_n`` most frequent
    are kept. Overall and per-band figures come from one conditional
    aggregate per option (one scan; equivalent to GROUPING SETS ((option),
    (option, band)) joined to the option x band grid, with a null band kept
    out of the bands but inside the overall row). Every top option appears for
    every band; empty combinations have null rate and n.
    """
    rows = explode_trimmed(df, cell, sep, "option")
    # the top-N list is bounded by N: it returns as a literal filter
    top = [r["option"] for r in collect_bounded(top_values(rows, "option", top_n), top_n, "top options")]
    kept = rows.filter(F.col("option").isin(top)).withColumn("band", right_closed_band(F.col(number), edges, bands))
    y = F.col(label).cast("double")
    # overall and every band in one aggregate: each top option gets all bands;
    # an empty band has no rows -> null rate and null n
    parts = [(OVERALL, F.lit(True))] + [(b, F.col("band") == b) for b in bands]
    aggs = []
    for i, (_, cond) in enumerate(parts):
        aggs += [F.avg(F.when(cond, y)).alias(f"r{i}"), F.count(F.when(cond, y)).alias(f"n{i}")]
    per_option = kept.groupBy("option").agg(*aggs)
    cells = F.array(*[
        F.struct(
            F.lit(b).alias("band"),
            (F.col(f"r{i}") * 100.0).alias("rate"),
            F.when(F.col(f"n{i}") > 0, F.col(f"n{i}").cast("double")).alias("n"),
        )
        for i, (b, _) in enumerate(parts)
    ])
    return per_option.select("option", F.explode(cells).alias("c")).select("option", "c.band", "c.rate", "c.n")


def rate_by_band(
    df: DataFrame,
    number: str,
    label: str,
    edges: Sequence[float] = CAREER_EDGES,
    bands: Sequence[str] = CAREER_BANDS,
    include_lowest: bool = True,
) -> DataFrame:
    """A4: rate per right-closed band of ``number``; observed bands only."""
    banded = df.withColumn("band", right_closed_band(F.col(number), edges, bands, include_lowest))
    return rate_by_group(banded.filter(F.col("band").isNotNull()), "band", label)


def rate_two_way(
    df: DataFrame,
    a: str,
    b: str,
    label: str,
    a_levels: DataFrame | None = None,
    b_levels: Sequence[str] | None = None,
    max_levels: int = 1_000,
) -> DataFrame:
    """A5: rate and n per ``(a, b)`` over the full level grid: unobserved
    combinations appear with ``n = 0`` and a null rate (categorical grouping).

    The ``a`` levels are a table (``a_levels``, or the distinct values of the data) of any size; the ``b`` levels are
    declared or taken from the data behind a size guard. The grid is built by exploding the ``b`` levels next to
    each ``a`` level, then the grouped counts are left-joined onto it.
    """
    if a_levels is None:
        a_levels = df.select(a).filter(F.col(a).isNotNull()).distinct()
    if b_levels is None:
        b_levels = [r[0] for r in collect_bounded(df.select(b).filter(F.col(b).isNotNull()).distinct(), max_levels, b)]
    grid = a_levels.select(a, F.explode(F.array(*[F.lit(y) for y in b_levels])).alias(b))
    sub = df.dropna(subset=[a, b, label])
    agg = sub.groupBy(a, b).agg(
        F.avg(F.col(label).cast("double")).alias("rate"),
        F.count(F.lit(1)).alias("n"),
    )
    return grid.join(agg, [a, b], "left").select(a, b, "rate", F.coalesce(F.col("n"), F.lit(0)).alias("n"))


def indicator_rate_two_way(df: DataFrame, indicator: Column | str, x: str, hue: str) -> DataFrame:
    """Mean of a 0/1 indicator per ``(x, hue)``, dropping nulls in either factor."""
    ind = F.col(indicator) if isinstance(indicator, str) else indicator
    return (
        df.dropna(subset=[x, hue])
        .groupBy(x, hue)
        .agg(F.avg(ind.cast("double")).alias("rate"), F.count(ind).alias("n"))
    )
