"""Column profiles: counts, numeric and categorical profiles, quantiles,
histograms (A1, A6-A12, A19-A21, A25).

Many columns are profiled by one ``unpivot`` to ``(column, value)`` followed
by one ``groupBy(column)`` - a single scan and shuffle instead of a job per
column. Quantiles are exact (``exact_quantiles``: bounded memory at any
scale); ``approx=True`` switches to ``percentile_approx`` sketches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canvass.fixed import HISTOGRAM_BINS, PROFILE_CLIP
from canvass.functions.scalars import clip_keep_null
from canvass.operators.quantile import exact_quantiles


def _quantile_maps(long: DataFrame, probs: Sequence[float], approx: bool, accuracy: int = 100_000) -> list[Column]:
    """One ``column -> value`` literal map per prob (exact by default)."""
    if approx:
        rows = long.groupBy("column").agg(F.percentile_approx("x", list(probs), accuracy).alias("q")).collect()
        q = {(r["column"], p): v for r in rows for p, v in zip(probs, r["q"])}
    else:
        q = exact_quantiles(long, probs)
    maps = []
    for p in probs:
        items = [x for (c, pp), v in q.items() if pp == p for x in (F.lit(c), F.lit(v).cast("double"))]
        maps.append(F.create_map(*items) if items else F.create_map().cast("map<string,double>"))
    return maps


def _at(m: Column) -> Column:
    return F.element_at(m, F.col("column"))


def numeric_long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, x)`` with ``x`` as double; NaN is turned into null at the source."""
    casted = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns])
    return casted.unpivot([], list(columns), "column", "x")


def string_long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column", "value")


def numeric_profile(
    df: DataFrame,
    columns: Sequence[str],
    clip_low: float = PROFILE_CLIP[0],
    clip_high: float = PROFILE_CLIP[1],
    approx: bool = False,
) -> DataFrame:
    """Per column n, missing, min/max and median of the original values;
    mean, variance and sd (ddof 1), population skewness and excess kurtosis of
    the values clipped to the ``clip_low``/``clip_high`` percentiles. Columns
    with fewer than two values are skipped.

    The clip bounds and medians come from ``exact_quantiles``; they return as
    literal per-column maps, so counts, extremes and the clipped moments are
    then one aggregate (no join).
    """
    long = numeric_long(df, columns)
    lo_m, hi_m, med_m = _quantile_maps(long, [clip_low, clip_high, 0.5], approx)
    clipped = clip_keep_null(F.col("x"), _at(lo_m), _at(hi_m))
    out = long.groupBy("column").agg(
        F.count("x").alias("n"),
        (F.count(F.lit(1)) - F.count("x")).alias("missing"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
        F.avg(clipped).alias("mean"),
        F.var_samp(clipped).alias("variance"),
        F.stddev_samp(clipped).alias("sd"),
        F.skewness(clipped).alias("skewness"),
        F.kurtosis(clipped).alias("kurtosis"),
    )
    return out.filter(F.col("n") >= 2).select(
        "column", "n", "missing", "min", "max", "mean", "variance", "sd", _at(med_m).alias("median"), "skewness", "kurtosis"
    )


def numeric_summary(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """A10: count, mean, sd (ddof 1), min, quartiles, max per column."""
    long = numeric_long(df, columns)
    q25, q50, q75 = _quantile_maps(long, [0.25, 0.5, 0.75], approx)
    agg = long.groupBy("column").agg(
        F.count("x").alias("count"),
        F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
    )
    return agg.select(
        "column", "count", "mean", "std", "min", _at(q25).alias("p25"), _at(q50).alias("p50"), _at(q75).alias("p75"), "max",
    )


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], approx: bool = False) -> DataFrame:
    """Linear-interpolated quantiles per column, one row per ``(column, prob)``."""
    long = numeric_long(df, columns)
    maps = _quantile_maps(long, probs, approx)
    cols = long.select("column").distinct()
    return cols.select(
        "column",
        F.explode(F.array(*[F.struct(F.lit(float(p)).alias("prob"), _at(m).alias("value")) for p, m in zip(probs, maps)])).alias("z"),
    ).select("column", "z.prob", "z.value")


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts per value including null, with the percent of all rows."""
    long = string_long(df, columns)
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    # every column holds one entry per row (nulls included), so each column's
    # total is the row count: no second pass and no window over a column's values
    total = df.count()
    return counts.select("column", "value", "n", (F.col("n") * 100.0 / F.lit(total)).alias("pct"))


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    """Count and percent of each target value (nulls included)."""
    return value_counts(df, [target]).select(F.col("value").alias(target), "n", "pct")


def ordered_counts(df: DataFrame, column: str, order: Sequence[str] | None = None) -> DataFrame:
    """Counts of a category in a declared order; without one, by frequency
    (ties by value). ``position`` is 1-based; values outside the declared order
    follow by frequency."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    if order:
        pos = F.create_map(*[x for i, v in enumerate(order) for x in (F.lit(v), F.lit(i))])
        key = F.coalesce(F.element_at(pos, F.col(column)), F.lit(len(order)))
    else:
        key = F.lit(0)
    w = Window.orderBy(key.asc(), F.col("n").desc(), F.col(column).asc())
    # the window runs over the distinct values of one category (already aggregated)
    return counts.withColumn("position", F.row_number().over(w))


def category_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column n, missing, distinct, mode (ties -> smallest
    value), mode count and mode percent. Only aggregates: counts per value, the
    top count per column, then the smallest value holding it."""
    long = string_long(df, columns)
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("c"))
    known = F.col("value").isNotNull()
    # the mode is the value with the largest count, ties to the smallest value:
    # min_by over (-count, value) - a partial aggregate, however many values a
    # column has (no window holding a column's values in one task)
    out = counts.groupBy("column").agg(
        F.sum(F.when(known, F.col("c"))).alias("n"),
        F.coalesce(F.sum(F.when(~known, F.col("c"))), F.lit(0)).alias("missing"),
        F.count(F.when(known, 1)).alias("distinct"),
        F.max(F.when(known, F.col("c"))).alias("mode_count"),
        F.min_by(F.col("value"), F.when(known, F.struct((-F.col("c")).alias("k"), F.col("value").alias("v")))).alias("mode"),
    )
    return out.filter(F.col("n").isNotNull()).select(
        "column",
        F.col("n").cast("bigint").alias("n"),
        F.col("missing").cast("bigint").alias("missing"),
        "distinct",
        "mode",
        "mode_count",
        (F.col("mode_count") * 100.0 / F.col("n")).alias("mode_pct"),
    )


def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS, log10: bool = False) -> DataFrame:
    """Equal-width bins over [min, max] (in log10 space when ``log10``);
    the last bin is closed. Null, NaN and infinite values take no part. One pass for the range, one partially-aggregated
    ``groupBy`` for the counts. Returns ``(bin, lower, upper, n)`` with every
    bin present (zeros included)."""
    x = F.log10(F.col(column)) if log10 else F.col(column).cast("double")
    vals = df.select(x.alias("x")).filter(F.abs("x") < float("inf"))
    lo, hi = vals.agg(F.min("x"), F.max("x")).first()
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin int, lower double, upper double, n bigint")
    width = (hi - lo) / bins if hi > lo else 1.0
    # edges are lo + i * width; x falls in bin i when edge_i <= x < edge_(i+1),
    # the floor estimate is corrected by one step where rounding crossed an edge
    est = F.floor((F.col("x") - F.lit(lo)) / F.lit(width))
    est = F.when(F.lit(lo) + est * F.lit(width) > F.col("x"), est - 1).otherwise(est)
    est = F.when(F.lit(lo) + (est + 1) * F.lit(width) <= F.col("x"), est + 1).otherwise(est)
    idx = F.least(F.greatest(est, F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = vals.groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    edges = grid.select(
        "bin",
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lower"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("upper"),
    )
    return edges.join(counts, "bin", "left").select("bin", "lower", "upper", F.coalesce("n", F.lit(0)).alias("n"))
