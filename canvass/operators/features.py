"""Feature transforms fitted on train and applied to any split.

Fitting is one aggregate over the training rows; its result is a handful of
numbers (bounds, medians, means, level counts) that travels to the driver and
comes back into the plan as literals, so applying a transform is a pure
projection - no join, no shuffle - on train, test or any later table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.fixed import INFREQUENT_LEVEL, MISSING_LEVEL, WINSOR
from canvass.functions.scalars import clip_keep_null
from canvass.operators.quantile import interpolated, order_statistics


@dataclass(frozen=True)
class NumericColumn:
    """What the linear-model track does to one numeric column, in this order: clip to quantiles of the training rows
    (``clip``: their two probabilities), ``log1p``, fill nulls with the training median."""

    source: str
    clip: tuple[float, float] | None = None
    log: bool = False
    any_flag: bool = False

    @property
    def output(self) -> str:
        return self.source + "_log" if self.log else self.source


@dataclass(frozen=True)
class FittedColumn:
    plan: NumericColumn
    bounds: tuple[float, float] | None
    median: float | None  # None without a value in the training rows

    def before_fill(self) -> Column:
        """P13 + P14; nulls stay null."""
        value = F.col(f"`{self.plan.source}`").cast("double")
        if self.bounds is not None:
            value = clip_keep_null(value, *self.bounds)
        return F.log1p(value) if self.plan.log else value

    def flags(self) -> list[Column]:
        """P15, of the raw value: whether it is missing, and whether there is any of it."""
        raw = F.col(f"`{self.plan.source}`")
        missing = raw.isNull().cast("tinyint").alias(f"{self.plan.source}_missing")
        some = F.coalesce(raw > 0, F.lit(False)).cast("tinyint").alias(f"{self.plan.source}_any")
        return [missing, some] if self.plan.any_flag else [missing]

    def filled(self) -> Column:
        """P16; a null that the median cannot fill fails the job."""
        name = self.plan.output
        value = F.coalesce(self.before_fill(), F.lit(self.median).cast("double"))
        stop = F.raise_error(F.lit(f"{name}: null after imputation (no training value)")).cast("double")
        return F.coalesce(value, stop).alias(name)


def linear_track(winsor: str | None, log: Sequence[str], any_flag: Sequence[str] = (), raw: Sequence[str] = (), probs: tuple[float, float] = WINSOR) -> list[NumericColumn]:
    """The track's columns: logged ones first, then those that stay as they are."""
    names = list(dict.fromkeys([*log, *raw]))
    return [NumericColumn(c, probs if c == winsor else None, c in log, c in any_flag) for c in names]


def fit_numeric(train: DataFrame, track: Sequence[NumericColumn]) -> list[FittedColumn]:
    """X18 fit. Clipping and log1p keep the order of values, so the order statistics of the raw columns, searched once for
    all of them, give the bounds and also the medians: a median's two neighbours go through the column's steps."""
    raw = train.select(*[F.col(f"`{c.source}`").cast("double").alias(c.source) for c in track])
    probs = sorted({0.5, *(p for c in track for p in c.clip or ())})
    found = order_statistics(raw.unpivot([], [f"`{c.source}`" for c in track], "column", "x"), probs)
    out = []
    for c in track:
        if (c.source, 0.5) not in found:
            out.append(FittedColumn(c, None, None))
            continue
        bounds = tuple(interpolated(*found[(c.source, p)]) for p in c.clip) if c.clip else None
        low, high, weight = found[(c.source, 0.5)]
        ends = [min(max(v, bounds[0]), bounds[1]) if bounds else v for v in (low, high)]
        out.append(FittedColumn(c, bounds, interpolated(*(math.log1p(v) if c.log else v for v in ends), weight)))
    return out


def apply_numeric(df: DataFrame, fitted: Sequence[FittedColumn], keep: Sequence[str]) -> DataFrame:
    """X18 apply: the kept columns, then each column's flags and its filled value, as one projection."""
    return df.select(*[F.col(f"`{c}`") for c in keep], *[x for f in fitted for x in (*f.flags(), f.filled())])


def parameters(fitted: Sequence[FittedColumn]) -> list[dict]:
    """The fitted numbers as records (for the JSON parameter file)."""
    return [
        {"column": f.plan.source, "output": f.plan.output, "clip_low": f.bounds[0] if f.bounds else None, "clip_high": f.bounds[1] if f.bounds else None, "log": f.plan.log, "median": f.median}
        for f in fitted
    ]


def winsorize(column: str, lo: float, hi: float, alias: str | None = None) -> Column:
    """P13 as a column: clip into the fitted bounds, keep nulls."""
    return clip_keep_null(F.col(column).cast("double"), lo, hi).alias(alias or column)


def fill_category(c: str, value: str = "Missing") -> Column:
    """A constant level for missing categories."""
    return F.coalesce(F.col(c), F.lit(value)).alias(c)


def fit_standardize(train: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """X4 fit: mean and population sd (ddof 0) per column on train."""
    row = train.agg(
        *[x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]
    ).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in columns}


def standardize(columns: Sequence[str], params: dict[str, tuple[float, float]]) -> list[Column]:
    """X4 apply: (x - mean) / sd; a zero sd leaves the centred value (sd := 1)."""
    out = []
    for c in columns:
        m, s = params[c]
        s = s if s and s > 0 else 1.0
        out.append(((F.col(c) - F.lit(m)) / F.lit(s)).alias(c))
    return out


INFREQUENT = INFREQUENT_LEVEL
MISSING = MISSING_LEVEL


def fit_levels(train: DataFrame, column: str) -> DataFrame:
    """X5 fit: level counts on train (nulls are the ``Missing`` level)."""
    return train.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(MISSING)).alias("level")).agg(
        F.count(F.lit(1)).alias("n_train")
    )


def fold_rare_levels(df: DataFrame, column: str, level_counts: DataFrame, min_frequency: int, alias: str) -> DataFrame:
    """X5 apply: ``df`` with ``alias``: a level seen at least ``min_frequency`` times on train keeps its
    name, a rarer train level becomes ``infrequent``, a level never seen on
    train stays unseen (null -> all-zero one-hot). A join with the level table, of any size; Spark broadcasts it
    when it is small and splits a level that holds most rows otherwise."""
    kept = level_counts.select(F.col("level").alias("__level"), F.when(F.col("n_train") >= min_frequency, F.col("level")).otherwise(F.lit(INFREQUENT)).alias(alias))
    keyed = df.withColumn("__level", F.coalesce(F.col(column).cast("string"), F.lit(MISSING)))
    return keyed.join(kept, "__level", "left").select(*df.columns, alias)


def skew_observed(df: DataFrame, pairs: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """Bias-corrected skewness G1 = g1 sqrt(n(n-1))/(n-2) of a raw column and
    of its transformed column on observed rows only (imputed rows excluded by
    their missing flag). ``pairs`` holds (name, raw, transformed, missing flag);
    one aggregate for all columns."""

    def g1(c: Column) -> Column:
        n = F.count(c).cast("double")
        return F.try_divide(F.skewness(c) * F.sqrt(n * (n - 1)), n - 2)

    exprs = []
    for name, raw, out, missing in pairs:
        obs = F.when(F.col(missing) == 0, F.col(out))
        exprs.append(
            F.struct(
                F.lit(name).alias("column"),
                F.count(F.col(raw)).alias("n"),
                g1(F.col(raw).cast("double")).alias("skew_before"),
                g1(obs).alias("skew_after"),
            )
        )
    return df.agg(F.array(*exprs).alias("r")).select(F.explode("r").alias("r")).select("r.*")
