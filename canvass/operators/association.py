"""Association statistics: correlation, chi-square, ANOVA, crosstab, OLS line,
bootstrap bands (A13-A18, A22, A23).

Each statistic is computed from grouped counts or moments: the raw rows are
scanned once and reduced map-side; everything after the first aggregate works
on tables bounded by (variables x levels). Tail probabilities are added by a
pandas UDF on those few result rows only.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canvass.fixed import (
    ALPHA,
    BOOTSTRAP_LEVEL,
    BOOTSTRAP_REPLICATES,
    CORRELATION_TIERS,
    CRAMERS_V_TIERS,
    ETA_SQUARED_TIERS,
    MIN_PAIRS,
    REGRESSION_CAP,
    SEED,
)
from canvass.functions.guards import collect_bounded
from canvass.functions.scalars import tier
from canvass.functions.tails import chi2_pvalue, f_pvalue, pearson_pvalue
from canvass.operators.profile import numeric_summary
from canvass.operators.quantile import column_quantiles
from canvass.session import checkpoint_root

#: Rows of one product of matrices.
GRAM_ROWS = 4096
#: A variance below this share of the mean square about the median counts as none.
NO_SPREAD = 1e-13


def correlation_pairs(df: DataFrame, columns: Sequence[str], min_n: int = MIN_PAIRS) -> DataFrame:
    """A13 + A14: Pearson r of every pair on pairwise-complete rows, with n and
    a strength tier (abs r >= .5 strong, >= .3 medium); pairs with n < min_n
    are skipped. Missing and NaN take no part; a pair with an infinite value has r = NaN, one without spread null.

    All pairs come from products of matrices: with X the values about their medians (0 where missing) and M the 0/1 matrix of present ones,
    M'M counts the rows, X'M and (X*X)'M sum a column where another is present, X'X the products. A task adds up
    its blocks and sends one row a pair; no row of the table is multiplied."""
    if len(columns) < 2:
        raise ValueError("need at least two columns")
    numbers = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) for c in columns]
    finite = [F.when(F.abs(x) < float("inf"), x) for x in numbers]
    middle = df.agg(*[F.percentile_approx(x, 0.5, 100).alias(f"m{i}") for i, x in enumerate(finite)]).first()
    shift = np.array([m or 0.0 for m in middle])
    upper = np.triu_indices(len(columns), 1)
    sums = ("n", "bad", "sx", "sy", "sxx", "syy", "sxy")

    def run(batches):
        total = None
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(shift))
            for lo in range(0, len(flat), GRAM_ROWS):
                x = flat[lo : lo + GRAM_ROWS] - shift
                here = (~np.isnan(x)).astype(np.float64)
                off = np.isinf(x).astype(np.float64)
                x = np.where(np.isfinite(x), x, 0.0)
                part = np.stack([here.T @ here, off.T @ here, x.T @ here, (x * x).T @ here, x.T @ x])
                total = part if total is None else total + part
        if total is not None:
            n, bad, s, ss, p = total
            both = lambda m: (m[upper], m.T[upper])
            cols = [n[upper], sum(both(bad)), *both(s), *both(ss), p[upper]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in upper), *(pa.array(c) for c in cols)], names=["i", "j", *sums])

    parts = df.select(F.array(*numbers).alias("v")).mapInArrow(run, "i int, j int, " + ", ".join(f"{c} double" for c in sums))
    added = parts.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in sums)).withColumn("n", F.col("n").cast("long")).filter(F.col("n") >= min_n)

    def spread(s: str, ss: str) -> Column:
        # about the median: a column without spread has sums that cancel but for rounding
        square = F.try_divide(F.col(ss), F.col("n"))
        v = square - F.pow(F.try_divide(F.col(s), F.col("n")), 2)
        return F.when(v > square * NO_SPREAD, v)

    xy = F.try_divide(F.col("sxy"), F.col("n")) - F.try_divide(F.col("sx"), F.col("n")) * F.try_divide(F.col("sy"), F.col("n"))
    # a column without spread has no correlation: null, never a division error
    corr = F.when(F.col("bad") > 0, F.lit(float("nan"))).otherwise(xy / (F.sqrt(spread("sx", "sxx")) * F.sqrt(spread("sy", "syy"))))
    name = lambda at: F.element_at(F.array(*map(F.lit, columns)), F.col(at) + 1)
    out = added.select(name("i").alias("var1"), name("j").alias("var2"), "n", corr.alias("r"))
    return out.withColumn("strength", F.when(F.col("r").isNotNull(), tier(F.abs(F.col("r")), *CORRELATION_TIERS)))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The square matrix in long form: every ordered pair of columns (diagonal included: 1, or null without spread or
    values), with the number of rows complete in both."""
    one = numeric_summary(df, columns)
    diagonal = one.select(F.col("column").alias("var1"), F.col("column").alias("var2"), F.col("count").alias("n"), F.when(F.col("std") > 0, 1.0).alias("r"))
    if len(columns) < 2:
        return diagonal
    upper = correlation_pairs(df, columns, min_n=0).select("var1", "var2", "n", "r")
    lower = upper.select(F.col("var2").alias("var1"), F.col("var1").alias("var2"), "n", "r")
    return upper.unionByName(lower).unionByName(diagonal)


def ranked(tests: DataFrame, by: str, keys: Sequence[str]) -> DataFrame:
    """A result table in its printed order, largest ``by`` first (absolute; undefined last, ties by ``keys``), with ``position`` from 1. The
    window holds one row for each test."""
    order = Window.orderBy(F.abs(by).desc_nulls_last(), *keys)
    return tests.withColumn("position", F.row_number().over(order))


def with_correlation_pvalue(pairs: DataFrame) -> DataFrame:
    """Two-sided p of r (t test on n - 2) and the p < 0.05 flag."""
    return pairs.withColumn("p_value", pearson_pvalue(F.col("r"), F.col("n"))).withColumn(
        "significant", F.col("p_value") < ALPHA
    )


def _long(df: DataFrame, variables: Sequence[str], target: str) -> DataFrame:
    return (
        df.select(F.col(target).cast("string").alias("target"), *[F.col(v).cast("string").alias(v) for v in variables])
        .unpivot("target", list(variables), "variable", "value")
        .filter(F.col("value").isNotNull() & F.col("target").isNotNull())
    )


MAX_VARIABLES = 10_000


def _literal(value) -> Column:
    if isinstance(value, dict):
        return F.create_map(*[x for k, v in value.items() for x in (F.lit(k), F.lit(v))])
    return F.lit(value)


def chi_square(df: DataFrame, variables: Sequence[str], target: str, yates: bool = True) -> DataFrame:
    """Chi-square test of independence of each variable with ``target``
    on complete cases; Yates' correction when dof = 1 (the common default),
    Cramer's V = sqrt(chi2 / (n (min(r, c) - 1))) and a tier (.3 / .1).

    Absent cells count as zeros without materialising the level grid:
    sum((O - E)^2 / E) = sum_observed(O^2 / E) - n, and in a 2x2 table every cell
    has the same |O - E|, so the corrected statistic follows from one cell.
    """
    # counts become doubles before any product: o^2 n or r c overflow a long at scale
    cells = _long(df, variables, target).groupBy("variable", "value", "target").agg(
        F.count(F.lit(1)).cast("double").alias("o")
    )
    # the contingency table is written once to the shared checkpoint folder and summed in levels: cells to
    # rows of the table, and cells to one map of column totals per variable (the target has few levels).
    # The map joins by variable, one row each, so no key gathers a variable's levels
    checkpoint_root(df.sparkSession)
    cells = cells.checkpoint()
    rows = cells.groupBy("variable", "value").agg(F.sum("o").alias("r_tot"))
    per_row = cells.groupBy("variable", "value").agg(F.sum("o").alias("r_tot"), F.collect_list(F.struct("target", "o")).alias("cells"))
    cols = cells.groupBy("variable", "target").agg(F.sum("o").alias("c_tot"))
    cols = cols.groupBy("variable").agg(
        F.map_from_entries(F.collect_list(F.struct("target", "c_tot"))).alias("totals"),
        F.count(F.lit(1)).alias("c"),
        F.min("target").alias("t1"),
        F.min_by("c_tot", "target").alias("c1"),
        F.sum("c_tot").alias("n"),
    )
    # a row for each variable: literals below, whatever the number of levels
    margins = collect_bounded(cols, MAX_VARIABLES, "variables")
    lit_map = lambda name: F.element_at(F.create_map(*[x for r in margins for x in (F.lit(r["variable"]), _literal(r[name]))]), F.col("variable"))
    if not margins:
        return df.sparkSession.createDataFrame([], "variable string, n long, chi2 double, dof long, cramers_v double, strength string")
    first = rows.groupBy("variable").agg(F.count(F.lit(1)).alias("r"), F.min("value").alias("v1"), F.min_by("r_tot", "value").alias("r1"))
    known = per_row.select("variable", "value", "r_tot", "cells", lit_map("totals").alias("totals"), lit_map("t1").alias("t1"))
    part = F.aggregate("cells", F.lit(0.0), lambda acc, x: acc + x["o"] * x["o"] / (F.col("r_tot") * F.element_at("totals", x["target"])))
    corner = F.aggregate(F.filter("cells", lambda x: x["target"] == F.col("t1")), F.lit(0.0), lambda acc, x: acc + x["o"])
    t = (
        known.select("variable", "value", part.alias("part"), corner.alias("corner"))
        .groupBy("variable")
        .agg(F.sum("part").alias("part"), F.min_by("corner", "value").alias("o11"))
        .join(first, "variable")
        .select("variable", "r", "r1", "o11", "part", lit_map("n").alias("n"), lit_map("c").alias("c"), lit_map("c1").alias("c1"))
        .withColumn("s", F.col("part") * F.col("n"))
    )
    n = F.col("n").cast("double")
    dof = (F.col("r") - 1) * (F.col("c") - 1)
    plain = F.greatest(F.col("s") - n, F.lit(0.0))  # the difference cancels: never below 0
    e11 = F.col("r1") * F.col("c1") / n
    # undefined statistics (a margin with one level) are null, never a division error
    corrected = F.try_divide(
        F.pow(F.greatest(F.abs(F.col("o11") - e11) - 0.5, F.lit(0.0)), 2) * F.pow(n, 3),
        F.col("r1") * (n - F.col("r1")) * F.col("c1") * (n - F.col("c1")),
    )
    chi2 = F.when(dof == 0, F.lit(0.0)).when((dof == 1) & F.lit(yates), corrected).otherwise(plain)
    out = t.select(
        "variable",
        F.col("n").cast("bigint").alias("n"),  # exact: a sum of whole counts
        chi2.alias("chi2"),
        dof.cast("bigint").alias("dof"),
        F.least(F.col("r"), F.col("c")).alias("_m"),
    )
    v = F.sqrt(F.try_divide(F.col("chi2"), F.col("n") * (F.col("_m") - 1)))
    return out.select(
        "variable", "n", "chi2", "dof", v.alias("cramers_v"), tier(v, *CRAMERS_V_TIERS).alias("strength")
    )


def with_chi_square_pvalue(tests: DataFrame) -> DataFrame:
    return tests.withColumn(
        "p_value", F.when(F.col("dof") == 0, F.lit(1.0)).otherwise(chi2_pvalue(F.col("chi2"), F.col("dof")))
    ).withColumn("significant", F.col("p_value") < ALPHA)


def _group_moments(df: DataFrame, variables: Sequence[str], group: str) -> DataFrame:
    return (
        df.select(F.col(group).cast("string").alias("grp"), *[F.col(v).cast("double").alias(v) for v in variables])
        .unpivot("grp", list(variables), "variable", "x")
        .filter(F.col("x").isNotNull() & F.col("grp").isNotNull())
        .groupBy("variable", "grp")
        .agg(F.count(F.lit(1)).alias("n_g"), F.avg("x").alias("mean_g"), F.var_pop("x").alias("var_g"))
    )


def anova(df: DataFrame, variables: Sequence[str], group: str) -> DataFrame:
    """One-way ANOVA of each numeric variable across the groups, with
    eta^2 = SS_between / SS_total and a tier (.14 large / .06 medium); variables
    with fewer than two groups are skipped. Per-group n, mean and population
    variance are the only pass over the rows."""
    # per variable, from the moments of its groups: sums, then the spread of the group means around the grand mean as
    # a merge of variances (n_g as weights); an aggregate, not a window over a variable's groups
    g = _group_moments(df, variables, group).withColumn("n_g", F.col("n_g").cast("double"))
    per = g.groupBy("variable").agg(F.sum("n_g").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n_g") * F.col("mean_g")).alias("total"), F.sum(F.col("n_g") * F.col("var_g")).alias("ssw"))
    grand = per.select("variable", F.col("n"), "k", "ssw", (F.col("total") / F.col("n")).alias("grand"))
    ss = (
        g.join(grand, "variable")
        .groupBy("variable", "n", "k", "ssw")
        .agg(F.sum(F.col("n_g") * F.pow(F.col("mean_g") - F.col("grand"), 2)).alias("ssb"))
        .filter(F.col("k") >= 2)
    )
    f_stat = F.try_divide(F.col("ssb") / (F.col("k") - 1), F.try_divide(F.col("ssw"), F.col("n") - F.col("k")))
    sst = F.col("ssb") + F.col("ssw")
    eta2 = F.try_divide(F.col("ssb"), F.when(sst > 0, sst))
    return ss.select(
        "variable",
        F.col("n").cast("bigint").alias("n"),
        F.col("k").cast("bigint").alias("k"),
        f_stat.alias("f_statistic"),
        eta2.alias("eta_squared"),
        tier(eta2, *ETA_SQUARED_TIERS, ("large", "medium", "small")).alias("effect"),
    )


def with_anova_pvalue(tests: DataFrame) -> DataFrame:
    return tests.withColumn(
        "p_value", f_pvalue(F.col("f_statistic"), F.col("k") - 1, F.col("n") - F.col("k"))
    ).withColumn("significant", F.col("p_value") < ALPHA)


def group_mean_sd(df: DataFrame, variables: Sequence[str], group: str) -> DataFrame:
    """N, mean and population sd of each variable per group."""
    return _group_moments(df, variables, group).select(
        "variable", F.col("grp").alias(group), F.col("n_g").alias("n"), F.col("mean_g").alias("mean"),
        F.sqrt("var_g").alias("sd"),
    )


def crosstab(df: DataFrame, row: str, col: str, max_levels: int = 1_000) -> DataFrame:
    """Counts of ``row`` x ``col`` on complete cases as a pivot with one
    column per ``col`` level (zeros for absent cells). The level list is
    collected behind a size guard and passed to ``pivot`` (no extra scan)."""
    sub = df.select(F.col(row), F.col(col).cast("string").alias(col)).dropna()
    levels = sorted(r[0] for r in collect_bounded(sub.select(col).distinct(), max_levels, f"{col} levels"))
    return sub.groupBy(row).pivot(col, levels).agg(F.count(F.lit(1))).na.fill(0, subset=levels)


def regression_line(df: DataFrame, x: str, y: str, cap_quantile: float = REGRESSION_CAP) -> DataFrame:
    """OLS line of ``y`` on ``x`` for rows with ``y`` at or below its
    ``cap_quantile`` quantile, on pairwise non-null rows."""
    (cap,) = column_quantiles(df, y, [cap_quantile])
    sub = df.filter((F.col(y) <= F.lit(cap)) & F.col(x).isNotNull())
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    return sub.agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope(ys, xs).alias("slope"),
        F.regr_intercept(ys, xs).alias("intercept"),
        F.regr_r2(ys, xs).alias("r2"),
    )


#: Grid points at which the bands of a regression line are given.
LINE_POINTS = 100


#: Draws made together.
DRAWS = 1 << 20


def uniform_draws(seeds: np.ndarray, n: int) -> np.ndarray:
    """Numbers in (0, 1), one row of ``n`` for each 64-bit seed: the splitmix64 generator, whose k-th number is a function of
    seed and k alone."""
    u = np.uint64
    with np.errstate(over="ignore"):
        z = seeds.astype(u)[:, None] + np.arange(1, n + 1, dtype=u) * u(0x9E3779B97F4A7C15)
        z = (z ^ (z >> u(30))) * u(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> u(27))) * u(0x94D049BB133111EB)
        z ^= z >> u(31)
    return ((z >> u(11)).astype(np.float64) + 0.5) * 2.0**-53


def poisson_quantiles(mean: int) -> tuple[int, np.ndarray]:
    """The least value and the distribution function from it on of a Poisson variable, to where the rest is below 1e-30."""
    reach = 12 * int(mean**0.5) + 24
    low = max(0, mean - reach)
    k = np.arange(low + 1, mean + reach)
    # log p(k) - log p(low), by the quotients mean / k
    log_p = np.concatenate([[0.0], np.cumsum(np.log(mean / k))])
    p = np.exp(log_p - log_p.max())
    return low, np.cumsum(p / p.sum())


def _resampled(counts: DataFrame, group: str | None, values: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """(group, b, w, then sums of w times each value and product of values) of ``replicates`` Poisson bootstraps; b = 0 is the data itself.

    ``counts`` has a row for each distinct (group, values) with its number of rows ``c``: c independent Poisson(1) weights
    sum to one Poisson(c) draw, so the cost follows the distinct values, not the rows. A row's draws are counted on from a
    hash of its content, so they are the same under any partitioning. A block of rows is drawn at once, for each c by
    one search in the distribution; a task adds up its own replicates by matrix products before the shuffle."""
    import pandas as pd

    products = [(i, j) for i in range(len(values)) for j in range(i, len(values))]
    names = ["w", *values, *(f"{values[i]}_{values[j]}" for i, j in products)]
    key = [group] if group else []

    def weights(seeds, c):
        drawn = uniform_draws(seeds, replicates)
        w = np.empty((len(c), replicates + 1))
        w[:, 0] = c
        for n in np.unique(c).tolist():
            low, below = poisson_quantiles(n)
            own = c == n
            w[own, 1:] = low + np.minimum(np.searchsorted(below, drawn[own], "right"), len(below) - 1)
        return w

    def run(frames):
        total: dict = {}
        rows = max(1, DRAWS // (replicates + 1))
        for f in frames:
            x = f[list(values)].to_numpy(np.float64)
            terms = np.column_stack([np.ones(len(f)), x, *(x[:, i] * x[:, j] for i, j in products)])
            seeds, c = f["__seed"].to_numpy(np.int64).view(np.uint64), f["c"].to_numpy(np.int64)
            owner, labels = pd.factorize(f[group]) if group else (np.zeros(len(f), np.int64), [None])
            order = np.argsort(owner, kind="stable")
            for lo in range(0, len(f), rows):
                at = order[lo : lo + rows]
                w = weights(seeds[at], c[at])
                ends = np.append(np.flatnonzero(np.diff(owner[at])) + 1, len(at))
                for i, j in zip(np.append(0, ends[:-1]).tolist(), ends.tolist()):
                    g = labels[owner[at[i]]]
                    part = w[i:j].T @ terms[at[i:j]]
                    total[g] = total[g] + part if g in total else part
                if len(total) > 1000:
                    yield from out(total)
                    total = {}
        yield from out(total)

    def out(total):
        for g, sums in total.items():
            frame = pd.DataFrame(sums, columns=names)
            frame.insert(0, "b", np.arange(replicates + 1, dtype="int64"))
            if group:
                frame.insert(0, group, g)
            yield frame

    kinds = ([f"`{group}` {counts.schema[group].dataType.simpleString()}"] if group else []) + ["b long"] + [f"`{n}` double" for n in names]
    content = F.xxhash64(F.lit(seed), *(F.col(f"`{c}`") for c in [*key, *values]))
    seeded = counts.select(*(F.col(f"`{c}`") for c in [*key, *values]), "c", content.alias("__seed"))
    parts = seeded.mapInPandas(run, ", ".join(kinds))
    return parts.groupBy(*(F.col(f"`{c}`") for c in key), "b").agg(*[F.sum(n).alias(n) for n in names])


def bootstrap_mean_ci(
    df: DataFrame, value: str, group: str, replicates: int = BOOTSTRAP_REPLICATES, seed: int = SEED, level: float = BOOTSTRAP_LEVEL
) -> DataFrame:
    """Percentile bootstrap band of a group mean: one estimator (Poisson weights on value counts) for any number of rows and
    distinct values. Rows with a null group or value take no part; a replicate whose weights are all 0 has no mean."""
    base = df.select(F.col(group), F.col(value).cast("double").alias("y")).dropna()
    counts = base.groupBy(group, "y").agg(F.count(F.lit(1)).alias("c"))
    reps = _resampled(counts, group, ["y"], replicates, seed).withColumn("m", F.try_divide("y", "w"))
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    bands = reps.groupBy(group).agg(
        F.percentile(F.when(F.col("b") > 0, F.col("m")), [lo, hi]).alias("q"),
        F.max(F.when(F.col("b") == 0, F.col("m"))).alias("mean"),
        F.max(F.when(F.col("b") == 0, F.col("w"))).alias("n"),
    )
    return bands.select(
        group, F.col("n").cast("long").alias("n"), "mean", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"), F.lit(replicates).alias("replicates")
    )


def regression_band(
    df: DataFrame, x: str, y: str, cap_quantile: float = REGRESSION_CAP, points: int = LINE_POINTS, replicates: int = BOOTSTRAP_REPLICATES, seed: int = SEED, level: float = BOOTSTRAP_LEVEL
) -> DataFrame:
    """A23 on A22: the regression line at ``points`` equal steps of x with its percentile bootstrap band: (x, fit, ci_low, ci_high)."""
    (cap,) = column_quantiles(df, y, [cap_quantile])
    base = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    counts = base.filter(F.col("y") <= F.lit(cap)).groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"))
    ends = counts.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    spark = df.sparkSession
    if ends["lo"] is None:
        return spark.createDataFrame([], "x double, fit double, ci_low double, ci_high double")
    s = _resampled(counts, None, ["x", "y"], replicates, seed)
    spread = F.col("w") * F.col("x_x") - F.col("x") * F.col("x")
    slope = F.try_divide(F.col("w") * F.col("x_y") - F.col("x") * F.col("y"), F.when(spread > 0, spread))
    lines = s.select("b", slope.alias("slope"), F.try_divide("x", "w").alias("mx"), F.try_divide("y", "w").alias("my"))
    step = (ends["hi"] - ends["lo"]) / max(1, points - 1)
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.lit(ends["lo"]) + i * F.lit(step))
    at = lines.select("b", F.explode(grid).alias("x"), "slope", "mx", "my").withColumn("fit", F.col("my") + F.col("slope") * (F.col("x") - F.col("mx")))
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    out = at.groupBy("x").agg(F.max(F.when(F.col("b") == 0, F.col("fit"))).alias("fit"), F.percentile(F.when(F.col("b") > 0, F.col("fit")), [lo, hi]).alias("q"))
    return out.select("x", "fit", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))
