import pytest
from pyspark.sql import functions as F

from canvass.operators import association as asc
from canvass.operators import evaluate as ev
from canvass.operators import profile as pf


def test_mode_tie_takes_smallest(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), ("b",), (None,)], "c string")
    r = pf.category_profile(df, ["c"]).first()
    assert (r["mode"], r["mode_count"], r["n"], r["missing"], r["distinct"]) == ("a", 2, 4, 1, 2)


def test_yates_2x2(spark):
    rows = [("r1", "c1")] * 10 + [("r1", "c2")] * 20 + [("r2", "c1")] * 30 + [("r2", "c2")] * 40
    df = spark.createDataFrame(rows, "v string, t string")
    corrected = asc.chi_square(df, ["v"], "t").first()
    plain = asc.chi_square(df, ["v"], "t", yates=False).first()
    assert corrected.chi2 == pytest.approx(0.4464285714285714)
    assert plain.chi2 == pytest.approx(0.7936507936507936)
    assert corrected.dof == 1
    p = asc.with_chi_square_pvalue(asc.chi_square(df, ["v"], "t")).first().p_value
    assert p == pytest.approx(0.5040358664525046, rel=1e-9)


def test_absent_cells_count_as_zero(spark):
    rows = [("a", "x")] * 5 + [("b", "y")] * 5 + [("c", "x")] * 2 + [("c", "y")] * 3
    df = spark.createDataFrame(rows, "v string, t string")
    r = asc.chi_square(df, ["v"], "t").first()
    # expected counts: a: 3.5/1.5*..., computed independently
    obs = {("a", "x"): 5, ("b", "y"): 5, ("c", "x"): 2, ("c", "y"): 3}
    rt = {"a": 5, "b": 5, "c": 5}
    ct = {"x": 7, "y": 8}
    chi2 = sum((obs.get((v, t), 0) - rt[v] * ct[t] / 15) ** 2 / (rt[v] * ct[t] / 15) for v in rt for t in ct)
    assert r.chi2 == pytest.approx(chi2)
    assert r.dof == 2


def test_anova_textbook(spark):
    groups = {"g1": [2.0, 3.0, 7.0], "g2": [4.0, 5.0, 6.0, 9.0], "g3": [10.0, 12.0]}
    df = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], "g string, x double")
    r = asc.with_anova_pvalue(asc.anova(df, ["x"], "g")).first()
    allx = [x for xs in groups.values() for x in xs]
    grand = sum(allx) / len(allx)
    ssb = sum(len(xs) * (sum(xs) / len(xs) - grand) ** 2 for xs in groups.values())
    sst = sum((x - grand) ** 2 for x in allx)
    f = (ssb / 2) / ((sst - ssb) / (len(allx) - 3))
    assert r.f_statistic == pytest.approx(f)
    assert r.eta_squared == pytest.approx(ssb / sst)
    assert 0 < r.p_value < 1


def test_auc_ties_and_monotone_invariance(spark):
    df = spark.createDataFrame([(i % 2, 0.3) for i in range(10)], "label int, score double")
    assert ev.roc_auc(df, "label", "score").first().roc_auc == pytest.approx(0.5)
    scores = [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.2), (1, 0.2), (0, 0.1)]
    a = spark.createDataFrame(scores, "label int, score double")
    b = a.withColumn("score", F.exp(F.col("score") * 3))
    # brute force: pairs (pos, neg), ties half
    pos = [s for y, s in scores if y == 1]
    neg = [s for y, s in scores if y == 0]
    brute = sum(1.0 if p > q else 0.5 if p == q else 0.0 for p in pos for q in neg) / (len(pos) * len(neg))
    assert ev.roc_auc(a, "label", "score").first().roc_auc == pytest.approx(brute)
    assert ev.roc_auc(b, "label", "score").first().roc_auc == pytest.approx(brute)


def test_roc_prefix_sums_across_many_ranges(spark):
    rows = [(i % 3 == 0 and 1 or 0, float((i * 7919) % 1000)) for i in range(3000)]
    df = spark.createDataFrame(rows, "label int, score double")
    pts = ev.roc_points(df, "label", "score", ranges=16).orderBy(F.col("threshold").desc()).collect()
    assert pts[0].fpr == 0 and pts[0].tpr == 0
    assert pts[-1].fpr == pytest.approx(1.0) and pts[-1].tpr == pytest.approx(1.0)
    # cumulative counts must equal a driver-side brute force
    import collections
    by = collections.Counter()
    for y, s in rows:
        by[(s, y)] += 1
    distinct = sorted({s for _, s in rows}, reverse=True)
    cp = 0
    for s, p in zip(distinct, pts[1:]):
        cp += by[(s, 1)]
        assert p.threshold == s and p.cum_pos == cp


def test_undefined_precision_is_zero(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "label int, pred int")
    r = ev.binary_metrics(df, "label", "pred").first()
    assert (r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0)


def test_bootstrap_is_repeatable(spark):
    df = spark.createDataFrame([(i, "g" + str(i % 2), float(i % 5)) for i in range(200)], "id long, g string, y double")
    fn = lambda d: asc.bootstrap_mean_ci(d, "y", "g", replicates=50)
    a, b = sorted(fn(df).collect()), sorted(fn(df.repartition(7)).collect())
    for x, y in zip(a, b):
        assert (x.g, x.n) == (y.g, y.n) == (x.g, 100)
        assert (x.mean, x.ci_low, x.ci_high) == pytest.approx((y.mean, y.ci_low, y.ci_high))
        assert x.ci_low <= x.mean <= x.ci_high


@pytest.mark.parametrize("distinct", [64, 65])
def test_bootstrap_equals_plain_python_at_any_number_of_values(spark, distinct):
    # the same Poisson weights, drawn one by one in plain Python
    import collections
    import math

    import numpy as np

    ys = [float(i % distinct) for i in range(300)]
    df = spark.createDataFrame([("g", y) for y in ys], "g string, y double")
    r = asc.bootstrap_mean_ci(df, "y", "g", replicates=40, seed=7).first()
    seeds = {x.y: x.h for x in df.select("y", F.xxhash64(F.lit(7), "g", "y").alias("h")).distinct().collect()}
    mask = (1 << 64) - 1

    def draw(h, k, mean):
        z = (h + k * 0x9E3779B97F4A7C15) & mask
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        u = (((z ^ (z >> 31)) >> 11) + 0.5) / 2**53
        n, p = 0, math.exp(-mean)
        while u >= p:
            u -= p
            n += 1
            p = math.exp(-mean + n * math.log(mean) - math.lgamma(n + 1))
        return n

    w, wy = np.zeros(41), np.zeros(41)
    for y, c in collections.Counter(ys).items():
        draws = np.array([c] + [draw(seeds[y] & mask, k, c) for k in range(1, 41)], float)
        w += draws
        wy += draws * y
    low, high = np.percentile((wy / w)[1:], [2.5, 97.5])
    assert (r.ci_low, r.ci_high) == pytest.approx((low, high))
    assert r.mean == pytest.approx(sum(ys) / 300) and r.n == 300


def test_regression_band_holds_the_line(spark):
    rows = [(float(i % 20), 3.0 * (i % 20) + ((i * 37) % 11)) for i in range(400)]
    got = asc.regression_band(spark.createDataFrame(rows, "x double, y double"), "x", "y", cap_quantile=1.0, points=5, replicates=200).orderBy("x").collect()
    assert len(got) == 5 and got[0].x == 0.0 and got[-1].x == 19.0
    assert all(r.ci_low <= r.fit <= r.ci_high for r in got)
    line = asc.regression_line(spark.createDataFrame(rows, "x double, y double"), "x", "y", cap_quantile=1.0).first()
    assert [r.fit for r in got] == pytest.approx([line.intercept + line.slope * r.x for r in got])


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(float(i), 5.0, float(i * i)) for i in range(10)], "a double, c double, `b.x` double")
    got = {(r.var1, r.var2): r for r in asc.correlation_pairs(df, ["a", "c", "b.x"]).collect()}
    assert got[("a", "c")].r is None and got[("a", "c")].strength is None and got[("a", "b.x")].r == pytest.approx(0.9627, abs=1e-3)


def test_poisson_draws_have_their_mean_and_variance():
    import numpy as np

    u = asc.uniform_draws(np.arange(50, dtype=np.uint64), 2000)
    assert 0 < u.min() and u.max() < 1 and len(np.unique(u)) == u.size and u.mean() == pytest.approx(0.5, abs=0.004)
    for mean in (1, 7, 1000, 10**7):
        low, below = asc.poisson_quantiles(mean)
        drawn = low + np.searchsorted(below, u.ravel(), "right")
        assert drawn.mean() == pytest.approx(mean, rel=0.02) and drawn.var() == pytest.approx(mean, rel=0.05)


def test_bootstrap_of_groups_across_blocks(spark, monkeypatch):
    # continuous values, null groups, a group of one row
    rows = [(None if i % 50 == 0 else "ab"[i % 2], i * 0.37) for i in range(600)] + [("c", 5.0), ("c", None)]
    df = spark.createDataFrame(rows, "`the.group` string, y double").withColumnRenamed("the.group", "g")
    got = {r.g: r for r in asc.bootstrap_mean_ci(df, "y", "g", replicates=100).collect()}
    assert set(got) == {"a", "b", "c"} and got["c"].n == 1 and got["c"].ci_low == got["c"].ci_high == 5.0
    assert all(got[g].ci_low < got[g].mean < got[g].ci_high for g in "ab")


def test_histogram_leaves_out_infinite_values(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 1.0, 2.0, float("inf"), float("-inf"), float("nan"), None)], "x double")
    got = pf.histogram(df, "x", bins=2).orderBy("bin").collect()
    assert [(r.lower, r.upper, r.n) for r in got] == [(0.0, 1.0, 1), (1.0, 2.0, 2)]


def test_bootstrap_band_of_a_proportion(spark):
    # 0/1 values: the band must be close to the normal-approximation band
    rows = [(i, "g", float(i % 10 < 3)) for i in range(2000)]
    r = asc.bootstrap_mean_ci(spark.createDataFrame(rows, "id long, g string, y double"), "y", "g").first()
    half = 1.96 * (0.3 * 0.7 / 2000) ** 0.5
    assert r.mean == pytest.approx(0.3)
    assert r.ci_low == pytest.approx(0.3 - half, abs=0.006) and r.ci_high == pytest.approx(0.3 + half, abs=0.006)


def test_approx_profile_path_close_to_exact(spark):
    df = spark.createDataFrame([(float((i * 7919) % 1000),) for i in range(5000)], "x double")
    exact = pf.numeric_summary(df, ["x"]).first()
    approx = pf.numeric_summary(df, ["x"], approx=True).first()
    for k in ("p25", "p50", "p75"):
        assert abs(exact[k] - approx[k]) <= 2.0
    assert exact["count"] == approx["count"] == 5000


def test_correlations_of_many_columns_equal_numpy(spark):
    """300 columns, 44,850 pairs; missing, NaN and infinite values, columns far from 0, constant where the other is present."""
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 300)) + 1e6 * (np.arange(300) % 7 == 0)
    x[:, 1] += 2 * x[:, 2]
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:60, 4], x[60:, 4], x[60:, 5] = 3.25, 7.5, np.nan
    x[3, 9] = np.inf
    names = [f"c.{i}" for i in range(300)]
    rows = [[None if np.isnan(v) and (i + k) % 2 else float(v) for i, v in enumerate(r)] for k, r in enumerate(x)]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names))
    got = {(r.var1, r.var2): (r.n, r.r) for r in asc.correlation_pairs(df.repartition(5), names, min_n=0).collect()}
    assert len(got) == 300 * 299 // 2
    for i in range(0, 300, 3):
        for j in range(i + 1, min(300, i + 12)):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            n, r = got[names[i], names[j]]
            assert n == both.sum()
            if 9 in (i, j) and both[3]:
                assert np.isnan(r)
            else:
                assert r == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)
    assert got["c.4", "c.5"] == (int((~np.isnan(x[:60, 5])).sum()), None)
