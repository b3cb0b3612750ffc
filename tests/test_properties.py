"""Property tests: each operator against a plain-Python statement of the rule."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from canvass.functions import scalars as sc
from canvass.operators import multiselect as ms
from canvass.operators.quantile import exact_quantiles

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
TEXT = st.text(alphabet="ab zAéüß", max_size=12)


@SETTINGS
@given(st.lists(TEXT, min_size=1, max_size=20))
def test_name_rule_column_equals_python(spark, names):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    got = [r[0] for r in df.orderBy("i").select(sc.name_rule_col(F.col("n"))).collect()]
    assert got == [sc.name_rule(n) for n in names]


def _band(x, edges, labels, include_lowest):
    for i, lab in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        if (lo <= x if (i == 0 and include_lowest) else lo < x) and x <= hi:
            return lab
    return None


@SETTINGS
@given(st.lists(st.floats(min_value=-5, max_value=70, allow_nan=False), min_size=1, max_size=30), st.booleans())
def test_right_closed_band_equals_python(spark, xs, lowest):
    edges, labels = [0, 2, 5, 10, 15, 20, 30, 60], ["a", "b", "c", "d", "e", "f", "g"]
    xs = xs + [float(e) for e in edges]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    got = [r[0] for r in df.orderBy("i").select(sc.right_closed_band(F.col("x"), edges, labels, lowest)).collect()]
    assert got == [_band(x, edges, labels, lowest) for x in xs]


CELL = st.one_of(st.none(), st.lists(st.sampled_from(["a", "b", " c", ""]), max_size=4).map(";".join))


@SETTINGS
@given(st.lists(CELL, min_size=1, max_size=25))
def test_unfold_long_equals_python(spark, cells):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "id long, q string")
    got = sorted((r.id, r.value) for r in ms.unfold_long(df, "id", ["q"]).collect())
    want = sorted((i, t) for i, c in enumerate(cells) if c is not None for t in c.split(";") if t != "")
    assert got == want


def _linear(values, p):
    v = sorted(values)
    h = (len(v) - 1) * p
    lo, hi = math.floor(h), math.ceil(h)
    return v[lo] if lo == hi else (hi - h) * v[lo] + (h - lo) * v[hi]


@SETTINGS
@given(st.lists(st.integers(min_value=-1000, max_value=1000), min_size=1, max_size=200))
def test_exact_quantiles_selection_equals_python(spark, ints):
    values = [x / 8.0 for x in ints]
    df = spark.createDataFrame([("c", x) for x in values], "column string, x double")
    probs = [0.0, 0.01, 0.5, 0.99, 1.0]
    got = exact_quantiles(df, probs, slice_rows=3, cuts=4)
    for p in probs:
        assert math.isclose(got[("c", p)], _linear(values, p), rel_tol=1e-12, abs_tol=1e-12)


def _chi2_brute(pairs):
    rows = sorted({v for v, _ in pairs})
    cols = sorted({t for _, t in pairs})
    n = len(pairs)
    obs = {}
    for p in pairs:
        obs[p] = obs.get(p, 0) + 1
    rt = {r: sum(obs.get((r, c), 0) for c in cols) for r in rows}
    ct = {c: sum(obs.get((r, c), 0) for r in rows) for c in cols}
    dof = (len(rows) - 1) * (len(cols) - 1)
    if dof == 0:
        return 0.0, 0
    total = 0.0
    for r in rows:
        for c in cols:
            e = rt[r] * ct[c] / n
            d = abs(obs.get((r, c), 0) - e)
            if dof == 1:
                d = max(d - 0.5, 0.0)
            total += d * d / e
    return total, dof


PAIRS = st.lists(st.tuples(st.sampled_from("abcd"), st.sampled_from("xyz")), min_size=2, max_size=120)


@SETTINGS
@given(PAIRS, st.booleans())
def test_chi_square_equals_full_grid(spark, pairs, two_by_two):
    from canvass.operators.association import chi_square

    if two_by_two:
        pairs = [("a" if v in "ab" else "c", "x" if t == "x" else "y") for v, t in pairs]
    df = spark.createDataFrame(pairs, "v string, t string")
    r = chi_square(df, ["v"], "t").first()
    chi2, dof = _chi2_brute(pairs)
    assert r.dof == dof
    assert math.isclose(r.chi2, chi2, rel_tol=1e-9, abs_tol=1e-9)


GROUPS = st.lists(st.tuples(st.sampled_from("pqr"), st.integers(min_value=-50, max_value=50)), min_size=4, max_size=80)


@SETTINGS
@given(GROUPS)
def test_anova_equals_python(spark, rows):
    from canvass.operators.association import anova

    data = [(g, x / 4.0) for g, x in rows]
    df = spark.createDataFrame(data, "g string, x double")
    got = anova(df, ["x"], "g").collect()
    groups = {}
    for g, x in data:
        groups.setdefault(g, []).append(x)
    if len(groups) < 2:
        assert got == []
        return
    xs = [x for _, x in data]
    n, k = len(xs), len(groups)
    grand = sum(xs) / n
    ssb = sum(len(v) * (sum(v) / len(v) - grand) ** 2 for v in groups.values())
    ssw = sum(sum((x - sum(v) / len(v)) ** 2 for x in v) for v in groups.values())
    r = got[0]
    assert (r.n, r.k) == (n, k)
    if ssb + ssw > 0:
        assert math.isclose(r.eta_squared, ssb / (ssb + ssw), rel_tol=1e-9, abs_tol=1e-12)
    if n > k and ssw > 1e-9:
        assert math.isclose(r.f_statistic, (ssb / (k - 1)) / (ssw / (n - k)), rel_tol=1e-7, abs_tol=1e-9)


PAIRS_NUM = st.lists(
    st.tuples(st.one_of(st.none(), st.integers(-20, 20)), st.one_of(st.none(), st.integers(-20, 20))), min_size=3, max_size=60
)


@SETTINGS
@given(PAIRS_NUM)
def test_correlation_pairwise_complete_equals_python(spark, rows):
    from canvass.operators.association import correlation_pairs

    df = spark.createDataFrame([(None if a is None else float(a), None if b is None else float(b)) for a, b in rows], "a double, b double")
    got = correlation_pairs(df, ["a", "b"], min_n=0).first()
    both = [(a, b) for a, b in rows if a is not None and b is not None]
    assert got.n == len(both)
    if len(both) >= 2:
        ma = sum(a for a, _ in both) / len(both)
        mb = sum(b for _, b in both) / len(both)
        sab = sum((a - ma) * (b - mb) for a, b in both)
        saa = sum((a - ma) ** 2 for a, _ in both)
        sbb = sum((b - mb) ** 2 for _, b in both)
        if saa > 0 and sbb > 0:
            assert math.isclose(got.r, sab / math.sqrt(saa * sbb), rel_tol=1e-9, abs_tol=1e-12)


@SETTINGS
@given(st.lists(st.sampled_from([0, 0, 0, 1, 2]), min_size=1, max_size=150))
def test_stratified_split_equals_python(spark, labels):
    import hashlib

    from canvass.operators import split as sp

    df = spark.createDataFrame(list(enumerate(labels)), "id long, y int")
    got = {r.id for r in sp.stratified_split(df, "id", "y").collect() if r.split == "test"}
    counts = {}
    for y in labels:
        counts[y] = counts.get(y, 0) + 1
    quotas = sp.largest_remainder_quotas(counts, math.ceil(0.2 * len(labels)))
    want = set()
    for y, q in quotas.items():
        ids = sorted((hashlib.md5(f"42:{i}".encode()).hexdigest(), i) for i, lab in enumerate(labels) if lab == y)
        want |= {i for _, i in ids[:q]}
    assert got == want and len(got) == math.ceil(0.2 * len(labels))


@SETTINGS
@given(st.lists(st.integers(min_value=0, max_value=400), min_size=2, max_size=120), st.integers(min_value=1, max_value=12))
def test_histogram_equals_python(spark, ints, bins):
    from canvass.operators.profile import histogram

    xs = [i / 7.0 for i in ints]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = {r.bin: r.n for r in histogram(df, "x", bins=bins).collect()}
    lo, hi = min(xs), max(xs)
    w = (hi - lo) / bins if hi > lo else 1.0
    want = {b: 0 for b in range(bins)}
    for x in xs:
        b = max(i for i in range(bins) if lo + i * w <= x)  # edge_i <= x < edge_i+1; last bin closed
        want[b] += 1
    assert got == want


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.sampled_from(["a", "b", "c", "B", "é"])), min_size=1, max_size=60))
def test_category_profile_equals_python(spark, values):
    from canvass.operators.profile import category_profile

    df = spark.createDataFrame([(v,) for v in values], "c string")
    got = category_profile(df, ["c"]).collect()
    known = [v for v in values if v is not None]
    if not known:
        assert got == []
        return
    counts = {}
    for v in known:
        counts[v] = counts.get(v, 0) + 1
    top = max(counts.values())
    r = got[0]
    assert (r.n, r.missing, r.distinct, r.mode_count) == (len(known), len(values) - len(known), len(counts), top)
    assert r.mode == min(v for v, c in counts.items() if c == top)
