import math

from pyspark.sql import functions as F

from canvass.operators import features as ft
from canvass.operators import split as sp


def _table(spark, n=503):
    return spark.createDataFrame([(i, int(i % 10 < 6)) for i in range(n)], "id long, y int")


def test_split_is_exact_and_repeatable(spark):
    df = _table(spark)
    base = None
    for parts in (1, 3, 7):
        s = sp.stratified_split(df.repartition(parts), "id", "y")
        test_ids = sorted(r.id for r in s.filter(F.col("split") == "test").collect())
        assert len(test_ids) == math.ceil(0.2 * 503)
        base = base or test_ids
        assert test_ids == base
    s = sp.stratified_split(df, "id", "y")
    r = sp.split_disjoint(s, "id").first()
    assert r.n_overlap == 0 and r.n_train + r.n_test == 503


def test_largest_remainder():
    q = sp.largest_remainder_quotas({0: 201, 1: 302}, 101)
    assert sum(q.values()) == 101 and q == {0: 40, 1: 61}


def test_folds_are_balanced(spark):
    folds = sp.stratified_folds(_table(spark, 500), "id", "y", k=5)
    sizes = {r.fold: r.n for r in folds.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    assert sizes == {0: 100, 1: 100, 2: 100, 3: 100, 4: 100}


def test_linear_fit_apply(spark):
    rows = [(i, float(i) if i % 7 else None, float(i % 4)) for i in range(1, 201)]
    df = spark.createDataFrame(rows, "id long, x double, z double")
    fitted = ft.fit_numeric(df, ft.linear_track(winsor="x", log=["x"], any_flag=["z"], raw=["z"]))
    low, high = fitted[0].bounds
    assert low <= high
    out = ft.apply_numeric(df, fitted, ["id"])
    assert out.filter(F.col("x_log").isNull()).count() == 0
    hi = math.log1p(high)
    assert out.agg(F.max("x_log")).first()[0] <= hi + 1e-12
    flags = out.agg(F.sum("x_missing"), F.sum("z_any")).first()
    assert flags[0] == len([r for r in rows if r[1] is None])
    assert flags[1] == len([r for r in rows if r[2] > 0])


def test_unseen_level_is_null(spark):
    train = spark.createDataFrame([("a",)] * 30 + [("b",)] * 2, "c string")
    test = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "c string")
    levels = ft.fit_levels(train, "c")
    got = sorted(((r.c, r.lvl) for r in ft.fold_rare_levels(test, "c", levels, 30, "lvl").collect()), key=str)
    assert got == sorted([("a", "a"), ("b", "infrequent"), ("z", None), (None, None)], key=str)


def test_seeded_sample_equals_ordered_limit(spark):
    df = _table(spark, 700)
    want = [r.id for r in df.orderBy(sp.seeded_order("id"), "id").limit(123).collect()]
    for parts in (1, 5):
        got = sorted(r.id for r in sp.seeded_sample(df.repartition(parts), "id", 123).collect())
        assert got == sorted(want)
    assert sp.seeded_sample(df, "id", 10_000).count() == 700
