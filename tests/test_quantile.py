import pytest
from pyspark.sql import functions as F

from canvass.operators.quantile import exact_quantiles

PROBS = [0.0, 0.005, 0.01, 0.25, 0.5, 0.75, 0.99, 0.995, 1.0]


def test_selection_path_equals_percentile(spark):
    # skewed values with a hot value holding a third of the rows, plus ties
    rows = [("a", float((i * 7919) % 1013) ** 2 / 7.0) for i in range(3000)] + [("a", 42.0)] * 1500
    rows += [("b", float(i % 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "column string, x double")
    got = exact_quantiles(df, PROBS, slice_rows=50, cuts=8)
    want = {r["column"]: r["q"] for r in df.groupBy("column").agg(F.percentile("x", PROBS).alias("q")).collect()}
    for c, qs in want.items():
        for p, v in zip(PROBS, qs):
            assert got[(c, p)] == pytest.approx(v, rel=1e-12, abs=1e-12)


def test_direct_path_and_empty_column(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", None), ("b", None)], "column string, x double")
    got = exact_quantiles(df, [0.5])
    assert got[("a", 0.5)] == pytest.approx(1.5)
    assert got.get(("b", 0.5)) is None


def test_spread_over_all_exponents_stays_within_slices(spark, monkeypatch):
    # values over the whole range of doubles: every gathered slice is bounded all the same
    from canvass.operators import quantile as q

    rows = [("a", 2.0 ** (i / 4 - 700)) for i in range(6000)]
    df = spark.createDataFrame(rows, "column string, x double")
    seen = []
    read = q._read_off
    monkeypatch.setattr(q, "_read_off", lambda base, ss: (seen.extend(s.rows for s in ss), read(base, ss))[1])
    got = q.exact_quantiles(df, [0.5, 0.99], slice_rows=200)
    want = df.agg(F.percentile("x", [0.5, 0.99])).first()[0]
    assert max(seen) <= 200
    assert [got[("a", 0.5)], got[("a", 0.99)]] == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("slice_rows", [1, 10, 100_000])
def test_result_does_not_depend_on_slice_size(spark, slice_rows):
    df = spark.createDataFrame([("a", float((i * 37) % 101)) for i in range(500)], "column string, x double")
    want = df.agg(F.percentile("x", PROBS)).first()[0]
    got = exact_quantiles(df, PROBS, slice_rows=slice_rows, cuts=4)
    assert [got[("a", p)] for p in PROBS] == pytest.approx(want, rel=1e-12)
