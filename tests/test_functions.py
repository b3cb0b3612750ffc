import math

import pytest
from pyspark.sql import functions as F

from canvass.functions import scalars as sc
from canvass.functions.tails import chi2_sf, f_sf, pearson_p


def test_name_rule():
    assert sc.name_rule("X in Y z") == "XInYZ"
    assert sc.name_rule("AITool Interested in Using") == "AIToolInterestedInUsing"
    assert sc.name_rule("NoSpace") == "NoSpace"


def test_name_rule_column_matches_python(spark):
    names = ["X in Y z", "a  b", "", "single", "straße über"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(sc.name_rule_col(F.col("n"))).collect()]
    assert got == [sc.name_rule(n) for n in names]


def test_tail_probabilities_textbook():
    assert chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert chi2_sf(18.307038, 10) == pytest.approx(0.05, abs=1e-7)
    assert f_sf(4.351243, 1, 20) == pytest.approx(0.05, abs=1e-6)
    assert pearson_p(0.0, 30) == pytest.approx(1.0)
    assert math.isnan(pearson_p(0.5, 2))


def test_right_closed_bins(spark):
    df = spark.createDataFrame([(3.0,), (3.1,), (10.0,), (100.0,), (101.0,), (-1.0,)], "x double")
    band = sc.right_closed_band(F.col("x"), [-1, 3, 10, 100], ["b1", "b2", "b3"])
    assert [r[0] for r in df.select(band).collect()] == ["b1", "b2", "b2", "b3", None, None]


def test_first_edge_included(spark):
    df = spark.createDataFrame([(0.0,), (2.0,), (2.5,)], "x double")
    band = sc.right_closed_band(F.col("x"), [0, 2, 5], ["a", "b"], include_lowest=True)
    assert [r[0] for r in df.select(band).collect()] == ["a", "a", "b"]


def test_sentinels_strict_and_lenient(spark):
    df = spark.createDataFrame([("Less than 1 year",), ("More than 50 years",), ("7",), (None,)], "y string")
    strict = [r[0] for r in df.select(sc.strict_sentinel_number(F.col("y"), "y")).collect()]
    assert strict == [0.5, 51.0, 7.0, None]
    bad = spark.createDataFrame([("about ten",)], "y string")
    with pytest.raises(Exception):
        bad.select(sc.strict_sentinel_number(F.col("y"), "y")).collect()
    assert bad.select(sc.lenient_number(F.col("y"))).first()[0] is None


def test_ordinal_unlisted_raises(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    m = {"a": 1.0, "b": None}
    assert [r[0] for r in df.select(sc.ordinal_code(F.col("c"), m, "c")).collect()] == [1.0, None, None]
    with pytest.raises(Exception):
        spark.createDataFrame([("z",)], "c string").select(sc.ordinal_code(F.col("c"), m, "c")).collect()


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-5.0,), (50.0,)], "x double")
    assert [r[0] for r in df.select(sc.clip_keep_null(F.col("x"), 0, 10)).collect()] == [None, 0.0, 10.0]


def test_violations_name_columns_counts_and_first_values(spark, tmp_path):
    from canvass.operators import clean as cl
    from canvass.operators import prepare

    rows = [(i, f"bad {i % 7}" if i % 3 == 0 else "4", ["low", "high", "odd", None][i % 4], "x;y") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, `years coding` string, level string, tools string")
    ordinals = {"level": {"low": 1.0, "high": None}}
    got = {r.column_name: r for r in cl.violations(df, ["years coding"], ordinals).collect()}
    assert (got["years coding"].n_rows, got["years coding"].n_values) == (20, 7) and got["years coding"].examples == [f"bad {i}" for i in range(5)]
    assert got["level"].asDict() == {"column_name": "level", "rule": "label", "n_rows": 15, "n_values": 1, "examples": ["odd"]}
    assert cl.violations(df.limit(0), ["years coding"], ordinals).count() == 0 == cl.violations(df).count()
    assert cl.violations(df, [], {"level": {"low": 1.0, "high": None, "odd": 2.0}}).count() == 0
    with pytest.raises(ValueError, match="(?s)level: 15 cells.*'odd'.*yearsCoding: 20 cells, 7 values are not a number: 'bad 0', 'bad 1'"):
        prepare.prepare(df, str(tmp_path), "id", sentinel_cols=["yearsCoding"], ordinals=ordinals)
