import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import ChiSquareTest
from pyspark.sql import functions as F

from canvass.operators import association as asc
from canvass.operators import model as md


def test_planted_signal_ranks_first(spark):
    # y depends on x1 only; x2 and the category are noise
    rows = []
    for i in range(600):
        x1 = ((i * 37) % 101) / 50.0 - 1.0
        x2 = ((i * 53) % 97) / 48.0 - 1.0
        y = 1 if x1 + 0.05 * ((i * 7) % 5 - 2) > 0 else 0
        rows.append((i, x1, x2, ["a", "b", "c"][i % 3], y))
    df = spark.createDataFrame(rows, "id long, x1 double, x2 double, cat string, target int")
    spec = md.FeatureSpec(numeric=["x1", "x2"], categorical=["cat"], passthrough=[], min_frequency=30)
    model = md.logistic_pipeline(df, spec).fit(df)
    coefs = md.coefficient_table(spark, model, spec).orderBy(F.abs("coefficient").desc()).collect()
    assert coefs[0].feature == "num__x1" and coefs[0].coefficient > 0
    scored = md.score(model, df, "id", "target")
    acc = scored.agg(F.avg((F.col("prediction") == F.col("target")).cast("double"))).first()[0]
    assert acc > 0.9


def test_unseen_level_scores_with_zero_onehot(spark):
    train = spark.createDataFrame([(i, float(i % 7), "a" if i % 2 else "b", i % 2) for i in range(200)],
                                  "id long, x double, cat string, target int")
    test = spark.createDataFrame([(1000, 1.0, "zzz", 0)], "id long, x double, cat string, target int")
    spec = md.FeatureSpec(numeric=["x"], categorical=["cat"], passthrough=[], min_frequency=30)
    model = md.logistic_pipeline(train, spec).fit(train)
    assert md.score(model, test, "id", "target").count() == 1


def test_chi_square_pvalue_matches_spark_ml(spark):
    rows = [(("a", "b", "c")[i % 3], ("x", "y")[(i * i) % 2 if i % 5 else 0]) for i in range(300)]
    df = spark.createDataFrame(rows, "v string, t string")
    ours = asc.with_chi_square_pvalue(asc.chi_square(df, ["v"], "t")).first()
    # the same table through ChiSquareTest (no Yates there; dof = 2 here, so none applies)
    codes = {"a": 0.0, "b": 1.0, "c": 2.0}
    vec = spark.createDataFrame([(Vectors.dense([codes[v]]), 1.0 if t == "y" else 0.0) for v, t in rows], ["features", "label"])
    ml = ChiSquareTest.test(vec, "features", "label").first()
    assert ours.dof == 2
    assert ours.chi2 == pytest.approx(float(ml.statistics[0]), rel=1e-9)
    assert ours.p_value == pytest.approx(float(ml.pValues[0]), rel=1e-6, abs=1e-12)


def test_prepare_tables_invariants(spark):
    import __spark_entry__ as E

    r = E.queries()["prepare_tables"](spark, "/root/testdata/sf0.001").first()
    assert r.silver_rows == r.wide_rows and r.long_rows > 0 and r.multiselect_questions >= 2
