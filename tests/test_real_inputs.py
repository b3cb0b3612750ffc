"""Inputs that real questionnaires hold: odd names, odd cells, odd numbers, odd ids."""

import math

import pytest
from pyspark.sql import functions as F

from canvass.functions import scalars as sc
from canvass.operators import clean as cl
from canvass.operators import evaluate as ev
from canvass.operators import features as ft
from canvass.operators import boosting
from canvass.operators import model as md
from canvass.operators import multiselect as ms
from canvass.operators import split as sp
from canvass.sources import csv as csvsrc
from canvass.sources import sinks

OPTIONS = ["Node.js", ".NET (5+)", "O'Reilly", "a`b", "back\\slash", "std lib", "\tb"]


def answers(spark):
    rows = [(i, OPTIONS[i % 7] + ";" + OPTIONS[(i + 3) % 7], "" if i % 2 else None, i % 2) for i in range(70)]
    return spark.createDataFrame(rows, "id long, `Lang Have.x` string, `Only.Empty` string, target int")


def test_option_and_column_names(spark):
    df = answers(spark)
    assert {r.column_name: r.is_multiselect for r in ms.detect_multiselect(df).collect()} == {"Lang Have.x": True, "Only.Empty": False}
    questions = ["Only.Empty", "Lang Have.x"]
    vocab = ms.collect_vocabulary(ms.unfold_long(df, "id", questions))
    wide = ms.multihot(df, ["id", "target"], vocab, questions=questions)
    assert wide.columns == ["id", "target", "Only.Empty__answered", "Lang Have.x__answered", *[f"Lang Have.x__{o}" for o in sorted(OPTIONS)]]
    rows = wide.orderBy("id").collect()
    for r in rows:
        chosen = {OPTIONS[r.id % 7], OPTIONS[(r.id + 3) % 7]}
        assert {o for o in OPTIONS if r[f"Lang Have.x__{o}"]} == chosen and r["Only.Empty__answered"] == bool(r.id % 2)
    spec = md.FeatureSpec([], [], [c for c in wide.columns[3:]])
    model = md.logistic_pipeline(wide, spec).fit(wide)
    names = [r.feature for r in md.coefficient_table(spark, model, spec).collect()]
    assert names == [f"remainder__{c}" for c in wide.columns[3:]]
    assert md.score(model, wide, "id", "target").count() == 70


def test_trimmed_options(spark):
    df = spark.createDataFrame([(1, "\tb;b; b ;c d")], "id long, q string")
    assert sorted(r.option for r in ms.explode_trimmed(df, "q").collect()) == ["b", "b", "b", "c d"]


@pytest.mark.parametrize("text, number", [("10", 10.0), ("-1.5e2", -150.0), (" 7 ", 7.0), (".5", 0.5), ("10d", None), ("NaN", None), ("0x1p3", None), ("inf", None), ("1f", None), ("", None)])
def test_number_text(spark, text, number):
    df = spark.createDataFrame([(text,)], "x string")
    assert df.select(sc.lenient_number(F.col("x"))).first()[0] == number
    strict = df.select(sc.strict_sentinel_number(F.col("x"), "x"))
    if number is None:
        with pytest.raises(Exception, match="not a number"):
            strict.collect()
    else:
        assert strict.first()[0] == number


@pytest.mark.parametrize("name, want", [("X in Y", "XInY"), ("a  b", "aB"), (" a", "A"), ("a ", "a"), ("one", "one"), ("", ""), ("ä öü", "äÖü")])
def test_name_rule(spark, name, want):
    assert sc.name_rule(name) == want
    assert spark.createDataFrame([(name,)], "n string").select(sc.name_rule_col(F.col("n"))).first()[0] == want


def test_tier_of_nan_is_lowest(spark):
    df = spark.createDataFrame([(float("nan"),), (0.4,), (None,)], "v double")
    assert [r[0] for r in df.select(sc.tier(F.col("v"), 0.3, 0.1)).collect()] == ["weak", "strong", "weak"]


CELLS = [(1, " a;b "), (2, "x\ny"), (3, ""), (4, None), (5, 'q"uo,te'), (6, "NA"), (7, "None"), (8, "N/A"), (9, "\\")]


def test_csv_cells_come_back(spark, tmp_path):
    df = spark.createDataFrame(CELLS, "id long, cell string")
    assert sorted(map(tuple, sinks.csv_roundtrip(df, f"{tmp_path}/a").collect())) == CELLS
    path = csvsrc.write_exact_na(df, f"{tmp_path}/b")
    back = csvsrc.read_exact_na(spark, path, ["cell", "id"], multi_line=True)
    assert back.columns == ["cell", "id"]
    want = {str(i): None if c in (None, "NA") else c for i, c in CELLS}
    assert {r.id: r.cell for r in back.collect()} == want


def test_families_wide_and_long(spark):
    wide = spark.createDataFrame([(1, 2, 3, 4)], ["AIBen", "AIBen__answered", "AIBenefit", "x"])
    assert cl.drop_family(wide, ["AIBen"]).columns == ["AIBenefit", "x"]
    long = spark.createDataFrame([(q,) for q in ["AIBen", "AIBen__answered", "AIBenefit", None]], "question string")
    assert sorted(str(r[0]) for r in cl.drop_family(long, ["AIBen"], "question").collect()) == ["AIBenefit", "None"]
    for df, col in ((wide, None), (long, "question")):
        with pytest.raises(ValueError, match="absent|families"):
            cl.drop_family(df, ["nothing"], col)


def test_null_ids_stay_in_a_split(spark):
    df = spark.createDataFrame([(i if i % 4 else None, i % 2, f"r{i}") for i in range(40)], "id long, y int, other string")
    rows = sp.stratified_split(df, "id", "y").collect()
    assert sorted(r.other for r in rows) == sorted(f"r{i}" for i in range(40)) and sum(r.split == "test" for r in rows) == 8
    assert sp.seeded_sample(df, "id", 25).count() == 25
    with pytest.raises(ValueError, match="training part"):
        sp.require_disjoint(spark.createDataFrame([(1, "train"), (1, "test")], "id long, split string"), "id")


def test_infinite_scores(spark):
    rows = [(1, math.inf), (0, -math.inf), (1, 0.5), (0, 0.5), (1, math.inf), (0, math.inf), (1, None), (0, math.nan)]
    df = spark.createDataFrame(rows, "label int, score double")
    kept = [(y, s) for y, s in rows if s is not None and not math.isnan(s)]
    pos, neg = [s for y, s in kept if y], [s for y, s in kept if not y]
    want = sum(1.0 if p > q else 0.5 if p == q else 0.0 for p in pos for q in neg) / (len(pos) * len(neg))
    assert ev.roc_auc(df, "label", "score").first().roc_auc == pytest.approx(want)


def test_column_without_values(spark):
    df = spark.createDataFrame([(i, None, float(i)) for i in range(5)], "id long, x double, y double")
    fitted = ft.fit_numeric(df, ft.linear_track(winsor="x", log=["x"], raw=["y"]))
    assert fitted[0].median is None and fitted[1].median == 2.0
    with pytest.raises(Exception, match="null after imputation"):
        ft.apply_numeric(df, fitted, ["id"]).collect()


def test_trees_take_many_levels_and_missing_numbers(spark):
    rows = [(i, None if i % 3 == 0 else float(i % 50), f"level {i % 20_000}", int(i % 50 > 24 and i % 3 > 0)) for i in range(24_000)]
    df = spark.createDataFrame(rows, "id long, x double, c string, target int")
    model = boosting.fit(md.bounded_rows(df, "id", 20_000), boosting.Columns(["x"], ["c"], []), trees=3, depth=3)
    got = model.score(df, "id")
    assert got.agg(F.avg((F.col("prediction") == F.col("target")).cast("double"))).first()[0] > 0.95


def test_regression_metrics_of_a_written_prediction_table(spark):
    from canvass.plans.catalog import CATALOG, logistic_predictions

    sf = "/root/testdata/sf0.001"
    rows = logistic_predictions(spark, sf).collect()
    got = CATALOG["logistic_test_metrics"](spark, sf).first()
    tp = sum(r.target == 1 == r.prediction for r in rows)
    fp, fn = sum(r.prediction > r.target for r in rows), sum(r.prediction < r.target for r in rows)
    pos, neg = [r.probability for r in rows if r.target], [r.probability for r in rows if not r.target]
    auc = sum(1.0 if p > q else 0.5 if p == q else 0.0 for p in pos for q in neg) / (len(pos) * len(neg))
    assert got.accuracy == pytest.approx(1 - (fp + fn) / len(rows)) and got.roc_auc == pytest.approx(auc)
    assert got.f1 == pytest.approx(2 * tp / (2 * tp + fp + fn) if tp else 0.0) and got.n == len(rows)
