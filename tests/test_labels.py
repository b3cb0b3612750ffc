from canvass.operators import labels

CODEBOOK = {"years": "How many years?", "seg": "Segment?", "tools": "Which tools?"}
WANT = {
    "num__years_log": ("How many years?", "log scale"),
    "num__yearsNum": ("How many years? (ordinal)", "numeric"),
    "num__spend": ("spend", "numeric"),
    "cat__seg_two_x": ("seg_two", "-> x"),
    "cat__seg_x_y": ("Segment?", "-> x_y"),
    "cat__seg_Missing": ("Segment?", "-> (no answer)"),
    "cat__seg_infrequent": ("Segment?", "-> (rare levels)"),
    "cat__other_x": ("other_x", None),
    "remainder__tools__answered": ("By hand", "answered"),
    "remainder__tools__a__b\nc": ("By hand", "-> a__b\nc"),
    "remainder__years_missing": ("How many years?", "missing"),
    "remainder__years_any": ("How many years?", "above zero"),
    "remainder__seg": ("Segment?", None),
    "plain": ("plain", None),
    None: (None, None),
}


def test_every_form_of_a_feature_name(spark):
    df = spark.createDataFrame([(k, 1) for k in WANT], "`a feature.name` string, base int")
    got = labels.label_features(df, "a feature.name", CODEBOOK, ["seg", "seg_two"], {"tools": "By hand"}).collect()
    assert {r[0]: (r.question, r.detail) for r in got} == WANT and all(r.base == 1 for r in got)


def test_without_labels_or_categories(spark):
    df = spark.createDataFrame([("cat__a_b",), ("num__a",)], "feature string")
    assert {(r.question, r.detail) for r in labels.label_features(df, "feature", {}, []).collect()} == {("a_b", None), ("a", "numeric")}
