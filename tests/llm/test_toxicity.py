import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from canvass.llm import toxicity as tx
from tests.llm.helpers import ODD, documents, sentence

INSULTS = ["scum", "idiot", "moron", "trashling"]


def corpus(spark, n=600):
    rng = random.Random(3)
    texts, grades = [], []
    for i in range(n):
        w = sentence(rng, rng.randrange(5, 80), 300).split()
        g = (0, 0, 0, 1, 2)[i % 5]
        for _ in range(3 * g):
            w.insert(rng.randrange(len(w)), rng.choice(INSULTS[: 2 * g]) + rng.choice(["", "!", "s"]))
        texts.append(" ".join(w))
        grades.append(g)
    return texts, grades


def test_grades_of_held_out_texts(spark):
    texts, grades = corpus(spark)
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, g) for i, g in enumerate(grades) if i % 2], "doc_id long, grade int")
    model = tx.train(docs, labels, "grade")
    assert (np.diff(model.thresholds) >= 0).all() and len(model.thresholds) == 2
    got = {r.doc_id: r for r in tx.score(spark, docs, model, ["doc_id"]).collect()}
    held = [i for i in range(len(texts)) if not i % 2]
    assert np.mean([(got[i].p_toxic >= tx.TOXIC) == (grades[i] > 0) for i in held]) > 0.97
    mean = [np.mean([got[i].expected_severity for i in held if grades[i] == g]) for g in (0, 1, 2)]
    assert mean[0] < 0.2 < mean[1] < mean[2]


def test_flags_are_graded_and_clean_texts_stay(spark):
    texts, grades = corpus(spark)
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(g > 0)) for i, g in enumerate(grades)], "doc_id long, toxic int")
    model = tx.train(docs, labels, "toxic", flags=True)
    rows = tx.score(spark, docs, model, ["doc_id"]).withColumn("hit", F.col("p_toxic") >= tx.TOXIC).collect()
    assert np.mean([r.hit for r in rows if grades[r.doc_id] == 0]) == 0
    assert np.mean([r.hit for r in rows if grades[r.doc_id] > 0]) > 0.97
    long = documents(spark, [" ".join(t for t, g in zip(texts, grades) if g == 0)])  # clean words don't add up
    assert tx.score(spark, long, model, ["doc_id"]).first().p_toxic < tx.TOXIC


def test_odd_rows(spark):
    texts, grades = corpus(spark, 60)
    docs = documents(spark, [*texts, *ODD, texts[4]], ids=[*range(60), *[None] * len(ODD), 4]).withColumnRenamed("lang", "severity")
    labels = spark.createDataFrame([(i, g) for i, g in enumerate(grades)] + [(None, 1), (3, None), (4, 0), (999, 2)], "doc_id long, grade int")
    model = tx.train(docs, labels, "grade", max_rows=40)
    rows = tx.score(spark, docs, model, ["doc_id", "severity"]).collect()
    assert len(rows) == 61 + len(ODD)
    empty = [r for r in tx.score(spark, documents(spark, [None, "", "  "]), model, ["doc_id"]).collect()]
    assert [(r.p_toxic, r.expected_severity, r.severity) for r in empty] == [(0.0, 0.0, 0)] * 3


def test_no_labels_and_one_grade(spark):
    docs = documents(spark, ["a b", "c"])
    none = spark.createDataFrame([], "doc_id long, grade int")
    assert tx.train(docs, none, "grade") is None
    assert [r.p_toxic for r in tx.score(spark, docs, None, ["doc_id"]).collect()] == [0.0, 0.0]
    same = tx.train(docs, spark.createDataFrame([(0, 0), (1, 0)], "doc_id long, grade int"), "grade")
    assert all(r.p_toxic < 0.5 for r in tx.score(spark, docs, same, ["doc_id"]).collect())
    assert tx.score(spark, documents(spark, []), same, ["doc_id"]).count() == 0


def test_gradient_steps_reach_the_likelihood_s_maximum():
    # one feature, two grades above 0: shares can be met exactly
    rng = np.random.default_rng(1)
    has = rng.random(4000) < 0.5
    grade = np.where(has, rng.choice([0, 1, 2], 4000, p=[0.2, 0.3, 0.5]), rng.choice([0, 1, 2], 4000, p=[0.8, 0.15, 0.05]))
    bounds = np.concatenate([[0], np.cumsum(has)])
    model = tx.fit(np.zeros(has.sum(), np.int64), bounds, grade, bits=4, steps=600)
    up = model.above(np.array([0.0, model.weights[0]]))
    assert up[1, 0] == pytest.approx((grade[has] > 0).mean(), abs=0.05) and up[0, 0] == pytest.approx((grade[~has] > 0).mean(), abs=0.05)
