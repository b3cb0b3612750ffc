"""Models: L2 logistic regression, cross-validation, coefficient
tables and a save/reload check (X3, X6, X15, S7). Boosted trees (X7) are in ``boosting``.

Statistics that the reference fits inside its preprocessing pipeline (means,
population sds, level counts) are fitted here on the training rows with one
aggregate, then frozen into a ``SQLTransformer`` stage, so the whole
``PipelineModel`` - preprocessing included - is saved, reloaded and applied
as one unit. Model fitting itself is Spark ML (distributed gradient passes,
L-BFGS state on the driver).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass import fixed
from canvass.functions.guards import collect_bounded
from canvass.operators import evaluate as ev
from canvass.operators.features import INFREQUENT, MISSING
from canvass.session import checkpoint_root

SEED = fixed.SEED


@dataclass(frozen=True)
class FeatureSpec:
    """Column roles of a model table."""

    numeric: Sequence[str]
    categorical: Sequence[str]
    passthrough: Sequence[str]
    label: str = "target"
    min_frequency: int = fixed.MIN_FREQUENCY


def _quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _named(spec: FeatureSpec) -> list[tuple[str, str, str]]:
    """(role, source column, safe column) of every input: stages see only generated names, since ML stages
    read a dot in a name as a struct field."""
    roles = [("num", spec.numeric), ("cat", spec.categorical), ("remainder", spec.passthrough)]
    return [(role, c, f"f{role[0]}{i}") for role, cols in roles for i, c in enumerate(cols)]


def _source(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def _prepare_statement(train: DataFrame, spec: FeatureSpec, standardize: bool, missing: str, fold_rare: bool, max_levels: int = 10_000) -> str:
    """Fit on ``train``: mean / population sd of numerics (``standardize``) and the frequent levels of each categorical (``fold_rare``;
    a one-hot model is as wide as its levels, hence the bound); return the frozen SQL that applies them."""
    named = _named(spec)
    numeric = [(c, safe) for role, c, safe in named if role == "num"]
    exprs = ["*"]
    stats = {}
    if standardize and numeric:
        row = train.agg(*[x for c, safe in numeric for x in (F.avg(_source(c)).alias(f"m_{safe}"), F.stddev_pop(_source(c)).alias(f"s_{safe}"))]).first()
        stats = {safe: (row[f"m_{safe}"] or 0.0, row[f"s_{safe}"] if row[f"s_{safe}"] else 1.0) for _, safe in numeric}
    for c, safe in numeric:
        m, s = stats.get(safe, (0.0, 1.0))
        exprs.append(f"(CAST({_source(c)} AS DOUBLE) - {m!r}) / {s!r} AS {safe}" if stats else f"CAST({_source(c)} AS DOUBLE) AS {safe}")
    for role, c, safe in named:
        if role == "remainder":
            exprs.append(f"CAST({_source(c)} AS DOUBLE) AS {safe}")
        if role != "cat":
            continue
        filled = f"COALESCE(CAST({_source(c)} AS STRING), {_quote(missing)})"
        if fold_rare:
            level = F.coalesce(F.col(_source(c)).cast("string"), F.lit(missing))
            counts = train.groupBy(level.alias("v")).count().filter(F.col("count") < spec.min_frequency)
            rare = [r["v"] for r in collect_bounded(counts, max_levels, c)]
            if rare:
                filled = f"CASE WHEN {filled} IN ({', '.join(map(_quote, rare))}) THEN {_quote(INFREQUENT)} ELSE {filled} END"
        exprs.append(f"{filled} AS {safe}_lvl")
    return "SELECT " + ", ".join(exprs) + " FROM __THIS__"


def logistic_pipeline(
    train: DataFrame, spec: FeatureSpec, c: float = fixed.C, max_iter: int = fixed.MAX_ITER, tol: float = 1e-6
) -> Pipeline:
    """Standardized numerics (ddof 0), one-hot categoricals with rare levels
    folded (unseen levels -> all zeros), passthrough 0/1 columns, and an L2
    logistic regression equal to C=1 of the common liblinear/lbfgs objective:
    regParam = 1 / (C n), unpenalised intercept, no internal standardization."""
    n = train.count()
    cats = [safe for role, _, safe in _named(spec) if role == "cat"]
    stages = [SQLTransformer(statement=_prepare_statement(train, spec, True, MISSING, True))]
    if cats:
        stages += [
            StringIndexer(
                inputCols=[f"{x}_lvl" for x in cats], outputCols=[f"{x}_idx" for x in cats],
                handleInvalid="keep", stringOrderType="alphabetAsc",
            ),
            OneHotEncoder(inputCols=[f"{x}_idx" for x in cats], outputCols=[f"{x}_oh" for x in cats], dropLast=True),
        ]
    inputs = [f"{safe}_oh" if role == "cat" else safe for role, _, safe in _named(spec)]
    stages += [
        VectorAssembler(inputCols=inputs, outputCol="features"),
        LogisticRegression(
            featuresCol="features", labelCol=spec.label, regParam=1.0 / (c * n), elasticNetParam=0.0,
            standardization=False, maxIter=max_iter, fitIntercept=True, tol=tol,
        ),
    ]
    return Pipeline(stages=stages)


#: Default bound of ``bounded_rows``; no query uses it.
MAX_FIT_ROWS = 20_000_000


def bounded_rows(train: DataFrame, id_col: str, max_rows: int = MAX_FIT_ROWS, seed: int = SEED) -> DataFrame:
    """At most about ``max_rows`` rows, by a hash of the id."""
    n = train.count()
    if n <= max_rows:
        return train
    return train.filter(F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(n)) < max_rows)


def score(model: PipelineModel, df: DataFrame, id_col: str, label: str) -> DataFrame:
    """``(id, label, probability of class 1, prediction at >= 0.5)``."""
    out = model.transform(df)
    p1 = vector_to_array(F.col("probability"))[1]
    return out.select(F.col(id_col), F.col(label).cast("int").alias(label), p1.alias("probability")).withColumn(
        "prediction", ev.predict_at(F.col("probability"))
    )


def feature_names(model: PipelineModel, spec: FeatureSpec) -> list[str]:
    """Names of the assembled features in their order, in the ``num__`` / ``cat__`` / ``remainder__`` style of the
    reference report: from the list of inputs and the indexer's levels, not from the generated names."""
    levels: dict[str, list[str]] = {}
    for stage in model.stages:
        if hasattr(stage, "labelsArray"):
            levels = {c: list(l) for c, l in zip(stage.getInputCols(), stage.labelsArray)}
    out = []
    for role, c, safe in _named(spec):
        out += [f"cat__{c}_{v}" for v in levels[f"{safe}_lvl"]] if role == "cat" else [f"{role}__{c}"]
    return out


def coefficient_table(spark: SparkSession, model: PipelineModel, spec: FeatureSpec) -> DataFrame:
    """``(feature, coefficient)`` of a fitted logistic pipeline (one row per
    feature - bounded by the model's width)."""
    lr = model.stages[-1]
    names = feature_names(model, spec)
    coefs = lr.coefficients.toArray().tolist()
    if len(names) != len(coefs):
        raise ValueError(f"{len(names)} feature names for {len(coefs)} coefficients")
    return spark.createDataFrame(list(zip(names, coefs)), "feature string, coefficient double")


def top_and_bottom(coefs: DataFrame, k: int = 15) -> DataFrame:
    """The k largest and k smallest coefficients (ties by name)."""
    top = coefs.orderBy(F.col("coefficient").desc(), "feature").limit(k).select(F.lit("positive").alias("side"), "*")
    bottom = coefs.orderBy(F.col("coefficient").asc(), "feature").limit(k).select(F.lit("negative").alias("side"), "*")
    return top.unionByName(bottom)


def cross_validate(
    table: DataFrame, folds: DataFrame, id_col: str, spec: FeatureSpec, k: int = fixed.FOLDS, **lr_args
) -> DataFrame:
    """K-fold CV on the training table; per fold a fresh pipeline is fitted
    on the other folds (preprocessing statistics included), then all held-out
    predictions are scored together: one ``groupBy(fold)`` for the counting
    metrics and one grouped ROC for the AUC. Returns mean and population sd of
    roc_auc, accuracy, f1, f1_macro and balanced_accuracy."""
    data = table.join(folds.select(id_col, "fold"), id_col)
    # every fold fit and score re-reads this table: cut its lineage once
    checkpoint_root(data.sparkSession)
    data = data.checkpoint()
    preds = None
    for f in range(k):
        model = logistic_pipeline(data.filter(F.col("fold") != f), spec, **lr_args).fit(data.filter(F.col("fold") != f))
        p = score(model, data.filter(F.col("fold") == f), id_col, spec.label).withColumn("fold", F.lit(f))
        preds = p if preds is None else preds.unionByName(p)
    lab, pr = F.col(spec.label), F.col("prediction")
    counts = preds.groupBy("fold").agg(
        F.count(F.when((lab == 1) & (pr == 1), 1)).alias("tp"), F.count(F.when((lab == 0) & (pr == 1), 1)).alias("fp"),
        F.count(F.when((lab == 1) & (pr == 0), 1)).alias("fn"), F.count(F.when((lab == 0) & (pr == 0), 1)).alias("tn"),
    )

    def div(a, b):
        return F.coalesce(F.try_divide(a, F.when(b > 0, b)), F.lit(0.0))

    p1 = div(F.col("tp"), F.col("tp") + F.col("fp"))
    r1 = div(F.col("tp"), F.col("tp") + F.col("fn"))
    p0 = div(F.col("tn"), F.col("tn") + F.col("fn"))
    r0 = div(F.col("tn"), F.col("tn") + F.col("fp"))

    def f1(p, r):
        return F.coalesce(F.try_divide(2 * p * r, F.when(p + r > 0, p + r)), F.lit(0.0))

    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    per_fold = counts.select(
        "fold",
        div(F.col("tp") + F.col("tn"), n).alias("accuracy"),
        f1(p1, r1).alias("f1"),
        ((f1(p1, r1) + f1(p0, r0)) / 2).alias("f1_macro"),
        ((r0 + r1) / 2).alias("balanced_accuracy"),
    ).join(ev.roc_auc(preds, spec.label, "probability", by=["fold"]).select("fold", "roc_auc"), "fold")
    metrics = ["roc_auc", "accuracy", "f1", "f1_macro", "balanced_accuracy"]
    long = per_fold.unpivot("fold", metrics, "metric", "value")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def reload_check(model: PipelineModel, path: str, df: DataFrame, id_col: str, label: str) -> DataFrame:
    """Save the fitted pipeline, load it back and count rows whose
    probability or prediction differ (must be 0)."""
    model.write().overwrite().save(path)
    again = PipelineModel.load(path)
    a = score(model, df, id_col, label)
    b = score(again, df, id_col, label).select(
        id_col, F.col("probability").alias("p2"), F.col("prediction").alias("y2")
    )
    j = a.join(b, id_col)
    return j.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when((F.col("probability") != F.col("p2")) | (F.col("prediction") != F.col("y2")), 1)).alias("n_different"),
    )
