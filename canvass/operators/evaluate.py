"""Classification metrics from a label and a score.

Counting metrics (confusion matrix, precision, recall, F1, report) are one
conditional aggregate. Curve metrics (ROC, AUC) need prefix sums over the
score order; they run on distinct scores only, and those are cut into ranges of
similar size (approximate quantiles -> ``Bucketizer``) so that each range is
summed in its own task and shifted by the totals of the ranges before it. No
window ever covers all rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canvass.fixed import THRESHOLD
from canvass.session import checkpoint_root

#: Ranges of the distinct scores; each is summed by one task. A documented parameter of the curve, like the number of
#: shuffle partitions: raise it with the table.
RANGES = 1024


def predict_at(score: Column, threshold: float = THRESHOLD) -> Column:
    """1 when the probability reaches the threshold (``>=``)."""
    return (score >= F.lit(threshold)).cast("int")


def _counts(label: Column, pred: Column) -> list[Column]:
    return [
        F.count(F.when((label == 1) & (pred == 1), 1)).alias("tp"),
        F.count(F.when((label == 0) & (pred == 1), 1)).alias("fp"),
        F.count(F.when((label == 1) & (pred == 0), 1)).alias("fn"),
        F.count(F.when((label == 0) & (pred == 0), 1)).alias("tn"),
    ]


def _safe_div(a: Column, b: Column) -> Column:
    """a / b, and 0 when b is 0 (the 'zero_division=0' convention)."""
    return F.coalesce(F.try_divide(a.cast("double"), F.when(b > 0, b)), F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, F.when(p + r > 0, p + r)), F.lit(0.0))


def confusion_matrix(df: DataFrame, label: str, pred: str) -> DataFrame:
    """All four cells (zeros included) and each cell's share of its actual row."""
    c = df.agg(*_counts(F.col(label), F.col(pred)))
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(name).alias("n"), F.col(row).alias("row_n"))
            for a, p, name, row in [
                (0, 0, "tn", "_neg"), (0, 1, "fp", "_neg"), (1, 0, "fn", "_pos"), (1, 1, "tp", "_pos"),
            ]
        ]
    )
    return (
        c.select("*", (F.col("tn") + F.col("fp")).alias("_neg"), (F.col("fn") + F.col("tp")).alias("_pos"))
        .select(F.explode(cells).alias("c"))
        .select("c.actual", "c.predicted", "c.n", _safe_div(F.col("c.n"), F.col("c.row_n")).alias("row_share"))
    )


def binary_metrics(df: DataFrame, label: str, pred: str) -> DataFrame:
    """X10 + X19: accuracy, precision, recall, F1 (0 when undefined), the
    positive share (baseline) and n, in one aggregate."""
    c = df.agg(*_counts(F.col(label), F.col(pred)), F.avg(F.col(label).cast("double")).alias("baseline"))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    precision = _safe_div(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = _safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select(
        _safe_div(F.col("tp") + F.col("tn"), n).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        _f1(precision, recall).alias("f1"),
        F.col("baseline"),
        n.alias("n"),
    )


def _per_class(c: DataFrame) -> DataFrame:
    """Precision / recall / F1 / support of class 1 and class 0 from the counts."""
    p1 = _safe_div(F.col("tp"), F.col("tp") + F.col("fp"))
    r1 = _safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    p0 = _safe_div(F.col("tn"), F.col("tn") + F.col("fn"))
    r0 = _safe_div(F.col("tn"), F.col("tn") + F.col("fp"))
    return c.select(
        "*",
        p1.alias("p1"), r1.alias("r1"), _f1(p1, r1).alias("f1_1"),
        p0.alias("p0"), r0.alias("r0"), _f1(p0, r0).alias("f1_0"),
        (F.col("tp") + F.col("fn")).alias("s1"), (F.col("tn") + F.col("fp")).alias("s0"),
    )


def macro_metrics(df: DataFrame, label: str, pred: str) -> DataFrame:
    """X11: F1 of each class, macro F1 and balanced accuracy."""
    c = _per_class(df.agg(*_counts(F.col(label), F.col(pred))))
    return c.select(
        F.col("f1_0"), F.col("f1_1"),
        ((F.col("f1_0") + F.col("f1_1")) / 2).alias("f1_macro"),
        ((F.col("r0") + F.col("r1")) / 2).alias("balanced_accuracy"),
    )


def classification_report(df: DataFrame, label: str, pred: str, names: Mapping[int, str] | None = None) -> DataFrame:
    """One row per class, then ``accuracy`` (the value repeated in every
    column, as the dict form of the report does), ``macro avg`` and
    ``weighted avg``; support is a double like in that table."""
    names = names or {0: "0", 1: "1"}
    c = _per_class(df.agg(*_counts(F.col(label), F.col(pred))))
    n = (F.col("s0") + F.col("s1")).cast("double")
    acc = F.try_divide(F.col("tp") + F.col("tn"), n)

    def row(name: str, p: Column, r: Column, f: Column, s: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1_score"),
            s.cast("double").alias("support"),
        )

    def wavg(a: str, b: str) -> Column:
        return F.try_divide(F.col(a) * F.col("s0") + F.col(b) * F.col("s1"), n)

    rows = F.array(
        row(names[0], F.col("p0"), F.col("r0"), F.col("f1_0"), F.col("s0")),
        row(names[1], F.col("p1"), F.col("r1"), F.col("f1_1"), F.col("s1")),
        row("accuracy", acc, acc, acc, acc),
        row("macro avg", (F.col("p0") + F.col("p1")) / 2, (F.col("r0") + F.col("r1")) / 2, (F.col("f1_0") + F.col("f1_1")) / 2, n),
        row("weighted avg", wavg("p0", "p1"), wavg("r0", "r1"), wavg("f1_0", "f1_1"), n),
    )
    return c.select(F.explode(rows).alias("r")).select("r.*")


def roc_points(df: DataFrame, label: str, score: str, by: Sequence[str] = (), ranges: int = RANGES) -> DataFrame:
    """One ROC point per distinct score (descending), every point kept
    (no dropping of collinear points), plus the starting point (0, 0) at
    threshold +inf (``start`` is true for it; a score may be infinite itself). Null and NaN scores take no part. Columns: ``*by, threshold, fpr, tpr, pos, neg, cum_pos,
    cum_neg, n_pos, n_neg``."""
    by = list(by)
    # distinct scores, checkpointed in the shared folder: the rows are scanned once; one aggregate gives
    # their number and the cuts
    grouped = df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))).groupBy(*by, F.col(score).cast("double").alias("threshold")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"),
        (F.count(F.lit(1)) - F.sum(F.col(label).cast("long"))).alias("neg"),
    )
    checkpoint_root(df.sparkSession)
    grouped = grouped.checkpoint()
    cuts = grouped.agg(F.percentile_approx("threshold", [i / ranges for i in range(1, ranges)], 100 * ranges).alias("q")).first()["q"]
    inner = sorted({float(x) for x in cuts or [] if math.isfinite(x)})
    # Bucketizer's last split is closed, so infinite scores are in the first or the last range
    splits = [float("-inf"), *inner, float("inf")]
    ranged = Bucketizer(splits=splits, inputCol="threshold", outputCol="_range", handleInvalid="keep").transform(grouped)
    # totals per (group, range): at most groups x ranges rows; offsets = totals of
    # the higher-score ranges, class totals = sums over all ranges of the group
    per_range = ranged.groupBy(*by, "_range").agg(F.sum("pos").alias("_rp"), F.sum("neg").alias("_rn"))
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    w_off = part.orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        *by, "_range",
        F.coalesce(F.sum("_rp").over(w_off), F.lit(0)).alias("_op"),
        F.coalesce(F.sum("_rn").over(w_off), F.lit(0)).alias("_on"),
        F.sum("_rp").over(part).alias("n_pos"),
        F.sum("_rn").over(part).alias("n_neg"),
    )
    totals = per_range.groupBy(*by).agg(F.sum("_rp").alias("n_pos"), F.sum("_rn").alias("n_neg"))
    w_in = Window.partitionBy(*by, "_range").orderBy(F.col("threshold").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    pts = ranged.join(offsets, [*by, "_range"]).select(
        *by, "threshold", "pos", "neg",
        (F.col("_op") + F.sum("pos").over(w_in)).alias("cum_pos"),
        (F.col("_on") + F.sum("neg").over(w_in)).alias("cum_neg"),
        "n_pos", "n_neg", F.lit(False).alias("start"),
    )
    start = totals.select(
        *by, F.lit(float("inf")).alias("threshold"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg"),
        F.lit(0).cast("long").alias("cum_pos"), F.lit(0).cast("long").alias("cum_neg"), "n_pos", "n_neg", F.lit(True).alias("start"),
    )
    allp = pts.select(*start.columns).unionByName(start)
    return allp.select(
        *by, "threshold",
        _safe_div(F.col("cum_neg"), F.col("n_neg")).alias("fpr"),
        _safe_div(F.col("cum_pos"), F.col("n_pos")).alias("tpr"),
        "pos", "neg", "cum_pos", "cum_neg", "n_pos", "n_neg", "start",
    )


def roc_auc(df: DataFrame, label: str, score: str, by: Sequence[str] = (), ranges: int = RANGES) -> DataFrame:
    """ROC AUC as the Mann-Whitney statistic with ties counting half:
    sum over distinct scores of pos * (negatives scored lower + neg / 2),
    divided by n_pos * n_neg (0.5 when a class is absent is not defined: null)."""
    by = list(by)
    pts = roc_points(df, label, score, by, ranges).filter(~F.col("start"))
    below = F.col("n_neg") - F.col("cum_neg")
    return pts.groupBy(*by, "n_pos", "n_neg").agg(
        F.sum(F.col("pos") * (below + F.col("neg") * 0.5)).alias("_u")
    ).select(
        *by,
        F.when(
            (F.col("n_pos") > 0) & (F.col("n_neg") > 0),
            F.try_divide(F.col("_u"), F.col("n_pos").cast("double") * F.col("n_neg").cast("double")),
        ).alias("roc_auc"),
        "n_pos",
        "n_neg",
    )


def predictions_table(
    df: DataFrame, id_col: str, label: str, prob: str, names: Mapping[int, str], threshold: float = THRESHOLD
) -> DataFrame:
    """X17 + P20: id, actual and predicted class, probability, both as labels,
    and whether they agree - one projection on the id-keyed scores."""
    pred = predict_at(F.col(prob), threshold)
    m = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    return df.select(
        F.col(id_col),
        F.col(label).cast("int").alias("actual_target"),
        pred.alias("predicted_target"),
        F.col(prob).cast("double").alias("predicted_probability"),
        F.element_at(m, F.col(label).cast("int")).alias("actual_label"),
        F.element_at(m, pred).alias("predicted_label"),
        (F.col(label).cast("int") == pred).alias("correct"),
    )
