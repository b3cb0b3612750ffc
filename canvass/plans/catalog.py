"""The query catalog: one named ``(spark, sf_dir) -> DataFrame`` per operator.

Each query starts from a fixture view over the driver's tables and applies
library operators; the matching DuckDB SQL lives in ``oracles.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass import fixed
from canvass.functions import scalars as sc
from canvass.operators import association as asc
from canvass.operators import boosting
from canvass.operators import clean as cl
from canvass.operators import evaluate as ev
from canvass.operators import features as ft
from canvass.operators import labels as lb
from canvass.operators import model as md
from canvass.operators import multiselect as ms
from canvass.operators import prepare as pr
from canvass.operators import profile as pf
from canvass.operators import rates as rt
from canvass.operators import split as sp
from canvass.operators.quantile import column_quantiles
from canvass.plans import fixtures as fx
from canvass.session import checkpoint_root, scratch_path
from canvass.sources import csv as csvsrc
from canvass.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, Query] = {}

QUESTIONS = ["have_cell", "want_cell"]
ALL_QUESTIONS = ["have_cell", "want_cell", "both_cell"]


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in CATALOG:
            raise ValueError(f"duplicate query {name}")
        CATALOG[name] = fn
        return fn

    return register


def respondents_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.with_both_cell(fx.respondents(spark, sf_dir))


# ---- multi-select ----------------------------------------------------------


@query("multiselect_long")
def q_multiselect_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ms.unfold_long(respondents_both(spark, sf_dir), "respondent_id", ALL_QUESTIONS)


@query("top_options")
def q_top_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ms.option_counts(respondents_both(spark, sf_dir), ALL_QUESTIONS)
    return ms.top_options(counts, 3).select("question", "value", "n", "rank")


@query("have_vs_want")
def q_have_vs_want(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ms.have_vs_want(fx.respondents(spark, sf_dir), "have_cell", "want_cell", 4)


@query("detect_multiselect")
def q_detect_multiselect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ms.detect_multiselect(fx.respondents(spark, sf_dir))


@query("multihot")
def q_multihot(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = respondents_both(spark, sf_dir)
    vocab = ms.collect_vocabulary(ms.unfold_long(df, "respondent_id", ALL_QUESTIONS))
    return ms.multihot(df, ["respondent_id", "segment", "country"], vocab, exclude_suffix="both_cell", questions=ALL_QUESTIONS)


@query("answered_flag")
def q_answered_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.respondents(spark, sf_dir)
    return df.select("respondent_id", *ms.answered_flags(df, QUESTIONS))


@query("set_intersection_check")
def q_set_intersection_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ms.derived_set_check(respondents_both(spark, sf_dir), "respondent_id", "have_cell", "want_cell", "both_cell")


@query("response_rate_by_class")
def q_response_rate_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.respondents(spark, sf_dir).withColumn("spend", F.col("spend").cast("string"))
    return ms.response_rate_by_class(df, ["have_cell", "want_cell", "spend"], "outcome")


# ---- cleaning --------------------------------------------------------------


# Fixed values of the fixture: an ordinal code per market segment
# (None = an answer that cannot be ordered).
SEGMENT_ORDINAL: dict[str, float | None] = {
    "AUTOMOBILE": 1.0,
    "BUILDING": 2.0,
    "FURNITURE": 3.0,
    "HOUSEHOLD": 4.0,
    "MACHINERY": None,
}
KNOWN_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"]


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver view of the respondent fixture: drop, names, strict numbers, ordinals."""
    return cl.to_silver(
        fx.respondents(spark, sf_dir),
        drop=["n_returns"],
        sentinel_cols=["years_text"],
        ordinals={"segment": SEGMENT_ORDINAL},
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Respondents with an answer to the outcome, a 0/1 target and lenient years."""
    df = fx.respondents(spark, sf_dir)
    return cl.drop_null_rows(df, ["outcome"]).select(
        "*",
        sc.binary_label(F.col("outcome")).alias("target"),
        sc.lenient_number(F.col("years_text")).alias("years"),
    )


@query("clean_silver")
def q_clean_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver(spark, sf_dir)


@query("sentinel_numeric")
def q_sentinel_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.respondents(spark, sf_dir)
    return df.select("respondent_id", sc.strict_sentinel_number(F.col("years_text"), "years_text").alias("years"))


@query("strict_violations")
def q_strict_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.respondents(spark, sf_dir).select("years_text", "segment", "country")
    labels = {k: v for k, v in SEGMENT_ORDINAL.items() if k != "BUILDING"}
    found = cl.violations(df, ["years_text", "country"], {"segment": labels})
    return found.withColumn("examples", F.array_join("examples", "|"))


@query("lenient_numeric")
def q_lenient_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.respondents(spark, sf_dir).select("respondent_id", "years_text", "segment")
    return cl.lenient_numeric(df, ["years_text", "segment"])


@query("ordinal_encode")
def q_ordinal_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.respondents(spark, sf_dir)
    return df.select("respondent_id", "segment", sc.ordinal_code(F.col("segment"), SEGMENT_ORDINAL, "segment").alias("segmentNum"))


@query("unknown_values")
def q_unknown_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.unknown_values(spark, fx.respondents(spark, sf_dir), "segment", KNOWN_SEGMENTS)


@query("binary_label")
def q_binary_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("respondent_id", "outcome", "target")


@query("trim_to_quantile")
def q_trim_to_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.respondents(spark, sf_dir)
    lo, hi = column_quantiles(df, "spend", [0.01, 0.99])
    return df.select("respondent_id", cl.in_range_else_null(F.col("spend"), lo, hi).alias("spend_trimmed"))


@query("leak_family_drop")
def q_leak_family_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = CATALOG["multihot"](spark, sf_dir)
    return cl.drop_family(wide, ["want_cell"])


@query("row_invariants")
def q_row_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: silver keeps one row per respondent, ids are unique, wide = silver rows."""
    s = silver(spark, sf_dir)
    wide = CATALOG["multihot"](spark, sf_dir)
    s_counts = s.agg(
        F.count(F.lit(1)).alias("silver_rows"),
        F.count_distinct("respondent_id").alias("distinct_ids"),
    )
    w_counts = wide.agg(F.count(F.lit(1)).alias("wide_rows"))
    # two one-row aggregates side by side: union, then one merge row
    both = s_counts.unionByName(w_counts, allowMissingColumns=True).agg(
        F.max("silver_rows").alias("silver_rows"),
        F.max("distinct_ids").alias("distinct_ids"),
        F.max("wide_rows").alias("wide_rows"),
    )
    return both.select(
        "silver_rows",
        "distinct_ids",
        "wide_rows",
        F.lit(len(s.columns)).alias("silver_cols"),
        F.lit(len(wide.columns)).alias("wide_cols"),
    )


# ---- rates -----------------------------------------------------------------


@query("rate_by_country")
def q_rate_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.rate_by_group(labelled(spark, sf_dir), "country", "target", min_n=60)


@query("rate_by_option_and_band")
def q_rate_by_option_and_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cl.drop_null_rows(labelled(spark, sf_dir), ["have_cell", "years"])
    return rt.rate_by_option_and_band(df, "have_cell", "target", "years", top_n=10)


@query("rate_by_band")
def q_rate_by_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cl.drop_null_rows(labelled(spark, sf_dir), ["years"])
    return rt.rate_by_band(df, "years", "target")


@query("rate_two_way")
def q_rate_two_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = labelled(spark, sf_dir).withColumn(
        "band", sc.right_closed_band(F.col("years"), rt.CAREER_EDGES, rt.CAREER_BANDS, include_lowest=True)
    )
    levels = fx.respondents(spark, sf_dir).select("segment").filter(F.col("segment").isNotNull()).distinct()
    return rt.rate_two_way(df, "segment", "band", "target", a_levels=levels, b_levels=rt.CAREER_BANDS)


@query("indicator_rate_two_way")
def q_indicator_rate_two_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.respondents(spark, sf_dir)
    return rt.indicator_rate_two_way(df, (F.col("n_returns") > 0).cast("int"), "segment", "outcome")


# ---- profiles --------------------------------------------------------------


CATEGORICAL = ["segment", "country", "outcome", "years_text"]


def respondents_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.respondents(spark, sf_dir)
    return df.withColumn("years", sc.lenient_number(F.col("years_text"))).withColumn("unit", F.lit(7.5))


@query("value_counts_pct")
def q_value_counts_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.value_counts(fx.respondents(spark, sf_dir), ["segment", "outcome", "years_text"])


@query("target_distribution")
def q_target_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.target_distribution(labelled(spark, sf_dir), "target")


@query("ordered_counts")
def q_ordered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.ordered_counts(fx.respondents(spark, sf_dir), "outcome", ["Yes", "Soon", "No"])


@query("numeric_profile")
def q_numeric_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.numeric_profile(respondents_numeric(spark, sf_dir), ["years", "n_returns"])


@query("numeric_summary")
def q_numeric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.numeric_summary(fx.doc_labels(spark, sf_dir), ["n_chars"])


@query("category_profile")
def q_category_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.category_profile(fx.respondents(spark, sf_dir), CATEGORICAL + ["have_cell"])


@query("quantiles")
def q_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.quantiles(fx.doc_labels(spark, sf_dir), ["n_chars"], [0.005, 0.01, 0.5, 0.99, 0.995])


@query("histogram")
def q_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.histogram(respondents_numeric(spark, sf_dir), "years", bins=fixed.HISTOGRAM_BINS)


@query("histogram_log")
def q_histogram_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.histogram(fx.doc_labels(spark, sf_dir), "n_chars", bins=fixed.HISTOGRAM_LOG_BINS, log10=True)


# ---- association -----------------------------------------------------------

# "unit" has no spread: its correlations are undefined
CORR_COLUMNS = ["spend", "n_returns", "years", "unit"]


@query("correlation_matrix")
def q_correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asc.correlation_matrix(respondents_numeric(spark, sf_dir), CORR_COLUMNS)


@query("correlation_pairs")
def q_correlation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asc.ranked(asc.correlation_pairs(respondents_numeric(spark, sf_dir), CORR_COLUMNS), "r", ["var1", "var2"])


@query("correlation_pvalue")
def q_correlation_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asc.with_correlation_pvalue(asc.correlation_pairs(respondents_numeric(spark, sf_dir), CORR_COLUMNS))


CHI_VARIABLES = ["segment", "country", "years_text"]


@query("chi_square")
def q_chi_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asc.ranked(asc.chi_square(fx.respondents(spark, sf_dir), CHI_VARIABLES, "outcome"), "cramers_v", ["variable"])


@query("chi_square_2x2")
def q_chi_square_2x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asc.chi_square(fx.doc_labels(spark, sf_dir), ["toxic"], "quality")


@query("chi_square_pvalue")
def q_chi_square_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = asc.chi_square(fx.respondents(spark, sf_dir), CHI_VARIABLES, "outcome").unionByName(
        asc.chi_square(fx.doc_labels(spark, sf_dir), ["toxic"], "quality")
    )
    return asc.with_chi_square_pvalue(tests)


ANOVA_VARIABLES = ["years", "n_returns"]


@query("anova")
def q_anova(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asc.ranked(asc.anova(respondents_numeric(spark, sf_dir), ANOVA_VARIABLES, "outcome"), "eta_squared", ["variable"])


@query("anova_pvalue")
def q_anova_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asc.with_anova_pvalue(asc.anova(respondents_numeric(spark, sf_dir), ANOVA_VARIABLES, "outcome"))


@query("group_mean_sd")
def q_group_mean_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asc.group_mean_sd(respondents_numeric(spark, sf_dir), ANOVA_VARIABLES, "outcome")


@query("crosstab")
def q_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asc.crosstab(fx.respondents(spark, sf_dir), "segment", "outcome")


@query("regression_line")
def q_regression_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asc.regression_line(respondents_numeric(spark, sf_dir), "years", "spend")


@query("bootstrap_ci")
def q_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = labelled(spark, sf_dir)
    return asc.bootstrap_mean_ci(df, "target", "segment")


@query("regression_band")
def q_regression_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asc.regression_band(respondents_numeric(spark, sf_dir), "years", "spend")


# ---- split -----------------------------------------------------------------


LINEAR = ft.linear_track(winsor="spend", log=["spend", "years", "n_returns"], any_flag=["n_returns"], raw=["segmentNum"])


def modelling_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled respondents with the numeric features of the linear track."""
    return labelled(spark, sf_dir).select(
        "respondent_id", "target", "segment", "country", "spend", "years", "n_returns",
        sc.ordinal_code(F.col("segment"), SEGMENT_ORDINAL, "segment").alias("segmentNum"),
        "have_cell", "want_cell",
    )


def split_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.stratified_split(modelling_table(spark, sf_dir), "respondent_id", "target")


def split_frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The modelling table with its split column (written once per scale, like
    the reference's train/test files), and its training part."""

    table = fx.materialized(spark, "model_split", sf_dir, lambda: split_table(spark, sf_dir))
    return table, table.filter(F.col("split") == "train")


@query("stratified_split")
def q_stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_table(spark, sf_dir).select("respondent_id", "target", "split")


@query("stratified_folds")
def q_stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, train = split_frames(spark, sf_dir)
    return sp.stratified_folds(train, "respondent_id", "target", k=5)


@query("seeded_sample")
def q_seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.seeded_sample(
        fx.doc_labels(spark, sf_dir).select("doc_id", "lang", "source", "n_chars"), "doc_id", fixed.SAMPLE_ROWS
    )


def split_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(respondent_id, target, split)`` read from the written split table."""
    return split_frames(spark, sf_dir)[0].select("respondent_id", "target", "split")


@query("split_ids")
def q_split_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.split_ids(split_view(spark, sf_dir), "respondent_id")


@query("split_disjoint")
def q_split_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.split_disjoint(split_view(spark, sf_dir), "respondent_id")


@query("apply_split")
def q_apply_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = split_view(spark, sf_dir).select("respondent_id", "split")
    return sp.apply_split(ids, fx.respondents(spark, sf_dir).select("respondent_id", "outcome", "segment"), "respondent_id")


@query("split_manifest")
def q_split_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split's parameters and counts as a JSON record, written to the
    shared checkpoint folder and read back."""

    resp = fx.respondents(spark, sf_dir)
    split = split_view(spark, sf_dir)
    counts = split.groupBy().agg(
        F.count(F.when(F.col("split") == "train", 1)).alias("n_train"),
        F.count(F.when(F.col("split") == "test", 1)).alias("n_test"),
        F.avg(F.when(F.col("split") == "train", F.col("target"))).alias("positive_rate_train"),
        F.avg(F.when(F.col("split") == "test", F.col("target"))).alias("positive_rate_test"),
    )
    dropped = resp.agg(F.count(F.when(F.col("outcome").isNull(), 1)).alias("n_dropped_unlabelled"))
    record = counts.unionByName(dropped, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in ["n_train", "n_test", "positive_rate_train", "positive_rate_test", "n_dropped_unlabelled"]]
    ).select(
        F.lit(sp.TEST_SIZE).alias("test_size"),
        F.lit(sp.SEED).alias("seed"),
        F.lit("target").alias("stratify"),
        "*",
    )
    path = scratch_path(spark, "split-manifest")
    return sinks.json_roundtrip(record, path)


# ---- features (linear track) ----------------------------------------------------


def fitted_linear(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[ft.FittedColumn]]:
    table, train = split_frames(spark, sf_dir)
    return table, ft.fit_numeric(train, LINEAR)


@query("winsorize")
def q_winsorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, fitted = fitted_linear(spark, sf_dir)
    bounds = next(f.bounds for f in fitted if f.plan.clip)
    return table.select("respondent_id", ft.winsorize("spend", *bounds, "spend_clipped"))


@query("log1p_transform")
def q_log1p_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, fitted = fitted_linear(spark, sf_dir)
    return table.select("respondent_id", *[f.before_fill().alias(f.plan.output) for f in fitted if f.plan.log])


@query("missing_flags")
def q_missing_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, fitted = fitted_linear(spark, sf_dir)
    out = ft.apply_numeric(table, fitted, ["respondent_id"])
    return out.select("respondent_id", *[c for c in out.columns if c.endswith("_missing") or c.endswith("_any")])


@query("median_impute")
def q_median_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted medians (after clip + log, train only) as a table."""
    _, fitted = fitted_linear(spark, sf_dir)
    return spark.createDataFrame([(f.plan.output, f.median) for f in fitted], "column string, median double")


@query("fit_apply_linear")
def q_fit_apply_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, fitted = fitted_linear(spark, sf_dir)
    return ft.apply_numeric(table, fitted, ["respondent_id", "split", "target"])


@query("linear_params_json")
def q_linear_params_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted numbers of the linear track as JSON records."""
    _, fitted = fitted_linear(spark, sf_dir)
    kinds = "column string, output string, clip_low double, clip_high double, log boolean, median double"
    return sinks.json_roundtrip(spark.createDataFrame(ft.parameters(fitted), kinds), scratch_path(spark, "linear-params"))


#: Questions that would give the target away.
LEAKS = ["want_cell"]


@query("pipeline_tables")
def q_pipeline_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps 3 and 4 as one flow on the wide table: leaking families go before the split, the parts are checked to be
    disjoint, transforms are fitted on train and applied to both, and train and test are written. Returns their shapes."""
    table, _ = split_frames(spark, sf_dir)
    vocab = ms.collect_vocabulary(ms.unfold_long(fx.respondents(spark, sf_dir), "respondent_id", QUESTIONS))
    wide = ms.multihot(table, [c for c in table.columns if c not in [*QUESTIONS, "split"]], vocab, questions=QUESTIONS)
    safe = cl.drop_family(wide, LEAKS)
    split = sinks.parquet_roundtrip(sp.stratified_split(safe, "respondent_id", "target"), scratch_path(spark, "flow-split"))
    sp.require_disjoint(split, "respondent_id")
    fitted = ft.fit_numeric(split.filter(F.col("split") == "train"), LINEAR)
    keep = [c for c in split.columns if c not in [n.source for n in LINEAR]]
    ready = sinks.parquet_roundtrip(ft.apply_numeric(split, fitted, keep), scratch_path(spark, "flow-ready"), ["split"])
    return ready.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("n_positive")).select(
        "split", "n", "n_positive", F.lit(len(wide.columns) - len(safe.columns)).alias("columns_dropped"), F.lit(len(ready.columns)).alias("columns_kept")
    )


@query("category_fill")
def q_category_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.respondents(spark, sf_dir)
    return df.select("respondent_id", ft.fill_category("outcome"), ft.fill_category("have_cell", "__MISSING__"))


@query("bin_right_closed")
def q_bin_right_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = respondents_numeric(spark, sf_dir)
    return df.select(
        "respondent_id",
        "years",
        sc.right_closed_band(F.col("years"), rt.EXPERIENCE_EDGES, rt.EXPERIENCE_BANDS).alias("experience_band"),
        sc.right_closed_band(F.col("years"), rt.CAREER_EDGES, rt.CAREER_BANDS, include_lowest=True).alias("career_band"),
    )


@query("standardize")
def q_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, fitted = fitted_linear(spark, sf_dir)
    out = ft.apply_numeric(table, fitted, ["respondent_id", "split"])
    cols = [c.output for c in LINEAR]
    scale = ft.fit_standardize(out.filter(F.col("split") == "train"), cols)
    return out.select("respondent_id", "split", *ft.standardize(cols, scale))


@query("rare_level_fold")
def q_rare_level_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X5 on the document table: ``source`` levels seen >= 20 times on the
    training part keep their name, rarer ones fold, unseen ones stay null."""
    table = fx.materialized(spark, "doc_split", sf_dir, lambda: sp.stratified_split(fx.doc_labels(spark, sf_dir), "doc_id", "quality"))
    levels = ft.fit_levels(table.filter(F.col("split") == "train"), "source")
    return ft.fold_rare_levels(table.select("doc_id", "split", "source"), "source", levels, 20, "source_level")


@query("skew_before_after")
def q_skew_before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, fitted = fitted_linear(spark, sf_dir)
    raw = table.select("*", *[F.col(c.source).alias(f"{c.source}_raw") for c in LINEAR])
    out = ft.apply_numeric(raw, fitted, ["split"] + [f"{c.source}_raw" for c in LINEAR])
    train = out.filter(F.col("split") == "train")
    return ft.skew_observed(train, [(c.source, f"{c.source}_raw", c.output, f"{c.source}_missing") for c in LINEAR])


# ---- evaluation on deterministic scores ------------------------------------------


# Display names of the two classes of the document target.
QUALITY_NAMES = {0: "low quality", 1: "high quality"}


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.scores(spark, sf_dir)
    return s.select("doc_id", "label", "score", ev.predict_at(F.col("score")).alias("pred"))


@query("score_threshold")
def q_score_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir)


@query("confusion_matrix")
def q_confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.confusion_matrix(scored(spark, sf_dir), "label", "pred")


@query("binary_metrics")
def q_binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.binary_metrics(scored(spark, sf_dir), "label", "pred")


@query("macro_metrics")
def q_macro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.macro_metrics(scored(spark, sf_dir), "label", "pred")


@query("classification_report")
def q_classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.classification_report(scored(spark, sf_dir), "label", "pred", QUALITY_NAMES)


@query("roc_curve")
def q_roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.roc_points(scored(spark, sf_dir), "label", "score").select("threshold", "fpr", "tpr")


@query("roc_auc")
def q_roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.roc_auc(scored(spark, sf_dir), "label", "score")


@query("predictions_table")
def q_predictions_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.predictions_table(fx.scores(spark, sf_dir), "doc_id", "label", "score", QUALITY_NAMES)


# ---- models ---------------------------------------------------------------------


def model_table(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, md.FeatureSpec]:
    """The linear-track table (imputed logs + flags), single-choice categories
    and the multi-hot options; checkpointed in the shared folder because every
    fold and model re-reads it."""
    table, fitted = fitted_linear(spark, sf_dir)
    base = ["respondent_id", "split", "target", "segment", "country"]
    lin = ft.apply_numeric(table, fitted, base + QUESTIONS)
    # the vocabulary comes from all respondents; the multi-hot columns are a
    # projection of the same rows (no join)
    vocab = ms.collect_vocabulary(ms.unfold_long(fx.respondents(spark, sf_dir), "respondent_id", QUESTIONS))
    keep = [c for c in lin.columns if c not in QUESTIONS]
    checkpoint_root(spark)
    out = ms.multihot(lin, keep, vocab, questions=QUESTIONS).checkpoint()
    flags = [c for c in lin.columns if c.endswith("_missing") or c.endswith("_any")]
    spec = md.FeatureSpec(
        numeric=[c.output for c in LINEAR],
        categorical=["segment", "country"],
        passthrough=flags + [c for c in out.columns if c not in keep],
    )
    return out, spec


def fitted_logistic(spark: SparkSession, sf_dir: str):
    out, spec = model_table(spark, sf_dir)
    train = out.filter(F.col("split") == "train")
    return out, spec, md.logistic_pipeline(train, spec).fit(train)


def logistic_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(respondent_id, target, probability, prediction) of the test part, scored once and written."""

    def build() -> DataFrame:
        out, _, model = fitted_logistic(spark, sf_dir)
        return md.score(model, out.filter(F.col("split") == "test"), "respondent_id", "target")

    return fx.materialized(spark, "logistic_predictions", sf_dir, build)


@query("logistic_scores")
def q_logistic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logistic_predictions(spark, sf_dir)


def test_metrics(predictions: DataFrame) -> DataFrame:
    """Every metric of a written prediction table as one row: X10, X11, X14, X19."""
    parts = [
        ev.binary_metrics(predictions, "target", "prediction"),
        ev.macro_metrics(predictions, "target", "prediction"),
        ev.roc_auc(predictions, "target", "probability").select("roc_auc"),
    ]
    rows = parts[0]
    for p in parts[1:]:  # one row each, side by side
        rows = rows.unionByName(p, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


@query("logistic_test_metrics")
def q_logistic_test_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return test_metrics(logistic_predictions(spark, sf_dir))


# Display names of the two classes of the respondent target.
TARGET_NAMES = {0: "will not", 1: "will"}


@query("logistic_report")
def q_logistic_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.classification_report(logistic_predictions(spark, sf_dir), "target", "prediction", TARGET_NAMES)


@query("labelled_coefficients")
def q_labelled_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X15 + X16 + J6: the model's own feature names with their question text."""
    _, spec, model = fitted_logistic(spark, sf_dir)
    return lb.label_features(md.coefficient_table(spark, model, spec), "feature", CODEBOOK, ["segment", "country"], MANUAL_LABELS)


@query("model_record")
def q_model_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run as a JSON record: sizes, encoded features, baseline, test result, strongest feature."""
    out, spec, model = fitted_logistic(spark, sf_dir)
    coefs = md.coefficient_table(spark, model, spec)
    strongest = coefs.orderBy(F.abs("coefficient").desc(), "feature").first()
    sizes = out.agg(F.count(F.when(F.col("split") == "train", 1)).alias("n_train"), F.count(F.when(F.col("split") == "test", 1)).alias("n_test")).first()
    record = test_metrics(logistic_predictions(spark, sf_dir)).select(
        F.lit("logistic").alias("model"),
        F.lit(sizes["n_train"]).alias("n_train"),
        F.lit(sizes["n_test"]).alias("n_test"),
        F.lit(coefs.count()).alias("n_features"),
        F.lit(strongest["feature"]).alias("strongest_feature"),
        F.lit(strongest["coefficient"]).alias("strongest_coefficient"),
        "baseline", "accuracy", "precision", "recall", "f1", "f1_macro", "balanced_accuracy", "roc_auc",
    )
    return sinks.json_roundtrip(record, scratch_path(spark, "model-record"))


@query("cv_metrics")
def q_cv_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, spec = model_table(spark, sf_dir)
    train = out.filter(F.col("split") == "train")
    folds = sp.stratified_folds(train, "respondent_id", "target", k=5)
    return md.cross_validate(train, folds, "respondent_id", spec, k=5)


@query("top_coefficients")
def q_top_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, spec, model = fitted_logistic(spark, sf_dir)
    return md.top_and_bottom(md.coefficient_table(spark, model, spec), k=15)


@query("model_reload_check")
def q_model_reload_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, spec, model = fitted_logistic(spark, sf_dir)
    return md.reload_check(model, scratch_path(spark, "logistic-model"), out.filter(F.col("split") == "test"), "respondent_id", "target")


def tree_table(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, md.FeatureSpec]:
    """The tree track: the split as it is, missing values included, with the multi-hot options; nothing clipped, logged or filled."""
    table, _ = split_frames(spark, sf_dir)
    vocab = ms.collect_vocabulary(ms.unfold_long(fx.respondents(spark, sf_dir), "respondent_id", QUESTIONS))
    keep = [c for c in table.columns if c not in QUESTIONS]
    checkpoint_root(spark)
    out = ms.multihot(table, keep, vocab, questions=QUESTIONS).checkpoint()
    spec = md.FeatureSpec(
        numeric=[c.source for c in LINEAR], categorical=["segment", "country"], passthrough=[c for c in out.columns if c not in keep]
    )
    return out, spec


def gbt_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        out, spec = tree_table(spark, sf_dir)
        model = boosting.fit(out.filter(F.col("split") == "train"), boosting.Columns(spec.numeric, spec.categorical, spec.passthrough))
        return model.score(out.filter(F.col("split") == "test"), "respondent_id")

    return fx.materialized(spark, "gbt_predictions", sf_dir, build)


@query("gbt_scores")
def q_gbt_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gbt_predictions(spark, sf_dir)


@query("gbt_test_metrics")
def q_gbt_test_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return test_metrics(gbt_predictions(spark, sf_dir))


# The questions behind the fixture's columns (the codebook).
CODEBOOK = {
    "segment": "Which market segment are you in?",
    "country": "Where do you live?",
    "outcome": "Do you plan to order again?",
    "years_text": "How many orders have you placed?",
    "spend": "How much did you spend on urgent orders?",
    "n_returns": "How many items did you return?",
    "have_cell": "Which part types did you return?",
    "want_cell": "Which part types did you accept?",
}
MANUAL_LABELS = {"respondent_id": "Respondent ID", "spend": "Urgent spend (currency units)"}


def feature_names_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feature name the model table produces, derived from the data:
    one-hot levels, multi-hot options, answered flags, numeric and flag columns."""
    resp = fx.respondents(spark, sf_dir)

    def options(q: str):
        tokens = F.filter(F.coalesce(ms.split_cell(F.col(q)), F.array().cast("array<string>")), lambda t: t != "")
        return F.transform(tokens, lambda t: F.concat(F.lit(f"remainder__{q}__"), t))

    # option and level names from one pass over the respondents
    names = resp.select(
        F.explode(
            F.concat(
                options("have_cell"),
                options("want_cell"),
                F.array(
                    F.concat(F.lit("cat__segment_"), F.coalesce("segment", F.lit(ft.MISSING))),
                    F.concat(F.lit("cat__country_"), F.coalesce("country", F.lit(ft.MISSING))),
                ),
            )
        ).alias("feature")
    ).distinct()
    plain = [f"num__{c.output}" for c in LINEAR] + [
        f"remainder__{c.source}_missing" for c in LINEAR
    ] + ["remainder__n_returns_any", "remainder__have_cell__answered", "remainder__want_cell__answered",
         "cat__segment_infrequent", "remainder__respondent_id"]
    return names.unionByName(spark.createDataFrame([(f,) for f in plain], "feature string"))


@query("feature_labels")
def q_feature_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lb.label_features(feature_names_table(spark, sf_dir), "feature", CODEBOOK, ["segment", "country"], MANUAL_LABELS)


# ---- sources and sinks ------------------------------------------------------------


@query("csv_null_token")
def q_csv_null_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The respondent view written as a survey export (null -> NA, '' -> "")
    and read back with NA as the only null token."""
    cols = ["respondent_id", "segment", "years_text", "have_cell", "want_cell"]
    path = csvsrc.write_exact_na(fx.respondents(spark, sf_dir).select(*cols), scratch_path(spark, "export-csv"))
    back = csvsrc.read_exact_na(spark, path, cols)
    return back.withColumn("respondent_id", F.col("respondent_id").cast("bigint"))


@query("codebook_clean")
def q_codebook_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3 + P19 + P2: a codebook derived from the pages (column name = page
    title, question = page HTML) goes through CSV and the codebook rules."""
    pages = fx.table(spark, sf_dir, "pages")
    book = pages.select(
        F.col("page_id").cast("string").alias("qid"),
        F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("column_raw"),
        F.col("html").alias("question"),
    )
    path = scratch_path(spark, "codebook-csv")
    book.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    cleaned = csvsrc.clean_codebook(csvsrc.read_codebook(spark, path))
    return cleaned.select(F.col("qid").cast("bigint").alias("page_id"), "column_silver", F.col("question_clean").alias("question"))


@query("parquet_roundtrip")
def q_parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long form written partitioned by question and read back."""
    long_df = ms.unfold_long(respondents_both(spark, sf_dir), "respondent_id", ALL_QUESTIONS)
    return sinks.parquet_roundtrip(long_df, scratch_path(spark, "long-parquet"), ["question"])


@query("csv_roundtrip")
def q_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statistics table written as CSV with a header and read back."""
    return sinks.csv_roundtrip(CATALOG["rate_by_country"](spark, sf_dir), scratch_path(spark, "rates-csv"))


@query("column_profile")
def q_column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role of every column of the silver view chosen from the schema
    (numeric / categorical / other; ids excluded explicitly), with its non-null
    count from one aggregate."""
    df = silver(spark, sf_dir)
    roles = cl.select_by_type(df, exclude=["respondent_id"])
    named = [(c, role) for role, cols in roles.items() for c in cols]
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c, _ in named])
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return counts.select(
        F.explode(
            F.array(*[
                F.struct(F.lit(c).alias("column_name"), F.lit(types[c]).alias("data_type"), F.lit(r).alias("role"),
                         F.col(c).alias("non_null"))
                for c, r in named
            ])
        ).alias("r")
    ).select("r.*")


# ---- the preparation steps end to end ----------------------------------------------------


@query("prepare_tables")
def q_prepare_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps 1-2 end to end: the respondent view (with the derived both_cell)
    exported as a raw CSV, read with the NA rule, cleaned to silver, unfolded
    to long (partitioned by question) and encoded to wide; returns the shapes."""
    raw_cols = ["respondent_id", "segment", "country", "outcome", "years_text", "spend", "n_returns",
                "have_cell", "want_cell", "both_cell"]
    export = csvsrc.write_exact_na(respondents_both(spark, sf_dir).select(*raw_cols), scratch_path(spark, "raw-export"))
    raw = csvsrc.read_exact_na(spark, export, raw_cols).select(
        F.col("respondent_id").cast("bigint").alias("respondent_id"),
        *[F.col(c) for c in raw_cols[1:5]],
        F.col("spend").cast("double").alias("spend"),
        F.col("n_returns").cast("bigint").alias("n_returns"),
        *[F.col(c) for c in raw_cols[7:]],
    )
    prepared = pr.prepare(
        raw, scratch_path(spark, "prepared"), "respondent_id", drop=["n_returns"], sentinel_cols=["years_text"],
        ordinals={"segment": SEGMENT_ORDINAL}, derived_suffix="both_cell",
    )
    return pr.summary(prepared)


@query("metrics_json")
def q_metrics_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation metrics as a JSON record in the shared folder, read back."""
    metrics = ev.binary_metrics(scored(spark, sf_dir), "label", "pred")
    return sinks.json_roundtrip(metrics, scratch_path(spark, "metrics-json"))
