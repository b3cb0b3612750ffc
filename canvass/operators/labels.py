"""Feature name -> question label.

A feature name says where it comes from; ``_rules`` lists the forms as patterns, the first that matches decides. A
pattern captures the questionnaire column, whose label is looked up in one map, and where there is one the answer.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.operators.features import INFREQUENT, MISSING

#: Detail of a rule whose second capture is the answer.
ANSWER = "-> {}"


def _rules(categorical: Sequence[str]) -> list[tuple[str, str | None]]:
    """(pattern, detail) of every form of a feature name, in order. An alternation tries its branches in
    order, so the longest categorical column that fits wins."""
    levels = "|".join(re.escape(c) for c in sorted(categorical, key=len, reverse=True))
    one_hot = [
        (rf"cat__({levels})_{re.escape(MISSING)}", "-> (no answer)"),
        (rf"cat__({levels})_{re.escape(INFREQUENT)}", "-> (rare levels)"),
        (rf"cat__({levels})_(.*)", ANSWER),
    ]
    other = r"(?!cat__).*?__"
    single = r"((?:(?!__).)*)"
    return [
        (r"num__(.*)_log", "log scale"),
        (r"num__(.*)", "numeric"),
        *(one_hot if categorical else []),
        (rf"{other}{single}__answered", "answered"),
        (rf"{other}{single}__(.*)", ANSWER),
        (rf"{other}(.*)_missing", "missing"),
        (rf"{other}(.*)_any", "above zero"),
        (rf"{other}(.*)", None),
    ]


def _texts(codebook: Mapping[str, str], manual: Mapping[str, str]) -> dict[str, str]:
    """The label of every column that has one: the manual one, else the codebook's, which also serves the column's ordinal
    form ``<column>Num``."""
    return {f"{c}Num": f"{text} (ordinal)" for c, text in codebook.items()} | dict(codebook) | dict(manual)


def label_features(
    features: DataFrame,
    feature_col: str,
    codebook: Mapping[str, str],
    categorical: Sequence[str],
    manual: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add ``question`` and ``detail`` to each feature name. A column without a label is its own question; a name that fits
    no rule is its question as it stands, without a leading ``cat__``. One projection; the rules and labels are literals."""
    feature = F.col(f"`{feature_col}`")
    labels = [F.lit(x) for pair in _texts(codebook, manual or {}).items() for x in pair]
    found = F.lit(None).cast("struct<base:string,detail:string>")
    for pattern, detail in reversed(_rules(categorical)):
        whole = f"(?s)^{pattern}$"
        told = F.concat(F.lit("-> "), F.regexp_extract(feature, whole, 2)) if detail == ANSWER else F.lit(detail)
        parts = F.struct(F.regexp_extract(feature, whole, 1).alias("base"), told.cast("string").alias("detail"))
        found = F.when(feature.rlike(whole), parts).otherwise(found)
    base = F.col("__found.base")
    label = F.coalesce(F.element_at(F.create_map(*labels), base), base) if labels else base
    question = F.coalesce(label, F.regexp_replace(feature, "^cat__", ""))
    out = features.withColumn("__found", found)
    return out.select(*(F.col(f"`{c}`") for c in features.columns), question.alias("question"), F.col("__found.detail").alias("detail"))
