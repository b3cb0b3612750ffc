"""Cleaning: drop, rename, sentinel numbers, ordinal codes, filters.

All column-wise work is one ``select`` (never hundreds of chained
``withColumn`` calls); checks that must fail fast are lazy ``raise_error``
expressions, so they cost no extra pass over the data.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.functions.guards import collect_bounded
from canvass.functions.scalars import (
    SENTINELS,
    lenient_number,
    name_rule,
    ordinal_code,
    sentinel_number,
    strict_sentinel_number,
)


MAX_QUESTIONS = 10_000


def drop_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Drop constant or superseded columns (all must exist)."""
    cols = list(columns)
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"cannot drop absent columns {missing}")
    return df.drop(*cols)


def normalise_names(df: DataFrame) -> DataFrame:
    """Rename every column through the name rule in one projection."""
    new = [name_rule(c) for c in df.columns]
    if len(set(new)) != len(new):
        raise ValueError("name rule maps two columns to one name")
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, new)])


def to_silver(
    df: DataFrame,
    drop: Sequence[str] = (),
    sentinel_cols: Sequence[str] = (),
    ordinals: Mapping[str, Mapping[str, float | None]] | None = None,
    sentinels: Mapping[str, float] = SENTINELS,
) -> DataFrame:
    """P1 + P2 + P3 + P5 as one projection: drop, normalise names, strict
    sentinel numbers (replacing the text column), add ``<c>Num`` ordinal codes."""
    ordinals = ordinals or {}
    df = normalise_names(drop_columns(df, drop))
    out: list[Column] = []
    for c in df.columns:
        if c in sentinel_cols:
            out.append(strict_sentinel_number(F.col(c), c, sentinels).alias(c))
        else:
            out.append(F.col(c))
    for c, mapping in ordinals.items():
        out.append(ordinal_code(F.col(c), mapping, c).alias(f"{c}Num"))
    return df.select(*out)


#: Values named for a column in a report of bad cells.
EXAMPLES = 5


def violations(
    df: DataFrame,
    sentinel_cols: Sequence[str] = (),
    ordinals: Mapping[str, Mapping[str, float | None]] | None = None,
    sentinels: Mapping[str, float] = SENTINELS,
    examples: int = EXAMPLES,
) -> DataFrame:
    """What the strict rules of ``to_silver`` would stop at: (column_name, rule, n_rows, n_values, examples) for each column
    with cells that are not a ``number`` or not a listed ``label``; ``examples`` are the first such values in string order. One scan;
    cells are counted by value before anything is ranked, and a column's ranking keeps ``examples`` rows a task. Sound columns and
    empty tables give no rows."""
    cell = lambda c, rule, bad: F.when(bad, F.struct(F.lit(c).alias("column_name"), F.lit(rule).alias("rule"), F.col(f"`{c}`").cast("string").alias("value")))
    checks = [cell(c, "number", F.col(f"`{c}`").isNotNull() & sentinel_number(F.col(f"`{c}`"), sentinels).isNull()) for c in sentinel_cols]
    checks += [cell(c, "label", F.col(f"`{c}`").isNotNull() & ~F.col(f"`{c}`").isin(*mapping)) for c, mapping in (ordinals or {}).items()]
    spark = df.sparkSession
    if not checks:
        return spark.createDataFrame([], "column_name string, rule string, n_rows long, n_values long, examples array<string>")
    key = ["column_name", "rule"]
    cells = df.select(F.explode(F.array_compact(F.array(*checks))).alias("bad")).select("bad.*")
    by_value = cells.groupBy(*key, "value").agg(F.count(F.lit(1)).alias("n"))
    totals = by_value.groupBy(*key).agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_values"))
    first = by_value.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("value"))).filter(F.col("place") <= examples)
    named = first.groupBy(*key).agg(F.array_sort(F.collect_list("value")).alias("examples"))
    return totals.join(named, key)


def violation_message(found: DataFrame) -> str | None:
    """One line for each column of ``violations``; None if there are none."""
    rows = sorted(collect_bounded(found, MAX_QUESTIONS, "columns with bad cells"), key=lambda r: (r["column_name"], r["rule"]))
    what = {"number": "not a number", "label": "not a listed label"}
    lines = [f"{r['column_name']}: {r['n_rows']} cells, {r['n_values']} values are {what[r['rule']]}: {', '.join(map(repr, r['examples']))}" for r in rows]
    return "\n".join(lines) or None


def lenient_numeric(df: DataFrame, columns: Sequence[str], sentinels: Mapping[str, float] = SENTINELS) -> DataFrame:
    """Replace each column by its lenient number (never raises)."""
    cols = set(columns)
    return df.select(*[lenient_number(F.col(c), sentinels).alias(c) if c in cols else F.col(c) for c in df.columns])


def unknown_values(spark: SparkSession, df: DataFrame, column: str, known: Iterable[str]) -> DataFrame:
    """Observed non-null values absent from ``known`` (a left-anti join; Spark
    broadcasts the caller's list when it is below the session's threshold)."""
    known_df = spark.createDataFrame([(k,) for k in known], T.StructType([T.StructField("value", T.StringType())]))
    observed = df.select(F.col(column).alias("value")).filter(F.col("value").isNotNull()).distinct()
    return observed.join(known_df, "value", "left_anti")


def drop_null_rows(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """Drop rows with a null in any column of ``subset``."""
    return df.dropna(subset=list(subset))


FAMILY_SEP = "__"


def families(names: Iterable[str], sep: str = FAMILY_SEP) -> dict[str, list[str]]:
    """Names indexed by their family, the part before the first ``sep``."""
    index: dict[str, list[str]] = {}
    for n in names:
        index.setdefault(n.partition(sep)[0], []).append(n)
    return index


def _look_up(index: Mapping[str, list[str]], bases: Iterable[str]) -> list[str]:
    absent = sorted(set(bases) - index.keys())
    if absent:
        raise ValueError(f"no column or question of the families {absent}")
    return [n for b in dict.fromkeys(bases) for n in index[b]]


def drop_family(df: DataFrame, bases: Sequence[str], question_col: str | None = None, sep: str = FAMILY_SEP) -> DataFrame:
    """Leave out whole families, ``base`` and every ``base__*``; a base without any member raises.

    Wide form: columns. Long form (``question_col``): rows by their question; the distinct questions are read
    for the check, rows without a question stay, and partition pruning applies when the table is partitioned by it."""
    if question_col is None:
        return df.drop(*_look_up(families(df.columns, sep), bases))
    asked = df.select(question_col).filter(F.col(question_col).isNotNull()).distinct()
    named = _look_up(families([r[0] for r in collect_bounded(asked, MAX_QUESTIONS, "questions")], sep), bases)
    return df.filter(F.coalesce(~F.col(question_col).isin(named), F.lit(True)))


def in_range_else_null(c: Column, lo: float, hi: float) -> Column:
    """P10: keep values inside [lo, hi], others become null."""
    return F.when((c >= F.lit(float(lo))) & (c <= F.lit(float(hi))), c)


def select_by_type(df: DataFrame, exclude: Sequence[str] = ()) -> dict[str, list[str]]:
    """Split columns into numeric / categorical / other by schema (no job)."""
    out: dict[str, list[str]] = {"numeric": [], "categorical": [], "other": []}
    for f in df.schema.fields:
        if f.name in exclude:
            continue
        if isinstance(f.dataType, T.NumericType) and not isinstance(f.dataType, T.ByteType):
            out["numeric"].append(f.name)
        elif isinstance(f.dataType, T.StringType):
            out["categorical"].append(f.name)
        else:
            out["other"].append(f.name)
    return out
