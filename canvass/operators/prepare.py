"""Raw answers -> silver, long and wide tables (the workflow's steps 1-2).

Composes the cleaning and multi-select operators: read the raw export with the
exact ``NA`` rule, clean it into ``silver`` (one row per respondent), detect
the multi-select questions, unfold them into ``long`` (partitioned by
question, so later per-question reads prune partitions) and encode ``wide``
(multi-hot + answered flags, derived questions left out). Each table is
written once and read back, so every later step starts from files and the
lineage is cut after each stage.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.functions.guards import collect_bounded
from canvass.operators import clean as cl
from canvass.operators import multiselect as ms
from canvass.sources import sinks


@dataclass
class Prepared:
    silver: DataFrame
    long: DataFrame
    wide: DataFrame
    multiselect: list[str]


def prepare(
    raw: DataFrame,
    out_dir: str,
    id_col: str,
    drop: Sequence[str] = (),
    sentinel_cols: Sequence[str] = (),
    ordinals: Mapping[str, Mapping[str, float | None]] | None = None,
    derived_suffix: str | None = None,
    sep: str = ms.MULTI_SEP,
    max_questions: int = 10_000,
) -> Prepared:
    """Run steps 1-2 and return the three written tables (read back lazily). Cells that the strict rules refuse stop it with a
    ValueError that names their columns, counts and first values; they are only looked for after the write has failed."""
    spark = raw.sparkSession
    try:
        silver = sinks.parquet_roundtrip(
            cl.to_silver(raw, drop=drop, sentinel_cols=sentinel_cols, ordinals=ordinals), f"{out_dir}/silver"
        )
    except Exception as e:
        named = cl.normalise_names(cl.drop_columns(raw, drop))
        told = cl.violation_message(cl.violations(named, sentinel_cols, ordinals))
        if told is None:
            raise
        raise ValueError(told) from e
    flags = collect_bounded(ms.detect_multiselect(silver, sep), max_questions, "columns")
    multi = [r["column_name"] for r in flags if r["is_multiselect"] and r["column_name"] != id_col]
    long = sinks.parquet_roundtrip(ms.unfold_long(silver, id_col, multi, sep), f"{out_dir}/long", ["question"])
    vocab = ms.collect_vocabulary(long)
    keep = [c for c in silver.columns if c not in multi]
    wide_df = ms.multihot(silver, keep, vocab, sep, exclude_suffix=derived_suffix, questions=multi)
    wide_df.write.mode("overwrite").parquet(f"{out_dir}/wide")
    wide = spark.read.schema(wide_df.schema).parquet(f"{out_dir}/wide")
    require_rows(raw.count(), silver, wide, id_col)
    return Prepared(silver, long, wide, multi)


def require_rows(n_raw: int, silver: DataFrame, wide: DataFrame, id_col: str) -> None:
    """Stop unless silver and wide have a row for each raw row and ids are unique (A1). Row counts of the written tables come from
    their footers."""
    n_silver, n_wide = silver.count(), wide.count()
    if not n_raw == n_silver == n_wide:
        raise ValueError(f"row counts differ: raw {n_raw}, silver {n_silver}, wide {n_wide}")
    again = silver.groupBy(id_col).count().filter("count > 1").limit(1).collect()
    if again:
        raise ValueError(f"{id_col} {again[0][0]} occurs {again[0][1]} times")


def summary(p: Prepared) -> DataFrame:
    """A1: shape of the three tables and the row-count invariant (wide rows =
    silver rows), as one row."""
    s = p.silver.agg(F.count(F.lit(1)).alias("silver_rows"))
    w = p.wide.agg(F.count(F.lit(1)).alias("wide_rows"))
    lg = p.long.agg(F.count(F.lit(1)).alias("long_rows"))
    one = s.unionByName(w, allowMissingColumns=True).unionByName(lg, allowMissingColumns=True).agg(
        F.max("silver_rows").alias("silver_rows"), F.max("wide_rows").alias("wide_rows"), F.max("long_rows").alias("long_rows")
    )
    return one.select(
        "*",
        F.lit(len(p.silver.columns)).alias("silver_cols"),
        F.lit(len(p.wide.columns)).alias("wide_cols"),
        F.lit(len(p.multiselect)).alias("multiselect_questions"),
    )
