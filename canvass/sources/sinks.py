"""Sinks: parquet, CSV and JSON written to the shared checkpoint folder, and
read back with an explicit schema (S4-S6). Writing a result is also how a
long lineage is cut: a later stage reads the written table, so a lost
executor never forces a recompute from the raw sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.sources.csv import keep_cells, read_cells

#: A null cell; no text value of a statistics table.
NULL_CELL = "\\N"


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """``partition_by``: rows meet by these columns first, so a value's files are bounded by size and not by the number of
    tasks; a value of many rows is split over several tasks by their sizes (skewed shares of a rebalance)."""
    if not partition_by:
        df.write.mode("overwrite").parquet(path)
        return path
    df.hint("rebalance", *partition_by).write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return path


def parquet_roundtrip(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write (optionally partitioned) and read back; partition columns come
    back last, so the original column order is restored."""
    write_parquet(df, path, partition_by)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def csv_roundtrip(df: DataFrame, path: str) -> DataFrame:
    """CSV with a header; read back by name as text and cast to the writer's types. Line breaks, outer blanks, quotes and
    empty cells come back as they were; null is the token ``NULL_CELL``."""
    keep_cells(df.select(*[F.col(f"`{f.name}`").cast("string").alias(f.name) for f in df.schema]).write.mode("overwrite"), NULL_CELL).csv(path)
    back = read_cells(df.sparkSession, path)
    cell = lambda c: F.nullif(F.coalesce(F.col(f"`{c}`"), F.lit("")), F.lit(NULL_CELL))
    return back.select(*[cell(f.name).cast(f.dataType).alias(f.name) for f in df.schema])


def json_roundtrip(df: DataFrame, path: str) -> DataFrame:
    """Parameter / manifest records as JSON lines, read back with their schema."""
    df.write.mode("overwrite").json(path)
    return df.sparkSession.read.schema(df.schema).json(path)
