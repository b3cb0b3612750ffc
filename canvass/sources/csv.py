"""CSV scans with the questionnaire's exact missing-value rule.

Only the literal token ``NA`` means "never asked"; an empty cell, ``None`` and
``N/A`` are answers. Spark's ``nullValue="NA"`` is not enough (an unquoted
empty cell would also become null), so every column is read as a string with
an impossible null token and mapped afterwards: ``nullif(coalesce(c, ''), 'NA')``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.fixed import DROPPED_MARKER, NULL_TOKEN
from canvass.functions.scalars import name_rule_col, strip

_NEVER = "\u0001"


def resolve_raw_path(spark: SparkSession, path: str) -> str:
    """The plain file when it exists, else its ``.gz`` twin (checked through
    the Hadoop FileSystem of the path, so it works on any cluster store)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for candidate in (path, path + ".gz"):
        p = jvm.org.apache.hadoop.fs.Path(candidate)
        if p.getFileSystem(conf).exists(p):
            return candidate
    raise FileNotFoundError(f"neither {path} nor {path}.gz exists")


def _as_strings(spark: SparkSession, multi_line: bool):
    """A reader that takes cells as they are: no types, no trimming, no null token of its own."""
    options = {"header": True, "inferSchema": False, "nullValue": _NEVER, "emptyValue": "", "escape": '"', "multiLine": multi_line}
    return spark.read.options(**options, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def keep_cells(writer, null_value: str):
    """A CSV writer that loses nothing: outer blanks stay, quotes are doubled, every cell is quoted (so line breaks and
    empty cells read back), and null is a token of its own."""
    options = {"header": True, "nullValue": null_value, "emptyValue": "", "escape": '"', "quoteAll": True}
    return writer.options(**options, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header as all-string columns, cells as written (line breaks allowed: a file is read by one task)."""
    return _as_strings(spark, multi_line=True).csv(path)


def read_exact_na(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    partitions: int | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Header CSV (plain or .gz) read as all-string with ``NA`` as the only null.

    The header names the columns; ``columns`` picks some of them, in any order. Quoted answers that hold line
    breaks need ``multi_line``; then (and for gzip) a file is read by one task, so such an export should be many
    files. ``partitions`` spreads the rows before heavy work.
    """
    raw = _as_strings(spark, multi_line).csv(path)
    picked = list(columns) if columns is not None else raw.columns
    out = raw.select(*[F.nullif(F.coalesce(F.col(f"`{c}`"), F.lit("")), F.lit(NULL_TOKEN)).alias(c) for c in picked])
    return out.repartition(partitions) if partitions else out


def write_exact_na(df: DataFrame, path: str) -> str:
    """Write CSV the way the survey export looks: null -> ``NA``, '' -> ``""``."""
    keep_cells(df.write.mode("overwrite"), NULL_TOKEN).csv(path)
    return path


def read_codebook(spark: SparkSession, path: str) -> DataFrame:
    """S3: the codebook as all strings. Question texts hold line breaks, so a file is read by one task; a codebook
    has a row for each question."""
    return _as_strings(spark, multi_line=True).csv(path)


def clean_codebook(codebook: DataFrame, name_col: str = "column_raw", text_col: str = "question") -> DataFrame:
    """P19 on the codebook: column name through the name rule; rows with an
    empty name or the dropped marker are skipped; question text loses HTML tags
    (replaced by a space), whitespace runs collapse to one space, ``*`` is
    removed, ends are stripped, and everything after the first ``?`` is cut."""
    name = name_rule_col(F.coalesce(F.col(name_col), F.lit("")))
    q = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "<[^>]+>", " ")
    q = F.regexp_replace(q, r"(?U)\s+", " ")
    q = strip(F.regexp_replace(q, "\\*", ""))
    pos = F.instr(q, "?")
    q = F.when(pos > 0, F.substring(q, F.lit(1), pos)).otherwise(q)
    return codebook.select("*", name.alias("column_silver"), q.alias("question_clean")).filter(
        (F.col("column_silver") != "") & (F.col("column_silver") != DROPPED_MARKER)
    )
