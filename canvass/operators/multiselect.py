"""Multi-select answers: detection, long unfold, multi-hot, option counts.

A multi-select cell is a ``sep``-joined string with three missing states:
null (never asked), ``''`` (asked, nothing picked) and tokens. Tokens are
never trimmed here; empty tokens are dropped; duplicates are kept in the long
form and count once in the multi-hot form.

Plan notes: the long form is one ``unpivot`` + ``explode`` over a single scan
(never one union per question), and per-option totals are one ``groupBy`` on
the long form (map-side partial aggregation) rather than hundreds of computed
0/1 columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.fixed import MULTI_SEP
from canvass.functions.guards import collect_bounded
from canvass.functions.scalars import strip


def _quoted(sep: str) -> str:
    return "\\Q" + sep + "\\E"


def split_cell(cell: Column, sep: str = MULTI_SEP) -> Column:
    """Tokens of a cell; null for null and for '' (asked but empty)."""
    return F.split(F.nullif(cell, F.lit("")), _quoted(sep), -1)


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def quoted(name: str) -> str:
    """A column name as SQL text, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def detect_multiselect(df: DataFrame, sep: str = MULTI_SEP, columns: Sequence[str] | None = None) -> DataFrame:
    """M1: string columns in which ``sep`` occurs in any non-null row.

    One global aggregate (partial per task, one tiny merge) for all columns,
    then ``stack`` to one row per column: ``(column_name, is_multiselect)``.
    """
    cols = list(columns) if columns is not None else string_columns(df)
    if not cols:
        raise ValueError("no string columns to inspect")
    flags = df.agg(
        *[
            F.coalesce(F.max(F.col(quoted(c)).contains(sep)), F.lit(False)).alias(f"_m{i}")
            for i, c in enumerate(cols)
        ]
    )
    return flags.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column_name"), F.col(f"_m{i}").alias("is_multiselect"))
                    for i, c in enumerate(cols)
                ]
            )
        ).alias("r")
    ).select("r.*")


def unfold_long(
    df: DataFrame,
    id_col: str,
    questions: Sequence[str],
    sep: str = MULTI_SEP,
    id_alias: str | None = None,
) -> DataFrame:
    """M3: ``(id, question, value)`` - one row per token; null and '' cells and
    empty tokens give no row; duplicate tokens are kept."""
    out_id = id_alias or id_col
    stacked = df.select(F.col(quoted(id_col)).alias(out_id), *map(quoted, questions)).unpivot(
        quoted(out_id), list(map(quoted, questions)), "question", "cell"
    )
    return (
        stacked.filter(F.col("cell").isNotNull())
        .select(quoted(out_id), "question", F.explode(F.split(F.col("cell"), _quoted(sep), -1)).alias("value"))
        .filter(F.col("value") != "")
    )


def answered_flags(df: DataFrame, questions: Sequence[str]) -> list[Column]:
    """``<q>__answered`` = cell is not null ('' counts as answered)."""
    return [F.col(quoted(q)).isNotNull().alias(f"{q}__answered") for q in questions]


def option_vocabulary(long_df: DataFrame) -> DataFrame:
    """Distinct ``(question, value)`` pairs, sorted (bounded by the questionnaire)."""
    return long_df.select("question", "value").distinct()


def collect_vocabulary(long_df: DataFrame, max_options: int = 20_000) -> dict[str, list[str]]:
    """Bring the option vocabulary to the driver behind a size guard."""
    rows = collect_bounded(option_vocabulary(long_df), max_options, "option vocabulary")
    vocab: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["question"], r["value"])):
        vocab.setdefault(r["question"], []).append(r["value"])
    return vocab


def multihot(
    df: DataFrame,
    keep: Sequence[str],
    vocab: dict[str, list[str]],
    sep: str = MULTI_SEP,
    exclude_suffix: str | None = None,
    questions: Sequence[str] | None = None,
) -> DataFrame:
    """M2 + M4 + P6 + P7: one projection producing the wide export.

    For every question of ``questions`` in their order (those of the vocabulary without; none that end in
    ``exclude_suffix``): ``<q>__answered``, also for a question that was only ever answered with '', and one tinyint
    ``<q>__<token>`` per sorted token of the vocabulary; null and '' give all zeros, duplicates give 1.
    A cell's tokens are looked up once and packed into bits; a column is a test of one bit. The projection goes to Spark as SQL text: a wide table has a thousand columns and more.
    """
    used = [q for q in (questions if questions is not None else list(vocab)) if not (exclude_suffix and q.endswith(exclude_suffix))]
    cells, columns = [quoted(c) for c in keep], [quoted(c) for c in keep]
    for i, q in enumerate(used):
        cells.append(f"{quoted(q)} IS NOT NULL AS __a{i}")
        columns.append(f"__a{i} AS {quoted(q + '__answered')}")
        options = vocab.get(q, [])
        for w in range(0, len(options), WORD_BITS):
            word = options[w : w + WORD_BITS]
            cells.append(f"{_answer_bits(q, word, sep)} AS __b{i}_{w}")
            # array_position counts from 1, so bit 0 marks the tokens that the word lacks
            columns += [f"cast(shiftright(__b{i}_{w}, {k}) & 1 AS tinyint) AS {quoted(f'{q}__{t}')}" for k, t in enumerate(word, 1)]
    return df.selectExpr(*cells).selectExpr(*columns)


#: Options of one bit word.
WORD_BITS = 60


def _answer_bits(question: str, options: Sequence[str], sep: str) -> str:
    """A cell's tokens as one number: bit k for the k-th of ``options``; each token is looked up once."""
    tokens = f"split(nullif({quoted(question)}, ''), {literal(_quoted(sep))}, -1)"
    listed = f"array({', '.join(map(literal, options))})"
    return f"coalesce(aggregate({tokens}, 0L, (bits, t) -> bits | shiftleft(1L, cast(array_position({listed}, t) AS int))), 0L)"


def option_counts(df: DataFrame, questions: Sequence[str], sep: str = MULTI_SEP) -> DataFrame:
    """Respondents per ``(question, value)``; a token repeated in one cell counts once
    (the multi-hot total). One explode and one partially-aggregated ``groupBy``."""
    names = list(map(quoted, questions))
    stacked = df.select(*names).unpivot([], names, "question", "cell")
    return (
        stacked.select("question", F.explode(F.array_distinct(split_cell(F.col("cell"), sep))).alias("value"))
        .filter(F.col("value") != "")
        .groupBy("question", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def top_options(counts: DataFrame, n: int) -> DataFrame:
    """The ``n`` most chosen options per question (ties by value).

    The window runs over already-aggregated counts (bounded by the vocabulary),
    never over raw rows.
    """
    w = Window.partitionBy("question").orderBy(F.col("n").desc(), F.col("value").asc())
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def have_vs_want(df: DataFrame, have: str, want: str, n: int, sep: str = MULTI_SEP) -> DataFrame:
    """M7 + M8 + J1: top-``n`` options by the Have count, the Want count of the
    same options (null when nobody wants it), melted to ``(value, kind, n)``."""
    counts = option_counts(df, [have, want], sep)
    # one row per option with both counts (a pivot of the counts, one scan)
    wide = counts.groupBy("value").pivot("question", [have, want]).agg(F.first("n"))
    wide = wide.select("value", F.col(have).alias("have_n"), F.col(want).alias("want_n")).filter(F.col("have_n").isNotNull())
    # the window runs over the option vocabulary, not rows
    w = Window.orderBy(F.col("have_n").desc(), F.col("value").asc())
    top = wide.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return top.unpivot(["value", "rank"], ["have_n", "want_n"], "kind", "n").select(
        "value",
        F.regexp_replace("kind", "_n$", "").alias("kind"),
        # a double, like the reference's re-indexed counts: null when nobody chose it
        F.col("n").cast("double").alias("n"),
        "rank",
    )


def derived_set_check(df: DataFrame, id_col: str, have: str, want: str, both: str, sep: str = MULTI_SEP) -> DataFrame:
    """M5: does ``both`` equal ``have`` intersect ``want`` on every row?

    Re-derived through the long form (the options a respondent has under both
    questions, from one aggregate per respondent), then compared with the
    stored cell null-safely. Returns one row of counts.
    """
    long_df = unfold_long(df, id_col, [have, want], sep)
    # one aggregate per respondent: the two option sets (bounded by the
    # questionnaire) and their intersection
    rederived = long_df.groupBy(id_col).agg(
        F.array_join(
            F.array_sort(
                F.array_intersect(
                    F.collect_set(F.when(F.col("question") == have, F.col("value"))),
                    F.collect_set(F.when(F.col("question") == want, F.col("value"))),
                )
            ),
            sep,
        ).alias("rederived")
    )
    joined = df.select(id_col, have, both).join(rederived, id_col, "left")
    expected = F.when(F.col(have).isNull(), F.lit(None).cast("string")).otherwise(
        F.coalesce(F.col("rederived"), F.lit(""))
    )
    same = F.col(both).eqNullSafe(expected)
    return joined.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(same, 1)).alias("n_match"),
        F.count(F.when(~same, 1)).alias("n_mismatch"),
    )


def explode_trimmed(df: DataFrame, cell: str, sep: str = MULTI_SEP, alias: str = "option") -> DataFrame:
    """M9: explode a cell and strip every token (the chart path trims)."""
    exploded = df.withColumn(alias, F.explode(F.split(F.col(quoted(cell)), _quoted(sep), -1)))
    return exploded.withColumn(alias, strip(F.col(alias)))


def response_rate_by_class(df: DataFrame, questions: Sequence[str], class_col: str) -> DataFrame:
    """Share of respondents who answered each question, per target class
    (the leakage diagnosis). Unpivot once, one ``groupBy``."""
    names = list(map(quoted, questions))
    stacked = df.filter(F.col(class_col).isNotNull()).select(class_col, *names).unpivot(class_col, names, "question", "cell")
    return stacked.groupBy("question", class_col).agg(
        F.count(F.lit(1)).alias("n"),
        (F.avg(F.col("cell").isNotNull().cast("double")) * 100.0).alias("answer_rate"),
    )
