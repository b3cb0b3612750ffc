"""Repeatable stratified splits, folds and samples.

Row order is a seeded hash, ``md5('<seed>:<id>')`` (ties by id), so every
result is the same under any partitioning and a lost task recomputes exactly
the rows it lost. Per-class quotas use the largest-remainder rule, so the
test size is exact.

Scale: ranking a 2-class target with ``row_number() over (partition by
class)`` would pull half the table into one task. Instead the hash prefix
splits each class into ``16^bucket_hex`` buckets of near-equal size. Bucket
counts are one partially-aggregated ``groupBy``; the boundary bucket of each
class is found on that small table; rows in earlier/later buckets are decided
without any ranking, and only the few rows of one boundary bucket per class are
ranked. Folds need a rank for every row: that is a window partitioned by
``(class, bucket)`` plus the bucket's offset.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canvass.fixed import FOLDS, SEED, TEST_SIZE
from canvass.functions.guards import collect_bounded
from canvass.session import checkpoint_root


def seeded_order(id_col: str, seed: int = SEED) -> Column:
    """The repeatable order key of a row: ``md5('<seed>:<id>')``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def largest_remainder_quotas(class_counts: Mapping, total_quota: int) -> dict:
    """Split ``total_quota`` over classes in proportion to their sizes; the
    rounding leftovers go to the largest remainders (ties by class)."""
    n = sum(class_counts.values())
    base = {k: (total_quota * v) // n for k, v in class_counts.items()}
    rem = {k: (total_quota * v) % n for k, v in class_counts.items()}
    extra = total_quota - sum(base.values())
    for k in sorted(class_counts, key=lambda k: (-rem[k], k))[:extra]:
        base[k] += 1
    return base


def _keyed(df: DataFrame, id_col: str, seed: int, bucket_hex: int) -> DataFrame:
    """All columns with the order key and its bucket. A null id has no hash; such rows come first, in a bucket of their own."""
    h = F.coalesce(seeded_order(id_col, seed), F.lit(""))
    return df.select("*", h.alias("_h"), F.substring(h, 1, bucket_hex).alias("_bucket"))


def _bucket_counts(keyed: DataFrame, class_col: str) -> DataFrame:
    counts = keyed.groupBy(class_col, "_bucket").agg(F.count(F.lit(1)).alias("_cnt"))
    # the window runs over bucket counts (<= 16^bucket_hex rows per class), not rows
    w = Window.partitionBy(class_col).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn("_cum", F.sum("_cnt").over(w)).withColumn("_before", F.col("_cum") - F.col("_cnt"))


def _counted(keyed: DataFrame, class_col: str) -> DataFrame:
    """Bucket counts with running totals, checkpointed: at most classes x
    16^bucket_hex rows, read for the class sizes and for the boundaries without
    scanning the rows again."""
    checkpoint_root(keyed.sparkSession)
    return _bucket_counts(keyed, class_col).checkpoint()


def _class_sizes(counts: DataFrame, class_col: str, max_classes: int) -> dict:
    rows = collect_bounded(counts.groupBy(class_col).agg(F.sum("_cnt").alias("n")), max_classes, "classes")
    return {r[class_col]: r["n"] for r in rows}


def _mark_first(
    keyed: DataFrame, counts: DataFrame, class_col: str, id_col: str, quotas: Mapping, max_classes: int
) -> DataFrame:
    """Add ``_take``: true for the first ``quotas[class]`` rows of each class in
    seeded order. Rows outside the boundary bucket are decided by comparison;
    only the boundary bucket of each class is ranked."""
    quota_map = F.create_map(*[x for k, q in quotas.items() for x in (F.lit(k), F.lit(q))])
    boundary_rows = collect_bounded(
        counts.withColumn("_quota", F.element_at(quota_map, F.col(class_col)))
        .filter((F.col("_cum") >= F.col("_quota")) & (F.col("_before") < F.col("_quota")))
        .select(class_col, "_bucket", (F.col("_quota") - F.col("_before")).alias("_need")),
        max_classes,
        "boundary buckets",
    )
    bucket_of = {r[class_col]: r["_bucket"] for r in boundary_rows}
    need_of = {r[class_col]: r["_need"] for r in boundary_rows}
    # a class without a boundary takes none of its rows
    none = F.lit(None).cast("string")
    b_map = F.create_map(*[x for k in quotas for x in (F.lit(k), F.lit(bucket_of[k]) if k in bucket_of else none)])
    n_map = F.create_map(*[x for k in quotas for x in (F.lit(k), F.lit(need_of.get(k, 0)))])
    boundary = F.element_at(b_map, F.col(class_col))
    side = keyed.withColumn("_edge", F.coalesce(F.col("_bucket") == boundary, F.lit(False)))
    decided = side.filter(~F.col("_edge")).withColumn("_take", F.coalesce(F.col("_bucket") < boundary, F.lit(False)))
    w = Window.partitionBy(class_col).orderBy("_h", id_col)
    edge = side.filter("_edge").withColumn("_take", F.row_number().over(w) <= F.element_at(n_map, F.col(class_col)))
    return decided.unionByName(edge).drop("_edge")


def stratified_split(
    df: DataFrame,
    id_col: str,
    class_col: str,
    test_size: float = TEST_SIZE,
    seed: int = SEED,
    bucket_hex: int = 5,
    max_classes: int = 1_000,
) -> DataFrame:
    """``df`` with ``split`` in {'train', 'test'}; test = ceil(test_size * N) rows in total, each class
    contributing its largest-remainder quota of its first rows in seeded order. All columns go along, so nothing is
    joined back. Rows with a null class take no part; null ids come first in the order."""
    df = df.filter(F.col(class_col).isNotNull())
    keyed = _keyed(df, id_col, seed, bucket_hex)
    counts = _counted(keyed, class_col)
    class_n = _class_sizes(counts, class_col, max_classes)
    quotas = largest_remainder_quotas(class_n, math.ceil(test_size * sum(class_n.values())))
    marked = _mark_first(keyed, counts, class_col, id_col, quotas, max_classes)
    return marked.select(*df.columns, F.when(F.col("_take"), "test").otherwise("train").alias("split"))


def stratified_folds(
    df: DataFrame, id_col: str, class_col: str, k: int = FOLDS, seed: int = SEED, bucket_hex: int = 5
) -> DataFrame:
    """``(id, class, fold)`` with fold = (rank within class - 1) mod k, the
    rank following the seeded order. Rank = offset of the row's bucket + its
    position inside the bucket (window partitioned by class and bucket)."""
    keyed = _keyed(df.select(id_col, class_col), id_col, seed, bucket_hex)
    offsets = _counted(keyed, class_col).select(class_col, "_bucket", "_before")
    w = Window.partitionBy(class_col, "_bucket").orderBy("_h", id_col)
    ranked = keyed.withColumn("_pos", F.row_number().over(w)).join(offsets, [class_col, "_bucket"])
    return ranked.select(
        id_col, class_col, ((F.col("_before") + F.col("_pos") - 1) % k).cast("int").alias("fold")
    )


def seeded_sample(df: DataFrame, id_col: str, n: int, seed: int = SEED, bucket_hex: int = 5) -> DataFrame:
    """The first ``n`` rows in seeded order (all rows when fewer). Found
    like the split's test part with one class: bucket counts, the boundary
    bucket, a rank inside it - no task ever gathers n rows per partition."""
    keyed = _keyed(df, id_col, seed, bucket_hex).withColumn("_one", F.lit(0))
    counts = _counted(keyed, "_one")
    total = _class_sizes(counts, "_one", 1).get(0, 0)
    marked = _mark_first(keyed, counts, "_one", id_col, {0: min(n, total)}, 1)
    return marked.filter(F.col("_take")).select(*df.columns)


def split_ids(split: DataFrame, id_col: str) -> DataFrame:
    """The id list of the split, written as the union of the two parts."""
    train = split.filter(F.col("split") == "train").select(id_col, F.lit("train").alias("split"))
    test = split.filter(F.col("split") == "test").select(id_col, F.lit("test").alias("split"))
    return train.unionByName(test)


def require_disjoint(split: DataFrame, id_col: str) -> None:
    """Stop when an id is in both parts."""
    n = split_disjoint(split, id_col).first()["n_overlap"]
    if n:
        raise ValueError(f"{n} ids are in the training part and in the test part")


def split_disjoint(split: DataFrame, id_col: str) -> DataFrame:
    """Sizes of both parts and the number of ids found in both (must
    be 0): one aggregate per id, then one global aggregate - a single scan and
    one shuffle, instead of a semi-join between the two parts."""
    per_id = split.groupBy(id_col).agg(
        F.count(F.when(F.col("split") == "train", 1)).alias("_tr"),
        F.count(F.when(F.col("split") == "test", 1)).alias("_te"),
    )
    return per_id.agg(
        F.sum("_tr").alias("n_train"),
        F.sum("_te").alias("n_test"),
        F.count(F.when((F.col("_tr") > 0) & (F.col("_te") > 0), 1)).alias("n_overlap"),
    )


def apply_split(split_ids_df: DataFrame, other: DataFrame, id_col: str) -> DataFrame:
    """Reuse the split on another table of the same respondents (inner equi-join)."""
    return other.join(split_ids_df.select(id_col, "split"), id_col)
