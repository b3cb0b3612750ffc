"""Questionnaire-shaped views over the driver's tables (FIXTURES.md F1-F4).

They are plain lazy DataFrames; every query in the catalog starts from one of
them, so all work grows with the underlying tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.session import scratch_path, ship_package
from canvass.sources.tables import table

# Fixed values of the respondent view (FIXTURES.md F1).
ASKED_PRIORITY = "1-URGENT"
ASKED_SINCE = "2000-06-01 00:00:00"
HAVE_FLAG = "R"
WANT_FLAG = "A"
FEW_ORDERS = 6  # fewer orders than this -> 'Less than 1 year'
MANY_ORDERS = 15  # more orders than this -> 'More than 50 years'


def _asked(orders_priority: Column, orders_date: Column) -> Column:
    return (orders_priority == F.lit(ASKED_PRIORITY)) & (
        orders_date >= F.expr(f"TIMESTAMP_NTZ '{ASKED_SINCE}'")
    )


def _sorted_cell(values: Column) -> Column:
    """Distinct non-null values joined with ';' in sorted order ('' when none)."""
    return F.array_join(F.array_sort(F.collect_set(values)), ";")


_MATERIALIZED: dict[tuple, str] = {}
#: Tables that the views are built from.
BASE_TABLES = ("customer", "nation", "orders", "lineitem", "part", "documents", "labels")


def materialized(spark: SparkSession, name: str, sf_dir: str, build) -> DataFrame:
    """Write a derived view once per application and scale to the shared
    checkpoint folder and read it back - the silver/gold tables of the
    workflow. Later queries read the small written table instead of
    recomputing its joins, and the lineage is cut (executor loss never forces
    a recompute from the raw tables)."""
    ship_package(spark)  # tail probabilities run in Python workers
    # by age and size of what is read, so that another table under the same path is another view
    key = (spark.sparkContext.applicationId, name, sf_dir.rstrip("/"), _state(spark, sf_dir))
    path = _MATERIALIZED.get(key)
    if path is None:
        path = scratch_path(spark, f"view-{name}")
        build().write.mode("overwrite").parquet(path)
        _MATERIALIZED[key] = path
    return spark.read.parquet(path)


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """Last change and length of each base table's file or folder: a few look-ups, no listing and no schema."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for t in BASE_TABLES:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{t}.parquet")
        status = path.getFileSystem(conf).getFileStatus(path)
        out.append((status.getModificationTime(), status.getLen()))
    return tuple(out)


def respondents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, materialized: see ``build_respondents``."""
    return materialized(spark, "respondents", sf_dir, lambda: build_respondents(spark, sf_dir))


def build_respondents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one row per customer with all three missing states.

    Plan shape: one aggregate over ``orders`` gives history, first order status
    (``min_by`` instead of a self-join) and the 'asked' spend; one aggregate over
    asked orders x R/A line items x part gives the multi-select cells. Both are
    hash-partitioned on the customer key, so the final left joins reuse that
    partitioning; ``nation`` (25 rows, a fixed dimension) is broadcast.
    """
    orders = table(spark, sf_dir, "orders")
    asked = _asked(F.col("o_orderpriority"), F.col("o_orderdate"))

    history = orders.groupBy(F.col("o_custkey").alias("custkey")).agg(
        F.count(F.lit(1)).alias("n_orders"),
        # an int code keeps the aggregate hash-based (a string buffer forces a sort)
        F.min_by(
            F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3),
            "o_orderkey",
        ).alias("first_code"),
        F.sum(F.when(asked, F.col("o_totalprice"))).alias("spend"),
        (F.count(F.when(asked, 1)) > 0).alias("was_asked"),
    )

    asked_orders = orders.filter(asked).select("o_orderkey", "o_custkey")
    lines = (
        table(spark, sf_dir, "lineitem")
        .filter(F.col("l_returnflag").isin(HAVE_FLAG, WANT_FLAG))
        .select("l_orderkey", "l_partkey", "l_returnflag")
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    cells = (
        asked_orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("o_custkey").alias("cells_key"))
        .agg(
            _sorted_cell(F.when(F.col("l_returnflag") == HAVE_FLAG, F.col("p_type"))).alias("have"),
            _sorted_cell(F.when(F.col("l_returnflag") == WANT_FLAG, F.col("p_type"))).alias("want"),
            F.count(F.when(F.col("l_returnflag") == HAVE_FLAG, 1)).alias("n_ret"),
        )
    )

    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    customer = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal"
    )
    joined = (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(history, F.col("c_custkey") == F.col("custkey"), "left")
        .join(cells, F.col("c_custkey") == F.col("cells_key"), "left")
    )
    was_asked = F.coalesce(F.col("was_asked"), F.lit(False))
    code = F.col("first_code")
    return joined.select(
        F.col("c_custkey").alias("respondent_id"),
        F.col("c_mktsegment").alias("segment"),
        F.col("n_name").alias("country"),
        F.when(F.col("c_acctbal") < 0, F.lit(None).cast("string"))
        .when(code == 1, "Yes")
        .when(code == 2, "Soon")
        .otherwise("No")
        .alias("outcome"),
        F.when(F.col("n_orders") < FEW_ORDERS, "Less than 1 year")
        .when(F.col("n_orders") > MANY_ORDERS, "More than 50 years")
        .otherwise(F.col("n_orders").cast("string"))
        .alias("years_text"),
        F.col("spend"),
        F.when(was_asked, F.coalesce(F.col("n_ret"), F.lit(0))).alias("n_returns"),
        F.when(was_asked, F.coalesce(F.col("have"), F.lit(""))).alias("have_cell"),
        F.when(was_asked, F.coalesce(F.col("want"), F.lit(""))).alias("want_cell"),
    )


def with_both_cell(df: DataFrame) -> DataFrame:
    """Add the derived multi-select ``both_cell`` = sorted(have intersect want).

    It plays the role of a questionnaire's derived intersection column: present in the
    long form, left out of the wide form.
    """
    have = F.split(F.nullif(F.col("have_cell"), F.lit("")), ";")
    want = F.split(F.nullif(F.col("want_cell"), F.lit("")), ";")
    both = F.array_join(F.array_sort(F.array_intersect(have, want)), ";")
    return df.withColumn(
        "both_cell",
        F.when(F.col("have_cell").isNull(), F.lit(None).cast("string")).otherwise(
            F.coalesce(both, F.lit(""))
        ),
    )


def doc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents LEFT JOIN labels USING (doc_id); text is not needed here."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return docs.join(labels, "doc_id", "left")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labelled documents with a deterministic score (needs no model)."""
    return (
        doc_labels(spark, sf_dir)
        .filter(F.col("quality").isNotNull())
        .select(
            "doc_id",
            F.col("quality").alias("label"),
            ((F.col("n_chars") % 97) / F.lit(97.0)).alias("score"),
        )
    )
