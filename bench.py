"""Benchmark the headline queries.

Runs each query of ``HEADLINE`` on ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) with ``local[$BENCH_CPUS]`` and prints ONE JSON line:
{"metric": ..., "value": total seconds, "unit": "sec", "queries": {...}, "sf": ...}.

Every query is executed in full through the ``noop`` sink (a ``count()`` would
let Catalyst prune the work away). ``prepare_reference_shape`` (the size of the reference's published timing) is listed
beside them and isn't part of the total. The session is warmed up once on the
smallest scale first, so JVM start-up and first-time code generation are not
charged to the first query. ``BENCH_EVENT_LOG_DIR`` (optional) writes Spark's
event log there for per-stage timings.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from canvass.plans.catalog import CATALOG  # noqa: E402
from canvass.session import local_session  # noqa: E402

HEADLINE = [
    # preprocessing: raw CSV -> silver -> long + wide, written (the reference's
    # one published timing), then its parts
    "prepare_tables",
    "clean_silver",
    "multiselect_long",
    "multihot",
    "parquet_roundtrip",
    # descriptive tables
    "top_options",
    "have_vs_want",
    "rate_by_option_and_band",
    "value_counts_pct",
    "numeric_profile",
    "category_profile",
    # tests of association
    "correlation_pairs",
    "chi_square",
    "anova",
    # split + transforms + evaluation
    "stratified_split",
    "fit_apply_linear",
    "roc_auc",
    "classification_report",
]


#: The reference's own table: respondents, multi-select questions and options of each.
ROWS, QUESTIONS, OPTIONS, PLAIN = 65_437, 57, 18, 40


def reference_shape(spark, sf_dir: str) -> float:
    """Raw CSV -> silver, long and wide at the size of the reference's published timing (65,437 rows, 97 columns). The raw file is
    derived from ``customer`` (rows several times over, answers by a hash) and written before the clock starts."""
    from pyspark.sql import functions as F

    from canvass.operators import prepare as pr
    from canvass.session import scratch_path
    from canvass.sources import csv as csvsrc
    from canvass.sources.tables import table

    people = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    times = F.sequence(F.lit(0), F.lit(-(-ROWS // max(1, people.count()))))
    rows = people.select("*", F.explode(times).alias("again"))
    rows = rows.select((F.col("again") * 10_000_000 + F.col("c_custkey")).alias("respondent_id"), "c_mktsegment").limit(ROWS)
    cell = lambda q: F.array_join(
        F.filter(F.array(*[F.lit(f"Option {q}.{k}") for k in range(OPTIONS)]), lambda o: F.pmod(F.xxhash64("respondent_id", o), F.lit(5)) == 0), ";"
    )
    asked = lambda q: F.when(F.pmod(F.xxhash64("respondent_id", F.lit(q)), F.lit(4)) > 0, cell(q))
    raw = rows.select(
        "respondent_id",
        *[asked(q).alias(f"Q{q}") for q in range(QUESTIONS)],
        *[F.concat("c_mktsegment", F.lit(str(k))).alias(f"P{k}") for k in range(PLAIN - 1)],
    )
    path = csvsrc.write_exact_na(raw.repartition(8), scratch_path(spark, "bench-raw"))
    t0 = time.perf_counter()
    pr.prepare(csvsrc.read_exact_na(spark, path), scratch_path(spark, "bench-prepared"), "respondent_id")
    return round(time.perf_counter() - t0, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    extra = {}
    event_dir = os.environ.get("BENCH_EVENT_LOG_DIR")
    if event_dir:
        # stage and task times without the web UI: Spark's event log in a scratch folder
        os.makedirs(event_dir, exist_ok=True)
        extra = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": event_dir}
    spark = local_session(
        cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="canvass-bench", extra=extra
    )
    warm = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    if os.path.isdir(warm):
        CATALOG["have_vs_want"](spark, warm).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        CATALOG[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)$", sf_dir)
    times["prepare_reference_shape"] = reference_shape(spark, sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times[q] for q in HEADLINE), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(m.group(1)) if m else sf_dir,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
