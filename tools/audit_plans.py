"""Time every catalog query and count scans and shuffles in its final plan.

Usage: python tools/audit_plans.py [sf_dir]
Prints one line per query: build time (eager fitting / vocabulary jobs), run
time (full execution through the noop sink), and the number of file scans,
reads of checkpointed intermediates, exchanges, single-partition exchanges and
broadcasts in the executed (adaptive) plan. Fitted models are skipped.
"""

from __future__ import annotations

import re
import sys
import time

sys.path.insert(0, ".")
from canvass.plans.catalog import CATALOG  # noqa: E402
from canvass.session import local_session  # noqa: E402

SKIP = {"gbt_scores", "gbt_test_metrics", "cv_metrics"}


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session()
    rows = []
    for name, fn in CATALOG.items():
        if name in SKIP:
            continue
        t0 = time.time()
        df = fn(spark, sf_dir)
        t1 = time.time()
        df.write.format("noop").mode("overwrite").save()
        t2 = time.time()
        plan = df._jdf.queryExecution().executedPlan().toString()
        files = len(re.findall(r"FileScan|Scan parquet|Scan csv|Scan json", plan))
        ckpt = len(re.findall(r"Scan ExistingRDD", plan))
        shuffles = len(re.findall(r"Exchange", plan)) - len(re.findall(r"ReusedExchange", plan))
        single = len(re.findall(r"Exchange SinglePartition", plan))
        broadcast = len(re.findall(r"BroadcastExchange", plan))
        rows.append((name, t1 - t0, t2 - t1, files, ckpt, shuffles, single, broadcast))
    for r in sorted(rows, key=lambda r: -(r[1] + r[2])):
        print("%-28s build=%6.2fs run=%6.2fs file_scans=%d checkpoint_reads=%d exchanges=%d single_partition=%d broadcasts=%d" % r)


if __name__ == "__main__":
    main()
