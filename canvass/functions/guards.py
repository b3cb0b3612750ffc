"""Size guards for the few results that are allowed to reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row


class TooLargeForDriver(RuntimeError):
    pass


def collect_bounded(df: DataFrame, max_rows: int, what: str) -> list[Row]:
    """Collect ``df`` only if it has at most ``max_rows`` rows.

    ``limit(max_rows + 1)`` stops the scan early, so an unexpectedly large
    result costs one bounded job instead of an out-of-memory driver.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise TooLargeForDriver(f"{what}: more than {max_rows} rows; refusing to collect")
    return rows
