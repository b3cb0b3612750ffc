"""Scans and sinks: parquet tables, exact-null CSV, codebook CSV, parquet/CSV/JSON sinks."""
