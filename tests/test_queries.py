"""Every catalog query against its DuckDB oracle on the smallest scale, and
the rows-only queries for shape and invariants."""

import hashlib
import math

import duckdb
import pytest

import __spark_entry__ as E
from canvass.plans.catalog import CATALOG
from canvass.sources.tables import TABLES

from .conftest import SF_SMALL

# the catalog's own queries (those of canvass.llm are tested in tests/llm)
QUERIES = {k: v for k, v in E.queries().items() if k in CATALOG}
ORACLES = {k: v for k, v in E.oracle_sql().items() if k in CATALOG}
SLOW = {"gbt_scores", "gbt_test_metrics", "cv_metrics"}


def _norm(v):
    if v is None:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def _digest(pdf):
    cols = sorted(pdf.columns)
    rows = sorted(repr(tuple(_norm(x) for x in r)) for r in pdf[cols].astype(object).itertuples(index=False))
    return cols, len(rows), hashlib.sha1("\n".join(rows).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_oracle(spark, con, key):
    got = _digest(QUERIES[key](spark, SF_SMALL).toPandas())
    want = _digest(con.execute(ORACLES[key]).fetchdf())
    assert got == want


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_rows_only_queries_run(spark, key):
    rows = QUERIES[key](spark, SF_SMALL).collect()
    assert len(rows) > 0


def test_model_reload_identical(spark):
    r = QUERIES["model_reload_check"](spark, SF_SMALL).first()
    assert r.n_rows > 0 and r.n_different == 0


def test_entry_schema_stable(spark):
    a = E.entry(spark)
    b = E.entry(spark)
    assert a.schema == b.schema
    assert len(a.collect()) > 0


def test_tree_and_cross_validation_queries(spark):
    scores = QUERIES["gbt_scores"](spark, SF_SMALL).collect()
    assert scores and all(0 <= r.probability <= 1 for r in scores)
    assert QUERIES["gbt_test_metrics"](spark, SF_SMALL).first().n == len(scores)
    cv = {r.metric: r for r in QUERIES["cv_metrics"](spark, SF_SMALL).collect()}
    assert set(cv) == {"roc_auc", "accuracy", "f1", "f1_macro", "balanced_accuracy"} and all(0 <= r["mean"] <= 1 for r in cv.values())
