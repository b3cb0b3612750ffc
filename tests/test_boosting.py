import math
import pickle
import random

import numpy as np
import pytest
from pyspark import RDD
from pyspark.sql import functions as F

from canvass.operators import boosting as bo
from canvass.operators import model as md
from canvass.plans import catalog

UNIT = 1 << 30


def plain_trees(bins, label, trees, depth, rate, l2):
    """Level-wise boosting, row by row: each tree as nested (feature, cut, left, right) or a leaf value; the final margins."""
    n, width = len(bins), len(bins[0])
    margin = [0.0] * n
    out = []
    for _ in range(trees):
        p = [float(1.0 / (1.0 + np.exp(-np.float64(m)))) for m in margin]
        g = [round((a - y) * UNIT) for a, y in zip(p, label)]
        h = [max(round(a * (1 - a) * UNIT), 1) for a in p]

        def score(rows):
            return (sum(g[i] for i in rows) / UNIT) ** 2 / (sum(h[i] for i in rows) / UNIT + l2)

        def node(rows, level):
            best, found = 1e-9, None
            if level < depth:
                for f in range(width):
                    for cut in sorted({bins[i][f] for i in rows})[:-1]:
                        left = [i for i in rows if bins[i][f] <= cut]
                        right = [i for i in rows if bins[i][f] > cut]
                        gain = score(left) + score(right) - score(rows)
                        if gain > best:
                            best, found = gain, (f, cut, left, right)
            if found is None:
                value = -rate * (sum(g[i] for i in rows) / UNIT) / (sum(h[i] for i in rows) / UNIT + l2)
                for i in rows:
                    margin[i] += value
                return value
            f, cut, left, right = found
            return f, cut, node(left, level + 1), node(right, level + 1)

        out.append(node(list(range(n)), 0))
    return out, margin


def nested(tree, i=0):
    if tree.feature[i] < 0:
        return float(tree.value[i])
    return int(tree.feature[i]), int(tree.cut[i]), nested(tree, 2 * i + 1), nested(tree, 2 * i + 2)


def table(spark, n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = rng.choice([None, float("nan"), rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)])
        z, flag, cat = rng.randrange(5) * 1.0, rng.choice([0, 1, None]), rng.choice(["a", "b", "c", None])
        signal = (x if x is not None and not math.isnan(x) else 0.7) + (z == 3) + 0.8 * (cat == "b") + (flag or 0)
        rows.append((i, x, z, cat, flag, int(signal + rng.gauss(0, 0.5) > 1)))
    return spark.createDataFrame(rows, "id long, x double, `z.z` double, cat string, flag int, target int")


COLUMNS = bo.Columns(["x", "z.z"], ["cat"], ["flag"])


def test_trees_equal_a_plain_builder(spark):
    df = table(spark, 90)
    only = bo.Columns(["x", "z.z"], [], ["flag"])
    model = bo.fit(df, only, trees=4, depth=3, rate=0.3)
    rows = df.collect()
    cuts = model.cuts
    code = lambda v, c: 0 if v is None or math.isnan(v) else 1 + int(np.searchsorted(c, v))
    bins = [[code(v, c) for v, c in zip((r["x"], r["z.z"], r["flag"]), cuts)] for r in rows]
    want, margin = plain_trees(bins, [r.target for r in rows], 4, 3, 0.3, bo.L2)

    def same(a, b):
        if isinstance(a, tuple) != isinstance(b, tuple):
            return False
        if not isinstance(a, tuple):
            return a == pytest.approx(b, rel=1e-12, abs=1e-15)
        # a plain cut is the highest bin that goes left; bins without rows between two cuts don't matter
        return a[:2] == b[:2] and same(a[2], b[2]) and same(a[3], b[3])

    assert all(same(nested(t), w) for t, w in zip(model.trees, want))
    got = {r.id: r.probability for r in model.score(df, "id").collect()}
    assert all(got[r.id] == pytest.approx(1 / (1 + math.exp(-m)), rel=1e-12) for r, m in zip(rows, margin))


def test_blocks_and_local_nodes_don_t_change_the_trees(spark):
    df = table(spark, 400)
    one = bo.fit(df, COLUMNS, trees=3, depth=4)
    for kinds in ({"block_rows": 60, "local_rows": 0}, {"block_rows": 60, "local_rows": 90}, {"block_rows": 150, "local_rows": 1000}):
        other = bo.fit(df, COLUMNS, trees=3, depth=4, **kinds)
        assert [nested(t) for t in other.trees] == [nested(t) for t in one.trees]


def test_what_the_driver_gets_doesn_t_grow_with_the_blocks(spark, monkeypatch):
    df = table(spark, 1200)
    sent = []
    collect = RDD.collect

    def counted(rdd):
        out = collect(rdd)
        sent.append(len(pickle.dumps(out)))
        return out

    monkeypatch.setattr(RDD, "collect", counted)
    most = []
    for block_rows in (600, 40):
        sent.clear()
        bo.fit(df, COLUMNS, trees=2, depth=4, block_rows=block_rows, local_rows=0)
        most.append(max(sent))
    # sums by bin take over 10000 bytes a node and block here
    assert max(most) < 6000 and most[1] < 1.1 * most[0]


def test_margins_are_renewed(spark, monkeypatch):
    df = table(spark, 200)
    want = [nested(t) for t in bo.fit(df, COLUMNS, trees=7, depth=2).trees]
    monkeypatch.setattr(bo, "REFRESH", 2)
    assert [nested(t) for t in bo.fit(df, COLUMNS, trees=7, depth=2).trees] == want


def test_ordered_statistics_equal_plain_prefixes(spark):
    df = table(spark, 300).withColumnRenamed("id", "__row")
    order = F.pmod(F.xxhash64(F.lit(42), F.col("__row")), F.lit(1 << bo.ORDER_BITS)).alias("o")
    rows = sorted(df.select("__row", "cat", "target", order).collect(), key=lambda r: (r.o, r["__row"]))
    got = {r["__row"]: r.t0 for r in bo.ordered_statistics(df, "__row", "target", ["cat"], 0.4).collect()}
    seen = {}
    for r in rows:
        n, s = seen.get(r.cat, (0, 0))
        assert got[r["__row"]] == pytest.approx((s + 20 * 0.4) / (n + 20))
        seen[r.cat] = n + 1, s + r.target
    assert len(got) == 300


def test_learns_and_scores_unseen_levels_and_empty_tables(spark):
    model = bo.fit(table(spark, 800), COLUMNS, trees=40, depth=3, rate=0.2)
    test = table(spark, 400, seed=9)
    hits = model.score(test, "id").agg(F.avg((F.col("prediction") == F.col("target")).cast("double"))).first()[0]
    base = test.agg(F.avg("target")).first()[0]
    assert hits > max(base, 1 - base) + 0.05
    assert model.score(test.withColumn("cat", F.lit("new")), "id").filter("probability is null").count() == 0
    none = bo.fit(test.limit(0), COLUMNS)
    assert {r.probability for r in none.score(test, "id").collect()} == {0.5}
    assert model.score(test.limit(0), "id").count() == 0


def test_the_query_fits_all_training_rows(spark, monkeypatch):
    df = table(spark, 300).withColumns({"respondent_id": F.col("id"), "split": F.when(F.col("id") % 5 == 0, "test").otherwise("train")})
    spec = md.FeatureSpec(numeric=["x", "z.z"], categorical=["cat"], passthrough=["flag"])
    fit, seen = bo.fit, []
    monkeypatch.setattr(catalog, "tree_table", lambda *_: (df, spec))
    monkeypatch.setattr(catalog.fx, "materialized", lambda spark, name, sf_dir, build: build())
    monkeypatch.setattr(bo, "fit", lambda train, columns: seen.append(train.count()) or fit(train, columns, trees=1, depth=2))
    monkeypatch.setattr(md.bounded_rows, "__defaults__", (50, 42))
    assert catalog.gbt_predictions(spark, "").count() == 60
    assert seen == [240]


def test_a_small_table_takes_one_job_for_many_trees(spark, monkeypatch):
    df, taken, collect = table(spark, 150), [], RDD.collect
    monkeypatch.setattr(RDD, "collect", lambda rdd: taken.append(1) or collect(rdd))
    model = bo.fit(df, COLUMNS, trees=bo.REFRESH + 3, depth=2)
    assert len(model.trees) == bo.REFRESH + 3 and len(taken) == 2


def test_margins_stay_with_the_blocks_of_a_large_table(spark, monkeypatch):
    df = table(spark, 200)
    want = [nested(t) for t in bo.fit(df, COLUMNS, trees=7, depth=2).trees]
    monkeypatch.setattr(bo, "REFRESH", 2)
    monkeypatch.setattr(bo, "LOCAL_CELLS", 40)
    assert [nested(t) for t in bo.fit(df, COLUMNS, trees=7, depth=2, block_rows=60).trees] == want


def test_features_counted_together_give_the_sums_of_each(monkeypatch):
    monkeypatch.setattr(bo, "SUM_ROWS", 70)
    rng = np.random.default_rng(3)
    size = np.array([255, 3, 7, 3, 255, 3, 3, 3, 3, 3, 22, 2])
    grower = bo.Grower(np.concatenate([[0], np.cumsum(size)]), 3, 0.1, 3.0)
    assert sorted(f for joint in grower.joints() for f in joint) == list(range(len(size))) and len(grower.joints()) == 5
    bins = np.stack([rng.integers(0, s, 300) for s in size], axis=1).astype(np.uint8)
    grads = rng.integers(-UNIT, UNIT, (2, 300))
    slot = rng.integers(-1, 2, 300)
    for slots, at in ((1, None), (2, slot)):
        want = np.zeros((slots, size.sum(), 3), np.int64)
        for i in range(300):
            s = 0 if at is None else at[i]
            for f in range(len(size)):
                if s >= 0:
                    want[s, grower.offsets[f] + bins[i, f]] += (*grads[:, i], 1)
        assert (grower.sums(grower.codes(bins), grads, at, slots) == want).all()
