import random

import numpy as np
import pytest

from canvass.llm import topk


def brute(rows, queries, k):
    out = []
    good = [(i, np.floor(1024 * np.array(v, float)).astype(object)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, v in {(q, tuple(v)): v for q, v in queries if v is not None and all(x is not None and np.isfinite(x) for x in v)}.items():
        own = np.floor(1024 * np.array(v, float)).astype(object)
        scored = [(-int(sum(int(a) * int(b) for a, b in zip(own, c))), i is None, i or 0, i) for i, c in good if i != q[0] and len(c) == len(own)]
        out += [(q[0], r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def check(spark, rows, queries, k=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    qs = spark.createDataFrame(queries, "vec_id long, embedding array<float>")
    got = sorted((tuple(r) for r in topk.top_k(spark, df, qs, k=k).collect()), key=str)
    f32 = lambda rows: [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == brute(f32(rows), f32(queries), k)


@pytest.mark.parametrize("tile", [3, 2048])
def test_equals_brute_force_with_ties(spark, tile, monkeypatch):
    monkeypatch.setattr(topk, "TILE", tile)
    monkeypatch.setattr(topk, "QUERY_TILES", 2)
    monkeypatch.setattr(topk.tiles, "__defaults__", (topk.SCALE, tile))
    rng = random.Random(1)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.1]) for _ in range(4)]) for i in range(90)]
    check(spark, rows, [r for r in rows if r[0] % 10 == 0])


def test_odd_vectors(spark):
    rows = [
        (1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, []), (7, [1.0]),
        (8, [2.0, 2.0]), (8, [2.0, 2.0]), (None, [1.0, 2.0]), (9, [1e30, -1e30]), (10, []), (11, [-0.0001, 3.0]),
    ]
    df = [r for r in rows if r[0] != 9]
    check(spark, df, [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (6, []), (7, [1.0]), (8, [2.0, 2.0]), (None, [1.0, 2.0])][:6])


def test_large_components_are_held_at_the_ends():
    a = np.array([[1e30, 1.0]])
    assert topk.products(a, np.array([[1e30, 0.0], [-1e30, 0.0], [0.0, 3.0]])).tolist() == [[2**63 - 1, -(2**63), 3]]


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(spark, df.limit(0), df.limit(0)).count() == 0
    assert topk.top_k(spark, df, df).count() == 0  # no other row
    assert topk.top_k(spark, df.limit(0), df).count() == 0
