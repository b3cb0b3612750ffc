import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from canvass.llm import induced


def brute(text, cap):
    n = len(text)
    tails = [text[i:] for i in range(n)]
    order = sorted(range(n), key=tails.__getitem__, reverse=True)
    shared = [0] * n
    for k in range(1, n):
        a, b = tails[order[k - 1]], tails[order[k]]
        while shared[k] < min(len(a), len(b), cap) and a[shared[k]] == b[shared[k]]:
            shared[k] += 1
    return order, shared


def sort(text, cap, memory):
    got = list(induced.suffixes(np.array(text, np.uint16), cap, memory))
    return [x for at, _ in got for x in at.tolist()], [x for _, s in got for x in s.tolist()]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.booleans(), st.booleans())
def test_equals_brute_force(text, doubled, small):
    text = text * 2 if doubled else text
    old = induced.BATCH, induced.INTERNAL
    if small:  # tiny batches, everything spilled, names sorted by induction again
        induced.BATCH, induced.INTERNAL = 5, 0
    try:
        assert sort(text, 10_000, 32 if small else 1 << 20) == brute(text, 10_000)
    finally:
        induced.BATCH, induced.INTERNAL = old


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=1, max_size=50), st.integers(1, 9))
def test_capped_prefixes(text, cap):
    at, shared = sort(text, cap, 1 << 20)
    assert sorted(at) == list(range(len(text))) and shared == brute(text, cap)[1]


def test_runs_go_to_disk():
    pool = induced.Pool(100)
    run = induced.Run(pool)
    for i in range(10):
        run.push(np.arange(20) + i, np.arange(20))
    assert pool.spilled > 0
    first, _ = run.pop()
    assert first[:20].tolist() == list(range(20)) and len(first) == 200
    assert run.pop() is None


def test_empty_text():
    assert list(induced.suffixes(np.zeros(0, np.uint16), 5)) == []


@pytest.mark.parametrize("text", [[5] * 300, list(range(50)), list(range(50))[::-1]])
def test_long_runs(text):
    assert sort(text, 1000, 1 << 20) == brute(text, 1000)


def test_names_that_differ_are_sorted_once(monkeypatch):
    rng = np.random.default_rng(3)
    names = rng.integers(0, 1000, 5000)
    names[4000:4040] = names[2000:2040]  # few suffixes are equal beyond two names
    counted = []
    for name in ("argsort", "unique"):
        monkeypatch.setattr(np, name, lambda x, *a, f=getattr(np, name), **k: counted.append(len(x)) or f(x, *a, **k))
    order, levels, agreed = induced._sort_names(names, 64)
    monkeypatch.undo()
    assert order.tolist() == sorted(range(5000), key=lambda i: names[i : i + 64].tolist())
    assert sum(counted) < 3 * len(names)
    for k, level in enumerate(levels):
        first = {}
        for place, i in enumerate(order.tolist()):
            first.setdefault(tuple(names[i : i + (1 << k)].tolist()), place)
        assert all(level[i] == first[tuple(names[i : i + (1 << k)].tolist())] for i in range(5000))
    for k in range(1, 5000):
        a, b = names[order[k - 1] :].tolist(), names[order[k] :].tolist()
        assert agreed[k] == sum(len(b) >= 1 << j <= len(a) and a[: 1 << j] == b[: 1 << j] for j in range(len(levels)))
