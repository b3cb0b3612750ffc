import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from canvass.llm import common as cm
from tests.llm.helpers import ODD, words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \t\n\x0b\x1cé日", max_size=30)), max_size=12), st.sampled_from([1, 7, 64, 1 << 20]))
def test_word_hashes_equal_words(texts, most):
    seen, rows = {}, 0
    batch = pa.record_batch({"id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    for block in cm.text_blocks([batch], "text", most):
        h, bounds = block.words()
        for i, (lo, hi) in zip(block.rows.column("id").to_pylist(), zip(bounds, bounds[1:])):
            own = words(texts[i])
            assert len(own) == hi - lo
            for w, x in zip(own, h[lo:hi].tolist()):
                assert seen.setdefault(w, x) == x
            rows += 1
    assert rows == len(texts)
    assert len(set(seen.values())) == len(seen)


def test_one_long_text_has_the_hashes_of_short_ones(monkeypatch):
    monkeypatch.setattr(cm, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(cm, "_POWERS", np.ones(1, np.uint64))
    long = pa.record_batch({"text": ["alpha beta " * 2000]})
    short = pa.record_batch({"text": ["beta alpha"]})
    found = [set(next(cm.text_blocks([b], "text")).words()[0].tolist()) for b in (long, short)]
    assert found[0] == found[1] and len(found[0]) == 2


def test_blocks_keep_all_rows_in_order():
    batch = pa.record_batch({"id": list(range(len(ODD))), "text": pa.array(ODD, pa.string())})
    got = [(i, t) for b in cm.text_blocks([batch.slice(2)], "text", 10) for i, t in zip(b.rows.column("id").to_pylist(), b.texts())]
    assert got == [(i, (t or "").encode()) for i, t in enumerate(ODD)][2:]


@pytest.mark.parametrize("n", [0, 1, 3])
def test_binaries(n):
    values, bounds = np.arange(10, dtype=np.int64), np.array([0, 2, 2, 9][: n + 1], np.int64)
    got = [np.frombuffer(x, np.int64).tolist() for x in cm.binaries(values[: bounds[-1]], bounds).to_pylist()]
    assert got == [values[i:j].tolist() for i, j in zip(bounds, bounds[1:])]
