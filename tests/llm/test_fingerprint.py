import hashlib
import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from canvass.llm import common as cm
from canvass.llm import fingerprint as fp
from tests.llm.helpers import ODD, documents, sentence


def pieces(text):
    out = set()
    for line in (text or "").split("\n"):
        w = [x for x in line.encode().split() if x]
        out |= {b" ".join(w[i : i + fp.PIECE]) for i in range(0, len(w), fp.PIECE)}
    return out


def alike(a, b):
    a, b = pieces(a), pieces(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def check(spark, texts, ids, ranges=None):
    rows = sorted(zip(ids, texts), key=lambda r: r[0])
    got = fp.fingerprint_edits(spark, documents(spark, texts, ids).withColumnRenamed("lang", "range"), ranges=ranges).collect()
    assert len(got) == len(texts)
    found = {r.doc_id: r for r in got}
    for k, (i, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        new = fp.edited(t, following)
        r = found[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert abs(r.near_edited - alike(t, new)) < 1e-9 and abs(r.near_next - alike(t, following)) < 1e-9
    return found


def test_equals_plain_python_over_any_ranges(spark):
    rng = random.Random(1)
    texts = [*ODD[:8], *["\n".join(sentence(rng, rng.randrange(1, 40), 50) for _ in range(rng.randrange(1, 9))) for _ in range(40)], sentence(rng, 6000)]
    texts += [texts[10], texts[10]]
    ids = rng.sample(range(1000), len(texts))
    base = None
    for ranges in (1, 7, None):
        found = check(spark, texts, ids, ranges)
        prints = {i: r.fingerprint for i, r in found.items()}
        base = base or prints
        assert prints == base
    same = [found[i].fingerprint for i, t in zip(ids, texts) if t == texts[10]]
    assert len(same) == 3 and len(set(same)) == 1


def test_repeated_rows_null_ids_single_and_empty(spark):
    got = fp.fingerprint_edits(spark, documents(spark, ["a b", "a b", "c", None], ids=[1, 1, None, None])).collect()
    assert len(got) == 4
    one = fp.fingerprint_edits(spark, documents(spark, ["a b c d"], ids=[3])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fp.fingerprint_edits(spark, documents(spark, [])).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(1, 400), max_size=90), st.sets(st.integers(1, 400), max_size=90)), min_size=1, max_size=6))
def test_peeling_recovers_all_differences(pairs):
    def packed(sets):
        flat = [np.array(sorted(s), np.uint64) * np.uint64(0x9E3779B97F4A7C15) for s in sets]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int64)
        return np.concatenate([np.sort(x) for x in flat]), bounds

    a, b = packed([x for x, _ in pairs]), packed([y for _, y in pairs])
    base = []
    for digest, bounds in (a, b):
        s = fp.Sketch(len(pairs), fp.BASE_BITS)
        s.add(cm.owners(bounds), digest, 1)
        base.append(s)
    every = np.arange(len(pairs))
    got = fp.likeness(a, b, tuple(base), every, every)
    assert np.allclose(got, [len(x & y) / len(x | y) if x | y else 1.0 for x, y in pairs])


def test_paragraphs_of_many_rows():
    texts = ["a b\nc", None, "\n\n", " ".join(map(str, range(20))), "a b\na b"]
    block = next(cm.text_blocks([pa.record_batch({"text": pa.array(texts, pa.string())})], "text"))
    _, bounds = fp.paragraph_digests(block)
    assert np.diff(bounds).tolist() == [len(pieces(t)) for t in texts]
