import hashlib
import random

import numpy as np
import pytest

from canvass.llm import suffix_dedup as sd
from tests.llm.helpers import ODD, documents, sentence


def brute(texts, length):
    """(removed mask) of each text: bytes covered by windows that start at two places."""
    seen, masks = {}, []
    raw = [(t or "").encode() for t in texts]
    for t in raw:
        for p in range(len(t) - length + 1):
            seen[t[p : p + length]] = seen.get(t[p : p + length], 0) + 1
    for t in raw:
        m = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                m[p : p + length] = True
        masks.append(m)
    return raw, masks


def check(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    df = documents(spark, texts, ids).withColumnRenamed("lang", "n_removed")
    got = sd.dedup(spark, df, ["doc_id", "n_removed"], texts=True).toDF("doc_id", "lang", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text").collect()
    raw, masks = brute(texts, sd.LENGTH)
    want = []
    for i, t, m in zip(ids, raw, masks):
        kept = bytes(np.frombuffer(t, np.uint8)[~m])
        spans = int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum())
        want.append((i, "en", len(t), int(m.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    return want


def test_equals_brute_force(spark):
    rng = random.Random(5)
    passage = sentence(rng, 120)
    copy = sentence(rng, 300)
    changed = copy[:900] + "#" + copy[901:]
    texts = [
        copy, copy, changed, passage + " " + sentence(rng, 80), sentence(rng, 60) + passage[7:],
        "é" * 500 + passage[:450], "é" * 450, "=" * 1500, "-" * 401 + "x" + "-" * 400, "ab" * 400, sentence(rng, 400), *ODD[:8],
    ]
    want = check(spark, texts)
    assert want[0][3] == len(copy) and 0 < want[2][3] < len(changed) and want[10][3] == 0


def test_windows_of_exactly_the_length(spark):
    rng = random.Random(6)
    s = "".join(rng.choice("abcdefgh") for _ in range(400))
    check(spark, [s, s, s[:399], "x" + s[1:], s + "y", s[1:] + "z" + s[:-1]])


def test_repeated_rows_null_ids_and_empty_table(spark):
    rng = random.Random(7)
    t = sentence(rng, 150)
    check(spark, [t, t, t, sentence(rng, 150)], [1, 1, None, None])
    assert sd.dedup(spark, documents(spark, []), ["doc_id"]).count() == 0


def test_a_shard_larger_than_its_memory(spark):
    # all runs of one shard through files: the same spans
    rng = random.Random(8)
    base = sentence(rng, 400)
    texts = [base[: 50 * i] + "#" + base[50 * i :] for i in range(12)]
    whole = sd._Shard(1 << 30)
    spooled = sd._Shard(64)
    for s in (whole, spooled):
        for i, t in enumerate(texts):
            s.add((i, i, 1), t.encode())
    assert sorted(whole.repeated(400)) == sorted(spooled.repeated(400))
    assert spooled.spool is not None


@pytest.mark.parametrize("stretch", [9, 22])
def test_runs_cover_every_window_once(stretch, monkeypatch):
    import pyarrow as pa

    from canvass.llm import common as cm

    monkeypatch.setattr(sd, "STRETCH_BITS", stretch)
    rng = random.Random(9)
    texts = [sentence(rng, n) for n in (10, 90, 300, 700)] + ["a" * 900]
    block = next(cm.text_blocks([pa.record_batch({"text": texts})], "text"))
    row, first, size, _, _ = sd.window_runs(block)
    for i, t in enumerate(texts):
        starts = [p for f, s in zip(first[row == i], size[row == i]) for p in range(f, f + s - sd.LENGTH + 1)]
        assert sorted(starts) == list(range(max(0, len(t.encode()) - sd.LENGTH + 1)))


def test_passages_are_told_and_stay(spark):
    rng = random.Random(12)
    tiny = " ".join(rng.choice("abcdefgh") + rng.choice("ijklmnop") for _ in range(55))
    texts = [sentence(rng, 30) + " " + tiny, tiny.replace(" ", "\n") + " " + sentence(rng, 40), tiny[:140], sentence(rng, 90), None]
    df = documents(spark, texts)
    got = {r.doc_id: r for r in sd.dedup(spark, df, ["doc_id"], words=sd.PASSAGE_WORDS, tell=True).collect()}
    assert [got[i].n_passages for i in range(5)] == [1, 1, 0, 0, 0]
    assert [got[i].passage_bytes for i in range(5)] == [len(tiny)] * 2 + [0] * 3
    assert all(r.n_removed == 0 and r.kept_sha256 == hashlib.sha256((texts[i] or "").encode()).hexdigest() for i, r in got.items())


def test_an_anchor_in_every_text(spark, monkeypatch):
    # one passage, shorter than a window, in all texts, with other words around it
    monkeypatch.setattr(sd, "SHARD", 4096)
    rng = random.Random(13)
    hot = sentence(rng, 50)
    copied = sentence(rng, 20) + hot + sentence(rng, 40)
    check(spark, [sentence(rng, 30) + hot + sentence(rng, 30) for _ in range(40)] + [copied, "x" + copied + "y"])


def test_a_shard_of_words_sorts_few_characters_a_word(monkeypatch):
    rng, length, sorted_ = random.Random(5), 4, []
    suffixes = sd.induced.suffixes
    monkeypatch.setattr(sd.induced, "suffixes", lambda text, *a: sorted_.append(len(text)) or suffixes(text, *a))
    for different in (1, 2, 3, 30, 300):
        # some words are one byte on end, some are turned about
        known = [bytes([i % 256]) * sd.WORD if i % 3 else bytes([i % 256, 0, 7, 0, (3 * i) % 256]) for i in range(different)]
        runs = [[rng.randrange(different) for _ in range(rng.randrange(length, 12))] for _ in range(40)]
        shard, places = sd._Shard(1 << 20), {}
        for i, run in enumerate(runs):
            shard.add((i, i, 1 + i % 2), b"".join(known[w] for w in run))
            for k in range(len(run) - length + 1):
                places.setdefault(tuple(known[w] for w in run[k : k + length]), []).append((i, k))
        want = {(i, b) for at in places.values() if len(at) > 1 for i, k in at for b in range(k * sd.WORD, (k + length) * sd.WORD) if i % 2 == 0}
        got = {(i, b) for i, _, spans in shard.repeated(length * sd.WORD, sd.WORD) for lo, hi in np.frombuffer(spans, "<i8").reshape(-1, 2) for b in range(lo, hi)}
        assert got == want
        assert sorted_[0] == 3 * sum(map(len, runs)) + len(runs)
        sorted_.clear()


def test_runs_of_words_take_one_worker_a_task(spark):
    rng = random.Random(3)
    keyed = sd._keyed(documents(spark, [" ".join(rng.choice("abcde") for _ in range(rng.randrange(30))) for _ in range(60)]), "text")
    runs = sd.run_table(keyed, 8 * sd.WORD, 3 * sd.WORD, sd.WORD, words=True)
    assert runs._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    two = sd.run_table(sd.word_strings(keyed), 8 * sd.WORD, 3 * sd.WORD, sd.WORD)
    assert sorted(map(tuple, runs.collect())) == sorted(map(tuple, two.collect())) != []


def test_windows_share_the_work_of_their_run(monkeypatch):
    # one well spread hash for the anchor and one for the bytes of a run, not one for each window
    import pyarrow as pa

    from canvass.llm import common as cm

    rng = random.Random(14)
    block = next(cm.text_blocks([pa.record_batch({"text": [sentence(rng, 500), "", sentence(rng, 30), None, sentence(rng, 900)]})], "text"))
    hashed, span_hash = [], cm.span_hash
    monkeypatch.setattr(cm, "span_hash", lambda p, start, end: hashed.append(len(start)) or span_hash(p, start, end))
    runs = len(sd.window_runs(block)[0])
    assert 0 < runs and sum(hashed) <= 2 * runs + len(block.bounds)


@pytest.mark.parametrize("step, most", [(1, 1 << 19), (5, 1 << 19), (1, 700), (5, 700)])
def test_equal_windows_have_equal_anchors(step, most, monkeypatch):
    # also in texts longer than a block and in pieces smaller than a window
    import pyarrow as pa

    from canvass.llm import common as cm

    monkeypatch.setattr(cm, "BLOCK_BYTES", most)
    monkeypatch.setattr(cm, "_POWERS", np.ones(1, np.uint64))
    monkeypatch.setattr(sd, "PIECE", 7)
    rng = random.Random(15)
    common = "".join(rng.choice("abcd") for _ in range(300))
    texts = [common, "x" * 10 + common + "y" * 900, "a" * 395, "a" * 60, "", "z" * 35 + common[50:] + "abcde" * 70]
    anchors = {}
    for block in cm.text_blocks([pa.record_batch({"text": texts})], "text", most):
        row, first, size, anchor, _ = sd.window_runs(block, 40 * step, 8 * step, step)
        for r, f, s, a in zip(row.tolist(), first.tolist(), size.tolist(), anchor.tolist()):
            text = block.data[block.bounds[r] : block.bounds[r + 1]].tobytes()
            for p in range(f, f + s - 40 * step + 1, step):
                anchors.setdefault(text[p : p + 40 * step], set()).add(a)
    assert len(anchors) > 40 and all(len(a) == 1 for a in anchors.values())


def test_spans_of_words_for_many_texts_at_once():
    import pyarrow as pa

    texts = [b"aa  b\nccc", b"", b"no spans", b" d ee", b"f"]
    spans = [[(0, 2), (2, 3)], None, [], [(1, 2), (0, 2)], [(0, 1)]]
    rows = [x and [{"begin": lo * sd.WORD, "end": hi * sd.WORD} for lo, hi in x] for x in spans]
    column = pa.array([rows[3], *rows], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))).slice(1)
    begin, end, bounds = sd.spans_of(column)
    assert bounds.tolist() == [0, 2, 2, 2, 4, 5]
    got = list(zip(*(x.tolist() for x in sd.in_bytes(texts, begin, end, bounds))))
    assert got == [(0, 5), (6, 9), (3, 5), (1, 5), (0, 1)]
    none = sd.spans_of(column.slice(1, 2))
    assert [len(x) for x in sd.in_bytes(texts[1:3], *none)] == [0, 0]
