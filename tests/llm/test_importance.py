import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from canvass.llm import common as cm
from canvass.llm import importance as im
from tests.llm.helpers import ODD, SF, documents, sentence


def grams(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def buckets(text):
    return [zlib.crc32(g.encode()) % 10000 for g in grams(text)[1]]


def expected(docs, target):
    """Contract in plain Python: (id, n_features, weight, score, rank) of each row."""
    s, t = [0] * 10000, [0] * 10000
    for _, x in docs:
        for b in buckets(x):
            s[b] += 1
    for x in target:
        for b in buckets(x):
            t[b] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    rows, able = [], []
    for i, x in docs:
        f = buckets(x)
        w = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(f), w, score, None])
        if len(grams(x)[0]) >= 20:
            able.append(len(rows) - 1)
    able.sort(key=lambda k: (-rows[k][3], rows[k][0] is None, rows[k][0] or 0))
    for rank, k in enumerate(able[: 25 * len(able) // 100], 1):
        rows[k][4] = rank
    return rows


def got(df):
    return [[r.doc_id, r.n_features, r.weight, r.score, r.rank] for r in df.collect()]


def key(r):
    return [(x is None, x or 0) for x in r]


def test_checksums_equal_zlib():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab1é z,") for _ in range(rng.randrange(200))) for _ in range(50)] + ["x" * 100 + " " + "y" * 33 + " z " + "q" * 32]
    block = next(cm.text_blocks([pa.record_batch({"text": pa.array(texts)})], "text"))
    bucket, row, n = im.features(block)
    for i, t in enumerate(texts):
        assert sorted(bucket[row == i].tolist()) == sorted(buckets(t))
        assert n[i] == len(grams(t)[0])


def test_bit_sliced_sums_equal_plain_sums():
    rng = np.random.default_rng(1)
    gain = rng.integers(-9000, 9000, im.BUCKETS)
    bucket = np.concatenate([rng.integers(0, im.BUCKETS, 3000), np.full(70_000, 17), np.full(5, 9999)])
    row = np.concatenate([rng.integers(0, 9, 3000), np.full(70_000, 4), np.full(5, 8)])
    wide = np.zeros(157 * 64, np.int64)
    wide[: im.BUCKETS] = gain
    sums = im.gain_sums(bucket, row, 10, im.bit_planes(np.maximum(wide, 0)), im.bit_planes(np.maximum(-wide, 0)))
    assert sums.tolist() == np.bincount(row, gain[bucket], minlength=10).astype(np.int64).tolist()


def test_whole_result_equals_plain_python(spark):
    rng = random.Random(2)
    texts = [*ODD, *[sentence(rng, rng.randrange(1, 80), 300) for _ in range(300)], *["same " * 30] * 40, "Ünï A_b-c 12.5% MiXed"]
    ids = [*range(len(texts) - 3), None, 5, 5]
    target = [None, "", *[sentence(rng, 40, 60) for _ in range(20)], "same thing"]
    docs = documents(spark, texts, ids).withColumnRenamed("n_chars", "rank").withColumnRenamed("lang", "score")
    out = im.resample(spark, docs, documents(spark, target))
    want = expected(list(zip(ids, texts)), target)
    assert sorted(got(out), key=key) == sorted(want, key=key)


def test_repeated_rows_of_one_id_get_different_ranks(spark):
    text = " ".join(f"w{i}" for i in range(25))
    docs = documents(spark, [text] * 40, [3] * 40)
    out = got(im.resample(spark, docs, documents(spark, ["w1 w2"])))
    assert sorted(r[4] for r in out if r[4]) == list(range(1, 11)) and len(out) == 40


@pytest.mark.parametrize("n", [0, 3])
def test_empty_tables(spark, n):
    docs = documents(spark, ["a b"] * n)
    out = got(im.resample(spark, docs, docs.limit(0)))
    assert len(out) == n and all(r[4] is None for r in out)


def test_given_documents_equal_plain_python(spark):
    from canvass.llm.queries import QUERIES

    name = "op11_importance_resampling"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(got(QUERIES[name](spark, SF)), key=key) == sorted(expected(docs, target), key=key)
