import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from canvass.llm import kneser_ney as kn
from tests.llm.helpers import ODD, documents, sentence, words


class Plain:
    """The model in dictionaries."""

    def __init__(self, texts):
        rows = [words(t) + [b"</s>"] for t in texts]
        self.count = Counter(w for r in rows for w in r)
        self.pairs = Counter(p for r in rows for p in zip([b"<s>", *r], r))
        self.starts = len(rows)
        self.before, self.after = Counter(), defaultdict(lambda: [0, 0, 0])
        for (v, w), n in self.pairs.items():
            self.before[w] += 1
            self.after[v][min(n, 3) - 1] += 1
        of = lambda c: kn._discounts([sum(x == k for x in c.values()) for k in (1, 2, 3, 4)])
        self.d, self.e = of(self.pairs), of(self.before)
        self.classes = [sum(min(x, 3) == k for x in self.before.values()) for k in (1, 2, 3)]

    def lower(self, w):
        n, types = self.before[w], max(1, len(self.pairs))
        free = sum(e * c for e, c in zip(self.e, self.classes)) / types if self.pairs else 1.0
        return max(n - (self.e[min(n, 3) - 1] if n else 0), 0) / types + free / (len(self.count) + 1)

    def p(self, v, w):
        total = self.starts if v == b"<s>" else self.count[v]
        if not total:
            return self.lower(w)
        n = self.pairs[(v, w)]
        weight = sum(d * a for d, a in zip(self.d, self.after[v]))
        return (max(n - (self.d[min(n, 3) - 1] if n else 0), 0) + weight * self.lower(w)) / total


def check(spark, texts, ids):
    out = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i in ids]
    model = Plain([t for t, h in zip(texts, out) if not h])
    total = sum(model.count.values())
    want = []
    for i, t, h in zip(ids, texts, out):
        w = words(t) + [b"</s>"]
        base = sum(math.log10((model.count[x] + 0.5) / (total + 0.5 * (len(model.count) + 1))) for x in w)
        score = sum(math.log10(model.p(v, x)) for v, x in zip([b"<s>", *w], w))
        want.append((i, h, len(w), sum(x in model.count for x in w), total, base, score))
    got = kn.score_documents(spark, documents(spark, texts, ids).withColumnRenamed("lang", "score")).drop("perplexity").collect()
    key = lambda r: (str(r[0]), r[2], r[6])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)
    return model


def test_equals_the_model_in_dictionaries(spark):
    rng = random.Random(1)
    texts = [sentence(rng, rng.randrange(1, 60), 40) for _ in range(60)] + [" ".join(f"w{x}" for x in range(k % 30)) for k in range(25)] + ODD[:8]
    model = check(spark, texts, list(range(len(texts))))
    for v in (b"<s>", b"w1", b"w39"):  # probabilities of all words and of an unknown one add up to 1
        assert sum(model.p(v, w) for w in model.count) + model.p(v, b"unknown") == pytest.approx(1)


def test_repeated_rows_null_ids_all_held_out_and_empty(spark):
    check(spark, ["a b", "a b", None, "B c"], [1, 1, None, None])
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    got = kn.score_documents(spark, documents(spark, ["a b"], ids=[held])).first()
    assert got.train_tokens == 0 and got.n_known == 0 and math.isfinite(got.score)
    assert kn.score_documents(spark, documents(spark, [])).count() == 0


def test_copies_of_training_text_are_likelier_than_their_words(spark):
    rng = random.Random(2)
    base = sentence(rng, 200, 150)
    rows = kn.score_documents(spark, documents(spark, [base] * 30)).collect()
    held = [r for r in rows if r.held_out]
    assert held and all(r.score > r.base_score + 50 for r in held)


def test_a_task_that_runs_twice_leaves_whole_files(tmp_path):
    import numpy as np

    store = kn.Store(f"file://{tmp_path}/x")
    for _ in range(2):
        store.write("a-0", np.arange(5))
    assert store.map("a-0", np.int64).tolist() == [0, 1, 2, 3, 4]
    store.write("empty", np.zeros(0, np.int64))
    assert len(store.map("empty", np.int64)) == 0


def test_bigram_counts_beyond_32_bits_stay_whole(tmp_path):
    import numpy as np

    store = kn.Store(f"file://{tmp_path}/y")
    for s, n in enumerate([[3, 2**32 + 5], [3, 2**32 - 1], []]):
        kn.save_pairs(store, s, np.arange(len(n), dtype=np.uint64), np.array(n, np.int64))
        key, got = kn.load_pairs(store, s)
        assert key.tolist() == list(range(len(n))) and got.tolist() == n
