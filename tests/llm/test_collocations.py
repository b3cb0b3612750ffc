import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from canvass.llm import collocations as co
from canvass.llm import count_automata as ca
from tests.llm.helpers import COLUMNS, ODD, SF

PHRASES = st.integers(1, 5).flatmap(lambda n: st.tuples(st.just(n), st.lists(st.lists(st.integers(1, 4), min_size=n, max_size=n), min_size=1, max_size=40)))


def rows(x):
    return [tuple(r) for r in x.tolist()]


@settings(max_examples=150, deadline=None)
@given(PHRASES)
def test_automata_keep_counts(case):
    n, lists = case
    given_ = np.array(lists, np.uint64)
    want = Counter(rows(given_))
    a = ca.Automaton.load(ca.build(given_).dump())
    got, f = ca.phrases([a])
    assert dict(zip(rows(got), f.tolist())) == want and rows(got) == sorted(want)
    # joining three shards, two of them joined before
    half = ca.build(given_[: len(given_) // 2 + 1])
    both = ca.union([a, ca.union([half, a])])
    got, f = ca.phrases([both], 2)
    total = want + want + Counter(rows(given_[: len(given_) // 2 + 1]))
    assert dict(zip(rows(got), f.tolist())) == {k: v for k, v in total.items() if v >= 2}
    # as few states as there are different right sides in each layer
    for j in range(n):
        sides = {}
        for p, c in want.items():
            sides.setdefault(p[:j], set()).add((p[j:], c))
        assert len(a.layers[j].first) - 1 == len({frozenset(s) for s in sides.values()})


@settings(max_examples=100, deadline=None)
@given(PHRASES, st.randoms())
def test_composing_looks_up_counts(case, rng):
    n, lists = case
    a = ca.build(np.array(lists, np.uint64))
    want = Counter(tuple(x) for x in lists)
    asks = np.unique(np.array([[rng.randrange(1, 6) for _ in range(n)] for _ in range(20)] + lists[:3], np.uint64), axis=0)
    got = ca.compose(ca.build(asks, np.arange(1, len(asks) + 1)), a, len(asks))
    assert got.tolist() == [want[p] for p in rows(asks)]


def plain(docs, least, top):
    """The contract in plain Python: (text, lang) rows to the report."""
    count, total = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, 6):
                for i in range(len(w) - n + 1):
                    count[lang, *w[i : i + n]] += 1
    cands = {p: a for p, a in count.items() if len(p) > 2 and a >= least}
    gone = set()
    for p, a in cands.items():
        for n in range(2, len(p) - 1):
            for i in range(1, len(p) - n + 1):
                if a >= count[p[0], *p[i : i + n]]:
                    gone.add((p[0], *p[i : i + n]))
    out = {}
    for p, a in cands.items():
        if p not in gone:
            best = min((1000 * a * total[p[0]] // (count[p[: k + 1]] * count[p[0], *p[k + 1 :]]), k) for k in range(1, len(p) - 1))
            k = best[1]
            out.setdefault(p[0], []).append((-best[0], -a, " ".join(p[1:]).encode(), count[p[: k + 1]], count[p[0], *p[k + 1 :]], total[p[0]]))
    return sorted((lang, i, x[2].decode(), -x[1], x[3], x[4], x[5], -x[0]) for lang, xs in out.items() for i, x in enumerate(sorted(xs)[:top], 1))


def report(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def texts(rng, n):
    chunks = ["new york city", "In Spite of", "big red dog house", "éa ñb", "a\x00b c d e f", "the the the"]
    out = []
    for _ in range(n):
        words = [rng.choice(chunks) if rng.random() < 0.4 else rng.choice("abcdefgh") for _ in range(rng.randrange(1, 60))]
        out.append("".join(w + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "!"]) for w in words))
    return out


def test_whole_report_equals_plain_python(spark, monkeypatch):
    rng = random.Random(4)
    some = [*texts(rng, 300), *ODD, *["copy of one text"] * 30]
    docs = [(t, rng.choice(["en", "de", None, "und"])) for t in some]
    df = spark.createDataFrame([(1, t, lang, "s", 0) for t, lang in docs], COLUMNS).withColumnRenamed("source", "phrase").withColumnRenamed("n_chars", "rank")
    assert report(co.collocations(spark, df, least=8, top=25)) == plain(docs, 8, 25)
    # many small shards, ranges, foldings and look-up groups give the same
    for name, value in (("GATHER", 300), ("RANGE_WORDS", 500), ("FOLD_BYTES", 2000), ("ASKED", 40), ("FILTER_BITS", 15)):
        monkeypatch.setattr(co, name, value)
    assert report(co.collocations(spark, df.repartition(7), least=8, top=25)) == plain(docs, 8, 25)


def test_tables_without_words_or_frequent_phrases(spark):
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate([None, "", " .\n", "a b c"])], COLUMNS)
    assert report(co.collocations(spark, df)) == [] == report(co.collocations(spark, df.limit(0)))


def test_given_documents_equal_plain_python(spark):
    from canvass.llm.queries import QUERIES

    docs = [(r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = plain(docs, 100, 2000)
    assert len(want) > 20 and report(QUERIES["op12_phrase_collocations"](spark, SF)) == want


def test_scores_beyond_64_bits(spark):
    """Counts of whole corpora: the product passes 64 bits before it is divided."""
    rows = [("x y", 4_000_000_000, 9_000_000_000_000, 5_000_000_007, 4_000_000_011)]
    df = spark.createDataFrame(rows, "phrase string, a long, total long, l1 long, r1 long")
    got = df.selectExpr("(CAST(a AS DECIMAL(18,0)) * CAST(total AS DECIMAL(18,0)) * 1000) div (CAST(l1 AS DECIMAL(18,0)) * CAST(r1 AS DECIMAL(18,0))) AS s").first().s
    assert got == 1000 * 4_000_000_000 * 9_000_000_000_000 // (5_000_000_007 * 4_000_000_011)
