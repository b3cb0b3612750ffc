import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql.classic.dataframe import DataFrame

from canvass.llm import components, ngram_join
from tests.llm.helpers import ODD, documents, sentence, words


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(texts, ids):
    """(n_shingles, component_id) of each row by comparing all pairs."""
    sets, parent = [shingle_set(t) for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[root(i)] = root(j)
    out = []
    for i, s in enumerate(sets):
        if not s:
            out.append((ids[i], 0, ids[i]))
            continue
        known = [ids[j] for j in range(len(ids)) if root(j) == root(i) and ids[j] is not None]
        out.append((ids[i], len(s), min(known, default=None)))
    return out


def edit(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def check(spark, texts, ids=None, **tune):
    ids = list(range(len(texts))) if ids is None else ids
    df = documents(spark, texts, ids).withColumnRenamed("lang", "node").withColumnRenamed("n_chars", "k1")
    got = sorted(map(tuple, ngram_join.join_groups(spark, df).collect()), key=str)
    assert got == sorted(brute(texts, ids), key=str)
    return got


def test_near_copies_chains_and_common_passages(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEFT", 3)
    monkeypatch.setattr(ngram_join, "RIGHT", 5)
    rng = random.Random(1)
    texts = []
    base = sentence(rng, 150)
    texts += [edit(rng, base, rng.randrange(0, 6)) for _ in range(25)]  # a group of near copies, some beyond reach of others
    chain = sentence(rng, 120)
    for _ in range(12):  # each near the one before, the ends far apart
        chain = edit(rng, chain, 2)
        texts.append(chain)
    passage = sentence(rng, 60)
    texts += [passage + " " + sentence(rng, rng.randrange(1, 60)) for _ in range(20)]
    texts += [sentence(rng, 40) for _ in range(10)]
    texts += ["A b  C d e", "a B c D\te", "a b c d", "a b c d e f", "x", "X", "x y", *ODD]
    order = list(range(100, 100 + len(texts)))
    rng.shuffle(order)
    got = check(spark, texts, order)
    assert len({c for _, _, c in got}) < len(got)


def test_a_pair_is_sent_about_once(spark, monkeypatch):
    # 60 texts with the same 300 shingles but for a few: without the tokens before, each pair would go out under dozens of tokens
    rng = random.Random(8)
    base = sentence(rng, 300)
    texts = [edit(rng, base, rng.randrange(2, 5)) for _ in range(60)]
    df = documents(spark, texts, list(range(60)))
    keyed = ngram_join._keyed(df, "doc_id", "text").select("__id", "__text", "__k1", "__k2")
    counts = spark.sparkContext.broadcast(ngram_join.frequencies(keyed))
    rows = ngram_join.prefixes(keyed, counts).select("node", "n", "prefix", "bits")
    nodes = [r.node for r in rows.collect()]
    members = spark.createDataFrame([(x, x) for x in nodes], "node long, label long")  # nothing linked yet
    sent = []
    real = DataFrame.distinct
    monkeypatch.setattr(DataFrame, "distinct", lambda self: sent.append(self) or real(self))
    found = {tuple(sorted(r)) for r in ngram_join.across(rows, members).collect()}
    sets = [shingle_set(t) for t in texts]
    order = {r.doc_id: r.node for r in ngram_join.prefixes(keyed, counts).collect()}
    links = {tuple(sorted((order[i], order[j]))) for i in range(60) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert links and links <= found
    assert sent[-1].count() <= 2 * len(found)


def test_at_the_threshold(spark):
    # 4 of 5 shingles shared is 0.8: a link; 7 of 9 isn't
    w = [f"t{i}" for i in range(40)]
    texts = [" ".join(w[:8]), " ".join(w[:9]), " ".join(w[:12]), " ".join([*w[:12], "p"]), " ".join([*w[:11], "q"])]
    check(spark, texts)


def test_repeated_rows_null_ids_and_empty_table(spark):
    rng = random.Random(2)
    a, b = sentence(rng, 30), sentence(rng, 30)
    check(spark, [a, a, a, b, b, None, None, " "], [5, 5, None, None, None, None, 3, 4])
    assert ngram_join.join_groups(spark, documents(spark, [])).count() == 0


def test_one_of_each_keeps_the_smallest_id_and_all_columns(spark):
    rng = random.Random(3)
    a, b, c = (sentence(rng, 40) for _ in range(3))
    texts = [a, a, edit(rng, a, 0) + " tail", b, c, c, None, "", " "]
    ids = [9, 4, 2, 7, 8, 8, 1, 1, None]
    kept = ngram_join.one_of_each(spark, documents(spark, texts, ids)).collect()
    assert kept[0].__fields__ == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(map(str, (r.doc_id for r in kept))) == sorted(map(str, [2, 7, 8, 1, 1, None]))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=25))
def test_components_equal_union_find(spark, links):
    parent = list(range(13))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.label for r in components.connected(df).collect()}
    assert got == {x: root(x) for a, b in links if a != b for x in (a, b)}


def test_any_order_puts_every_token_in_one_place():
    tokens = np.unique(np.random.default_rng(1).integers(0, 2**63, 500, dtype=np.int64).view(np.uint64))
    counts = np.random.default_rng(2).integers(0, 50, 1 << ngram_join.COUNTERS_BITS)
    for which in (0, 1, 2):
        whole = ngram_join.ordered(tokens, counts, which)
        part = ngram_join.ordered(tokens[::3], counts, which)
        assert sorted(whole.tolist()) == tokens.tolist()
        assert [t for t in whole.tolist() if t in set(part.tolist())] == part.tolist()


def test_few_pairs_of_a_wide_join_are_written_in_few_files(spark):
    rng = np.random.default_rng(12)
    tokens = [rng.integers(-(2**62), 2**62, 300).tolist() for _ in range(1000)]
    sets = spark.createDataFrame([(2 * i + k, 300, t, t, t) for i, t in enumerate(tokens) for k in (0, 1)], "node long, n long, tokens array<long>, second array<long>, third array<long>")
    pairs = spark.createDataFrame([(2 * i, 2 * i + 1) for i in range(1000)] + [(i, i + 2) for i in range(500)], "a long, b long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = ngram_join.allowed(pairs, sets)
        rows = sorted(map(tuple, found.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows == [(2 * i, 2 * i + 1, 300, 300) for i in range(1000)]
    assert len(found.inputFiles()) == 1  # 1000 pairs, though the sets they were joined with fill several tasks


def test_only_postings_of_open_tokens_are_joined_where_these_are_many(spark, monkeypatch):
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(1, 2**62, 100)).astype(np.uint64) for _ in range(200)]
    sets += [np.concatenate([s[:95], rng.integers(1, 2**62, 5).astype(np.uint64)]) for s in sets[:10]]
    rows = [(i, len(s), bytearray(s[:21].tobytes()), bytearray(ngram_join.parity(s))) for i, s in enumerate(sets)]
    prefixes = spark.createDataFrame(rows, "node long, n long, prefix binary, bits binary")
    members = spark.createDataFrame([(i, i) for i in range(len(sets))], "node long, label long")
    want = sorted(map(tuple, ngram_join.across(prefixes, members).collect()))
    assert want == [(i, 200 + i) for i in range(10)]
    joined, join = [], DataFrame.join

    def counted(self, other, on=None, how=None):
        if on == "token":
            joined.append(self.count())
        return join(self, other, on, how)

    monkeypatch.setattr(DataFrame, "join", counted)
    monkeypatch.setattr(ngram_join, "OPEN_TOKENS", 0)
    assert sorted(map(tuple, ngram_join.across(prefixes, members).collect())) == want
    assert joined == [2 * 10 * 21]  # of 4410


def test_the_filter_of_open_tokens_holds_all_and_few_others(spark):
    tokens = np.random.default_rng(6).integers(-(2**63), 2**63 - 1, 30_000)
    df = spark.createDataFrame([(int(t), 1) for t in tokens[:3000]], "token long, m long").repartition(3)
    bits = ngram_join.open_filter(df)
    assert len(bits) == 1 << (ngram_join.FILTER_BITS - 3)
    assert ngram_join._may_be_open(tokens[:3000], bits).all()
    assert ngram_join._may_be_open(tokens[3000:], bits).sum() < 20
    assert not ngram_join.open_filter(df.limit(0)).any()
