import random

import duckdb
import pytest

from canvass.llm import mixing
from canvass.llm.oracles import _MIX, ORACLES
from tests.llm.helpers import ODD, documents, sentence, words


def reshared(sizes, weights, share, most):
    """Targets by handing the excess on, round by round."""
    goal = share * sum(sizes)
    target, full = [0.0] * len(sizes), set()
    while True:
        rest = goal - sum(most * sizes[i] for i in full)
        heft = sum(w for i, w in enumerate(weights) if i not in full)
        for i, w in enumerate(weights):
            target[i] = most * sizes[i] if i in full else rest * w / heft
        over = {i for i in range(len(sizes)) if i not in full and target[i] > most * sizes[i]}
        if not over:
            return target
        full |= over


def test_targets_equal_resharing_round_by_round(spark):
    rng = random.Random(4)
    for n in (1, 2, 5, 9):
        sizes = [rng.choice([0, 1, 10, 500, 4000]) for _ in range(n)]
        if not sum(sizes):
            sizes[0] = 3
        names = sorted(f"s{i}" for i in range(n - 1)) + [None]
        df = spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        want = reshared(sizes, [(3, 1, 2)[i % 3] for i in range(n)], 1.5, 2)
        assert [got[s] for s in names] == pytest.approx(want)


def corpus(spark, n=300):
    rng = random.Random(5)
    texts = [sentence(rng, rng.randrange(1, 60)) + rng.choice([".", ""]) for _ in range(n)]
    sources = [rng.choice(["a", "a", "a", "b", "ß", None]) for _ in range(n)]
    return documents(spark, texts + ODD, sources=sources + ["b"] * len(ODD)).withColumnRenamed("lang", "target")


@pytest.mark.parametrize("salted", [False, True])
def test_equals_sql_and_meets_targets(spark, salted, monkeypatch):
    if salted:
        monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    df = corpus(spark)
    got = mixing.mix_words(df).toPandas()
    con = duckdb.connect()
    con.register("docs", df.toPandas()[["doc_id", "text", "source"]])
    sql = ORACLES["op4_mixing_sources"].replace("FROM documents", "FROM docs")
    want = con.execute(sql).fetchdf()[list(got.columns)]
    key = lambda f: sorted(map(tuple, f.astype(object).where(f.notna(), None).values.tolist()), key=str)
    assert key(got.drop(columns="target")) == key(want.drop(columns="target"))
    assert sorted(got.target) == pytest.approx(sorted(want.target))
    assert (got.taken <= 2 * got["size"]).all()
    by = got.groupby(got.source.fillna("-"))
    assert ((by.target.first() - by.taken.sum()) < 1).all() and ((by.target.first() - by.taken.sum()) >= 0).all()
    assert _MIX


def test_sizes_reruns_and_partitions(spark):
    df = corpus(spark, 80)
    a = sorted(map(str, mixing.mix_words(df).collect()))
    assert a == sorted(map(str, mixing.mix_words(df.repartition(7)).collect()))
    texts = {r.doc_id: r.text for r in df.collect()}
    assert all(r["size"] == len(words(texts[r.doc_id])) for r in mixing.mix_words(df).collect())


def test_repeated_rows_share_the_cut(spark):
    df = documents(spark, ["one two three"] * 6 + ["x y"] * 2, ids=[1] * 6 + [None] * 2, sources=["a"] * 6 + ["b"] * 2)
    got = mixing.mix_words(df).collect()
    taken = sorted(r.taken for r in got if r.doc_id == 1)
    assert taken[0] == taken[-1] and abs(sum(taken) - [r.target for r in got if r.doc_id == 1][0]) < 6


def test_mixed_documents_are_whole_and_keep_their_columns(spark):
    df = corpus(spark, 120).withColumnRenamed("target", "lang").filter("coalesce(n_chars, 0) < 1000")
    mixed = mixing.mix_documents(df)
    assert mixed.columns == df.columns
    texts = {(r.doc_id, r.text) for r in df.collect()}
    rows = mixed.collect()
    assert rows and all((r.doc_id, r.text) in texts for r in rows)
    size = sum(len(words(r.text)) for r in rows)
    want = sum({r.source: r.target for r in mixing.mix_words(df).collect()}.values())
    assert abs(size - want) < 4 * 60


def test_empty_table_and_empty_texts(spark):
    assert mixing.mix_words(documents(spark, [])).count() == 0
    got = mixing.mix_words(documents(spark, [None, "", " "], sources=["a", "a", None])).collect()
    assert [(r["size"], r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 3
