"""The stages on a small corpus with planted cases, each held against a plain version on the stage's own input."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline as cp
from canvass.llm import common as cm
from tests.llm.helpers import documents, sentence
from tests.llm.test_ngram_join import brute as brute_groups
from tests.llm.test_suffix_dedup import brute as brute_spans

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    passage = sentence(rng, 90)
    texts, toxic = [], []
    for i in range(160):
        text = sentence(rng, rng.randrange(20, 90)) + "."
        if i % 4 == 0:
            text = text + " " + " ".join(rng.choice(["scum", "idiot", "moron"]) for _ in range(4))
        toxic.append(i % 4 == 0)
        texts.append(text)
    for k in (1, 2, 3):  # a copy, a near copy, and texts that share a passage
        texts += [texts[k], texts[k] + " tail", sentence(rng, 30) + " " + passage]
        toxic += [False] * 3
    path = tmp_path_factory.mktemp("corpus")
    sources = [rng.choice(["a", "b", "c"]) for _ in texts]
    documents(spark, texts, sources=sources).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(t)) for i, t in enumerate(toxic) if i % 3], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), texts, toxic


def test_stages_in_turn(spark, folder):
    path, texts, toxic = folder
    assert [n for n, _ in cp.STAGES] == ["toxicity", "ngram_jaccard_join", "suffix_array_dedup", "mixing_sources", "best_fit_packing"]
    docs = cm.table(spark, path, "documents")
    steps = {}
    for name, stage in cp.STAGES:
        docs = cm.written(stage(spark, docs, path), "test")
        steps[name] = docs.collect()
        if name != "best_fit_packing":
            assert docs.columns == COLUMNS
    clean = {i for i, t in enumerate(toxic) if not t}
    assert {r.doc_id for r in steps["toxicity"]} == clean
    kept = sorted(r.doc_id for r in steps["ngram_jaccard_join"])
    rows = [(r.doc_id, r.text) for r in steps["toxicity"]]
    groups = brute_groups([t for _, t in rows], [i for i, _ in rows])
    assert kept == sorted({c for _, _, c in groups})
    rows = [(r.doc_id, r.text) for r in steps["ngram_jaccard_join"]]
    raw, masks = brute_spans([t for _, t in rows], 400)
    left = {i: bytes(b for b, m in zip(t, mask) if not m).decode("utf-8", "ignore") for (i, _), t, mask in zip(rows, raw, masks)}
    assert {r.doc_id: r.text for r in steps["suffix_array_dedup"]} == {i: t for i, t in left.items() if t.strip()}
    assert any(len(t) < len(dict(rows)[i]) for i, t in left.items())
    mixed = {(r.doc_id, r.text) for r in steps["mixing_sources"]}
    assert mixed <= {(r.doc_id, r.text) for r in steps["suffix_array_dedup"]}
    ends = {}
    for r in steps["best_fit_packing"]:
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in p) <= 2048 for p in ends.values())
    assert len({r.doc_id for r in steps["best_fit_packing"]}) == len({i for i, _ in mixed})


def test_run_on_an_empty_table(spark, folder, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_all_eleven_are_registered(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names} and "pipeline" in names
    assert entry.oracle_sql().keys() >= {"op4_mixing_sources", "op8_warc_fixity"}


def by_words(texts, least=51):
    """The texts without all words in repeated strings of ``least`` words, and what stands between these; and the number of such strings."""
    rows = [[(m.start(), m.end()) for m in re.finditer(r"\S+", t)] for t in texts]
    strings = [[tuple(t[a:b] for a, b in r[i : i + least]) for i in range(len(r) - least + 1)] for t, r in zip(texts, rows)]
    seen = Counter(s for own in strings for s in own)
    left = []
    for t, r, own in zip(texts, rows, strings):
        gone = set()
        for i, s in enumerate(own):
            if seen[s] > 1:
                gone.update(range(r[i][0], r[i + least - 1][1]))
        left.append("".join(c for k, c in enumerate(t) if k not in gone))
    return left, sum(n > 1 for n in seen.values())


def test_passages_of_51_words_under_400_bytes_are_cut(spark):
    rng = random.Random(11)
    short = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(n))
    texts = []
    for n in (50, 51, 51, 52, 57, 60):
        passage = short(n)
        assert len(passage) < 400
        texts += [short(70) + " " + passage + " " + short(75), passage + " " + short(90), short(40) + "\n" + passage.replace(" ", "  ", 9)]
    texts += [short(200), "one two", " ".join("a" for _ in range(60))]
    want, strings = by_words(texts)
    assert strings > 10 and want[:3] == texts[:3] and all(a != b for a, b in zip(want[3:18], texts[3:18]))
    got = {r.doc_id: r.text for r in cp.cut_repeats(spark, documents(spark, texts), "").collect()}
    assert got == {i: t for i, t in enumerate(want) if t.strip()}


def test_clashing_names_pass_through_all_stages(spark, folder):
    path, texts, _ = folder
    extra = ["p_toxic", "severity", "n_removed", "kept_text", "__size", "__weight", "__key", "__id", "__text", "__k1", "k1", "node", "a.b", "c0"]
    docs = cm.table(spark, path, "documents")
    for i, name in enumerate(extra):
        docs = docs.withColumn(name, docs["doc_id"] * 100 + i)
    for name, stage in cp.STAGES[:-1]:
        docs = cm.written(stage(spark, docs, path), "test")
        assert docs.columns == COLUMNS + extra
        for r in docs.collect():
            assert [r[c] for c in extra] == [r.doc_id * 100 + i for i in range(len(extra))]
            assert name == "suffix_array_dedup" or r.n_chars is not None
    assert cp.pack_sequences(spark, docs, path).count() > 0


def test_null_and_empty_texts_in_each_stage(spark, folder):
    path, _, _ = folder
    rows = [(1, None), (2, ""), (3, None), (None, "one two"), (None, "one two"), (5, " \t")]
    docs = documents(spark, [t for _, t in rows], [i for i, _ in rows])
    assert cp.drop_toxic(spark, docs, path).count() == 6
    assert sorted(str(r.doc_id) for r in cp.one_of_near_copies(spark, docs, path).collect()) == ["1", "2", "3", "5", "None"]
    assert cp.cut_repeats(spark, docs, path).count() == 6
    assert cp.pack_sequences(spark, docs, path).count() == 6
