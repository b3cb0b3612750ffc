import bisect
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from canvass.llm import common as cm
from canvass.llm import window_fit as wf
from canvass.llm.byte_tokens import ByteEncoder
from tests.llm.helpers import ODD, SF, documents, sentence

PATH = public_tokenizers.path("byte_bpe_50k.json")


def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def plain(lengths, most):
    """Best-fit decreasing by a sorted list of rooms: how full the windows are."""
    rooms = []
    for x in lengths:
        i = bisect.bisect_left(rooms, x)
        room = rooms.pop(i) if i < len(rooms) else most
        bisect.insort(rooms, room - x)
    return sorted(most - r for r in rooms)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=90), st.integers(40, 64))
def test_tree_finds_the_tightest_window(lengths, most):
    lengths.sort(reverse=True)
    window, offset, held = wf.best_fit(lengths, most)
    assert sorted(held) == plain(lengths, most)
    check_layout([(w, o, n) for w, o, n in zip(window, offset, lengths)], most)
    parts = wf.close_gaps(lengths, window, offset, held, most)
    check_layout([(w, o, n) for _, _, n, w, o in parts], most)
    assert len({p[3] for p in parts}) == -(-sum(lengths) // most)
    for i, n in enumerate(lengths):  # each id in exactly one part
        at = 0
        for _, start, size, _, _ in sorted(p for p in parts if p[0] == i):
            assert start == at
            at += size
        assert at == n


def check_layout(pieces, most):
    by = {}
    for s, o, n in pieces:
        by.setdefault(s, []).append((o, n))
    for parts in by.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end and n > 0
            end += n
        assert end <= most


def check_pieces(rows, texts, most=wf.MOST):
    """Every id of every document in one piece, with its checksum; sequences gapless."""
    t = tokenizer()
    own = {}
    for r in rows:
        own.setdefault(r.doc_id, []).append(r)
    assert set(own) == set(texts)
    for i, text in texts.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(own[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    check_layout([(r.sequence_id, r.offset, r.length) for r in rows], most)


def test_pieces_are_the_tokenizer_s_and_sequences_are_whole(spark):
    rng = random.Random(3)
    texts = [*ODD, *[sentence(rng, rng.randrange(1, 1500)) for _ in range(60)], "same text", "same text", "It's 12² don't_<|endoftext|>x"]
    df = documents(spark, texts).withColumnRenamed("n_chars", "sequence_id").withColumnRenamed("lang", "doc")
    check_pieces(wf.pack_documents(spark, df, PATH).collect(), dict(enumerate(texts)))


def test_lengths_without_partners_are_cut(spark):
    """Copies a little longer than half a window: without cuts every window would be half empty."""
    text = " a" * 1100
    rows = wf.pack_documents(spark, documents(spark, [text] * 200), PATH).collect()
    check_pieces(rows, dict.fromkeys(range(200), text))
    assert len({r.sequence_id for r in rows}) == -(-200 * 1101 // 2048)


def test_many_groups(spark):
    rng = random.Random(8)
    texts = [sentence(rng, rng.randrange(1, 400)) for _ in range(300)]
    rows = wf.pack_documents(spark, documents(spark, texts), PATH, group=64).collect()
    check_pieces(rows, dict(enumerate(texts)))
    held = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= -(-held // 2048) + 5  # a window a group


def test_repeated_rows_null_ids_and_empty_table(spark):
    df = documents(spark, ["a b c"] * 5 + [None], ids=[7, 7, 7, None, None, None])
    rows = wf.pack_documents(spark, df, PATH).collect()
    assert len(rows) == 6 and sorted(r.offset for r in rows) == [0, 4, 8, 12, 16, 20]
    assert wf.pack_documents(spark, df.limit(0), PATH).count() == 0


def test_given_documents(spark):
    from canvass.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check_pieces(QUERIES["op13_window_fit_packing"](spark, SF).collect(), texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \t\n\r\x0b\x1c\x85\xa0  　.,'sdé!?)aZ9ñ½日|\x00"), max_size=14), max_size=5))
def test_parts_give_the_whole_s_ids(texts):
    e = test_parts_give_the_whole_s_ids.__dict__.setdefault("encoder", ByteEncoder(PATH))
    assert e.by_chunk and e.simple
    block = next(cm.text_blocks([pa.record_batch({"text": pa.array([*texts, "x"], pa.string())})], "text"))
    ids, bounds = e.encode(block)
    for t, i, j in zip(texts, bounds, bounds[1:]):
        assert ids[i:j].tolist() == e.whole.encode(t, add_special_tokens=False).ids
