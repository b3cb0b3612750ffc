import bisect
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from canvass.llm import packing
from tests.llm.helpers import ODD, documents, sentence

PATH = public_tokenizers.path("word_bpe_49k.json")


def one_by_one(lengths, most):
    """Best-fit decreasing, piece by piece."""
    rooms, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, x)
        room = rooms.pop(i) if i < len(rooms) else most
        n += room == most
        if room > x:
            bisect.insort(rooms, room - x)
    return n


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=80))
def test_plan_equals_best_fit_one_by_one(lengths):
    counts = {x: lengths.count(x) for x in set(lengths)}
    p = packing.plan(counts, 20)
    assert p.sequences == one_by_one(lengths, 20)
    used = {}
    for x, n in counts.items():
        seq, off = p.take(np.full(n, x), np.arange(n))
        for s, o in zip(seq.tolist(), off.tolist()):
            used.setdefault(s, []).append((o, x))
    for pieces in used.values():  # gapless, within the sequence
        end = 0
        for o, x in sorted(pieces):
            assert o == end
            end += x
        assert end <= 20
    assert len(used) == p.sequences


def test_pieces_are_the_tokenizer_s_and_sequences_are_whole(spark):
    rng = random.Random(3)
    texts = [*ODD, *[sentence(rng, rng.randrange(1, 900)) for _ in range(60)], "same text here", "same text here", "It's 12² don't_<|endoftext|>x"]
    df = documents(spark, texts).withColumnRenamed("n_chars", "piece")
    got = packing.pack_documents(spark, df, PATH).collect()
    whole = Tokenizer.from_file(PATH)
    whole.encode_special_tokens = True
    want = {}
    for i, t in enumerate(texts):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), packing.MOST):
            want[(i, k // packing.MOST)] = (k, len(ids[k : k + packing.MOST]), zlib.crc32(ids[k : k + packing.MOST].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= packing.MOST
    assert len(by) == one_by_one([n for _, n, _ in want.values()], packing.MOST)


def test_repeated_rows_null_ids_and_empty_table(spark):
    df = documents(spark, ["a b c"] * 5 + [None], ids=[7, 7, 7, None, None, None])
    got = packing.pack_documents(spark, df, PATH).collect()
    assert len(got) == 6 and sorted(r.offset for r in got) == [0, 4, 8, 12, 16, 20]
    assert packing.pack_documents(spark, df.limit(0), PATH).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_of_other_tokenizers(name):
    import pyarrow as pa

    from canvass.llm import common as cm
    from canvass.llm.tokens import Encoder

    path = public_tokenizers.path(name)
    e = Encoder(path)
    assert e.by_chunk == name.startswith("word")
    texts = [t for t in ODD if t != "word " * 30_000] + ["Ab,c. X's été ¡olé! 3½"]
    block = next(cm.text_blocks([pa.record_batch({"text": pa.array(texts, pa.string())})], "text"))
    ids, bounds = e.encode(block)
    for t, i, j in zip(texts, bounds, bounds[1:]):
        want = e.whole.encode(t or "", add_special_tokens=False).ids
        assert ids[i:j].tolist() == want
