"""Small tables and plain-Python versions for the operators' tests."""

from __future__ import annotations

import random
import re

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text: str | None) -> list[bytes]:
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())


def sentence(rng: random.Random, n: int, vocabulary: int = 5000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents(spark, texts, ids=None, sources=None):
    ids = range(len(texts)) if ids is None else ids
    sources = ["s"] * len(texts) if sources is None else sources
    rows = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in zip(ids, texts, sources)]
    return spark.createDataFrame(rows, COLUMNS)


#: Odd texts that every operator must take.
ODD = [None, "", " \t\n", "x", "é", "a\x00b", "ẞ İ ſ", "日本語 テキスト", "word " * 30_000]
