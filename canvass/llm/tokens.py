"""Token ids of whole texts from a public tokenizer file, one white-space chunk at a time.

Where a tokenizer drops white space (which is probed when it is loaded), a text's ids are the ids of its chunks
on end; others encode whole texts. A worker looks all chunks of a block up at once in
a hash table of the chunks it met (by 64-bit hash; ids on end in one array) and only encodes new
ones. The table is emptied when full, so its memory is bounded; results don't depend on it.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np

from canvass.llm.common import TextBlock

#: A worker keeps the ids of so many chunks, at most half the slots of its table.
KEEP = 1 << 21
PIECES = 300_000
#: Chunks of these characters can be cut without the tokenizer's own (slow) parts, if the probes agree:
#: letters, single digits and runs of marks. No apostrophes, superscripts, fractions or dotted capital I.
_EASY = re.compile("[!-&(-~¡-±´-¸º»¿-įı-ɏ]+")
_CUT = re.compile(r"[^\W\d_]+|\d|(?:[^\w\s]|_)+")
_PROBES = ("Ab", "ab,", "x1y22z", "a_b-c!!", "Éaµª", "ſŉn#", "12.5%", "(d)||e", "×÷ö", "z¡¿")


class Encoder:
    """Ids equal to ``Tokenizer.encode(text, add_special_tokens=False)``, with the special tokens'
    strings taken as ordinary text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        whole.encode_special_tokens = True
        self.whole, self.normal, self.pre, self.model = whole, whole.normalizer, whole.pre_tokenizer, whole.model
        # whether ASCII case never matters: then chunks are looked up in lower case
        self.folds = self.normal is not None and self.normal.normalize_str("AZaz") == "azaz"
        self.coded: dict[int, str] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.easy = self.folds and all(self._easy(p) == self._general(p) for p in _PROBES)
        apart = [whole.encode(x, add_special_tokens=False).ids for x in ("Ab", "c'd", "e")]
        self.by_chunk = whole.encode("Ab c'd\n\t e ", add_special_tokens=False).ids == list(chain(*apart))
        self._empty()

    def _empty(self) -> None:
        self.keys = np.zeros(2 * KEEP, np.uint64)
        self.slots = np.zeros(2 * KEEP, np.int32)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(KEEP + 1, np.int64)
        self.n = 0

    # ---- one chunk ----

    def _general(self, text: str) -> list[int]:
        if self.normal is not None:
            text = self.normal.normalize_str(text)
        return [t.id for p, _ in self.pre.pre_tokenize_str(text) for t in self.model.tokenize(p)]

    def _easy(self, text: str) -> list[int]:
        ids: list[int] = []
        for p in _CUT.findall(text.lower()):
            got = self.pieces.get(p)
            if got is None:
                if len(self.pieces) >= PIECES:
                    self.pieces.clear()
                got = self.pieces[p] = tuple(t.id for t in self.model.tokenize(self._coded(p)))
            ids += got
        return ids

    def _coded(self, piece: str) -> str:
        """The piece in the pre-tokenizer's alphabet for bytes."""
        if piece.isascii():
            return piece
        for c in piece:
            if ord(c) not in self.coded:
                self.coded[ord(c)] = "".join(p for p, _ in self.pre.pre_tokenize_str(c))
        return piece.translate(self.coded)

    def _chunk(self, chunk: bytes) -> list[int]:
        text = chunk.decode("utf-8", "replace")
        return self._easy(text) if self.easy and _EASY.fullmatch(text) else self._general(text)

    # ---- many ----

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key in the table, -1 for those it lacks."""
        mask = len(self.keys) - 1
        at = (keys & np.uint64(mask)).astype(np.int64)
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        while len(left):
            there = self.keys[at]
            hit = there == keys[left]
            out[left[hit]] = self.slots[at[hit]]
            on = ~hit & (there != 0)
            left, at = left[on], (at[on] + 1) & mask
        return out

    def _add(self, keys: np.ndarray, ids: list[list[int]]) -> None:
        mask = len(self.keys) - 1
        number = np.arange(self.n, self.n + len(keys))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))
        begin = self.start[self.n]
        self.start[self.n + 1 : self.n + len(keys) + 1] = begin + np.cumsum(sizes)
        if begin + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool) + len(flat), np.uint32)])
        self.pool[begin : begin + len(flat)] = flat
        self.n += len(keys)
        left, at = np.arange(len(keys)), (keys & np.uint64(mask)).astype(np.int64)
        while len(left):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[left[free]]
            mine = free & (self.keys[at] == keys[left])
            self.slots[at[mine]] = number[left[mine]]
            left, at = left[~mine], (at[~mine] + 1) & mask

    def encode(self, block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows on end, and the bounds of each row's ids."""
        if not self.by_chunk:
            ids = [x.ids for x in self.whole.encode_batch([t.decode("utf-8", "replace") for t in block.texts()], add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(ids), np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        start, end, bounds = block.word_spans()
        keys = block.span_hashes(start, end, lower=self.folds)
        keys[keys == 0] = 1
        number = self._find(keys)
        if (number < 0).any():
            new, first = np.unique(keys[number < 0], return_index=True)
            if self.n + len(new) > KEEP:
                self._empty()
                new, first = np.unique(keys, return_index=True)
                where = first
            else:
                where = np.flatnonzero(number < 0)[first]
            raw = block.data.tobytes()
            ids = [self._chunk(raw[i:j]) for i, j in zip(start[where].tolist(), end[where].tolist())]
            if len(new) > KEEP:  # one row of very many chunks: without the table
                by_key = np.searchsorted(new, keys)
                return self._joined(ids, by_key, bounds)
            self._add(new, ids)
            number = self._find(keys)
        begin = self.start[number]
        return self._gather(self.pool, begin, self.start[number + 1] - begin, bounds)

    def _joined(self, ids, by_key, bounds):
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))
        begin = np.cumsum(sizes) - sizes
        return self._gather(flat, begin[by_key], sizes[by_key], bounds)

    @staticmethod
    def _gather(pool, begin, sizes, bounds):
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        index = np.arange(total) + np.repeat(begin - (ends - sizes), sizes)
        return pool[index], np.concatenate([[0], ends])[bounds]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder for a tokenizer file (loaded once by a worker)."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
