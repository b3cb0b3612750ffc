"""Token ids of whole texts from a byte-level tokenizer file, one chunk at a time.

Such a tokenizer joins a space to the word behind it and never merges across the start of a run of white space that follows
other text, nor from a letter to a mark. So a text may be cut before every white-space byte that follows a character which isn't white
space, and between a letter and a mark; the ids of the parts on end are the text's. Parts repeat (a space and a word,
mostly) and are looked up like the chunks of ``tokens.Encoder``.
"""

from __future__ import annotations

import re

import numpy as np

from canvass.llm.common import TextBlock
from canvass.llm.tokens import Encoder

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Last bytes that white space of more than one byte may have (U+0085, U+00A0, U+1680, U+2000-U+200A, U+2028, U+2029, U+202F,
#: U+205F, U+3000). No cut behind them: another character of these last bytes only makes a part longer.
_TAIL = np.zeros(256, bool)
_TAIL[[0x9F, 0xA0, 0xA8, 0xA9, 0xAF, *range(0x80, 0x8B)]] = True
_MAY_END = ~_BLANK & ~_TAIL
_MAY_END[0x1C:0x20] = False
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?)")] = True
#: Parts of one word of the tokenizer: letters, with or without a space before them.
_SIMPLE = re.compile("( ?)([A-Za-zÀ-ÖØ-öø-ÿ]+)")
_WORDS = ("a", " Ab", "été", " Ñandú", " unbelievably", "straße")


class Parts(TextBlock):
    """A block whose ``word_spans`` are the parts that may be encoded apart; they cover all bytes."""

    def word_spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(self.data)
        if not n:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(len(self.bounds), np.int64)
        begins = np.zeros(n, bool)
        before, here = self.data[:-1], self.data[1:]
        begins[1:] = (_BLANK[here] & _MAY_END[before]) | (_MARK[here] & _LETTER[before])
        begins[self.bounds[:-1][self.bounds[1:] > self.bounds[:-1]]] = True
        start = np.flatnonzero(begins)
        return start, np.append(start[1:], n), np.searchsorted(start, self.bounds)


_PROBE = "It's  a\n\n b  c    d'll 12½, e_f!\t\t(g)\r\n  "


class ByteEncoder(Encoder):
    """Ids equal to ``Tokenizer.encode(text, add_special_tokens=False)``, with the special tokens' strings taken as ordinary text. A
    tokenizer for which the parts of the probe don't give the whole's ids encodes whole texts."""

    def __init__(self, path: str):
        super().__init__(path)
        self.space = self.pre.pre_tokenize_str(" a")[0][0][:-1]
        self.simple = self.normal is None and all(self._word(*_SIMPLE.fullmatch(w).groups()) == self._part(w) for w in _WORDS)
        raw = _PROBE.encode()
        block = Parts(None, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        start, end, _ = block.word_spans()
        parts = [i for a, b in zip(start.tolist(), end.tolist()) for i in self._chunk(raw[a:b])]
        self.by_chunk = parts == self.whole.encode(_PROBE, add_special_tokens=False).ids
        self.folds = False

    def _part(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def _word(self, space: str, letters: str) -> list[int]:
        """A part that is one word: without the tokenizer's own (slow) cutting."""
        return [t.id for t in self.model.tokenize((self.space if space else "") + self._coded(letters))]

    def _chunk(self, chunk: bytes) -> list[int]:
        text = chunk.decode("utf-8", "replace")
        m = _SIMPLE.fullmatch(text) if self.simple else None
        return self._word(*m.groups()) if m else self._part(text)

    def encode(self, block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
        return super().encode(Parts(block.rows, block.data, block.bounds))


_ENCODERS: dict[str, ByteEncoder] = {}


def byte_encoder(path: str) -> ByteEncoder:
    """The process's encoder for a tokenizer file (loaded once by a worker)."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteEncoder(path)
    return _ENCODERS[path]
