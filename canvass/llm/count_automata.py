"""Weighted acyclic automata: phrases of one length and their counts.

A phrase is a row of 64-bit labels. States lie in layers, one for each word; a state's arcs are sorted by label, and the arcs of the last layer carry the
counts. Phrases with a common beginning share its states; states with the same arcs (labels, targets, counts) are one, so common
ends are shared too. All steps go through a layer at a time by array operations:

- ``build``: from the phrases of a shard, sorted;
- ``union``: a walk through several automata at once; arcs of one label from one joint state lead to one joint state, counts add up;
- ``compose``: a walk through an automaton of requests and one of counts, along the labels that both have.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from canvass.llm.common import mix64

_U = np.uint64


@dataclass
class Layer:
    first: np.ndarray  # first arc of each state, and the end
    letter: np.ndarray  # place of each arc's label in the alphabet, ascending within a state
    target: np.ndarray  # state of the next layer; in the last layer the count


@dataclass
class Automaton:
    alphabet: np.ndarray  # uint64, ascending
    layers: list[Layer]

    def dump(self) -> bytes:
        arrays = [self.alphabet] + [a for x in self.layers for a in (np.diff(x.first), x.letter, x.target)]
        out = [struct.pack("<H", len(self.layers))]
        for a in arrays:
            top = int(a.max(initial=0))
            small = a.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")
            out += [struct.pack("<BQ", small.itemsize, len(small)), small.tobytes()]
        return b"".join(out)

    @staticmethod
    def load(raw: bytes) -> Automaton:
        (n,) = struct.unpack_from("<H", raw)
        at, arrays = 2, []
        for _ in range(1 + 3 * n):
            width, size = struct.unpack_from("<BQ", raw, at)
            arrays.append(np.frombuffer(raw, f"<u{width}", size, at + 9))
            at += 9 + width * size
        layers = [
            Layer(np.concatenate([[0], np.cumsum(d, dtype=np.int64)]), l.astype(np.int64), t.astype(np.int64))
            for d, l, t in zip(arrays[1::3], arrays[2::3], arrays[3::3])
        ]
        return Automaton(arrays[0].astype(_U), layers)


def _arcs(first: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The arcs of each of ``state`` on end, and how many each has."""
    degree = first[state + 1] - first[state]
    ends = np.cumsum(degree)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(first[state] - (ends - degree), degree), degree


def _sums(group: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, group, value)
    return out


def _minimal(alphabet: np.ndarray, parent: list[np.ndarray], letter: list[np.ndarray], count: np.ndarray) -> Automaton:
    """From a tree of prefixes (node i of layer j hangs from ``parent[j][i]`` by ``letter[j][i]``, sorted): from the last layer to
    the first, states with the same arcs become one."""
    layers: list[Layer] = []
    target = count
    for j in reversed(range(len(parent))):
        states = len(parent[j - 1]) if j else 1
        first = np.searchsorted(parent[j], np.arange(states + 1))
        degree = np.diff(first)
        look = mix64(letter[j].astype(_U) * _U(0x9E3779B97F4A7C15) + target.astype(_U) * _U(0xD6E8FEB86659FD93))
        look = mix64(_sums_wrapping(look, first) + degree.astype(_U))
        _, chosen, place = np.unique(look, return_index=True, return_inverse=True)
        like = chosen[place]
        # equal looks are compared arc by arc; a state that only looks alike stays
        arcs, _ = _arcs(first, np.arange(states))
        theirs, size = _arcs(first, like)
        same = size == degree
        if same.all():
            equal = (letter[j][arcs] == letter[j][theirs]) & (target[arcs] == target[theirs])
            same = np.bincount(np.repeat(np.arange(states), degree), ~equal, minlength=states) == 0
        kept = np.flatnonzero((like == np.arange(states)) | ~same)
        like = np.where(same, like, np.arange(states))
        rank = np.searchsorted(kept, like)
        arcs, degree = _arcs(first, kept)
        layers.append(Layer(np.concatenate([[0], np.cumsum(degree)]), letter[j][arcs], target[arcs]))
        target = rank
    return Automaton(alphabet, layers[::-1])


def _sums_wrapping(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(value) + 1, _U)
    np.cumsum(value, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def build(phrases: np.ndarray, weight: np.ndarray | None = None) -> Automaton:
    """``phrases``: a uint64 array with a phrase in each row (one at least), in any order; equal rows add up. ``weight``: 1 each without."""
    m, n = phrases.shape
    alphabet, ids = np.unique(phrases, return_inverse=True)
    ids = ids.reshape(m, n)
    node, parent, letter = np.zeros(m, np.int64), [], []
    for j in range(n):
        key, node = np.unique(node * len(alphabet) + ids[:, j], return_inverse=True)
        parent.append(key // len(alphabet))
        letter.append(key % len(alphabet))
    count = np.bincount(node, minlength=len(parent[-1])) if weight is None else _sums(node, weight, len(parent[-1]))
    return _minimal(alphabet, parent, letter, count)


def _joined(parts: Sequence[Automaton]):
    """Layers of several automata on end, over one alphabet."""
    alphabet = np.unique(np.concatenate([p.alphabet for p in parts]))
    places = [np.searchsorted(alphabet, p.alphabet) for p in parts]
    n = len(parts[0].layers)
    layers = []
    for j in range(n):
        own = [p.layers[j] for p in parts]
        degree = np.concatenate([np.diff(x.first) for x in own])
        letter = np.concatenate([at[x.letter] for at, x in zip(places, own)])
        if j + 1 < n:
            sizes = [len(p.layers[j + 1].first) - 1 for p in parts]
            base = np.cumsum([0, *sizes[:-1]])
            target = np.concatenate([x.target + b for b, x in zip(base, own)])
        else:
            target = np.concatenate([x.target for x in own])
        layers.append(Layer(np.concatenate([[0], np.cumsum(degree)]), letter, target))
    return alphabet, layers


def _walk_all(parts: Sequence[Automaton]):
    alphabet, layers = _joined(parts)
    joint = np.zeros(len(parts), np.int64)
    state = np.arange(len(parts))  # their first states
    parent, letter = [], []
    for x in layers:
        arcs, degree = _arcs(x.first, state)
        key, joint = np.unique(np.repeat(joint, degree) * len(alphabet) + x.letter[arcs], return_inverse=True)
        parent.append(key // len(alphabet))
        letter.append(key % len(alphabet))
        state = x.target[arcs]
    return alphabet, parent, letter, _sums(joint, state, len(parent[-1]))


def union(parts: Sequence[Automaton]) -> Automaton:
    """One automaton for all phrases of ``parts`` (of one length), counts summed."""
    return _minimal(*_walk_all(parts))


def phrases(parts: Sequence[Automaton], least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The phrases of the union that have a count of ``least`` or more, sorted, and the counts."""
    alphabet, parent, letter, count = _walk_all(parts)
    node = np.flatnonzero(count >= least)
    out = np.zeros((len(node), len(parent)), _U)
    found = count[node]
    for j in reversed(range(len(parent))):
        out[:, j] = alphabet[letter[j][node]]
        node = parent[j][node]
    return out, found


def compose(requests: Automaton, counts: Automaton, n: int) -> np.ndarray:
    """``requests`` carries numbers 1 .. n instead of counts. The count of request i at place i - 1; 0 for phrases that ``counts`` lacks."""
    out = np.zeros(n, np.int64)
    at = np.searchsorted(counts.alphabet, requests.alphabet)
    at = np.minimum(at, len(counts.alphabet) - 1)
    known = counts.alphabet[at] == requests.alphabet
    q, c = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for x, y in zip(requests.layers, counts.layers):
        arcs, degree = _arcs(x.first, q)
        letter, state = x.letter[arcs], np.repeat(c, degree)
        wanted = state * len(counts.alphabet) + at[letter]
        have = np.repeat(np.arange(len(y.first) - 1), np.diff(y.first)) * len(counts.alphabet) + y.letter
        place = np.minimum(np.searchsorted(have, wanted), len(have) - 1)
        hit = known[letter] & (have[place] == wanted)
        q, c = x.target[arcs][hit], y.target[place[hit]]
    out[q - 1] = c
    return out
