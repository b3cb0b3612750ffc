"""External suffix sorting of one shard by induced sorting, with common-prefix values.

The order of all suffixes follows from the order of the few that begin a rising run (S* suffixes): scanning
the sorted ones upwards, each gives its place to the suffix one position to the left if that is of type L
(larger than its successor), then downwards for type S. What waits for its turn lies in a priority
queue of (first character, rank of the successor, position). Ranks are handed out in rising order, so
the queue is a first-in-first-out run for each character; a run is processed in batches of array operations and
goes to disk when the runs in memory are too large. Common-prefix values travel with
the tuples: two neighbours of a bucket share one character and what their successors share, the
minimum of the values between the successors' ranks.

The S* suffixes are ordered by naming the pieces between them (themselves sorted by one induction) and
sorting the string of names: again by induction while it is larger than memory, and
in memory below that. Prefixes are compared up to ``cap`` characters; ties beyond are left in any order.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Bytes of waiting tuples and results that a shard keeps in memory.
MEMORY = 96 << 20
#: Elements of a batch.
BATCH = 1 << 20
#: Arrays over the whole shard are mapped from disk above so many bytes.
MAPPED = 256 << 20
#: Strings of names up to this length are sorted in memory.
INTERNAL = 1 << 23


def whole_array(n: int, dtype) -> np.ndarray:
    """Zeros, in an unnamed file when large."""
    if n * np.dtype(dtype).itemsize > MAPPED:
        return np.memmap(tempfile.TemporaryFile(), dtype=dtype, shape=(n,))
    return np.zeros(n, dtype)


class Pool:
    """Memory shared by the runs of a shard; beyond the limit arrays go to one unnamed file, which
    ends with the task."""

    def __init__(self, memory: int = MEMORY):
        self.memory, self.used, self.file, self.spilled = memory, 0, None, 0

    def put(self, array: np.ndarray):
        if self.used + array.nbytes <= self.memory:
            self.used += array.nbytes
            return array
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        self.file.write(np.ascontiguousarray(array).data)
        self.spilled += array.nbytes
        return at, len(array), array.dtype

    def get(self, kept) -> np.ndarray:
        if isinstance(kept, np.ndarray):
            self.used -= kept.nbytes
            return kept
        at, n, dtype = kept
        self.file.seek(at)
        return np.frombuffer(self.file.read(n * dtype.itemsize), dtype)


class Run:
    """A run of tuples (arrays of equal length), taken out from the front or, once, from the back."""

    def __init__(self, pool: Pool):
        self.pool, self.parts, self.head = pool, [], 0

    def push(self, *arrays: np.ndarray) -> None:
        if len(arrays[0]):
            self.parts.append((len(arrays[0]), [self.pool.put(a) for a in arrays]))

    def pop(self) -> list[np.ndarray] | None:
        """The tuples that wait, about a batch of them at most; None if there are none."""
        taken, n = [], 0
        while self.head < len(self.parts) and (not taken or n + self.parts[self.head][0] <= BATCH):
            size, kept = self.parts[self.head]
            self.parts[self.head] = None
            taken.append([self.pool.get(k) for k in kept])
            n += size
            self.head += 1
        if not taken:
            return None
        return taken[0] if len(taken) == 1 else [np.concatenate(x) for x in zip(*taken)]

    def backwards(self) -> Iterator[list[np.ndarray]]:
        while self.parts:
            _, kept = self.parts.pop()
            yield [self.pool.get(k)[::-1] for k in kept]


class Types:
    def __init__(self, text: np.ndarray):
        n = len(text)
        edge = np.flatnonzero(text[1:] != text[:-1]) + 1
        begin = np.concatenate([[0], edge])
        size = np.diff(np.append(begin, n))
        rising = np.zeros(len(begin), bool)
        rising[:-1] = text[begin[1:]] > text[begin[:-1]]
        self.small = np.repeat(rising, size)  # type S
        star = self.small.copy()
        star[1:] &= ~self.small[:-1]
        star[0] = False
        self.star = np.flatnonzero(star)
        self.begin, self.size = begin, size

    def same(self, at: np.ndarray) -> np.ndarray:
        """How often the character at each position repeats from there."""
        k = np.searchsorted(self.begin, at, "right") - 1
        return self.begin[k] + self.size[k] - at


def _share(values: np.ndarray, last: int, ranks: np.ndarray, cap: int) -> np.ndarray:
    """One character and the least value between the ranks of neighbours' successors, for rising ``ranks``; ``last`` is the
    rank before the first."""
    if not cap:
        return np.zeros(len(ranks), np.int64)
    span = values[last + 1 : int(ranks[-1]) + 1]
    starts = np.concatenate([[0], ranks[:-1] - last])
    return np.minimum(np.minimum.reduceat(span, starts).astype(np.int64) + 1, cap)


def _deal(queue: dict[int, Run], pool: Pool, text: np.ndarray, at: np.ndarray, rank: np.ndarray) -> None:
    """Queue positions by their character, in the given order."""
    if not len(at):
        return
    first = text[at]
    order = np.argsort(first, kind="stable")
    first = first[order]
    cut = np.concatenate([[0], np.flatnonzero(first[1:] != first[:-1]) + 1, [len(first)]])
    for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
        own = order[i:j]
        queue.setdefault(int(first[i]), Run(pool)).push(at[own], rank[own])


def induce(text: np.ndarray, types: Types, star: np.ndarray, star_lcp: np.ndarray, cap: int, memory: int = MEMORY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes from the sorted S* ones, largest first, in batches (positions, characters shared with
    the one before, at most ``cap``)."""
    n, pool = len(text), Pool(memory)
    kind = np.int32 if n < 2**31 else np.int64
    star_first = text[star]
    letters = np.flatnonzero(np.bincount(text)) if text.dtype.itemsize <= 2 else np.unique(text)
    bounds = np.searchsorted(star_first, letters, "left"), np.searchsorted(star_first, letters, "right")
    # upwards: type L. Rank 0 is the end of the text
    values = whole_array(n + 1, np.uint16)
    queue: dict[int, Run] = {}
    _deal(queue, pool, text, np.array([n - 1], kind), np.array([0], np.int64))
    rank, large = 1, {}
    for c, lo, hi in zip(letters.tolist(), *(b.tolist() for b in bounds)):
        mine = queue.pop(c, None) or Run(pool)
        queue[c] = mine
        large[c] = Run(pool)
        last, final = -1, None
        while (got := mine.pop()) is not None:
            at, successor = got
            share = np.zeros(len(at), np.int64)
            if last < 0:
                share[1:] = _share(values, int(successor[0]), successor[1:], cap) if len(at) > 1 else share[1:]
            else:
                share = _share(values, last, successor, cap)
            last, final = int(successor[-1]), at[-1:]
            values[rank : rank + len(at)] = share
            large[c].push(at, share.astype(np.uint16))
            mark = np.arange(rank, rank + len(at))
            rank += len(at)
            type_l = ~types.small[at - 1]  # of position 0 the end of the text, of type L: taken out
            type_l &= at > 0
            _deal(queue, pool, text, at[type_l] - 1, mark[type_l])
        del queue[c]
        for i in range(lo, hi, BATCH):
            at = star[i : min(hi, i + BATCH)].astype(kind)
            share = np.minimum(star_lcp[i : i + len(at)], cap)
            if i == lo:
                share = share.copy()
                share[0] = 0 if final is None else min(cap, types.same(final)[0], types.same(at[:1])[0])
            values[rank : rank + len(at)] = share
            _deal(queue, pool, text, at - 1, np.arange(rank, rank + len(at)))  # an S* suffix follows one of type L
            rank += len(at)
    # downwards: type S, with ranks from the largest; type L goes by as it was found
    values = whole_array(n + 1, np.uint16)
    queue, rank = {}, 0

    def step(at: np.ndarray, share: np.ndarray):
        nonlocal rank
        values[rank : rank + len(at)] = share
        mark = np.arange(rank, rank + len(at))
        rank += len(at)
        type_s = types.small[at - 1]  # none before position 0: the last character is of type L
        _deal(queue, pool, text, at[type_s] - 1, mark[type_s])
        return at, share

    for c in letters.tolist()[::-1]:
        mine = queue.pop(c, None) or Run(pool)
        queue[c] = mine
        last, final = -1, None
        while (got := mine.pop()) is not None:
            at, successor = got
            share = np.zeros(len(at), np.int64)
            if last < 0:
                share[1:] = _share(values, int(successor[0]), successor[1:], cap) if len(at) > 1 else share[1:]
            else:
                share = _share(values, last, successor, cap)
            last, final = int(successor[-1]), at[-1:]
            yield step(at, share)
        del queue[c]
        carried = None  # a value belongs between a suffix and the one below it
        for at, share in large[c].backwards():
            down = np.empty(len(at), np.int64)
            down[1:] = share[:-1]
            if carried is None:
                down[0] = 0 if final is None else min(cap, types.same(final)[0], types.same(at[:1])[0])
            else:
                down[0] = carried
            carried = int(share[-1])
            yield step(at, down)


def _names(text: np.ndarray, types: Types, memory: int) -> tuple[np.ndarray, int]:
    """Ranks of the pieces from each S* position to the next, from one induction over S* positions ordered by their first
    character only; and how many there are."""
    star = types.star
    first = star[np.argsort(text[star], kind="stable")]
    number = np.full(len(text), -1, np.int32) if len(text) < 2**31 else np.full(len(text), -1, np.int64)
    number[star] = np.arange(len(star))
    found = np.empty(len(star), np.int64)
    k = len(star)
    for at, _ in induce(text, types, first, np.zeros(len(first), np.int64), 0, memory):
        own = number[at]
        own = own[own >= 0]
        found[k - len(own) : k] = own[::-1]
        k -= len(own)
    # equal pieces have equal characters up to and with the next S* position
    end = np.append(star[1:] + 1, len(text))
    size = (end - star)[found]
    equal = np.zeros(len(found), bool)
    equal[1:] = (size[1:] == size[:-1]) & (found[1:] != len(star) - 1) & (found[:-1] != len(star) - 1)
    left = np.flatnonzero(equal)
    k = 0
    while len(left):
        more = size[left] > k
        same = text[star[found[left[more]]] + k] == text[star[found[left[more] - 1]] + k]
        equal[left[more][~same]] = False
        left = left[more][same]
        k += 1
    rank = np.cumsum(~equal) - 1
    names = np.empty(len(star), np.int64)
    names[found] = rank
    return names, int(rank[-1]) + 1 if len(rank) else 0


def _sort_names(names: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Sort the suffixes of a string of names by doubling, up to ``depth`` names; the ranks after 1, 2, 4, .. names (the place of
    the first suffix that is equal so far); and how many of these ranks each shares with the one before. Suffixes that equal no other one
    keep their place."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    place, elements, key = np.arange(n), order, names[order]
    levels, agreed, step = [], np.zeros(n, np.uint8), 1
    while True:
        new = np.ones(len(place), bool)
        new[1:] = key[1:] != key[:-1]
        head = np.flatnonzero(new)
        rank = levels[-1].copy() if levels else np.empty(n, np.int32 if n < 2**31 else np.int64)
        rank[elements] = np.repeat(place[head], np.diff(np.append(head, len(place))))
        levels.append(rank)
        agreed[place[~new]] = len(levels)
        tied = ~new
        tied[:-1] |= tied[1:]
        place, elements = place[tied], elements[tied]
        if step >= depth or not len(place):
            return order, levels, agreed
        behind = elements + step
        inside = behind < n
        key = rank[elements] * np.int64(n + 1)
        key[inside] += rank[behind[inside]] + 1
        by = np.argsort(key, kind="stable")  # the ranks rise already
        elements, key = elements[by], key[by]
        order[place] = elements
        step *= 2


def sorted_stars(text: np.ndarray, types: Types, cap: int, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """The S* positions in suffix order and the characters each shares with the one before (at most ``cap``)."""
    star = types.star
    if not len(star):
        return star, np.zeros(0, np.int64)
    names, distinct = _names(text, types, memory)
    depth = cap // 2 + 2  # a piece moves on by two characters at least
    if len(names) > INTERNAL and distinct < len(names):
        order, shared = _recurse(names, depth, memory)
    else:
        order, levels, agreed = _sort_names(names, depth)
        shared = np.zeros(len(order), np.int64)
        for k in range(len(levels) - 1, -1, -1):  # names shared by neighbours
            shared[agreed == k + 1] = 1 << k
            left = np.flatnonzero(agreed > k + 1)
            a, b = order[left - 1] + shared[left], order[left] + shared[left]
            inside = np.maximum(a, b) + (1 << k) <= len(names)
            left, a, b = left[inside], a[inside], b[inside]
            shared[left[levels[k][a] == levels[k][b]]] += 1 << k
    # in characters: whole pieces, then one by one in the piece that differs
    at = star[order]
    behind = np.append(star, len(text))
    lcp = np.zeros(len(order), np.int64)
    i = np.minimum(order[1:] + shared[1:], len(star))
    lcp[1:] = behind[i] - at[1:]
    left = np.flatnonzero(lcp[1:] < cap) + 1
    while len(left):
        p, q = at[left] + lcp[left], at[left - 1] + lcp[left]
        inside = (p < len(text)) & (q < len(text))
        left, p, q = left[inside], p[inside], q[inside]
        left = left[text[p] == text[q]]
        lcp[left] += 1
        left = left[lcp[left] < cap]
    return at, np.minimum(lcp, cap)


def _recurse(names: np.ndarray, depth: int, memory: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of a string of names by induction on the next level, smallest first, and the names shared with the one before."""
    order, shared = whole_array(len(names), np.int64), whole_array(len(names), np.int64)
    k = len(names)
    for at, share in suffixes(names, depth, memory):
        order[k - len(at) : k] = at[::-1]
        # a batch's values are towards the suffix above: they belong to the place above
        upto = min(len(names), k + 1)
        moved = share[::-1]
        shared[k - len(at) + 1 : upto] = moved[: upto - (k - len(at) + 1)]
        k -= len(at)
    return order, shared


def suffixes(text: np.ndarray, cap: int, memory: int = MEMORY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes of ``text`` (characters as unsigned numbers), largest first: batches of positions and of the number of
    characters shared with the one before, at most ``cap``. An empty text has none."""
    if not len(text):
        return
    types = Types(text)
    star, lcp = sorted_stars(text, types, cap, memory)
    yield from induce(text, types, star, lcp, cap, memory)
