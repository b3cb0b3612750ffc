"""Similarity self-join of word n-gram sets by prefix filters under several global token orders.

Two sets with Jaccard similarity t or more share a token among the first n - ceil(t n) + 1 tokens of each, under any
total order of all tokens. Candidates must pass that under three orders, all with frequent tokens last (their
frequency comes from a fixed-size table of counts over the whole corpus; any table gives right results):
sharing under the first finds them, how much they share under the second and third must allow
the similarity, and only then whole sets are compared.

Equal sets are one node from the start. Links are found in two rounds, so a group of thousands of near copies doesn't
become all its pairs: first each token's members meet only the least of them, in one of a few orders of the nodes; the links found give
components, and then only members of different components meet, in cells of bounded size. There every posting carries a parity bitmap
of its whole set: sets whose bitmaps differ in d bits differ in d tokens at least, so a pair that can't be similar is
refused before it is sent. It also carries the tokens just before its own: two sets that share one of these met there already, and
are not sent again.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm import common as cm
from canvass.llm.components import connected

WORDS = 5
PERCENT = 80
#: Counters of the frequency table (8 bytes each; it is broadcast).
COUNTERS_BITS = 20
SLICES = 32
#: Members of a token on either side of a cell.
LEFT, RIGHT = 256, 1 << 16
#: Open tokens (32 bytes each) that are broadcast; beyond, they are joined, with the postings that pass a filter of 2**FILTER_BITS bits.
OPEN_TOKENS = 1_000_000
FILTER_BITS = 27
#: Bits of a set's parity bitmap.
PARITY_BITS = 512
#: Tokens before its own that a posting carries.
BEFORE = 4
_U = np.uint64
_TURN = cm.random_words(16, 77)
#: Orders of the nodes (by their bits, some turned over) in which a token takes the least member; the token says which.
_ORDERS = cm.random_words(4, 78).view(np.int64)


# ---- sets ----------------------------------------------------------------------------


def shingles(block: cm.TextBlock, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word n-grams of each row in order, and the rows' bounds. A row of fewer words has its whole
    sequence as one; a row without words has none."""
    h, bounds = block.words()
    size = np.diff(bounds)
    many = np.maximum(size - words + 1, np.minimum(size, 1))
    ends = np.concatenate([[0], np.cumsum(many)])
    total = np.zeros(max(0, len(h)), _U)
    for k in range(min(words, len(h))):  # sums of word k places on, times a multiplier of the place
        total[: len(h) - k] += cm.mix64(h[k:] + _TURN[k]) * _TURN[k + 5]
    first = np.arange(ends[-1]) + np.repeat(bounds[:-1] - ends[:-1], many)
    out = total[first]
    for row in np.flatnonzero((size > 0) & (size < words)):
        own = h[bounds[row] : bounds[row + 1]]
        out[ends[row]] = (cm.mix64(own + _TURN[: len(own)]) * _TURN[5 : 5 + len(own)]).sum() + _U(len(own))
    return cm.mix64(out), ends


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n + (-percent * n // 100) + 1  # n - ceil(t n) + 1


def _bucket(token: np.ndarray) -> np.ndarray:
    return (token >> _U(64 - COUNTERS_BITS)).astype(np.int64)


def ordered(tokens: np.ndarray, counts: np.ndarray, which: int) -> np.ndarray:
    """Distinct tokens in one of the global orders: by frequency (to the unit, the power of two, the power of four), then by a
    hash of their own."""
    often = counts[_bucket(tokens)]
    if which:
        often = np.frexp(often.astype(np.float64))[1] // which
    return tokens[np.lexsort((cm.mix64(tokens + _TURN[10 + which]), often))]


def frequencies(docs: DataFrame) -> np.ndarray:
    """Counts of all shingles by hash bucket; tasks add up their own and send them packed."""
    spark = docs.sparkSession
    part = (1 << COUNTERS_BITS) // SLICES

    def count(batches):
        total = np.zeros(1 << COUNTERS_BITS, np.int64)
        for block in cm.text_blocks(batches, "text"):
            total += np.bincount(_bucket(shingles(block)[0]), minlength=1 << COUNTERS_BITS)
        rows = [zlib.compress(total[i * part : (i + 1) * part].tobytes(), 1) for i in range(SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(rows, pa.binary())], names=["slice", "counts"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(zlib.decompress(c), np.int64)
                total[s] = total[s] + own if s in total else own
        if total:
            rows = [zlib.compress(x.tobytes(), 1) for x in total.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(rows, pa.binary())], names=["slice", "counts"])

    packed = "slice int, counts binary"
    counted = docs.select(F.col("__text").alias("text")).mapInArrow(count, packed)
    out = np.zeros(1 << COUNTERS_BITS, np.int64)
    for r in counted.repartition(min(SLICES, cm.shuffle_width(spark)), "slice").mapInArrow(add, packed).collect():  # a row for each slice
        out[r["slice"] * part : (r["slice"] + 1) * part] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    return out


def _distinct(block: cm.TextBlock):
    tokens, bounds = shingles(block)
    for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        yield np.unique(tokens[i:j])


def _node(tokens: np.ndarray) -> int:
    """The node of a set: a hash of its tokens in order."""
    n = len(tokens)
    return int(cm.mix64(np.array([(cm.mix64(tokens) * (cm.random_words(1, 5)[0] + _U(2) * np.arange(n, dtype=_U))).sum() + _U(n)], _U)).view(np.int64)[0])


def parity(tokens: np.ndarray) -> bytes:
    """Per bit whether an odd number of the set's tokens falls on it."""
    place = (cm.mix64(tokens + _TURN[15]) >> _U(64 - PARITY_BITS.bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=PARITY_BITS) & 1).astype(np.uint8)).tobytes()


def prefixes(docs: DataFrame, counts) -> DataFrame:
    """(k1, k2, doc_id, n, node, prefix, bits) of every row: size and node of its set, its first tokens in the first order and its
    parity bitmap (both null where the same set came before in the block)."""

    def run(batches):
        for block in cm.text_blocks(batches, "text"):
            sizes, nodes, firsts, bits, seen = [], [], [], [], set()
            for tokens in _distinct(block):
                sizes.append(len(tokens))
                node = _node(tokens) if len(tokens) else None
                nodes.append(node)
                fresh = node is not None and node not in seen
                seen.add(node)
                firsts.append(ordered(tokens, counts.value, 0)[: prefix_size(len(tokens))].tobytes() if fresh else None)
                bits.append(parity(tokens) if fresh else None)
            own = [pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(firsts, pa.binary()), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays([*block.rows.columns, *own], names=["k1", "k2", "doc_id", "n", "node", "prefix", "bits"])

    rows = docs.select(F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), F.col("__id").alias("doc_id"), F.col("__text").alias("text"))
    return rows.mapInArrow(run, "k1 long, k2 long, doc_id long, n long, node long, prefix binary, bits binary")


def whole_sets(docs: DataFrame, wanted: DataFrame, counts) -> DataFrame:
    """(node, n, tokens, second, third) of the sets of the rows with the keys ``wanted`` (different ones): all tokens, and the first
    ones in the other two orders. Rows that repeat are next to each other behind the sort-merge join, so a set comes
    once (or as often as a split of a hot key makes pieces)."""

    def run(batches):
        last = None
        for block in cm.text_blocks(batches, "text"):
            rows = []
            keys = zip(block.rows.column("k1").to_pylist(), block.rows.column("k2").to_pylist())
            for key, tokens in zip(keys, _distinct(block)):
                if key != last and len(tokens):
                    p = prefix_size(len(tokens))
                    rows.append((_node(tokens), len(tokens), *(x.view(np.int64) for x in (tokens, ordered(tokens, counts.value, 1)[:p], ordered(tokens, counts.value, 2)[:p]))))
                last = key
            for i in range(0, len(rows), 64):
                kinds = (pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3)
                columns = [pa.array(x, t) for x, t in zip(zip(*rows[i : i + 64]), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "tokens", "second", "third"])

    texts = docs.select(F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), F.col("__text").alias("text"))
    return texts.join(wanted.hint("merge"), ["k1", "k2"]).select("k1", "k2", "text").mapInArrow(run, "node long, n long, tokens array<long>, second array<long>, third array<long>")


# ---- candidates --------------------------------------------------------------------------


def _postings(batch: pa.RecordBatch):
    """(token, node, size of the set, place in the prefix) of a batch of prefix rows."""
    raw = batch.column("prefix").to_pylist()
    many = np.array([len(x) // 8 for x in raw], np.int64)
    token = np.frombuffer(b"".join(raw), np.int64)
    ends = np.cumsum(many)
    place = np.arange(len(token)) - np.repeat(ends - many, many)
    return token, np.repeat(batch.column("node").to_numpy(), many), np.repeat(batch.column("n").to_numpy(), many), place


def _bound(i, j, na, nb, percent: int = PERCENT):
    """Whether sets of these sizes that share a token at places i and j (of one order) can be similar enough."""
    most = np.minimum(i, j) + 1 + np.minimum(na - i - 1, nb - j - 1)
    return (100 + percent) * most >= percent * (na + nb)


def _first_bound(i, j, na, nb, percent: int = PERCENT):
    """The same where they share no token before."""
    most = np.minimum(na - i, nb - j)
    return (100 + percent) * most >= percent * (na + nb)


def _turned(node: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Nodes as the token's order compares them; twice gives the node again."""
    return node ^ _ORDERS[token & (len(_ORDERS) - 1)]


def stars(prefix_rows: DataFrame) -> DataFrame:
    """(a, b, fits): each token's members with the least of them in the token's order, if their sizes and the token's places in both allow the
    similarity; (a, a, false) for members that meet another one at all. Tasks link their own members first and send one for each token."""

    def pairs(a, b, fits):
        """Distinct pairs that fit for some token, and the members of all."""
        if not len(a):
            return np.zeros((0, 3), np.int64)
        low, high = np.minimum(a, b), np.maximum(a, b)
        near = np.unique(np.stack([low[fits], high[fits]], 1), axis=0) if fits.any() else np.zeros((0, 2), np.int64)
        some = np.unique(np.concatenate([a, b]))
        rows = np.ones((len(near) + len(some), 3), np.int64)
        rows[: len(near), :2] = near
        rows[len(near) :] = np.stack([some, some, 0 * some], 1)
        return rows

    def local(batches):
        for batch in batches:
            token, node, n, place = _postings(batch)
            order = np.lexsort((_turned(node, token), token))
            token, node, n, place = token[order], node[order], n[order], place[order]
            new = np.ones(len(token), bool)
            new[1:] = token[1:] != token[:-1]
            first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(token) else np.zeros(0, np.int64)
            other = ~new & (node != node[first])
            k = first[other]
            own = pairs(node[k], node[other], _bound(place[k], place[other], n[k], n[other]))
            link = np.concatenate([np.zeros(int(new.sum()), bool), np.ones(len(own), bool)])
            cols = (link, np.concatenate([token[new], own[:, 0]]), np.concatenate([_turned(node[new], token[new]), own[:, 1]]), np.concatenate([n[new], own[:, 2]]).astype(np.int32), np.concatenate([place[new], 0 * own[:, 2]]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in cols], names=["link", "key", "node", "n", "place"])

    def merge(batches):
        held = None  # the token before, with its least member
        for batch in batches:
            link, key, node, n, place = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            n, place = n.astype(np.int64), place.astype(np.int64)
            out = [(key[link], node[link], n[link] > 0)]
            cols = [x[~link] for x in (key, node, n, place)]
            if len(cols[0]):
                if held is not None:
                    cols = [np.concatenate([[h], x]) for h, x in zip(held, cols)]
                key, node, n, place = cols[0], _turned(cols[1], cols[0]), *cols[2:]
                new = np.ones(len(key), bool)
                new[1:] = key[1:] != key[:-1]
                first = np.flatnonzero(new)[np.cumsum(new) - 1]
                other = ~new & (node != node[first])
                k = first[other]
                out.append((node[k], node[other], _bound(place[k], place[other], n[k], n[other])))
                held = [x[first[-1]] for x in cols]
            found = pairs(*(np.concatenate(x) for x in zip(*out)))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, i])) for i in range(2)] + [pa.array(found[:, 2] > 0)], names=["a", "b", "fits"])

    sent = prefix_rows.select("node", "n", "prefix").mapInArrow(local, "link boolean, key long, node long, n int, place int")
    sent = sent.repartition(cm.shuffle_width(prefix_rows.sparkSession), "key").sortWithinPartitions("link", "key", "node")
    return sent.mapInArrow(merge, "a long, b long, fits boolean").groupBy("a", "b").agg(F.max("fits").alias("fits"))


def _filter_places(token: np.ndarray) -> np.ndarray:
    """The two bits of each token in the filter of open tokens."""
    mixed = cm.mix64(token.view(_U) + _TURN[14])
    return np.stack([mixed >> _U(64 - FILTER_BITS), mixed & _U((1 << FILTER_BITS) - 1)]).astype(np.int64)


def open_filter(tokens: DataFrame) -> np.ndarray:
    """Bits (packed, of a fixed number) that all ``tokens`` and few others have set; put together by ranges of bits in the cluster."""
    spark = tokens.sparkSession
    part = (1 << FILTER_BITS) // SLICES

    def places(batches):
        for batch in batches:
            at = np.unique(_filter_places(batch.column(0).to_numpy()))
            ends = np.searchsorted(at, np.arange(SLICES + 1) * part)
            rows = [(at[i:j] % part).astype(np.uint32).tobytes() for i, j in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(rows, pa.binary())], names=["slice", "bits"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total.setdefault(s, np.zeros(part, bool))[np.frombuffer(at, np.uint32)] = True
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.packbits(x).tobytes() for x in total.values()], pa.binary())], names=["slice", "bits"])

    packed = "slice int, bits binary"
    out = np.zeros((SLICES, part // 8), np.uint8)
    found = tokens.select("token").mapInArrow(places, packed)
    for r in found.repartition(min(SLICES, cm.shuffle_width(spark)), "slice").mapInArrow(add, packed).collect():  # a row for each slice
        out[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def _may_be_open(token: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = _filter_places(token)
    return ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)


def across(prefix_rows: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b): members of a token that are in different components (``prefix_rows``: different sets; ``members``: node, label), where sizes and places allow
    the similarity. In each token's group the largest component stays on one side: the others meet it and each other."""
    spark = prefix_rows.sparkSession
    sent = None

    def spread(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):  # a posting is larger than a token
                part = batch.slice(lo, 512)
                token, node, n, place = _postings(part)
                many = np.array([len(x) // 8 for x in part.column("prefix").to_pylist()], np.int64)
                label = np.repeat(part.column("label").to_numpy(), many)
                before = np.zeros((len(token), BEFORE), np.int64)  # 0: none
                for k in range(1, BEFORE + 1):
                    before[k:, k - 1] = np.where(place[k:] >= k, token[:-k], 0)
                parities = np.frombuffer(b"".join(part.column("bits").to_pylist()), np.int64).reshape(part.num_rows, -1)
                columns, row = (token, node, label, n, place), np.repeat(np.arange(part.num_rows), many)
                if sent is not None:
                    few = np.flatnonzero(_may_be_open(token, sent.value))
                    columns, row, before = tuple(x[few] for x in columns), row[few], before[few]
                both = np.concatenate([parities[row], before], axis=1)
                bits = cm.binaries(both.reshape(-1), np.arange(len(both) + 1) * both.shape[1])
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in columns), bits], names=["token", "node", "label", "n", "place", "bits"])

    def tokens(batches):
        for batch in batches:
            many = np.array([len(x) // 8 for x in batch.column("prefix").to_pylist()], np.int64)
            label = np.repeat(batch.column("label").to_numpy(), many)
            yield pa.RecordBatch.from_arrays([pa.array(_postings(batch)[0]), pa.array(label)], names=["token", "label"])

    kept = prefix_rows.join(members, "node").select("node", "label", "n", "prefix", "bits")
    groups = kept.mapInArrow(tokens, "token long, label long")
    groups = groups.groupBy("token", "label").agg(F.count(F.lit(1)).alias("m"))
    groups = groups.groupBy("token").agg(F.sum("m").alias("m"), F.max(F.struct("m", "label")).alias("top")).filter("m > top.m")
    groups = cm.written(_few(groups.select("token", F.col("top.label").alias("top"), F.col("m").alias("all"), (F.col("m") - F.col("top.m")).alias("few"))), "ngram-open")
    lefts = F.ceil(F.col("few") / LEFT)
    rights = F.ceil(F.col("all") / RIGHT)
    # the open tokens go to the tasks while they are few, else the postings to them: with their bitmaps these are many times the texts, so first
    # those of other tokens (nearly all) are left out
    few = groups.count() <= OPEN_TOKENS
    sent = None if few else spark.sparkContext.broadcast(open_filter(groups))
    rows = kept.mapInArrow(spread, "token long, node long, label long, n long, place long, bits binary")
    both = rows.join(F.broadcast(groups) if few else groups, "token")
    spot = F.xxhash64("node")
    left = both.filter("label != top").select(
        "token", F.pmod(spot, lefts).alias("i"), F.explode(F.sequence(F.lit(0), rights - 1)).alias("j"), F.lit(False).alias("right"), "node", "label", "n", "place", "top", "bits"
    )
    right = both.select(
        "token", F.explode(F.sequence(F.lit(0), lefts - 1)).alias("i"), F.pmod(spot, rights).alias("j"), F.lit(True).alias("right"), "node", "label", "n", "place", "top", "bits"
    )
    cells = left.unionByName(right).repartition(cm.shuffle_width(spark), "token", "i", "j").sortWithinPartitions("token", "i", "j", "right")

    def meet(batches):
        current, held = None, None
        for batch in batches:
            token, i, j, right, node, label, n, place, top = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(9))
            carried = np.frombuffer(b"".join(batch.column(9).to_pylist()), _U).reshape(len(token), PARITY_BITS // 64 + BEFORE)
            bits, before = carried[:, :-BEFORE], carried[:, -BEFORE:]
            edge = np.flatnonzero((token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            cuts = np.concatenate([[0], edge, [len(token)]])
            found = []
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                cell = (token[lo], i[lo], j[lo])
                mid = lo + int(np.searchsorted(right[lo:hi], True))
                if cell != current:
                    current, held = cell, None
                if mid > lo:
                    own = tuple(x[lo:mid] for x in (node, label, n, place, bits, before))
                    held = own if held is None else tuple(np.concatenate(x) for x in zip(held, own))
                if held is None:
                    continue
                for k in range(mid, hi, 2048):
                    part = slice(k, min(hi, k + 2048))
                    a = [x[:, None] for x in held[:4]]
                    good = (a[1] != label[part]) & ((label[part] == top[lo]) | (a[0] < node[part])) & _first_bound(a[3], place[part], a[2], n[part])
                    x, y = np.nonzero(good)
                    if len(x):
                        met = np.zeros(len(x), bool)
                        for k in range(BEFORE):
                            own = held[5][x, k][:, None]
                            met |= ((own != 0) & (own == before[part][y])).any(axis=1)
                        x, y = x[~met], y[~met]
                    if len(x):
                        both, apart = held[2][x] + n[part][y], np.bitwise_count(held[4][x] ^ bits[part][y]).sum(axis=1, dtype=np.int64)
                        close = (100 + PERCENT) * ((both - apart) // 2) >= PERCENT * both
                        x, y = x[close], y[close]
                    if len(x):
                        p, q = held[0][x], node[part][y]
                        found.append(np.stack([np.minimum(p, q), np.maximum(p, q)], 1))
                if sum(map(len, found)) > 200_000:
                    yield _pairs(found)
                    found = []
            if found:
                yield _pairs(found)

    def _pairs(found):
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], names=["a", "b"])

    return cells.mapInArrow(meet, "a long, b long").distinct()


def _few(found: DataFrame) -> DataFrame:
    """What a wide join or count has left, dealt out anew for writing: as many files as its own size asks for, not one for each task of the
    join. On a local file system each file costs a process or more (``chmod``), which is a fork of the executor."""
    return found.hint("rebalance")


def _ends(table: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    return tuple(table.select(F.col("node").alias(e), *(F.col(c).alias(f"{c}_{e}") for c in columns)) for e in "ab")


def allowed(pairs: DataFrame, short: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b, n_a, n_b) whose sizes and whose second and third prefixes, one after the other, allow the similarity: tokens that
    two sets share are among both prefixes, or behind one of them."""
    pairs = pairs.select("a", "b")
    for which in ("second", "third"):
        left, right = _ends(short, ["n", which])
        most = F.size(F.array_intersect(which + "_a", which + "_b")) + F.greatest(F.col("n_a") - F.size(which + "_a"), F.col("n_b") - F.size(which + "_b"))
        fits = (F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent)
        fits = fits & ((100 + percent) * most >= percent * (F.col("n_a") + F.col("n_b")))
        found = pairs.join(left, "a").join(right, "b").filter(fits)
        pairs = cm.written(_few(found.select("a", "b", *(["n_a", "n_b"] if which == "third" else []))), f"ngram-{which}")
    return pairs


def similar(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose whole sets are similar enough."""
    left, right = _ends(sets, ["tokens"])
    shared = F.size(F.array_intersect("tokens_a", "tokens_b"))
    enough = 100 * shared >= percent * (F.col("n_a") + F.col("n_b") - shared)
    return pairs.join(left, "a").join(right, "b").filter(enough).select("a", "b").distinct()


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with a 128-bit key of their id and text."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.withColumns({"__id": F.col(f"`{id_col}`").cast("long"), "__text": text})
    return rows.withColumns({"__k1": F.xxhash64("__id", "__text"), "__k2": F.xxhash64(F.lit(7), "__text", "__id")})


def _nodes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionAll(pairs.filter("a != b").select(F.col("b").alias("node"))).distinct()


def similar_groups(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, doc_id, n_shingles, component_id, root) of every row; ``component_id`` is the smallest id that links reach (Jaccard similarity of
    the 5-word shingle sets of 0.8 or more), its own included.

    Null and empty texts and texts without words have empty sets and link with nothing. Equal sets always link. Null ids are not
    counted: a component of null ids only has a null id. Repeated rows come out as often as they are. An empty table gives no rows. ``root``: the component itself; null for an empty set."""
    keyed = _keyed(docs, id_col, text_col).select("__id", "__text", "__k1", "__k2")
    counts = spark.sparkContext.broadcast(frequencies(keyed))
    rows = cm.written(prefixes(keyed, counts), "ngram-prefixes")
    placed = cm.written(rows.select("k1", "k2", "doc_id", "n", "node"), "ngram-rows")
    met = cm.written(stars(rows.filter("prefix is not null").select("node", "n", "prefix")), "ngram-stars")
    wanted = _nodes_of(met)
    short = rows.filter("prefix is not null").select("node", "n", "prefix", "bits")
    short = cm.written(short.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "ngram-short")
    cm.discard(rows)
    keys = cm.written(placed.filter("node is not null").groupBy("node").agg(F.min(F.struct("k1", "k2")).alias("k")).join(wanted, "node").select("node", "k.k1", "k.k2"), "ngram-keys")
    near = met.filter("fits")
    sets = cm.written(whole_sets(keyed, keys.join(_nodes_of(near), "node").select("k1", "k2"), counts), "ngram-sets")
    links = cm.written(_few(similar(allowed(near, sets), sets)), "ngram-links")
    labels = connected(links, name="ngram-components")
    members = cm.written(short.select("node").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "ngram-members")
    open_ = cm.written(across(short, members), "ngram-across")
    new = _nodes_of(open_).join(sets.select("node"), "node", "left_anti")
    more_sets = cm.written(whole_sets(keyed, keys.join(new, "node").select("k1", "k2"), counts), "ngram-sets")
    sets = sets.unionByName(more_sets)
    more = cm.written(_few(similar(allowed(open_, sets), sets)), "ngram-links")
    cm.discard(sets, short)
    # components of components
    end = lambda c: members.select(F.col("node").alias(c), F.col("label").alias(c + "_label"))
    joined = connected(more.join(end("a"), "a").join(end("b"), "b").select(F.col("a_label").alias("a"), F.col("b_label").alias("b")), name="ngram-components")
    last = members.join(joined.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left").select("node", F.coalesce("root", "label").alias("root"))
    # the smallest id of each node, then of each component
    smallest = placed.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least")).join(last, "node", "left")
    smallest = cm.written(smallest.select("node", "least", F.coalesce("root", "node").alias("root")), "ngram-nodes")
    roots = smallest.groupBy("root").agg(F.min("least").alias("component_id"))
    component = smallest.join(roots, "root").select("node", "root", "component_id")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = placed.join(component, "node", "left")
    return out.select("k1", "k2", "doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), "root")


def join_groups(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return similar_groups(spark, docs).select("doc_id", "n_shingles", "component_id")


def one_of_each(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows and columns of ``docs`` without near copies: of each component the row with the smallest id stays (null ids last; of
    several texts with that id the one with the least content key, of repeated rows one). Rows without words all stay."""
    groups = cm.written(similar_groups(spark, docs, id_col, text_col), "ngram-groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nil"), "doc_id", "k1", "k2")).alias("first")
    stay = groups.filter("root is not null").groupBy("root").agg(first).select("first.k1", "first.k2")
    often = groups.filter("root is not null").groupBy("k1", "k2").agg((F.count(F.lit(1)) > 1).alias("often"))
    stay = cm.written(stay.join(often, ["k1", "k2"]), "ngram-stay")
    keyed = _keyed(docs, id_col, text_col).drop("__id", "__text")
    on = (F.col("__k1") == F.col("s.k1")) & (F.col("__k2") == F.col("s.k2"))
    kept = lambda which: keyed.join(stay.filter(which).alias("s"), on, "left_semi")
    once, again = kept("not often"), kept("often").dropDuplicates(["__k1", "__k2"])
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    wordless = docs.filter(~text.rlike(r"[^\x20\x09-\x0D]"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return once.select(*columns).unionByName(again.select(*columns)).unionByName(wordless)
