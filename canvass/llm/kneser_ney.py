"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays, memory-mapped by workers.

Words are 64-bit hashes. The arrays of the words (sorted hashes, counts) are files by hash range; a word's number is its
place in them. A bigram is (number of the first word, number of the second) in one 64-bit key; its shard's file has
the sorted keys and counts. Per word there are the numbers of different words seen before it (its
continuation count) and of words seen after it once, twice and more often. Everything is counted over all training
texts, and all files grow with the corpus; nothing is kept whole in a task or on the driver.

The files lie in the shared folder (``spark.checkpoint.dir``). Workers map them read-only, so a machine's workers share the pages in
use. Where the folder is no file system that can be mapped, Spark distributes the files to the executors
(``addFile``) and they map these copies.

p(w | v) = max(c(vw) - D(c(vw)), 0) / c(v) + g(v) q(w), with q(w) = max(n(w) - E(n(w)), 0) / n + h / (words + 1),
where n(w) counts the different words before w, D and E are the discounts for counts of 1, 2 and 3 or more, and
g and h the weights they free. The end of a text is a word, its beginning a context.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm import common as cm
from canvass.session import checkpoint_root

_U = np.uint64
END = _U(0x0123456789ABCDEF)
#: Texts counted or scored together.
STRETCH = 4 << 20


# ---- files -----------------------------------------------------------------------------


@dataclass
class Store:
    """Arrays as files in a folder: written once by a task (to another name first, so that a repeated task does no harm), mapped by others."""

    folder: str

    def write(self, name: str, array: np.ndarray) -> None:
        fs, path = pafs.FileSystem.from_uri(self.folder)
        fs.create_dir(path, recursive=True)
        own = f"{path}/.{name}-{uuid.uuid4().hex}"
        with fs.open_output_stream(own) as f:
            f.write(pa.py_buffer(np.ascontiguousarray(array)))
        fs.move(own, f"{path}/{name}")

    def local(self) -> bool:
        return urlparse(self.folder).scheme == "file"

    def spread(self, spark: SparkSession, names: list[str]) -> None:
        if not self.local():
            for n in names:
                spark.sparkContext.addFile(f"{self.folder}/{n}")

    def map(self, name: str, dtype) -> np.ndarray:
        path = f"{urlparse(self.folder).path}/{name}" if self.local() else SparkFiles.get(name)
        if not os.path.getsize(path):
            return np.zeros(0, dtype)
        return np.memmap(path, dtype, "r")


def new_store(spark: SparkSession, name: str) -> Store:
    root = checkpoint_root(spark)
    if "://" not in root:
        root = root if root.startswith("file:") else "file://" + os.path.abspath(root)
    if root.startswith("file:/") and not root.startswith("file://"):
        root = "file://" + root[5:]
    return Store(f"{root}/{name}-{uuid.uuid4().hex[:12]}")


# ---- tokens ----------------------------------------------------------------------------


def tokens(block: cm.TextBlock) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of each row with the end behind, and the rows' bounds."""
    h, bounds = block.words()
    rows = len(bounds) - 1
    out = np.empty(len(h) + rows, _U)
    at = np.arange(len(h)) + cm.owners(bounds)
    out[at] = h
    ends = bounds + np.arange(rows + 1)
    out[ends[1:] - 1] = END
    return out, ends


def _summed(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    order = np.argsort(key)
    key, count = key[order], count[order]
    if not len(key):
        return key, count
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[head], np.add.reduceat(count, head)


# ---- words -------------------------------------------------------------------------------


@dataclass
class Words:
    """Where the word files are; range r has the hashes with these top bits."""

    store: Store
    bits: int
    base: np.ndarray  # number of the first word of each range, and of all
    total: int  # tokens

    def mapped(self, what: str, dtype) -> list[np.ndarray]:
        return [self.store.map(f"word-{what}-{r}", dtype) for r in range(1 << self.bits)]


class Lexicon:
    """A worker's view of the word files."""

    def __init__(self, words: Words):
        self.words, self.hashes = words, words.mapped("hash", _U)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for unknown ones."""
        distinct, inverse = np.unique(h, return_inverse=True)
        out = np.full(len(distinct), -1, np.int64)
        for r, lo, hi in _ranges(distinct, self.words.bits):
            known, own = self.hashes[r], distinct[lo:hi]
            if len(known):
                at = np.searchsorted(known, own)
                hit = known[np.minimum(at, len(known) - 1)] == own
                out[lo:hi][hit] = at[hit] + self.words.base[r]
        return out[inverse.reshape(-1)]


def _ranges(sorted_keys: np.ndarray, bits: int):
    if not bits:
        yield 0, 0, len(sorted_keys)
        return
    edges = np.searchsorted(sorted_keys, np.arange(1, 1 << bits, dtype=_U) << _U(64 - bits))
    lo = 0
    for r, hi in enumerate([*edges.tolist(), len(sorted_keys)]):
        if hi > lo:
            yield r, lo, hi
        lo = hi


def count_words(train: DataFrame, store: Store, bits: int) -> Words:
    spark = train.sparkSession

    def count(batches):
        key, n = np.zeros(0, _U), np.zeros(0, np.int64)
        for block in cm.text_blocks(batches, "text"):
            own, many = np.unique(tokens(block)[0], return_counts=True)
            key, n = _summed(np.concatenate([key, own]), np.concatenate([n, many]))
            if len(key) > 1 << 21:
                yield from _out(key, n)
                key, n = np.zeros(0, _U), np.zeros(0, np.int64)
        yield from _out(key, n)

    def _out(key, n):
        for r, lo, hi in _ranges(key, bits):
            yield pa.RecordBatch.from_arrays(
                [pa.array([r], pa.int32()), pa.array([key[lo:hi].tobytes()], pa.binary()), pa.array([n[lo:hi].tobytes()], pa.binary())], names=["range", "keys", "counts"]
            )

    def save(batches):
        for r, key, n in _merged(batches):
            store.write(f"word-hash-{r}", key)
            store.write(f"word-count-{r}", n)
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([len(key)]), pa.array([int(n.sum())])], names=["range", "n", "total"])

    packed = train.mapInArrow(count, "range int, keys binary, counts binary")
    sizes = _by_range(packed, bits, spark).mapInArrow(save, "range int, n long, total long")
    sizes = {r["range"]: (r["n"], r["total"]) for r in sizes.collect()}  # a row for each range
    for r in range(1 << bits):
        if r not in sizes:
            store.write(f"word-hash-{r}", np.zeros(0, _U))
            store.write(f"word-count-{r}", np.zeros(0, np.int64))
    store.spread(spark, [f"word-{w}-{r}" for w in ("hash", "count") for r in range(1 << bits)])
    base = np.concatenate([[0], np.cumsum([sizes.get(r, (0, 0))[0] for r in range(1 << bits)])])
    return Words(store, bits, base, sum(t for _, t in sizes.values()))


def _by_range(rows: DataFrame, bits: int, spark: SparkSession) -> DataFrame:
    return rows.repartition(min(1 << bits, cm.shuffle_width(spark)), "range").sortWithinPartitions("range")


def _merged(batches):
    """(range, distinct keys, sums) of packed rows sorted by range; a range is merged whenever twice as much has come in."""
    current, key, n, more = None, None, None, []

    def merge():
        nonlocal key, n, more
        if more:
            key, n = _summed(np.concatenate([key, *(k for k, _ in more)]), np.concatenate([n, *(c for _, c in more)]))
            more = []

    for batch in batches:
        for r, k, c in zip(*(batch.column(i) for i in range(3))):
            r = r.as_py()
            if r != current:
                if current is not None:
                    merge()
                    yield current, key, n
                current, key, n, more = r, np.zeros(0, _U), np.zeros(0, np.int64), []
            more.append((np.frombuffer(k.as_py(), _U), np.frombuffer(c.as_py(), np.int64)))
            if sum(len(x) for x, _ in more) > max(1 << 20, len(key)):
                merge()
    if current is not None:
        merge()
        yield current, key, n


def save_pairs(store: Store, shard: int, key: np.ndarray, n: np.ndarray) -> None:
    """A shard's sorted bigrams and their counts, in 4 bytes each unless one needs more."""
    store.write(f"pair-key-{shard}", key)
    store.write(f"pair-count-{shard}", n.astype("<u4" if n.max(initial=0) < 1 << 32 else "<i8"))


def load_pairs(store: Store, shard: int) -> tuple[np.ndarray, np.ndarray]:
    key, n = store.map(f"pair-key-{shard}", _U), store.map(f"pair-count-{shard}", "<u4")
    return key, n if len(n) == len(key) else store.map(f"pair-count-{shard}", "<i8")


# ---- bigrams -----------------------------------------------------------------------------


@dataclass
class Model:
    words: Words
    shards: int
    discounts: tuple  # of bigram counts 1, 2, 3+
    lower: tuple  # of continuation counts
    starts: int  # training texts
    start_after: tuple  # different first words seen once, twice, more often
    types: int  # different bigrams
    classes: tuple  # words with continuation count 1, 2, 3+


def _shard(first: np.ndarray, second: np.ndarray, shards: int) -> np.ndarray:
    """A bigram's shard; by both words, so a frequent word's bigrams are dealt to all."""
    return (cm.mix64(first.astype(_U) * _U(0x9E3779B97F4A7C15) + second.astype(_U)) % _U(shards)).astype(np.int64)


def _pairs(numbers: np.ndarray, ends: np.ndarray, start: int) -> np.ndarray:
    """The word before each token (``start`` at the beginning of a row)."""
    before = np.empty_like(numbers)
    before[1:] = numbers[:-1]
    before[ends[:-1][np.diff(ends) > 0]] = start
    return before


def _discounts(n: np.ndarray) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from how many counts are 1, 2, 3 and 4; between 0 and the count."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    ask = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 0.75, 3 - 4 * y * n4 / n3 if n3 else 0.9]
    return tuple(min(max(d, 0.05), k + 0.95) for k, d in enumerate(ask))


def train_model(spark: SparkSession, texts: DataFrame, bits: int | None = None) -> Model:
    """``texts``: a column ``text`` (null counts as empty). Files for the words by 2**bits hash ranges (a quarter of the shuffle
    partitions), for the bigrams by twice as many shards as partitions: each shard sends a packed row to each
    range, so the ranges are kept few. An empty table gives a model without words."""
    width = cm.shuffle_width(spark)
    bits = bits if bits is not None else min(10, max(2, int(np.ceil(np.log2(width / 4)))))
    store = new_store(spark, "kneser-ney")
    words = count_words(texts, store, bits)
    shards = 2 * width
    start = int(words.base[-1])  # the number of the beginning
    if start >= 1 << 32:
        raise ValueError("more than 2**32 different words: bigram keys need more bits")

    def count(batches):
        lexicon = Lexicon(words)
        held, size, many = [], 0, 0
        for block in cm.text_blocks(batches, "text", STRETCH):
            h, ends = tokens(block)
            if many + len(h) >= 1 << 32:  # counts are sent in 4 bytes
                yield from _out(held)
                held, size, many = [], 0, 0
            many += len(h)
            number = lexicon.numbers(h)
            key, n = np.unique((_pairs(number, ends, start).astype(_U) << _U(32)) | number.astype(_U), return_counts=True)
            held.append((key, n))
            size += len(key)
            if size > 3_000_000:
                yield from _out(held)
                held, size, many = [], 0, 0
        if held:
            yield from _out(held)

    def _out(held):
        key, n = _summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
        shard = _shard(key >> _U(32), key & _U(0xFFFFFFFF), shards)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        for s in range(shards):
            own = order[cuts[s] : cuts[s + 1]]
            if len(own):
                first, second = (key[own] >> _U(32)).astype("<u4"), (key[own] & _U(0xFFFFFFFF)).astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (first, second, n[own].astype("<u4")))],
                    names=["shard", "first", "second", "counts"],
                )

    def joined(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                first, second, n = (np.frombuffer(batch.column(k)[i].as_py(), "<u4") for k in (1, 2, 3))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), pa.array([((first.astype(_U) << _U(32)) | second).tobytes()], pa.binary()), pa.array([n.astype(np.int64).tobytes()], pa.binary())],
                    names=["range", "keys", "counts"],
                )

    kinds = "kind int, range int, ids binary, a binary, b binary, c binary"

    def save(batches):
        names = ["kind", "range", "ids", "a", "b", "c"]
        for s, key, n in _merged(joined(batches)):
            save_pairs(store, s, key, n)
            first, second = (key >> _U(32)).astype(np.int64), (key & _U(0xFFFFFFFF)).astype(np.int64)
            counts = np.array([(n == k).sum() for k in (1, 2, 3, 4)] + [len(n)], np.int64)
            yield _stat(names, 0, s, np.zeros(0, np.int64), counts, counts, counts)
            # words after each first word by count, and different words before each second word, by word range
            ids, at = np.unique(first, return_inverse=True)
            after = [np.bincount(at.reshape(-1)[low], minlength=len(ids)) for low in (n == 1, n == 2, n >= 3)]
            yield from _by_word(names, 1, ids, after)
            ids, before = np.unique(second, return_counts=True)
            yield from _by_word(names, 2, ids, [before, before, before])

    def _stat(names, kind, r, ids, a, b, c):
        cols = [pa.array([kind], pa.int32()), pa.array([int(r)], pa.int32()), *(pa.array([np.ascontiguousarray(x, np.int64).tobytes()], pa.binary()) for x in (ids, a, b, c))]
        return pa.RecordBatch.from_arrays(cols, names=names)

    def _by_word(names, kind, ids, cols):
        cuts = np.searchsorted(ids, words.base)
        for r in range(1 << bits):
            lo, hi = cuts[r], cuts[r + 1]
            if hi > lo:
                yield _stat(names, kind, r, ids[lo:hi] - words.base[r], *(x[lo:hi] for x in cols))
        if cuts[-1] < len(ids):  # the beginning is no word
            yield _stat(names, kind + 10, 0, np.zeros(0, np.int64), *(np.array([x[-1]]) for x in cols))

    packed = texts.mapInArrow(count, "shard int, first binary, second binary, counts binary")
    packed = packed.repartition(shards, "shard").sortWithinPartitions("shard")
    stats = cm.written(packed.mapInArrow(save, kinds), "kneser-ney-counts")
    totals, after_start, shards_seen = np.zeros(5, np.int64), np.zeros(3, np.int64), set()
    for r in stats.filter("kind in (0, 11)").select("kind", "range", "a", "b", "c").collect():  # up to two small rows for each shard
        if r["kind"] == 0:
            totals += np.frombuffer(r["a"], np.int64)
            shards_seen.add(r["range"])
        else:
            after_start += [int(np.frombuffer(r[x], np.int64)[0]) for x in "abc"]
    for s in set(range(shards)) - shards_seen:
        save_pairs(store, s, np.zeros(0, _U), np.zeros(0, np.int64))

    def words_after(batches):
        current, out = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                kind, r = batch.column("kind")[i].as_py(), batch.column("range")[i].as_py()
                if r != current:
                    if current is not None:
                        yield _finish(current, out)
                    current, out = r, np.zeros((4, int(words.base[r + 1] - words.base[r])), np.int64)
                ids, a, b, c = (np.frombuffer(batch.column(x)[i].as_py(), np.int64) for x in ("ids", "a", "b", "c"))
                if kind == 1:
                    for k, x in enumerate((a, b, c)):
                        out[k][ids] += x
                else:
                    out[3][ids] += a
        if current is not None:
            yield _finish(current, out)

    def _finish(r, out):
        for name, x in zip(("after1", "after2", "after3", "before"), out):
            store.write(f"word-{name}-{r}", x.astype("<u4"))
        by = [int((out[3] == k).sum()) for k in (1, 2, 3, 4)] + [int((out[3] >= 3).sum())]
        return pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([by], pa.list_(pa.int64()))], names=["range", "n"])

    by_word = stats.filter("kind in (1, 2)").repartition(min(1 << bits, width), "range").sortWithinPartitions("range")
    classes, ranges_seen = np.zeros(5, np.int64), set()
    for r in by_word.mapInArrow(words_after, "range int, n array<long>").collect():  # a row for each range
        classes += r["n"]
        ranges_seen.add(r["range"])
    for r in set(range(1 << bits)) - ranges_seen:
        for name in ("after1", "after2", "after3", "before"):
            store.write(f"word-{name}-{r}", np.zeros(int(words.base[r + 1] - words.base[r]), "<u4"))
    store.spread(spark, [f"pair-{w}-{s}" for w in ("key", "count") for s in range(shards)])
    store.spread(spark, [f"word-{w}-{r}" for w in ("after1", "after2", "after3", "before") for r in range(1 << bits)])
    return Model(
        words, shards, _discounts(totals[:4]), _discounts(classes[:4]), int(after_start.sum() and texts.count()), tuple(after_start), int(totals[4]), (int(classes[0]), int(classes[1]), int(classes[4]))
    )


class Scorer:
    """A worker's mapped model."""

    def __init__(self, model: Model):
        self.m, self.lexicon = model, Lexicon(model.words)
        w = model.words
        self.count = w.mapped("count", np.int64)
        self.stats = {x: w.mapped(x, "<u4") for x in ("after1", "after2", "after3", "before")}
        self.keys, self.counts = zip(*(load_pairs(w.store, s) for s in range(model.shards)))

    def _gather(self, arrays: list[np.ndarray], numbers: np.ndarray) -> np.ndarray:
        """Values of words by rising numbers."""
        out = np.zeros(len(numbers), np.float64)
        cuts = np.searchsorted(numbers, self.m.words.base)
        for r in range(len(cuts) - 1):
            if cuts[r + 1] > cuts[r]:
                own = slice(cuts[r], cuts[r + 1])
                out[own] = arrays[r][numbers[own] - self.m.words.base[r]]
        return out

    def score(self, h: np.ndarray, ends: np.ndarray):
        """log10 p of each token given the one before, and each token's count."""
        m, start = self.m, int(self.m.words.base[-1])
        number = self.lexicon.numbers(h)
        before = _pairs(number, ends, start)
        ids = np.unique(number)
        ids = ids[ids >= 0]
        count = self._gather(self.count, ids)
        value = {x: self._gather(a, ids) for x, a in self.stats.items()}
        at = np.searchsorted(ids, number)
        known = number >= 0
        at = np.where(known, at, 0)
        take = lambda x: np.where(known, x[at], 0.0) if len(ids) else np.zeros(len(number))
        # the lower order: how many different words come before
        e1, e2, e3 = m.lower
        n = take(value["before"])
        discount = np.select([n >= 3, n == 2, n == 1], [e3, e2, e1], 0.0)
        c1, c2, c3 = m.classes
        types = max(1, m.types)
        free = (e1 * c1 + e2 * c2 + e3 * c3) / types if m.types else 1.0
        lower = np.maximum(n - discount, 0) / types + free / (start + 1)
        # the context: how often it occurs and what it is followed by
        d1, d2, d3 = m.discounts
        where = np.searchsorted(ids, before)
        inside = (before >= 0) & (before < start)
        where = np.where(inside, where, 0)
        got = lambda x, s: np.where(inside, x[where] if len(ids) else 0.0, np.where(before == start, float(s), 0.0))
        total = got(count, m.starts)
        weight = d1 * got(value["after1"], m.start_after[0]) + d2 * got(value["after2"], m.start_after[1]) + d3 * got(value["after3"], m.start_after[2])
        seen = np.zeros(len(number))
        ask = known & (before >= 0)
        key = (before[ask].astype(_U) << _U(32)) | number[ask].astype(_U)
        distinct, inverse = np.unique(key, return_inverse=True)
        seen[ask] = self._pair_counts(distinct)[inverse.reshape(-1)]
        off = np.select([seen >= 3, seen == 2, seen == 1], [d3, d2, d1], 0.0)
        p = np.where(total > 0, (np.maximum(seen - off, 0) + weight * lower) / np.maximum(total, 1), lower)
        return np.log10(p), take(count)

    def _pair_counts(self, key: np.ndarray) -> np.ndarray:
        out = np.zeros(len(key))
        shard = _shard(key >> _U(32), key & _U(0xFFFFFFFF), self.m.shards)
        order = np.argsort(shard, kind="stable")  # keys stay sorted within a shard
        cuts = np.searchsorted(shard[order], np.arange(self.m.shards + 1))
        for s in range(self.m.shards):
            own = order[cuts[s] : cuts[s + 1]]
            if len(own) and len(self.keys[s]):
                at = np.minimum(np.searchsorted(self.keys[s], key[own]), len(self.keys[s]) - 1)
                hit = self.keys[s][at] == key[own]
                out[own[hit]] = self.counts[s][at[hit]]
        return out


_SCORERS: dict[str, Scorer] = {}


def held_out(doc_id: Column, folds: int = 5, fold: int = 1) -> Column:
    """Whether a document is kept out of training; a null id isn't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def score_texts(spark: SparkSession, docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens (words and the end), n_known, train_tokens, base_score (add-half unigrams), score (log10
    probability of the whole text under the model), perplexity (10 ** (-score / n_tokens)). Null texts count as empty."""
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        key = model.words.store.folder
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(model)
        scorer = _SCORERS[key]
        total, distinct = model.words.total, int(model.words.base[-1])
        for block in cm.text_blocks(batches, "text", STRETCH):
            h, ends = tokens(block)
            log_p, count = scorer.score(h, ends)
            base = np.log10((count + 0.5) / (total + 0.5 * (distinct + 1)))
            head = ends[:-1]  # every row has a token at least
            size = np.diff(ends)
            sums = [np.add.reduceat(x, head) for x in (log_p, base, (count > 0).astype(np.int64))]
            cols = [pa.array(size), pa.array(sums[2]), pa.array(np.full(len(size), total)), pa.array(sums[1]), pa.array(sums[0]), pa.array(10 ** np.minimum(300, -sums[0] / size))]
            yield pa.RecordBatch.from_arrays([*block.rows.columns, *cols], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def score_documents(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the documents that aren't held out and score all."""
    train = docs.filter(~held_out(F.col(id_col))).select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return score_texts(spark, docs, train_model(spark, train), id_col, text_col)
