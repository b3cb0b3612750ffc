"""Boosted trees by distributed histograms, with ordered target statistics for categories.

Features are coded once to at most 255 bins (a missing number is the lowest) and kept in blocks of rows. A tree grows level by level: one
pass sums gradients, hessians and rows by node, feature and bin, only for the smaller child of each split; the larger one's sums are its
parent's less those. The sums are added up and searched in the cluster, by groups of features, and stay there for the next level; the driver
gets each group's best split of each node. Nodes of few rows (``LOCAL_CELLS``) are gathered by node and finished where they lie, all their
levels in one pass. Tables of so few rows are one block, and a task grows ``REFRESH`` trees on it at a time. Gradients are whole numbers of
2**-30, so all sums are exact, and the trees don't depend on how rows are dealt to blocks, on the order of sums or on which nodes are finished locally.

A category's number is the rate of the label among the rows of its level that come before the row in a seeded order, so no row
carries its own label; prefix sums go by buckets of that order, so a frequent level isn't one task. New rows take the rate of all training
rows of the level.

Margins are kept with the blocks from tree to tree and checkpointed every ``REFRESH`` trees, so a lost executor costs little.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canvass import fixed
from canvass.operators import evaluate as ev
from canvass.session import checkpoint_root, scratch_path

CUTS = 253
BLOCK_ROWS = 1 << 16
#: Rows times features that one task holds, at a byte each; beside them its rows take some 50 bytes each.
LOCAL_CELLS = 1 << 25
REFRESH = 25
#: Rows that are summed at a time, and places of features counted as one.
SUM_ROWS, JOINT = 1 << 16, 512
#: Groups of features whose sums are added up and searched apart.
GROUPS = 8
UNIT = float(1 << 30)
#: Added to the sum of hessians of a leaf.
L2 = 3.0
#: Weight of the overall rate in a level's rate, in rows.
SMOOTHING = 20.0
ORDER_BITS, BUCKET_BITS = 40, 12


@dataclass(frozen=True)
class Columns:
    """Column roles: numbers, categories and 0/1 columns."""

    numeric: Sequence[str]
    categorical: Sequence[str]
    flags: Sequence[str]
    label: str = "target"


@dataclass
class Tree:
    """Nodes of a full binary tree, children of i at 2i + 1 and 2i + 2. ``feature`` is -1 at leaves; rows of a bin up to ``cut`` go left."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        n = (2 << depth) - 1
        return Tree(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n))

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            right = bins[rows, np.maximum(f, 0)] > self.cut[at]
            at = np.where(inner, 2 * at + 1 + right, at)

    def values(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.nodes(bins)]


@dataclass
class Grower:
    """What a split needs to know, the same on the driver and in tasks."""

    offsets: np.ndarray  # first place of each feature's bins among all bins, and the end
    depth: int
    rate: float
    l2: float

    def gradients(self, label: np.ndarray, margin: np.ndarray) -> np.ndarray:
        """Gradient and hessian of each row, in whole units."""
        p = 1.0 / (1.0 + np.exp(-margin))
        g = np.rint((p - label) * UNIT).astype(np.int64)
        h = np.maximum(np.rint(p * (1.0 - p) * UNIT), 1.0).astype(np.int64)
        return np.stack([g, h])

    def joints(self) -> list[list[int]]:
        """The features, those of few bins put together: what is counted by all their bins at once gives the sums of each."""
        size = np.diff(self.offsets)
        out, few, places = [], [], 1
        for f in range(len(size)):
            if size[f] ** 2 > JOINT:
                out.append([f])
                continue
            if few and places * size[f] > JOINT:
                out.append(few)
                few, places = [], 1
            few, places = [*few, f], places * int(size[f])
        return out + [few] if few else out

    def codes(self, bins: np.ndarray) -> list[np.ndarray]:
        """Per joint of features each row's place among their bins."""
        size = np.diff(self.offsets)
        out = []
        for joint in self.joints():
            code = bins[:, joint[0]].astype(np.int16)
            for f in joint[1:]:
                code = code * np.int16(size[f]) + bins[:, f]
            out.append(code)
        return out

    def sums(self, codes: list[np.ndarray], grads: np.ndarray, slot: np.ndarray | None, slots: int) -> np.ndarray:
        """[slot, bin, 3]: sums of the rows of each slot (-1: none; no ``slot``: all in one) by feature and bin."""
        size = np.diff(self.offsets)
        row = None if slot is None else np.flatnonzero(slot >= 0)
        n = grads.shape[1] if row is None else len(row)
        joints = self.joints()
        shapes = [[int(size[f]) for f in joint] for joint in joints]
        held = [np.zeros((3, slots * int(np.prod(shape))), np.int64) for shape in shapes]
        for lo in range(0, n, SUM_ROWS):
            part = slice(lo, lo + SUM_ROWS) if row is None else row[lo : lo + SUM_ROWS]
            g, h = (grads[c, part].astype(np.float64) for c in range(2))
            own = None if row is None else slot[part]
            for code, total in zip(codes, held):
                many = total.shape[1]
                key = code[part].astype(np.int64) if own is None else own * (many // slots) + code[part]
                for c, weight in enumerate((g, h)):  # exact: below 2**53
                    total[c] += np.bincount(key, weight, many).astype(np.int64)
                total[2] += np.bincount(key, minlength=many)
        out = np.zeros((slots, int(self.offsets[-1]), 3), np.int64)
        for joint, shape, total in zip(joints, shapes, held):
            cells = total.reshape(3, slots, *shape)
            for i, f in enumerate(joint):
                of = cells.sum(axis=tuple(2 + k for k in range(len(joint)) if k != i)) if len(joint) > 1 else cells
                out[:, self.offsets[f] : self.offsets[f + 1]] = of.transpose(1, 2, 0)
        return out

    def leaf(self, total: np.ndarray) -> float:
        return -self.rate * (float(total[0]) / UNIT) / (float(total[1]) / UNIT + self.l2)

    def groups(self) -> list[int]:
        """Bounds of groups of features of about as many bins each."""
        width = len(self.offsets) - 1
        marks = np.searchsorted(self.offsets, np.linspace(0, self.offsets[-1], min(GROUPS, width) + 1))
        return sorted({0, *marks.tolist(), width})

    def total(self, hist: np.ndarray, first: int = 0) -> np.ndarray:
        """Sums of all rows, from those of the features ``first``, .."""
        return hist[: self.offsets[first + 1] - self.offsets[first]].sum(axis=0)

    def best(self, hist: np.ndarray, first: int = 0, end: int | None = None) -> tuple[float, int, int, np.ndarray] | None:
        """The split of most gain (ties: first feature, lowest cut) by the features from ``first`` to before ``end``, whose sums ``hist`` holds:
        gain, feature, cut, sums left. None if nothing is gained."""
        offsets = self.offsets[first : None if end is None else end + 1] - self.offsets[first]
        total = self.total(hist, first)
        run = np.cumsum(hist, axis=0)
        before = np.zeros_like(run)
        starts = np.repeat(offsets[:-1], np.diff(offsets))
        before[starts > 0] = run[starts[starts > 0] - 1]
        left = run - before
        right = total[None, :] - left
        score = lambda s: (s[..., 0] / UNIT) ** 2 / (s[..., 1] / UNIT + self.l2)
        gain = np.where((left[:, 2] > 0) & (right[:, 2] > 0), score(left) + score(right) - score(total), 0.0)
        at = int(gain.argmax())
        if gain[at] <= 1e-9:
            return None
        feature = int(np.searchsorted(offsets, at, "right") - 1)
        return float(gain[at]), first + feature, at - int(offsets[feature]), left[at]

    def place(self, tree: Tree, node: int, total: np.ndarray, found: tuple | None) -> list[tuple[int, np.ndarray]]:
        """Make ``node`` a leaf, or split it as ``best`` found and return its children with their sums."""
        if found is None:
            tree.value[node] = self.leaf(total)
            return []
        _, tree.feature[node], tree.cut[node], left = found
        return [(2 * node + 1, left), (2 * node + 2, total - left)]

    def finish(self, bins: np.ndarray, codes: list[np.ndarray], grads: np.ndarray, node: int) -> tuple[Tree, list[int], np.ndarray]:
        """The whole subtree of ``node`` from its rows: a tree that holds it, its nodes and each row's leaf."""
        tree = Tree.empty(self.depth)
        level = (node + 1).bit_length() - 1
        at = np.full(len(bins), node)
        open_, hists, made = [node], {node: self.sums(codes, grads, None, 1)[0]}, [node]
        while open_:
            pairs = [c for n in open_ if (c := self.place(tree, n, self.total(hists[n]), None if level == self.depth else self.best(hists[n])))]
            if not pairs:
                break
            feature = tree.feature[at]
            row = np.flatnonzero(feature >= 0)
            here = at[row]
            at[row] = 2 * here + 1 + (bins[row, feature[row]] > tree.cut[here])
            level += 1
            if level < self.depth:
                hists = children(pairs, hists, lambda small: self.sums(codes, grads, slots_of(at, small), len(small)))
            else:  # leaves need their own sums only: any one feature's bins hold them
                hists = {n: self._whole(total) for pair in pairs for n, total in pair}
            open_ = [n for pair in pairs for n, _ in pair]
            made += open_
        return tree, made, at

    def several(self, block: tuple[np.ndarray, np.ndarray, np.ndarray], trees: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[Tree]]:
        """The next trees of a table that is one block, and the block with its margins after them."""
        bins, label, margin = block
        codes, grown = self.codes(bins), []
        for _ in range(trees):
            tree, _, at = self.finish(bins, codes, self.gradients(label, margin), 0)
            margin = margin + tree.value[at]
            grown.append(tree)
        return bins, label, margin, grown

    def _whole(self, total: np.ndarray) -> np.ndarray:
        hist = np.zeros((int(self.offsets[-1]), 3), np.int64)
        hist[0] = total
        return hist


def slots_of(at: np.ndarray, nodes: Sequence[int]) -> np.ndarray:
    out = np.full(int(max(at.max(initial=0), max(nodes, default=0))) + 1, -1, np.int64)
    out[list(nodes)] = np.arange(len(nodes))
    return out[at]


def smaller_first(pair: list[tuple[int, np.ndarray]]) -> tuple[int, int]:
    a, b = sorted(pair, key=lambda c: (c[1][2], c[0]))
    return a[0], b[0]


def with_others(counted, pairs: list[tuple[int, int]], hists: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Sums of all children: those counted for the smaller of each pair, the parent's less those for the larger."""
    out = {}
    for own, (n, other) in zip(counted, pairs):
        out[n] = own
        out[other] = hists[(n - 1) // 2] - own
    return out


def children(pairs, hists, count) -> dict[int, np.ndarray]:
    if not pairs:
        return {}
    ordered = [smaller_first(pair) for pair in pairs]
    return with_others(count([n for n, _ in ordered]), ordered, hists)


def grow(state: RDD, blocks: int, grower: Grower, local_rows: int) -> Tree:
    """One tree from the blocks (bins, label, margin)."""
    tree = Tree.empty(grower.depth)
    groups = grower.groups()
    dealt = len(groups) - 1

    def current(block):
        bins, label, margin = block
        return bins, grower.gradients(label, margin)

    def level_sums(pairs: list[tuple[int, int]], parents: RDD | None) -> RDD:
        """(group of features, node -> its sums by bin) of the root, or of all ``pairs`` of nodes, smaller ones first; their parents' are held."""
        nodes = [n for n, _ in pairs]

        def run(block):
            bins, grads = current(block)
            slot = slots_of(tree.nodes(bins), nodes) if nodes else None
            hists = grower.sums(grower.codes(bins), grads, slot, max(1, len(nodes)))
            for g in range(dealt):
                yield g, hists[:, grower.offsets[groups[g]] : grower.offsets[groups[g + 1]]]

        counted = state.flatMap(run).reduceByKey(np.add, dealt)
        if parents:
            held = counted.join(parents, dealt).mapValues(lambda x: with_others(x[0], pairs, x[1]))
        else:
            held = counted.mapValues(lambda x: {0: x[0]})
        return held.persist(StorageLevel.MEMORY_AND_DISK)

    def search(held: RDD, nodes: list[int]) -> dict[int, tuple]:
        """The sums and the best split of each node. A group of features sends a few numbers for each."""

        def run(item):
            g, hists = item
            gain, rest = np.zeros(len(nodes)), np.zeros((len(nodes), 8), np.int64)
            for i, n in enumerate(nodes):
                rest[i, 5:] = grower.total(hists[n], groups[g])
                if found := grower.best(hists[n], groups[g], groups[g + 1]):
                    gain[i], rest[i, 0], rest[i, 1], rest[i, 2:5] = found
            return g, gain, rest

        sent = sorted(held.map(run).collect(), key=lambda x: x[0])
        out = {}
        for i, n in enumerate(nodes):
            gain, rest = max(((gain[i], rest[i]) for _, gain, rest in sent), key=lambda x: x[0])  # ties: the first group
            out[n] = rest[5:], (float(gain), int(rest[0]), int(rest[1]), rest[2:5]) if gain > 0 else None
        return out

    def finish(nodes: list[int]) -> None:
        def rows_of(block):
            bins, grads = current(block)
            slot = slots_of(tree.nodes(bins), nodes)
            for i, n in enumerate(nodes):
                own = np.flatnonzero(slot == i)
                if len(own):  # gradients and hessians are at most 2**30
                    yield n, (bins[own], grads[:, own].astype(np.int32))

        def build(item):
            n, parts = item
            parts = list(parts)
            bins = np.concatenate([b for b, _ in parts])
            tree, made, _ = grower.finish(bins, grower.codes(bins), np.concatenate([g for _, g in parts], axis=1), n)
            return [(n, int(tree.feature[n]), int(tree.cut[n]), float(tree.value[n])) for n in made]

        found = state.flatMap(rows_of)
        # rows of one block lie together already
        gathered = found.mapValues(lambda x: [x]) if blocks == 1 else found.groupByKey(min(blocks, len(nodes)))
        for n, feature, cut, value in gathered.flatMap(build).collect():
            tree.feature[n], tree.cut[n], tree.value[n] = feature, cut, value

    small: list[int] = []
    open_, pairs, held = [(0, None)], [], None
    for level in range(grower.depth + 1):
        if level and level == grower.depth:  # leaves need their own sums only
            for n, total in open_:
                grower.place(tree, n, total, None)
            break
        before, held = held, level_sums(pairs, held)
        found = search(held, [n for n, _ in open_])
        if before:
            before.unpersist()
        split = [c for n, _ in open_ if (c := grower.place(tree, n, found[n][0], found[n][1] if level < grower.depth else None))]
        # few rows: a whole subtree later, in one pass for all such nodes
        small += [n for pair in split for n, total in pair if total[2] <= local_rows and level + 1 < grower.depth]
        pairs = [smaller_first(pair) for pair in split if any(n not in small for n, _ in pair)]
        open_ = [c for pair in split for c in pair if c[0] not in small]
        if not open_:
            break
    held.unpersist()
    if small:
        finish(small)
    return tree


# ---- categories and bins ----------------------------------------------------


def _level(c: str):
    return F.coalesce(F.col(_quoted(c)).cast("string"), F.lit(fixed.TREE_MISSING_LEVEL))


def _quoted(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def ordered_statistics(train: DataFrame, row_col: str, label: str, categorical: Sequence[str], prior: float, seed: int = fixed.SEED, smoothing: float = SMOOTHING) -> DataFrame:
    """``row_col`` and ``t0``, ``t1``, ..: per category column the smoothed rate of the label among the rows of the same level that
    come before the row in the order of a seeded hash (ties by ``row_col``)."""
    order = F.pmod(F.xxhash64(F.lit(seed), F.col(row_col)), F.lit(1 << ORDER_BITS))
    levels = F.array(*[F.struct(F.lit(i).alias("c"), _level(c).alias("level")) for i, c in enumerate(categorical)])
    long = train.select(row_col, F.col(_quoted(label)).cast("double").alias("y"), order.alias("o"), F.explode(levels).alias("x")).select(row_col, "y", "o", "x.c", "x.level")
    long = long.withColumn("bucket", F.shiftright("o", ORDER_BITS - BUCKET_BITS))
    earlier = Window.partitionBy("c", "level").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = long.groupBy("c", "level", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"))
    sums = sums.select("c", "level", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("s").over(earlier), F.lit(0.0)).alias("s0"))
    within = Window.partitionBy("c", "level", "bucket").orderBy("o", row_col).rowsBetween(Window.unboundedPreceding, -1)
    placed = long.withColumn("n1", F.count(F.lit(1)).over(within)).withColumn("s1", F.coalesce(F.sum("y").over(within), F.lit(0.0))).join(sums, ["c", "level", "bucket"])
    rate = (F.col("s0") + F.col("s1") + smoothing * prior) / (F.col("n0") + F.col("n1") + smoothing)
    return placed.groupBy(row_col).agg(*(F.max(F.when(F.col("c") == i, rate)).alias(f"t{i}") for i in range(len(categorical))))


@dataclass
class Model:
    """Fitted trees with all that new rows need. ``rates``: per category column a written table (level, rate)."""

    columns: Columns
    prior: float
    rates: list[DataFrame]
    cuts: list[np.ndarray]
    trees: list[Tree] = field(default_factory=list)

    def coded(self, df: DataFrame) -> DataFrame:
        """``df`` with the rates of its levels as ``t0``, .. (the overall rate for unseen ones)."""
        for i, (c, rates) in enumerate(zip(self.columns.categorical, self.rates)):
            named = rates.select(F.col("level").alias(f"__l{i}"), F.col("rate").alias(f"__r{i}"))
            df = df.withColumn(f"__k{i}", _level(c)).join(named, F.col(f"__k{i}") == F.col(f"__l{i}"), "left")
            df = df.withColumn(f"t{i}", F.coalesce(f"__r{i}", F.lit(self.prior))).drop(f"__k{i}", f"__l{i}", f"__r{i}")
        return df

    def score(self, df: DataFrame, id_col: str) -> DataFrame:
        """``(id, label, probability of class 1, prediction at >= 0.5)``."""
        kind, label = df.schema[id_col].dataType.simpleString(), self.columns.label
        sent = df.sparkSession.sparkContext.broadcast((self.trees, self.cuts))
        rows = self.coded(df).select(F.col(_quoted(id_col)).alias("id"), F.col(_quoted(label)).cast("int").alias("y"), F.array(*_features(self.columns)).alias("x"))

        def run(batches: Iterator[pa.RecordBatch]):
            trees, cuts = sent.value
            for b in batches:
                bins = _bins(b.column(2), cuts)
                margin = np.zeros(len(bins))
                for t in trees:
                    margin += t.values(bins)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(1.0 / (1.0 + np.exp(-margin)))], names=["id", "y", "probability"])

        out = rows.mapInArrow(run, f"id {kind}, y int, probability double")
        return out.select(F.col("id").alias(id_col), F.col("y").alias(label), "probability").withColumn("prediction", ev.predict_at(F.col("probability")))


def _features(columns: Columns) -> list:
    numbers = [F.nanvl(F.col(_quoted(c)).cast("double"), F.lit(None).cast("double")) for c in columns.numeric]
    return numbers + [F.col(f"t{i}") for i in range(len(columns.categorical))] + [F.col(_quoted(c)).cast("double") for c in columns.flags]


def _bins(values: pa.Array, cuts: list[np.ndarray]) -> np.ndarray:
    """Bins of rows of features: 0 for missing, else 1 and how many cuts lie below the value."""
    x = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), len(cuts))
    out = np.zeros(x.shape, np.uint8)
    for f, c in enumerate(cuts):
        out[:, f] = np.where(np.isnan(x[:, f]), 0, 1 + np.searchsorted(c, x[:, f]))
    return out


def _cut_points(coded: DataFrame, columns: Columns) -> list[np.ndarray]:
    """At most ``CUTS`` cuts of each number or rate, by one aggregate; 0/1 columns are cut at 0."""
    used = _features(columns)[: len(columns.numeric) + len(columns.categorical)]
    shares = [(i + 1) / (CUTS + 1) for i in range(CUTS)]
    found = coded.agg(*(F.percentile_approx(x, shares, 10_000).alias(f"c{i}") for i, x in enumerate(used))).first() if used else []
    return [np.unique(np.array(c or [], np.float64)) for c in found] + [np.zeros(1) for _ in columns.flags]


def fit(
    train: DataFrame, columns: Columns, trees: int = fixed.TREES, rate: float = fixed.LEARNING_RATE, depth: int = fixed.DEPTH, seed: int = fixed.SEED, l2: float = L2,
    block_rows: int = BLOCK_ROWS, local_rows: int | None = None,
) -> Model:
    """Fit ``trees`` trees of ``depth`` to the 0/1 label (rows without one take no part). An empty table gives a model that says 1/2."""
    spark = train.sparkSession
    checkpoint_root(spark)
    path = scratch_path(spark, "boosting-rows")
    train.filter(F.col(_quoted(columns.label)).isNotNull()).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("__row", F.monotonically_increasing_id())
    y = F.col(_quoted(columns.label)).cast("double")
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("rate")).first()
    n, prior = whole["n"], whole["rate"] if whole["rate"] is not None else 0.5
    if not n:
        return Model(columns, prior, [spark.createDataFrame([], "level string, rate double")] * len(columns.categorical), [np.zeros(0)] * len(_features(columns)))
    rates = [
        rows.groupBy(_level(c).alias("level")).agg(((F.sum(y) + SMOOTHING * prior) / (F.count(F.lit(1)) + SMOOTHING)).alias("rate")).checkpoint() for c in columns.categorical
    ]
    coded = rows.join(ordered_statistics(rows, "__row", columns.label, columns.categorical, prior, seed), "__row") if columns.categorical else rows
    coded = coded.select("__row", y.alias("__y"), F.array(*_features(columns)).alias("__x"), *(f"t{i}" for i in range(len(columns.categorical))), *map(_quoted, columns.numeric)).checkpoint()
    cuts = _cut_points(coded, Columns(columns.numeric, columns.categorical, (), "__y")) + [np.zeros(1) for _ in columns.flags]
    model = Model(columns, prior, rates, cuts)

    def pack(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            bins, labels = _bins(b.column(1), cuts), b.column(0).to_numpy(zero_copy_only=False)
            for lo in range(0, len(bins), block_rows):
                part = np.ascontiguousarray(bins[lo : lo + block_rows])
                yield pa.RecordBatch.from_arrays([pa.array([part.tobytes()], pa.binary()), pa.array([labels[lo : lo + block_rows].astype("<f8").tobytes()], pa.binary())], names=["bins", "label"])

    width = len(cuts)
    local_rows = LOCAL_CELLS // width if local_rows is None else local_rows
    one = n <= local_rows
    values = coded.select("__y", "__x")
    packed = (values if one else values.repartition(-(-n // block_rows))).mapInArrow(pack, "bins binary, label binary")

    def block(r):
        label = np.frombuffer(r["label"], "<f8")
        return np.frombuffer(r["bins"], np.uint8).reshape(-1, width), label, np.zeros(len(label))

    def join(rows_):  # batches of a partition become its block
        got = list(rows_)
        if got:
            yield tuple(np.concatenate(x) for x in zip(*got))

    def kept(rdd: RDD) -> RDD:
        rdd.persist(StorageLevel.MEMORY_AND_DISK)
        rdd.checkpoint()
        return rdd

    offsets = np.concatenate([[0], np.cumsum([len(c) + 2 for c in cuts])])
    grower = Grower(offsets, depth, rate, l2)
    if one:
        state = packed.repartition(1).rdd.map(block).mapPartitions(join)
        for done in range(0, trees, REFRESH):
            many = min(REFRESH, trees - done)
            grown = kept(state.map(lambda b, many=many: grower.several(b[:3], many)))
            model.trees += grown.flatMap(lambda b: b[3]).collect()
            state.unpersist()
            state = grown
        state.unpersist()
        return model

    def renewed(tree: Tree):
        return lambda b: (b[0], b[1], b[2] + tree.values(b[0]))

    state = kept(packed.rdd.map(block).mapPartitions(join))
    blocks, older = state.count(), None
    for _ in range(trees):
        if model.trees:
            older, state = state, state.map(renewed(model.trees[-1]))
            state = kept(state) if len(model.trees) % REFRESH == 0 else state.persist(StorageLevel.MEMORY_AND_DISK)
        model.trees.append(grow(state, blocks, grower, local_rows))
        if older:
            older.unpersist()
    state.unpersist()
    return model
