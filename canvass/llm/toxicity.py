"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

The model has one weight for each feature and an ordered threshold for each grade above 0:
P(grade > k) = sigmoid(w . x - t_k), so all thresholds share the weights. A document's score is the expected
severity, the sum of these probabilities. Features are the presence of words and of
words' first 4, 5 and 6 bytes anywhere in the whole text, hashed to ``BITS`` bits; only those whose share differs
clearly between graded and clean texts get a weight, so long clean texts don't add up noise.

It is fitted on a bounded sample of labelled rows (``max_rows``, by a hash order, up to half of them above grade 0,
weighted back to their share); scoring is one pass over all documents without a shuffle. The weights
(2**BITS doubles) are all that is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from canvass.llm import common as cm

BITS = 19
#: Bound on the labelled rows used to fit.
MAX_ROWS = 8000
PREFIXES = (4, 5, 6)
#: Standard errors by which a feature's share must differ to get a weight.
CLEAR = 4.0
STEPS = 200
PENALTY = 1e-4
RATE = 0.1
#: A text is toxic from this probability of a grade above 0.
TOXIC = 0.5

_MARK = np.zeros(256, bool)
_MARK[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True


@dataclass
class Model:
    weights: np.ndarray  # one for each feature
    thresholds: np.ndarray  # ascending, one for each grade above 0

    def above(self, margin: np.ndarray) -> np.ndarray:
        """P(grade > k) of each row, for k = 0, 1, .."""
        return _sigmoid(margin[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def features(block: cm.TextBlock, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """All features of each row in order (A-Z as a-z, up to three marks at either end of a word left off; words repeat),
    and the rows' bounds."""
    start, end, bounds = block.word_spans()
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(len(block.bounds), np.int64)
    mark = _MARK[block.data]
    for _ in range(3):
        start = np.where((end - start > 1) & mark[start], start + 1, start)
        end = np.where((end - start > 1) & mark[end - 1], end - 1, end)
    size = end - start
    ends = [end] + [start + n for n in PREFIXES]
    has = np.column_stack([np.ones(len(size), bool)] + [size > n for n in PREFIXES])
    first = np.repeat(start, has.sum(axis=1))
    last = np.column_stack(ends)[has]
    # a prefix and an equal whole word are one feature
    index = (block.span_hashes(first, last) >> np.uint64(64 - bits)).astype(np.int64)
    return index, np.concatenate([[0], np.cumsum(has.sum(axis=1))])[bounds]


def distinct(index: np.ndarray, bounds: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique((cm.owners(bounds).astype(np.int64) << bits) | index)
    return key & ((1 << bits) - 1), np.searchsorted(key >> bits, np.arange(len(bounds)))


def clear_features(index: np.ndarray, row: np.ndarray, high: np.ndarray, bits: int) -> np.ndarray:
    """Whether each feature's share of rows differs by ``CLEAR`` standard errors between ``high`` rows and the others."""
    a, b = max(1, int(high.sum())), max(1, int((~high).sum()))
    x = np.bincount(index[high[row]], minlength=1 << bits)
    y = np.bincount(index[~high[row]], minlength=1 << bits)
    both = (x + y) / (a + b)
    error = np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / a + 1 / b))
    return np.abs(x / a - y / b) >= CLEAR * error


def grades_from_flags(index: np.ndarray, bounds: np.ndarray, flag: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Ordered grades from a 0/1 label: 0, or 1 to 3 by how many of the flagged rows' typical features a flagged row
    holds (terciles of the flagged rows). Typical: clearly more frequent, and at least ten times as frequent."""
    row, high = cm.owners(bounds), flag > 0
    a, b = max(1, int(high.sum())), max(1, int((~high).sum()))
    x = np.bincount(index[high[row]], minlength=1 << bits) / a
    y = np.bincount(index[~high[row]], minlength=1 << bits) / b
    typical = clear_features(index, row, high, bits) & (x > 10 * y)
    hits = np.bincount(row, typical[index], minlength=len(flag))
    cuts = np.quantile(hits[high], [1 / 3, 2 / 3]) if high.any() else [0, 0]
    return np.where(high, 1 + (hits > cuts[0]) + (hits > cuts[1]), 0).astype(np.int64)


def fit(index: np.ndarray, bounds: np.ndarray, grade: np.ndarray, bits: int = BITS, weight: np.ndarray | None = None, steps: int = STEPS) -> Model:
    """Maximum likelihood with an L2 penalty, by Adam on the whole sample. ``index``: distinct features of each row;
    ``weight``: of rows. With grades of one value only, the model gives that grade throughout."""
    n, top = len(grade), max(1, int(grade.max(initial=1)))
    weight = np.ones(n) if weight is None else weight
    weight = weight / weight.sum()
    row = cm.owners(bounds)
    use = clear_features(index, row, grade > 0, bits)
    kept = use[index]
    index, row = index[kept], row[kept]
    used, index = np.unique(index, return_inverse=True)
    share = np.clip((weight[:, None] * (grade[:, None] > np.arange(top)[None, :])).sum(axis=0), 1e-3, 1 - 1e-3)
    w, t = np.zeros(len(used)), np.log((1 - share) / share)
    t = np.maximum.accumulate(t)
    m, v = np.zeros(len(used) + top), np.zeros(len(used) + top)
    every = np.arange(n)
    below, above = grade > 0, grade < top
    for step in range(1, steps + 1):
        margin = np.bincount(row, w[index], minlength=n)
        edge = np.column_stack([np.ones(n), _sigmoid(margin[:, None] - t[None, :]), np.zeros(n)])
        # P(grade = k) = edge[k] - edge[k + 1]; the loss's slopes by the margin and by the thresholds on both sides
        p = np.maximum(edge[every, grade] - edge[every, grade + 1], 1e-9)
        slope = edge * (1 - edge)
        lo, hi = weight * slope[every, grade] / p, weight * slope[every, grade + 1] / p
        by_threshold = np.bincount(grade[below] - 1, lo[below], minlength=top) - np.bincount(grade[above], hi[above], minlength=top)
        gradient = np.concatenate([np.bincount(index, (hi - lo)[row], minlength=len(used)) + PENALTY * w, by_threshold])
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient * gradient
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w = w - move[: len(used)]
        t = np.maximum.accumulate(t - move[len(used) :])
    weights = np.zeros(1 << bits)
    weights[used] = w
    return Model(weights, t)


def train(
    docs: DataFrame, labels: DataFrame, grade: str, flags: bool = False, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, bits: int = BITS
) -> Model | None:
    """Fit on labelled documents. ``grade``: a column of whole numbers from 0, or (``flags``) a 0/1 label that is graded by
    ``grades_from_flags``. Null labels and ids, and ids without a document, take no part; of repeated labels the
    highest counts; of repeated ids one row. None without labelled documents."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(grade).isNotNull())
    best = known.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(grade)).cast("int").alias("grade"))
    count = best.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("grade") > 0).cast("long")).alias("high")).first()
    parts = [best.filter(kind).orderBy(F.xxhash64("id"), "id").limit(max_rows // 2) for kind in (F.col("grade") > 0, F.col("grade") <= 0)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # max_rows rows
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches):
        for block in cm.text_blocks(batches, "text"):
            index, bounds = distinct(*features(block, bits), bits)
            ids, grades = block.rows.column("id").cast(pa.int64()), block.rows.column("grade").cast(pa.int32())
            yield pa.RecordBatch.from_arrays([ids, grades, cm.binaries(index.astype("<i4"), bounds)], names=["id", "grade", "features"])

    found = texts.join(chosen, "id").mapInArrow(run, "id long, grade int, features binary")
    rows = found.groupBy("id").agg(F.min(F.struct("grade", "features")).alias("r")).select("id", "r.*").collect()  # max_rows at most
    if not rows:
        return None
    rows.sort(key=lambda r: r["id"])
    flag = np.array([max(0, r["grade"]) for r in rows], np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(r["features"]) // 4 for r in rows])]).astype(np.int64)
    index = np.frombuffer(b"".join(r["features"] for r in rows), "<i4").astype(np.int64)
    high = flag > 0
    weight = np.where(high, (count["high"] or 0) / max(1, high.sum()), (count["n"] - (count["high"] or 0)) / max(1, (~high).sum()))
    if flags:
        flag = grades_from_flags(index, bounds, flag, bits)
    return fit(index, bounds, flag, bits, np.maximum(weight, 1e-9))


def _above(model: Model | None, block: cm.TextBlock, bits: int) -> np.ndarray:
    """P(grade > k) of each text of a block; 0 without a model or features."""
    if model is None:
        return np.zeros((len(block.bounds) - 1, 1))
    index, bounds = features(block, bits)
    some = model.weights[index] != 0  # few features have a weight
    sub, at = distinct(index[some], np.concatenate([[0], np.cumsum(some)])[bounds], bits)
    total = np.concatenate([[0.0], np.cumsum(model.weights[sub])])
    up = model.above(total[at[1:]] - total[at[:-1]])
    up[np.diff(bounds) == 0] = 0
    return up


def keep_below(spark: SparkSession, docs: DataFrame, model: Model | None, limit: float = TOXIC, text_col: str = "text", bits: int = BITS) -> DataFrame:
    """The rows of ``docs`` whose P(grade > 0) is below ``limit``, all columns as they are. A row goes through the worker once and no column is
    added, so names can't clash and texts aren't sent twice. Null and empty texts stay, and all rows without a model."""
    sent = spark.sparkContext.broadcast(model)
    own = [f"c{i}" for i in range(len(docs.columns))]
    text = own[docs.columns.index(text_col)]
    rows = docs.toDF(*own)

    def run(batches):
        model = sent.value
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                texts = pa.RecordBatch.from_arrays([part.column(text).cast(pa.large_string())], names=["text"])
                below = [_above(model, block, bits)[:, 0] < limit for block in cm.text_blocks(iter([texts]), "text")]
                yield part.filter(pa.array(np.concatenate(below)))

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)


#: Rows that are filtered at a time.
ROWS = 256

ADDED = ("expected_severity", "severity", "p_toxic")


def score(spark: SparkSession, docs: DataFrame, model: Model | None, columns: list[str], text_col: str = "text", bits: int = BITS) -> DataFrame:
    """``columns`` of ``docs`` with ``expected_severity`` (double), ``severity`` (the likeliest grade, int) and ``p_toxic``
    (P(grade > 0), double). Null and empty texts, and all texts without a model, have 0. Columns of ``docs`` may bear the
    same names; then the result has them twice."""
    sent = spark.sparkContext.broadcast(model)
    own = [f"c{i}" for i in range(len(columns))]
    rows = docs.select(*(F.col(f"`{c}`").alias(o) for c, o in zip(columns, own)), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    kinds = [StructField(o, docs.schema[c].dataType) for o, c in zip(own, columns)]
    added = [StructField(n, IntegerType() if n == "severity" else DoubleType()) for n in ADDED]

    def run(batches):
        model = sent.value
        for block in cm.text_blocks(batches, "__text"):
            n = len(block.bounds) - 1
            up = _above(model, block, bits)
            edge = np.column_stack([np.ones(n), up, np.zeros(n)])
            grade = (edge[:, :-1] - edge[:, 1:]).argmax(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*block.rows.columns, pa.array(up.sum(axis=1)), pa.array(grade), pa.array(up[:, 0])], names=[*own, *ADDED])

    return rows.mapInArrow(run, StructType(kinds + added)).toDF(*columns, *ADDED)
