"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs (lines, cut into pieces of at most ``PIECE`` words) are hashed to 64-bit digests; each distinct
digest is added to one cell of each of three sub-tables: a count, the XOR of digests and the
XOR of check values. Subtracting two sketches cancels what both texts hold, and peeling (taking
out cells with a single digest, again and again) recovers the digests that differ. When
peeling gets stuck, the sketches are built again four times larger, until it ends.

All pairs of a block are built and peeled at once, with array operations.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canvass.llm import common as cm

PIECE = 6
TABLES = 3
BASE_BITS = 3  # the fingerprint has TABLES * 2**BASE_BITS cells
STEP_BITS = 2
_TURNS = (np.uint64(0), np.uint64(20), np.uint64(40))
_U = np.uint64


def paragraph_digests(block: cm.TextBlock, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct digests of each row, sorted, and the rows' bounds. Paragraphs end at line feeds; a
    longer one is cut after every ``piece`` words. A row without words has none."""
    start, end, bounds = block.word_spans()
    if not len(start):
        return np.zeros(0, _U), np.zeros(len(block.bounds), np.int64)
    owner = cm.owners(bounds)
    line = np.searchsorted(np.flatnonzero(block.data == 10), start)
    fresh = np.ones(len(start), bool)
    fresh[1:] = (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(fresh)
    place = np.arange(len(start)) - np.repeat(first, np.diff(np.append(first, len(start))))
    head = np.flatnonzero(place % piece == 0)
    tail = np.append(head[1:], len(start)) - 1
    digest = cm.span_hash(cm.prefix_hash(block.data), start[head], end[tail])
    row = owner[head]
    order = np.lexsort((digest, row))
    digest, row = digest[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (digest[1:] != digest[:-1])
    digest, row = digest[new], row[new]
    return digest, np.searchsorted(row, np.arange(len(bounds)))


def _check(digest: np.ndarray) -> np.ndarray:
    return cm.mix64(digest ^ _U(0xA5A5A5A55A5A5A5A))


def _cells(row: np.ndarray, digest: np.ndarray, bits: int) -> np.ndarray:
    """(TABLES, n) cell numbers in tables that stand on end, one of TABLES << bits cells for each row."""
    spread = cm.mix64(digest + _U(0x51ED270B))
    mask = _U((1 << bits) - 1)
    base = row.astype(np.int64) * (TABLES << bits)
    # beyond 2**20 cells a sub-table's bits overlap the next one's, which only makes retries likelier
    return np.stack([base + (k << bits) + ((spread >> t) & mask).astype(np.int64) for k, t in enumerate(_TURNS)])


class Sketch:
    """Sketches of ``rows`` sets on end."""

    def __init__(self, rows: int, bits: int):
        self.rows, self.bits = rows, bits
        n = rows * (TABLES << bits)
        self.count, self.keys, self.checks = np.zeros(n, np.int64), np.zeros(n, _U), np.zeros(n, _U)

    def add(self, row: np.ndarray, digest: np.ndarray, sign) -> None:
        cells, check = _cells(row, digest, self.bits), _check(digest)
        for at in cells:
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.keys, at, digest)
            np.bitwise_xor.at(self.checks, at, check)

    def minus(self, other: Sketch) -> Sketch:
        out = Sketch(0, self.bits)
        out.rows = self.rows
        out.count, out.keys, out.checks = self.count - other.count, self.keys ^ other.keys, self.checks ^ other.checks
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, digest, sign) of all digests recovered, and whether each row came out empty."""
        width = TABLES << self.bits
        rows, digests, signs = [], [], []
        while True:
            pure = np.flatnonzero((np.abs(self.count) == 1) & (self.checks == _check(self.keys)))
            if not len(pure):
                break
            row, digest, sign = pure // width, self.keys[pure], self.count[pure]
            order = np.lexsort((digest, row))  # one digest may be alone in several cells
            row, digest, sign = row[order], digest[order], sign[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (digest[1:] != digest[:-1])
            row, digest, sign = row[new], digest[new], sign[new]
            self.add(row, digest, -sign)
            rows.append(row)
            digests.append(digest)
            signs.append(sign)
        left = ((self.count != 0) | (self.keys != 0)).reshape(self.rows, width).any(axis=1)
        if not rows:
            none = np.zeros(0, np.int64)
            return none, none.view(_U), none, ~left
        return np.concatenate(rows), np.concatenate(digests), np.concatenate(signs), ~left

    def text(self, row: int) -> str:
        """One sketch as text: counts, digests and checks, little-endian, in base 64."""
        width = TABLES << self.bits
        own = slice(row * width, (row + 1) * width)
        raw = self.count[own].astype("<i4").tobytes() + self.keys[own].astype("<u8").tobytes() + (self.checks[own] >> _U(32)).astype("<u4").tobytes()
        return base64.b64encode(raw).decode()


def _some(digest: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The digests of the given rows, and each one's position among those rows."""
    size = bounds[rows + 1] - bounds[rows]
    ends = np.cumsum(size)
    index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(bounds[rows] - (ends - size), size)
    return digest[index], np.repeat(np.arange(len(rows)), size)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], base: tuple[Sketch, Sketch], ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    """Shared part of all distinct paragraphs of the pairs (row ia[i] of ``a``, row ib[i] of ``b``): from the
    differing digests that subtracting and peeling recover. 1 for two texts without words."""
    na, nb = a[1][ia + 1] - a[1][ia], b[1][ib + 1] - b[1][ib]
    out = np.ones(len(ia))
    pairs, bits = np.arange(len(ia)), BASE_BITS
    while len(pairs):
        sketches = []
        for (digest, bounds), rows, ready in ((a, ia[pairs], base[0]), (b, ib[pairs], base[1])):
            if bits == BASE_BITS:
                s = Sketch(0, bits)
                s.rows = len(pairs)
                own = (rows[:, None] * (TABLES << bits) + np.arange(TABLES << bits)).ravel()
                s.count, s.keys, s.checks = ready.count[own], ready.keys[own], ready.checks[own]
            else:
                s = Sketch(len(pairs), bits)
                d, row = _some(digest, bounds, rows)
                s.add(row, d, 1)
            sketches.append(s)
        row, _, sign, done = sketches[0].minus(sketches[1]).peel()
        only_a = np.bincount(row[sign > 0], minlength=len(pairs))
        only_b = np.bincount(row[sign < 0], minlength=len(pairs))
        every = nb[pairs] + only_a
        found = np.where(every > 0, (na[pairs] - only_a) / np.maximum(every, 1), 1.0)
        out[pairs[done]] = found[done]
        pairs, bits = pairs[~done], bits + STEP_BITS
    return out


# ---- over all documents ----------------------------------------------------------


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many of the start of another text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _block(texts: list[bytes]) -> cm.TextBlock:
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return cm.TextBlock(pa.RecordBatch.from_arrays([], names=[]), np.frombuffer(b"".join(texts), np.uint8), bounds)


def _compare(docs: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """``docs``: (id, text, whether it is asked for) in order; each asked one but the last has its next behind it."""
    raw = [t for _, t, _ in docs]
    plain = [t.decode("utf-8", "replace") for t in raw]
    asked = np.array([i for i in range(len(docs) - 1) if docs[i][2]], np.int64)
    changed = [edited(plain[i], plain[i + 1]).encode() for i in asked]
    mine, new = paragraph_digests(_block(raw)), paragraph_digests(_block(changed))
    sketch = []
    for digest, bounds in (mine, new):
        s = Sketch(len(bounds) - 1, BASE_BITS)
        s.add(cm.owners(bounds), digest, 1)
        sketch.append(s)
    every = np.arange(len(asked))
    near_edited = likeness(mine, new, (sketch[0], sketch[1]), asked, every)
    near_next = likeness(mine, mine, (sketch[0], sketch[0]), asked, asked + 1)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([docs[i][0] for i in asked], pa.int64()),
            pa.array([len(plain[i]) for i in asked], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in changed]),
            pa.array([sketch[0].text(i) for i in asked]),
            pa.array([sketch[1].text(i) for i in every]),
            pa.array(near_edited),
            pa.array(near_next),
        ],
        schema=schema,
    )


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_edits(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Fingerprint every text and its edited text, and compare them and the next document's.

    The next document is by ascending id, null ids last, equal ids by a hash of the text (repeated equal rows follow
    each other); the first follows the last, and a single document follows itself. Null texts count as
    empty. An empty table gives no rows.

    The ids are cut into ranges by quantiles. Each range is sorted and read on end by one task; the
    first document of a range goes along to the range before it, so no task needs another's."""
    from pyspark.ml.feature import Bucketizer

    ranges = ranges or 4 * cm.shuffle_width(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    cuts = sorted(set(rows.select("id").approxQuantile("id", [i / ranges for i in range(1, ranges)], 0.5 / ranges))) if ranges > 1 else []
    last = len(cuts) + 1.0  # for null ids
    known = F.col("id").cast("double")
    if cuts:
        cut = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="known", outputCol="bucket", handleInvalid="keep")
        rows = cut.transform(rows.withColumn("known", F.coalesce(known, F.lit(0.0)))).drop("known")
    else:
        rows = rows.withColumn("bucket", F.lit(0.0))
    place = F.when(F.col("id").isNull(), F.lit(last)).otherwise(F.col("bucket")).cast("int")
    rows = rows.withColumn("range", place).withColumn("h", F.xxhash64("text")).drop("bucket")
    # the first document of each range (a row for each range), and the range before it: the last one's for the first
    order = F.struct(F.col("id").isNull().alias("nil"), F.col("id").alias("id"), F.col("h").alias("h"))
    all_ranges = Window.orderBy("range")
    firsts = cm.written(
        rows.groupBy("range")
        .agg(F.min(order).alias("first"))
        .withColumn("before", F.coalesce(F.lag("range").over(all_ranges), F.max("range").over(all_ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))),
        "fingerprint-ranges",
    )
    # it also goes behind the end of the range before; repeated equal rows give several, of which one is used
    rows = rows.join(F.broadcast(firsts), "range")
    copy = lambda r, ghost: F.struct(r.alias("range"), F.lit(ghost).alias("ghost"))
    own = copy(F.col("range"), 0)
    is_first = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("h") == F.col("first.h"))
    to = F.when(is_first, F.array(own, copy(F.col("before"), 1))).otherwise(F.array(own))
    rows = rows.select("id", "text", "h", F.explode(to).alias("to"))
    rows = rows.select("to.range", "to.ghost", F.col("id").isNull().alias("nil"), "id", "h", "text")
    dealt = rows.repartition(max(1, min(ranges, cm.shuffle_width(spark))), "range").sortWithinPartitions("range", "ghost", "nil", "id", "h", "text")
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    )

    def run(batches):
        held, at, ended = [], None, False
        size = 0
        for batch in batches:
            ids, where, ghost = batch.column("id").to_pylist(), batch.column("range").to_pylist(), batch.column("ghost").to_pylist()
            texts = batch.column("text").cast(pa.large_binary())
            for i in range(batch.num_rows):
                if where[i] != at:
                    if len(held) > 1:
                        yield _compare(held, schema)
                    held, size, at, ended = [], 0, where[i], False
                if ended:
                    continue
                ended = bool(ghost[i])
                text = texts[i].as_py()
                held.append((ids[i], text, not ghost[i]))
                size += len(text)
                if size > cm.BLOCK_BYTES and len(held) > 1:
                    yield _compare(held, schema)
                    held, size = held[-1:], len(held[-1][1])
        if len(held) > 1:
            yield _compare(held, schema)

    return dealt.mapInArrow(run, OUT)
