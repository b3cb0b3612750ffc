"""Best-fit decreasing packing of tokenized documents, window by window.

1. Every text is tokenized once, in the scan. A document longer than a window is first cut into full windows and a rest; only
   (document, start, length, checksum, document's tokens) are written.
2. A full window needs no search: it is a sequence of its own.
3. Rests are dealt in turn over groups of about ``GROUP`` rows, however equal their ids or lengths are, so that a group is bounded and there are
   more groups for more documents. A task packs a group by decreasing length. A segment tree over the capacities that are left (a leaf holds
   the open windows of that capacity, an inner node whether there are any below) finds the tightest window that takes a rest
   in two walks of its height.
4. What a group's windows leave free in sum can be less than they need: as long as it is a whole window, the emptiest window is
   given up, and its rests are cut to fill the gaps of the fullest ones. So a group pads less than one window in all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from canvass.llm import common as cm
from canvass.llm.byte_tokens import byte_encoder

MOST = 2048
END = 1
#: Rests of a group, on average.
GROUP = 1 << 16
_LONGS = ("start", "length", "ids_crc32", "doc_tokens")


class Capacities:
    """A segment tree over remaining capacities 0 .. ``most``."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.any = [False] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(most + 1)]

    def _mark(self, capacity: int, value: bool) -> None:
        i = capacity + self.leaves
        while i and self.any[i] != value:
            self.any[i] = value
            i >>= 1
            if i:
                value = self.any[2 * i] or self.any[2 * i + 1]

    def put(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        self._mark(capacity, True)

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Take out a window with the least capacity of at least ``length``: (capacity, window)."""
        i = length + self.leaves
        while not self.any[i]:
            while i & 1:  # a right child: nothing more to its right below the parent
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.leaves:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        window = self.open[capacity].pop()
        if not self.open[capacity]:
            self._mark(capacity, False)
        return capacity, window


def best_fit(lengths: Sequence[int], most: int = MOST) -> tuple[list[int], list[int], list[int]]:
    """Window and offset of each piece (``lengths`` in decreasing order, from 1 to ``most``), and what each window holds."""
    tree = Capacities(most)
    window, offset, held = [], [], []
    for length in lengths:
        found = tree.tightest(length)
        if found is None:
            capacity, w = most, len(held)
            held.append(0)
        else:
            capacity, w = found
        window.append(w)
        offset.append(most - capacity)
        held[w] += length
        if capacity > length:
            tree.put(capacity - length, w)
    return window, offset, held


def close_gaps(lengths: Sequence[int], window: list[int], offset: list[int], held: list[int], most: int = MOST) -> list[tuple[int, int, int, int, int]]:
    """Give up the emptiest windows while the others have room for what they hold; their pieces are cut where a gap is full.
    (piece, start within it, length, window, offset) of all parts."""
    keep = -(-sum(held) // most)
    order = sorted(range(len(held)), key=lambda w: (-held[w], w))
    gaps = [(w, held[w]) for w in order[:keep] if held[w] < most]  # fullest first
    given = set(order[keep:])
    out = []
    at = 0
    for i, n in enumerate(lengths):
        if window[i] not in given:
            out.append((i, 0, n, window[i], offset[i]))
            continue
        start = 0
        while start < n:
            w, used = gaps[at]
            part = min(n - start, most - used)
            out.append((i, start, part, w, used))
            start += part
            gaps[at] = (w, used + part)
            at += used + part == most
    return out


def cut(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, end: int = END) -> DataFrame:
    """Tokenize whole texts and cut those of more than ``most`` ids into full windows and a rest. Per piece: ``doc`` (the id), ``start`` (ids
    of the document before it), ``length``, ``ids`` (of a rest, little-endian unsigned 32-bit; null for full windows), ``ids_crc32`` and
    ``doc_tokens``. Every document ends with the id ``end``, so a null or empty text is one piece of one id."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]):
        encode = byte_encoder(tokenizer).encode
        for block in cm.text_blocks(batches, "__text"):
            ids, bounds = encode(block)
            rows, start, length, crc, total, raw = [], [], [], [], [], []
            for row in range(len(bounds) - 1):
                own = np.append(ids[bounds[row] : bounds[row + 1]], np.uint32(end)).astype("<u4")
                for k in range(0, len(own), most):
                    part = own[k : k + most]
                    rows.append(row)
                    start.append(k)
                    length.append(len(part))
                    crc.append(zlib.crc32(part))
                    total.append(len(own))
                    raw.append(part.astype("<u2" if part.max() < 65536 else "<u4").tobytes() if len(part) < most else None)
            yield pa.RecordBatch.from_arrays(
                [block.rows.column(0).take(pa.array(rows)), *(pa.array(x, pa.int64()) for x in (start, length, crc, total)), pa.array(raw, pa.binary())],
                names=["doc", *_LONGS, "ids"],
            )

    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("__text"))
    from pyspark.sql.types import BinaryType

    return rows.mapInArrow(run, StructType([StructField("doc", kind), *(StructField(c, LongType()) for c in _LONGS), StructField("ids", BinaryType())]))


def _numbers(raw: bytes, length: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * length else "<u4").astype("<u4")


def pack_documents(
    spark: SparkSession, docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, end: int = END, group: int = GROUP
) -> DataFrame:
    """Tokenize, cut and pack all documents: a row per piece with ``id_col``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id`` and ``offset``. Rows with equal or null ids are packed each on its own; columns other than the two aren't read, so their
    names can't clash; an empty table gives no rows."""
    pieces = cm.written(cut(docs, tokenizer, id_col, text_col, most, end), "window-pieces")
    whole = pieces.filter(F.col("length") == most)
    # even numbers for full windows, odd ones for those of the groups
    full = whole.select("doc", *_LONGS, (F.monotonically_increasing_id() * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rests = pieces.filter(F.col("length") < most)
    groups = max(1, -(-rests.count() // group))

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got)  # one group
        rows = rows.take(pa.compute.sort_indices(rows, [("length", "descending"), ("doc", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]))
        lengths = rows["length"].to_pylist()
        placed = close_gaps(lengths, *best_fit(lengths, most), most)
        piece, inner, length, window, offset = (np.array(x, np.int64) for x in zip(*placed))
        rows = rows.take(pa.array(piece))
        crc = rows["ids_crc32"].to_numpy().copy()
        for i in np.flatnonzero(length < rows["length"].to_numpy()).tolist():
            ids = _numbers(rows["ids"][i].as_py(), rows["length"][i].as_py())
            crc[i] = zlib.crc32(ids[inner[i] : inner[i] + length[i]])
        base = TaskContext.get().partitionId() << 32
        out = pa.table(
            [rows["doc"], pa.array(rows["start"].to_numpy() + inner), pa.array(length), pa.array(crc), rows["doc_tokens"], pa.array((base + window) * 2 + 1), pa.array(offset)],
            names=["doc", *_LONGS, "sequence_id", "offset"],
        )
        yield from out.combine_chunks().to_batches()

    # in turn over the groups: no key, so neither equal ids nor equal lengths meet in one task
    packed = rests.repartition(groups).mapInArrow(run, full.schema)
    return full.unionByName(packed).withColumnRenamed("doc", id_col)
