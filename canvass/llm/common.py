"""Helpers shared by the operators: written intermediate tables and text as byte arrays.

Text goes through the operators as the bytes of an Arrow column (``TextBlock``), so words,
shingles and windows of many documents are found by a few array operations at a time.
A null text counts as empty. Blocks are cut to a few MB, so a task's memory doesn't depend on
the table or on the batch size of the session; one document is never cut.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from canvass.session import scratch_path, ship_package

#: Words are runs of other bytes than these.
SPACES = b" \t\n\x0b\x0c\r"
BLOCK_BYTES = 1 << 19

_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACES)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back.

    Cuts the lineage, so a lost executor costs no more than the running step. Afterwards the
    context cleaner may remove the shuffle files of the step."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more: all that was made from them is written itself."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        conf = t.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let the context cleaner see that finished steps are no longer referenced: it drops
    their shuffle files only when the driver has collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---- arrays of bytes --------------------------------------------------------


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def random_words(n: int, seed: int) -> np.ndarray:
    """``n`` repeatable 64-bit values, odd, for use as multipliers or table entries."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


_BYTE_CODE = random_words(256, 11)
_BASE = int(random_words(1, 29)[0])
_POWERS = np.ones(1, _U)


def powers(n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, kept for the process."""
    global _POWERS
    if len(_POWERS) <= n:
        steps = np.full(max(n, BLOCK_BYTES) + 1, _BASE, _U)
        steps[0] = 1
        _POWERS = np.multiply.accumulate(steps)
    return _POWERS


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums of code(byte i) * base**i over the first 0, 1, .. len bytes, modulo 2**64."""
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE_CODE[data] * powers(len(data))[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end) of the bytes behind ``prefix``; equal bytes
    have equal hashes wherever they stand, as long as their distance to the end of the
    block is made up for (the power)."""
    n = len(prefix) - 1
    raised = (prefix[end] - prefix[start]) * _aligned(n, start)
    return mix64(raised + (end - start).astype(_U))


def rolling_sums(prefix: np.ndarray, start: int, n: int, size: int, step: int) -> np.ndarray:
    """What ``span_hash`` mixes, of ``n`` spans of ``size`` bytes, one at every ``step``-th byte from ``start``: equal bytes have equal
    sums, and the high bits depend on all bytes."""
    upto = start + (n - 1) * step + 1
    out = prefix[start + size : upto + size : step] - prefix[start:upto:step]
    top = len(prefix) - 1
    if top > BLOCK_BYTES:
        out *= _aligned(top, np.arange(start, upto, step))
    else:  # the powers stand in a row
        out *= powers(BLOCK_BYTES)[BLOCK_BYTES - upto + 1 : BLOCK_BYTES - start + 1][::-1][::step]
    return out


def _aligned(n: int, start: np.ndarray) -> np.ndarray:
    top = max(n, BLOCK_BYTES)
    if n > BLOCK_BYTES:  # one document longer than a block: align to a fixed larger power
        top = 1 << int(n).bit_length()
        return _power_to(top, start)
    return powers(top)[top - start]


def _power_to(top: int, start: np.ndarray) -> np.ndarray:
    """base**(BLOCK_BYTES - start) also for starts beyond a block, by the inverse of the base."""
    inverse = pow(_BASE, -1, 1 << 64)
    far = start > BLOCK_BYTES
    out = powers(BLOCK_BYTES)[np.where(far, 0, BLOCK_BYTES - start)]
    steps = np.full(int((start[far] - BLOCK_BYTES).max(initial=0)) + 1, inverse, _U)
    steps[0] = 1
    back = np.multiply.accumulate(steps)
    out[far] = back[start[far] - BLOCK_BYTES]
    return out


@dataclass
class TextBlock:
    """Whole texts of some rows: their bytes on end, and where each begins."""

    rows: pa.RecordBatch  # the other columns
    data: np.ndarray  # uint8
    bounds: np.ndarray  # int64, one more than rows

    def words(self, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in order, and the bounds of each row's words among them.
        ``lower``: A-Z count as a-z."""
        start, end, bounds = self.word_spans()
        return self.span_hashes(start, end, lower), bounds

    def span_hashes(self, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
        return span_hash(prefix_hash(_LOWER[self.data] if lower else self.data), start, end)

    def word_spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(self.data):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(len(self.bounds), np.int64)
        word = _IS_WORD[self.data]
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        ends[:-1] &= ~word[1:]
        full = self.bounds[1:] > self.bounds[:-1]  # words don't cross rows
        first, last = self.bounds[:-1][full], self.bounds[1:][full] - 1
        begins[first] = word[first]
        ends[last] = word[last]
        start = np.flatnonzero(begins)
        return start, np.flatnonzero(ends) + 1, np.searchsorted(start, self.bounds)

    def texts(self) -> Iterator[bytes]:
        raw = self.data.tobytes()
        b = self.bounds.tolist()
        for i, j in zip(b, b[1:]):
            yield raw[i:j]


def text_blocks(batches: Iterator[pa.RecordBatch], text: str, most: int = BLOCK_BYTES) -> Iterator[TextBlock]:
    """Cut batches into blocks of whole rows, of about ``most`` bytes of text each. A batch of
    null or empty texts still gives its rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = pc.fill_null(batch.column(text).cast(pa.large_binary()), b"")
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        others = batch.drop_columns([text])
        lo = 0
        while lo < len(column):
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
            hi = min(hi, len(column))
            yield TextBlock(others.slice(lo, hi - lo), data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
            lo = hi


def owners(bounds: np.ndarray) -> np.ndarray:
    """The row of each element, from the rows' bounds."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column: the bytes of values[bounds[i]:bounds[i+1]] for each i."""
    values = np.ascontiguousarray(values)
    at = (bounds * values.itemsize).astype(np.int64)
    raw = pa.py_buffer(values.view(np.uint8) if len(values) else b"")
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(at), raw]).cast(pa.binary())


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
