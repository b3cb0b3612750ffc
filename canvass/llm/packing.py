"""Best-fit packing of tokenized documents into sequences, planned on the length histogram.

1. Every text is tokenized once, in the scan; a document longer than a sequence is cut into
   pieces of a whole sequence and a rest. Only (document, piece, length, checksum) is written.
2. The plan is made over the counts of each length (at most ``most`` of them), never over documents:
   best-fit decreasing, done for all pieces of one length at a time. It is a list of intervals:
   "pieces of this length with ranks a..b take sequences s, s+1, .. at this offset".
3. Pieces take their slots by their rank within the length. A length's pieces are dealt into hash
   buckets; a bucket's first rank comes from the small table of bucket sizes, so a length
   that holds most pieces (whole sequences do) is ranked by many tasks.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canvass.llm import common as cm
from canvass.llm.tokens import encoder

MOST = 2048
END = 0
#: Buckets of a length. A window holds a bucket; the table of bucket sizes has MOST * BUCKETS rows at most.
BUCKETS = 512
#: Intervals of the plan: each length opens or splits a few groups of sequences. Checked.
PLAN_ROWS = 4_000_000


@dataclass
class Plan:
    """Intervals sorted by length and first rank."""

    length: np.ndarray
    first: np.ndarray  # rank of the interval's first piece within its length
    sequence: np.ndarray  # that piece's sequence; the next rank takes the next sequence
    offset: np.ndarray
    sequences: int

    def take(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (self.length.astype(np.int64) << 48) + self.first
        at = np.searchsorted(key, (length.astype(np.int64) << 48) + rank, "right") - 1
        return self.sequence[at] + (rank - self.first[at]), self.offset[at]


def plan(counts: dict[int, int], most: int = MOST) -> Plan:
    """Best-fit decreasing over a length histogram. ``open[r]``: the runs of sequences with r
    places left, as (first sequence, how many). All pieces of a length fill the fullest
    sequences that take them first, each with as many as it holds, as one-by-one best fit does."""
    open_: dict[int, list[tuple[int, int]]] = {}
    rooms = np.zeros(most + 1, bool)
    out: list[tuple[int, int, int, int]] = []
    made = 0
    for length in sorted((x for x, n in counts.items() if n > 0), reverse=True):
        left, rank = counts[length], 0
        while left:
            fits = np.flatnonzero(rooms[length:])
            if len(fits):
                room = length + int(fits[0])
                begin, n = open_[room].pop()
                if not open_[room]:
                    rooms[room] = False
            else:
                room, begin = most, made
                n = -(-left // (most // length))
                made += n
            each = room // length
            full = min(n, left // each)
            parts = [(begin, full, each)]
            if full < n:
                rest = left - full * each  # fewer than a sequence takes
                parts.append((begin + full, 1 if rest else 0, rest))
                spare = n - full - (1 if rest else 0)
                if spare:
                    open_.setdefault(room, []).append((begin + full + (1 if rest else 0), spare))
                    rooms[room] = True
            for at, run, pieces in parts:
                if not run or not pieces:
                    continue
                for k in range(pieces):
                    out.append((length, rank, at, most - room + k * length))
                    rank += run
                left -= run * pieces
                if room - pieces * length:
                    open_.setdefault(room - pieces * length, []).append((at, run))
                    rooms[room - pieces * length] = True
        if len(out) > PLAN_ROWS:
            raise ValueError(f"the packing plan has more than {PLAN_ROWS} intervals")
    cols = np.array(out, np.int64).reshape(-1, 4)
    cols = cols[np.lexsort((cols[:, 1], cols[:, 0]))]
    return Plan(cols[:, 0], cols[:, 1], cols[:, 2], cols[:, 3], made)


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, end: int = END) -> DataFrame:
    """Tokenize whole texts and cut the long ones. Per piece: id, ``piece`` (from 0), ``start`` (ids of the
    document before it), ``length``, ``ids_crc32`` (of its ids as little-endian unsigned 32-bit numbers).

    Every document ends with the id ``end``, so a null or empty text is one piece of one id. Rows
    with equal or null ids are packed each on its own. Columns other than the two are not read."""
    kind = docs.schema[id_col].dataType

    def run(batches):
        encode = encoder(tokenizer).encode
        for block in cm.text_blocks(batches, "__text"):
            ids, bounds = encode(block)
            rows, number, start, length, crc = [], [], [], [], []
            for row in range(len(bounds) - 1):
                own = np.append(ids[bounds[row] : bounds[row + 1]], np.uint32(end)).astype("<u4")
                for k in range(0, len(own), most):
                    part = own[k : k + most]
                    rows.append(row)
                    number.append(k // most)
                    start.append(k)
                    length.append(len(part))
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [block.rows.column(0).take(pa.array(rows)), *(pa.array(x, pa.int64()) for x in (number, start, length, crc))],
                names=["doc", "piece", "start", "length", "ids_crc32"],
            )

    out = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("__text"))
    from pyspark.sql.types import LongType, StructField, StructType

    return out.mapInArrow(
        run, StructType([StructField("doc", kind), *(StructField(c, LongType()) for c in ("piece", "start", "length", "ids_crc32"))])
    )


def pack(cut: DataFrame, most: int = MOST) -> DataFrame:
    """Give the pieces (columns of ``pieces``) their ``sequence_id`` and ``offset``.

    ``cut`` should be a written table: it is read for the histogram and again for the ranks.
    Which of several pieces of one length takes which slot follows a hash of (doc, piece, checksum);
    an empty table gives no rows."""
    spark = cut.sparkSession
    bucket = F.pmod(F.xxhash64("doc", "piece", "ids_crc32"), F.lit(BUCKETS))
    keyed = cut.withColumn("bucket", bucket)
    sizes = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    sizes = cm.written(sizes, "packing-sizes")
    rows = sizes.groupBy("length").agg(F.sum("n").alias("n")).limit(most + 1).collect()  # a row for each length
    planned = spark.sparkContext.broadcast(plan({r["length"]: r["n"] for r in rows}, most))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "bucket").orderBy(F.xxhash64("doc", "piece", "ids_crc32"), "doc", "piece", "start", "ids_crc32")
    ranked = (
        keyed.withColumn("at", F.row_number().over(within) - 1)
        .join(firsts, ["length", "bucket"])
        .select("doc", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("at")).alias("rank"))
    )

    def place(batches):
        for batch in batches:
            sequence, offset = planned.value.take(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)],
                names=["doc", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(
    spark: SparkSession, docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, end: int = END
) -> DataFrame:
    """Tokenize, cut and pack all documents: a row per piece, ``id_col`` first."""
    cut = cm.written(pieces(docs, tokenizer, id_col, text_col, most, end), "packing-pieces")
    packed = pack(cut, most)
    return packed.withColumnRenamed("doc", id_col)
