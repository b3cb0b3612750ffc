"""Importance resampling towards a target distribution, with bit-sliced sums.

Features are runs of 1 and 2 words, hashed to ``BUCKETS`` buckets by crc32. One pass over each side counts its buckets (a
task sends one row a bucket, however many rows it read); a bucket's gain is the floored log ratio of the smoothed shares.

A document's weight is the floored mean gain of its features, computed by bit slices: plane j of the document
is a string of ``BUCKETS`` bits that has bit b set if bit j of its count of bucket b is set; plane i of the gains likewise, one
set for positive and one for negative gains. The sum over features is sum over i, j of 2**(i + j) * popcount(document plane j AND gain
plane i), exact in integers. Documents of a block share the array operations; planes that no document needs aren't made.

The draw adds Gumbel noise from a hash of the id and takes the highest scores. The cut comes from the histogram of scores
(whole numbers in a narrow range); only drawn candidates are sorted, by ranges of (score, id, row), and ranked by a range's offset.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm import common as cm

BUCKETS = 10_000
SEED = 7
#: Documents of fewer words take no part in the draw.
LEAST_WORDS = 20
#: Per cent of those that is drawn.
PERCENT = 25
#: Words up to this length get their checksum by array operations, longer ones one by one.
_SHORT = 32

_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = True
_WORD[ord("a") : ord("z") + 1] = True
_WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = (out >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (out & np.uint32(1)))
    return out


_CRC = _crc_table()


def _append_tables() -> np.ndarray:
    """[n, k, v]: what n zero bytes make of a checksum state whose byte k is v and whose others are 0. A state is linear in
    its bits, so a whole state is the exclusive or of four entries."""
    state = np.zeros((_SHORT + 1, 4, 256), np.uint32)
    for k in range(4):
        state[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(_SHORT):
        state[n + 1] = _CRC[state[n] & np.uint32(255)] ^ (state[n] >> np.uint32(8))
    return state


_APPEND = _append_tables()
_ONES = np.uint32(0xFFFFFFFF)
#: crc32 of n zero bytes
_ZEROS = np.array([zlib.crc32(bytes(n)) for n in range(_SHORT + 1)], np.uint32)


def word_spans(block: cm.TextBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, start and end of each word, and the bounds of the rows' words."""
    data = _LOWER[block.data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return data, none, none, np.zeros(len(block.bounds), np.int64)
    word = _WORD[data]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    full = block.bounds[1:] > block.bounds[:-1]  # words don't cross rows
    first, last = block.bounds[:-1][full], block.bounds[1:][full] - 1
    begins[first] = word[first]
    ends[last] = word[last]
    start = np.flatnonzero(begins)
    return data, start, np.flatnonzero(ends) + 1, np.searchsorted(start, block.bounds)


def word_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of each word, a byte of all words at a time."""
    size = end - start
    out = np.full(len(start), _ONES, np.uint32)
    live = np.flatnonzero((size <= _SHORT) & (size > 0))
    for k in range(_SHORT):
        live = live[size[live] > k]
        if not len(live):
            break
        state = out[live]
        out[live] = _CRC[(state ^ data[start[live] + k]) & np.uint32(255)] ^ (state >> np.uint32(8))
    out ^= _ONES
    for i in np.flatnonzero(size > _SHORT).tolist():
        out[i] = zlib.crc32(data[start[i] : end[i]])
    return out


def pair_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray, crc: np.ndarray, first: np.ndarray) -> np.ndarray:
    """crc32 of the words ``first`` and the words after them, joined by a space: the checksum of the first and
    the space, carried over as many zero bytes as the second has, and the second's own."""
    state = crc[first] ^ _ONES
    head = (_CRC[(state ^ np.uint32(32)) & np.uint32(255)] ^ (state >> np.uint32(8))) ^ _ONES
    size = (end - start)[first + 1]
    n = np.minimum(size, _SHORT)
    carried = _ZEROS[n].copy()
    for k in range(4):
        carried ^= _APPEND[n, k, (head >> np.uint32(8 * k)) & np.uint32(255)]
    # crc(a + b) = crc(a + zeros) ^ crc(b) ^ crc(zeros), and the affine part of crc(a + zeros) is crc(zeros) itself
    out = carried ^ crc[first + 1] ^ _ZEROS[n]
    for i in np.flatnonzero(size > _SHORT).tolist():
        j = first[i] + 1
        out[i] = zlib.crc32(data[start[j] : end[j]], int(head[i]))
    return out


def features(block: cm.TextBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket and the row of every feature (repeats included), and each row's words."""
    data, start, end, bounds = word_spans(block)
    n_words = np.diff(bounds)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), n_words
    crc = word_crcs(data, start, end)
    row = cm.owners(bounds)
    first = np.flatnonzero(row[1:] == row[:-1])
    pairs = pair_crcs(data, start, end, crc, first)
    bucket = np.concatenate([crc, pairs]) % np.uint32(BUCKETS)
    return bucket.astype(np.int64), np.concatenate([row, row[first]]), n_words


def bucket_counts(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket. Null and empty texts have none; other columns aren't read."""

    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(BUCKETS, np.int64)
        for block in cm.text_blocks(batches, "text"):
            total += np.bincount(features(block)[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["bucket", "n"])

    counted = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(BUCKETS, np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row for each bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket the floored 1000 * log of target share over raw share, both smoothed by one feature a bucket."""
    all_raw, all_target = float(int(raw.sum()) + BUCKETS), float(int(target.sum()) + BUCKETS)
    share = lambda s, t: ((float(t) + 1.0) * all_raw) / ((float(s) + 1.0) * all_target)
    return np.array([math.floor(1000.0 * math.log(share(s, t))) for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def bit_planes(values: np.ndarray) -> np.ndarray:
    """Bit i of non-negative ``values`` as row i, packed into 64-bit words."""
    n = int(values.max(initial=0)).bit_length()
    bits = ((values[None, :] >> np.arange(n)[:, None]) & 1).astype(np.uint8)
    return _words(np.packbits(bits, axis=1, bitorder="little"))


def _words(packed: np.ndarray) -> np.ndarray:
    pad = -packed.shape[1] % 8
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, pad)))).view(np.uint64)


def gain_sums(bucket: np.ndarray, row: np.ndarray, rows: int, positive: np.ndarray, negative: np.ndarray) -> np.ndarray:
    """The sum of gains of each row's features, from bit planes."""
    out = np.zeros(rows, np.int64)
    key, count = np.unique(row * BUCKETS + bucket, return_counts=True)
    row, bucket = key // BUCKETS, key % BUCKETS
    j = 0
    while len(count):
        on = (count & 1).astype(bool)
        own, at = np.unique(row[on], return_inverse=True)  # rows whose counts have this bit
        plane = np.zeros((len(own), positive.shape[1] * 64), np.uint8)
        plane[at, bucket[on]] = 1
        plane = _words(np.packbits(plane, axis=1, bitorder="little"))
        for sign, planes in ((1, positive), (-1, negative)):
            for i in range(len(planes)):
                hits = np.bitwise_count(plane & planes[i]).sum(axis=1, dtype=np.int64)
                out[own] += sign * (hits << (i + j))
        count = count >> 1
        keep = count > 0
        row, bucket, count = row[keep], bucket[keep], count[keep]
        j += 1
    return out


def weigh(spark: SparkSession, docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, ``n_words``, ``n_features``, ``weight``. Rows with equal or null ids count each on its own;
    texts without words have weight 0."""
    wide = -(-BUCKETS // 64) * 64
    signed = np.zeros(wide, np.int64)
    signed[:BUCKETS] = gain
    sent = spark.sparkContext.broadcast((bit_planes(np.maximum(signed, 0)), bit_planes(np.maximum(-signed, 0))))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        positive, negative = (p if len(p) else np.zeros((0, wide // 64), np.uint64) for p in sent.value)
        for block in cm.text_blocks(batches, "__text"):
            bucket, row, n_words = features(block)
            n = np.where(n_words > 0, 2 * n_words - 1, 0)
            total = gain_sums(bucket, row, len(n), positive, negative)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [block.rows.column(0), pa.array(n_words, pa.int64()), pa.array(n, pa.int64()), pa.array(weight, pa.int64())],
                names=["id", "n_words", "n_features", "weight"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long")


def with_score(weighed: DataFrame, seed: int = SEED) -> DataFrame:
    """Add ``score``: the weight and Gumbel noise in thousandths, from a hash of the id (a null id: of the empty string)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return weighed.withColumn("score", F.col("weight") + noise)


#: Bound on the different scores: whole numbers between a few ten thousand above and below 0.
MOST_SCORES = 1_000_000


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Rank the highest scores of the rows with at least ``least_words`` words: ``percent`` of them (floored), ties to the smaller id (null
    ids last), then in any fixed order. Others have a null ``rank``. ``scored`` should be a written table."""
    spark = scored.sparkSession
    fit = F.col("n_words") >= least_words
    histogram = scored.filter(fit).groupBy("score").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("score").desc())
    counts = histogram.limit(MOST_SCORES + 1).collect()
    if len(counts) > MOST_SCORES:
        raise ValueError(f"more than {MOST_SCORES} different scores")
    wanted = percent * sum(r["n"] for r in counts) // 100
    cut, seen = None, 0
    for r in counts:
        if seen >= wanted:
            break
        cut, seen = r["score"], seen + r["n"]
    if cut is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    chance = fit & (F.col("score") >= cut)
    parts = cm.shuffle_width(spark)
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row")]
    # the row's number splits an id that many rows have
    numbered = scored.withColumn("row", F.monotonically_increasing_id())
    ranged = numbered.filter(chance).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("row")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in scored.schema.fields)

    def place(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            at = pa.array(np.arange(n + 1, n + b.num_rows + 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), at], names=[*b.schema.names, "part", "at"])
            n += b.num_rows

    placed = cm.written(ranged.mapInArrow(place, f"{kinds}, part int, at long"), "importance-ranks")
    sizes = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each partition
    before, offsets = 0, []
    for p in sorted(sizes):
        offsets += [F.lit(p), F.lit(before).cast("long")]
        before += sizes[p]
    rank = F.col("at") + F.element_at(F.create_map(*offsets), F.col("part"))
    ranked = placed.withColumn("rank", F.when(rank <= wanted, rank)).drop("part", "at")
    rest = scored.filter(~F.coalesce(chance, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest)


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per document of ``docs``: id, ``n_features``, ``weight``, ``score`` and ``rank`` (null if not drawn), all long but the id, and ``n_words``.

    ``target``: the texts to come close to (column ``text_col``). An empty target or empty ``docs`` count as no features. Null texts
    are empty; columns of other names aren't read, so they can't clash."""
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, text_col))
    scored = cm.written(with_score(weigh(spark, docs, gain, id_col, text_col)), "importance-scores")
    return draw(scored, percent).withColumnRenamed("id", id_col)
