"""Removing long repeated byte strings with suffix arrays over shards.

Every ``length``-byte window of every text is assigned to an anchor: the position in it whose ``SEED``-byte string has the
least hash. Equal windows have equal anchors at equal offsets, so all occurrences of a window meet in the shard of its
anchor's hash. Neighbouring windows mostly share their anchor; they form a run, one row.

1. runs: the anchor, first window, bytes and digest of each run, a row for each document.
2. distinct runs: equal (anchor, digest) are equal texts. They are counted (in the task first, so a
   text with thousands of copies sends a row a task); windows of a run that occurs twice are repeated.
3. Other runs whose anchor occurs elsewhere can share some windows. Their bytes, with one copy of the runs that
   occur often, go to shards of about ``SHARD`` bytes by the anchor's hash. A shard is sorted by
   induced sorting (``induced``), which works from disk when a shard is far larger than memory:
   windows repeat where neighbouring suffixes share ``length`` bytes.
4. The covered spans go back to the documents.

The same finds strings of whole words, whatever stands between them: each word is written as ``WORD`` bytes of its hash, and
windows begin at words only. In a shard in memory a word is ``DIGITS`` characters, its number among the shard's words.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from canvass.llm import common as cm
from canvass.llm import induced

LENGTH = 400
SEED = 128
#: The fewest words of a passage that may not stand twice.
PASSAGE_WORDS = 51
#: Words of the string that anchors a window of words.
WORD_SEED = 16
#: Bytes of a word's hash. Two strings of 51 words count as equal only if all their words agree in 40 bits.
WORD = 5
#: Characters of a word while a shard is sorted in memory.
DIGITS = 3
#: Bytes that are sorted together, and such shards in a task.
SHARD = 1 << 20
TASK_SHARDS = 4
#: Windows looked at together; positions in it take so many bits beside a hash.
STRETCH_BITS = 22
#: Hashes whose minima are taken together.
PIECE = 1 << 14
_U = np.uint64


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, a piece that stays in the processor's cache at a time."""
    n = len(x) - width + 1
    out = np.empty(n, x.dtype)
    for lo in range(0, n, PIECE):
        piece = x[lo : min(n, lo + PIECE) + width - 1]
        done = 1
        while done < width:
            step = min(done, width - done)
            piece = np.minimum(piece[: len(piece) - step], piece[step:])
            done += step
        out[lo : lo + len(piece)] = piece
    return out


def window_runs(block: cm.TextBlock, length: int = LENGTH, seed: int = SEED, step: int = 1):
    """The runs of all rows: (row, first byte within the row, bytes, anchor hash, digest). Windows and anchors begin at every
    ``step``-th byte of a row; ``length``, ``seed`` and the rows' sizes are multiples of it."""
    size, part = length // step, seed // step
    n, bounds = len(block.data) // step, block.bounds // step
    long = np.flatnonzero(np.diff(bounds) >= size)  # only these rows have windows, up to ``stop``
    start, stop = bounds[long], bounds[long + 1] - size + 1
    prefix = cm.prefix_hash(block.data)
    mask = _U((1 << (STRETCH_BITS + 1)) - 1)
    out = []
    for lo in range(0, max(0, n - size + 1), 1 << STRETCH_BITS):
        hi = min(n - size + 1, lo + (1 << STRETCH_BITS))  # windows lo .. hi - 1
        here = slice(np.searchsorted(stop, lo, "right"), np.searchsorted(start, hi))  # rows with windows here
        if here.start >= here.stop:
            continue
        order = cm.rolling_sums(prefix, lo * step, hi + size - part - lo, part * step, step)  # only anchors need well spread hashes
        order &= ~mask
        order |= np.arange(len(order), dtype=_U)
        least = _least(order, size - part + 1)
        new = np.empty(len(least), bool)
        new[0] = True
        np.not_equal(least[1:], least[:-1], out=new[1:])
        new[np.maximum(start[here] - lo, 0)] = True
        behind = stop[here] - lo  # windows there cross the end of their row
        new[behind[behind < len(new)]] = True
        head = np.flatnonzero(new)
        last = np.append(head[1:], len(new)) + (lo - 1)
        first, anchor = head + lo, (least[head] & mask).astype(np.int64) + lo
        row = np.searchsorted(start, first, "right") - 1
        inside = (row >= 0) & (first < stop[row])
        first, last, anchor, row = first[inside], last[inside], anchor[inside], row[inside]
        digest = cm.span_hash(prefix, first * step, (last + size) * step) ^ cm.mix64((anchor - first).astype(_U) + _U(1))
        hashes = cm.span_hash(prefix, anchor * step, (anchor + part) * step)
        out.append((long[row], (first - start[row]) * step, (last + size - first) * step, hashes, digest))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(_U), none.view(_U)
    return tuple(np.concatenate(x) for x in zip(*out))


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """Rows with a 128-bit key of their content; equal rows (of all columns) may share it."""
    names = [c for c in docs.columns if c != text_col and docs.schema[c].dataType.typeName() not in ("map", "variant")]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    quoted = [F.col(f"`{c}`") for c in names]
    return docs.withColumns({"__k1": F.xxhash64(*quoted, text), "__k2": F.xxhash64(F.lit(7), text, *quoted), "__text": text})


def word_block(block: cm.TextBlock) -> cm.TextBlock:
    """The hashes of all words of each text on end in place of it."""
    h, bounds = block.words(lower=False)
    return cm.TextBlock(block.rows, np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :WORD].reshape(-1), bounds * WORD)


def word_strings(keyed: DataFrame) -> DataFrame:
    """The keys with the hashes of all words of a text on end in place of it."""

    def encode(batches):
        for block in map(word_block, cm.text_blocks(batches, "__text")):
            yield pa.RecordBatch.from_arrays([*block.rows.columns, cm.binaries(block.data, block.bounds)], names=["__k1", "__k2", "__text"])

    return keyed.select("__k1", "__k2", "__text").mapInArrow(encode, "__k1 long, __k2 long, __text binary")


def spans_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans of all rows on end, as (begin, end), and where each row's begin; null: none."""
    bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    flat = column.flatten()
    return flat.field("begin").to_numpy(), flat.field("end").to_numpy(), bounds


def in_bytes(texts: list[bytes], begin: np.ndarray, end: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the hashes of the texts' words as spans of their bytes, from the first word to the end of the last."""
    many = np.diff(bounds)
    some = np.flatnonzero(many)
    sizes = np.array([len(texts[i]) for i in some], np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    first, last, words = cm.TextBlock(None, np.frombuffer(b"".join([texts[i] for i in some]), np.uint8), at).word_spans()
    word, byte = np.repeat(words[:-1], many[some]), np.repeat(at[:-1], many[some])
    return first[word + begin // WORD] - byte, last[word + end // WORD - 1] - byte


def _flat(batch: pa.RecordBatch):
    """A batch of run rows as arrays: (key columns by run, first, size, anchor, digest)."""
    sizes = np.array([len(x) // 8 for x in batch.column("first").to_pylist()], np.int64)
    keys = [np.repeat(batch.column(c).to_numpy(), sizes) for c in ("k1", "k2")]
    join = lambda c: np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int64)
    return *keys, join("first"), join("size"), join("anchor"), join("digest")


def run_table(docs: DataFrame, length: int = LENGTH, seed: int = SEED, step: int = 1, words: bool = False) -> DataFrame:
    """The runs of each text with any. With ``words`` those of its words' hashes, made by the same worker: a second one for each task would
    stay with the executor."""
    most = cm.BLOCK_BYTES * 2 // WORD if words else cm.BLOCK_BYTES  # a word is two bytes with its space at least

    def find(batches):
        for block in cm.text_blocks(batches, "text", most):
            block = word_block(block) if words else block
            row, first, size, anchor, digest = window_runs(block, length, seed, step)
            bounds = np.searchsorted(row, np.arange(len(block.bounds)))
            some = np.flatnonzero(np.diff(bounds))
            if not len(some):
                continue
            bounds = np.append(bounds[some], bounds[-1])
            packed = [cm.binaries(x, bounds) for x in (first, size, cm.signed(anchor), cm.signed(digest))]
            keys = [block.rows.column(c).take(pa.array(some)) for c in ("k1", "k2")]
            yield pa.RecordBatch.from_arrays([*keys, *packed], names=["k1", "k2", "first", "size", "anchor", "digest"])

    rows = docs.select(F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), F.col("__text").alias("text"))
    return rows.mapInArrow(find, "k1 long, k2 long, first binary, size binary, anchor binary, digest binary")


def distinct_runs(runs: DataFrame) -> DataFrame:
    """(anchor, digest, n, texts, k1, k2, first, size) of runs whose anchor occurs again: how often the run occurs, how many
    different runs its anchor has, and one place of it."""

    def count(batches):
        for batch in batches:
            k1, k2, first, size, anchor, digest = _flat(batch)
            order = np.lexsort((digest, anchor))
            new = np.ones(len(order), bool)
            a, d = anchor[order], digest[order]
            new[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
            head = np.flatnonzero(new)
            one = order[head]
            n = np.diff(np.append(head, len(order)))
            cols = (anchor[one], digest[one], n, k1[one], k2[one], first[one], size[one])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["anchor", "digest", "n", "k1", "k2", "first", "size"])

    from pyspark.sql import Window

    width = cm.shuffle_width(runs.sparkSession)
    counted = runs.mapInArrow(count, "anchor long, digest long, n long, k1 long, k2 long, first long, size long").repartition(width, "anchor")
    place = F.min(F.struct("k1", "k2", "first", "size")).alias("place")
    found = counted.groupBy("anchor", "digest").agg(F.sum("n").alias("n"), place)
    mine = Window.partitionBy("anchor")
    found = found.withColumn("texts", F.count(F.lit(1)).over(mine)).filter("n > 1 or texts > 1")
    return found.select("anchor", "digest", "n", "texts", "place.*")


class _Shard:
    """Collects the runs of a shard, in memory up to a bound and then in an unnamed file."""

    def __init__(self, memory: int):
        self.memory, self.rows, self.sizes, self.parts, self.held, self.spool = memory, [], [], [], 0, None

    def add(self, row: tuple, text: bytes) -> None:
        self.rows.append(row)
        self.sizes.append(len(text))
        self.parts.append(text)
        self.held += len(text)
        if self.held > self.memory:
            self.spool = self.spool or tempfile.TemporaryFile()
            self.spool.write(b"".join(self.parts))
            self.parts, self.held = [], 0

    def characters(self) -> tuple[np.ndarray, np.ndarray]:
        if self.spool is not None:
            self.spool.write(b"".join(self.parts))
            self.spool.flush()
            data = np.memmap(self.spool, np.uint8, "r")
        else:
            data = np.frombuffer(b"".join(self.parts), np.uint8)
        sizes = np.array(self.sizes, np.int64)
        ends = np.cumsum(sizes)
        text = induced.whole_array(int(ends[-1]) + len(sizes), np.uint16)
        for i, (lo, hi) in enumerate(zip((ends - sizes).tolist(), ends.tolist())):
            text[lo + i : hi + i] = data[lo:hi]
            text[lo + i : hi + i] += 1
        return text, ends - sizes + np.arange(len(sizes))

    def numbered(self, step: int) -> tuple[np.ndarray, np.ndarray]:
        """The same with ``DIGITS`` characters for each ``step`` bytes: the digits of their number among the shard's different strings. First,
        second and third digits are different characters, so a string at a first digit equals none at another one."""
        words = np.zeros((sum(self.sizes) // step, 8), np.uint8)
        words[:, :step] = np.frombuffer(b"".join(self.parts), np.uint8).reshape(-1, step)
        known, number = np.unique(words.view(_U).reshape(-1), return_inverse=True)
        base = 1
        while base**DIGITS < len(known):
            base += 1
        digits = np.empty((len(number), DIGITS), np.uint16)
        for k in range(DIGITS):
            digits[:, DIGITS - 1 - k] = number % base + k * base + 1
            number = number // base
        sizes = np.array(self.sizes, np.int64) // step * DIGITS
        begin = np.cumsum(sizes) - sizes + np.arange(len(sizes))
        text = np.zeros(int(sizes.sum()) + len(sizes), np.uint16)
        inside = np.ones(len(text), bool)
        inside[begin + sizes] = False
        text[inside] = digits.reshape(-1)
        return text, begin

    def repeated(self, length: int, step: int = 1):
        """For each run that occurs once, the spans (relative to it) of its windows that also occur elsewhere in the shard;
        windows begin at every ``step``-th character of a run."""
        sizes, unit = np.array(self.sizes, np.int64), step
        if DIGITS < step <= 8 and self.spool is None:
            text, begin = self.numbered(step)
            sizes, length, step = sizes // unit * DIGITS, length // unit * DIGITS, DIGITS
        else:
            text, begin = self.characters()
        again = induced.whole_array(len(text), bool)
        last = None
        for at, share in induced.suffixes(text, length, self.memory):
            hit = np.flatnonzero(share >= length)
            again[at[hit]] = True
            again[at[hit[hit > 0] - 1]] = True
            if len(hit) and hit[0] == 0 and last is not None:
                again[last] = True
            last = int(at[-1])
        for (anchor, digest, n), lo, size in zip(self.rows, begin.tolist(), sizes.tolist()):
            starts = np.flatnonzero(again[lo : lo + size - length + 1 : step]) * step
            if n == 1 and len(starts):
                cut = np.flatnonzero(np.diff(starts) > step)
                head, tail = starts[np.append(0, cut + 1)] // step * unit, (starts[np.append(cut, len(starts) - 1)] + length) // step * unit
                yield anchor, digest, np.column_stack([head, tail]).astype("<i8").tobytes()


def shared_spans(
    docs: DataFrame, distinct: DataFrame, length: int = LENGTH, memory: int = induced.MEMORY, step: int = 1, words: bool = False
) -> DataFrame:
    """(anchor, digest, spans) of the runs that occur once and share windows with others, by suffix arrays over shards. With ``words`` the
    runs are those of the hashes of the texts' words, made for the texts that have such runs."""
    needed = distinct.filter("texts > 1")
    total = needed.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total // SHARD))
    where = needed.groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "digest", "n", "first", "size")).alias("runs"))  # of one document

    def cut(batches):
        for block in cm.text_blocks(batches, "text"):
            listed = block.rows.column("runs")
            block = word_block(block) if words else block
            flat = listed.flatten()
            runs = list(zip(*(flat.field(c).to_pylist() for c in ("anchor", "digest", "n", "first", "size"))))
            at = np.cumsum([0, *pc.list_value_length(listed).to_pylist()]).tolist()
            # a few MB of runs at a time
            out, held = [], 0
            for i, text in enumerate(block.texts()):
                for anchor, digest, n, first, size in runs[at[i] : at[i + 1]]:
                    part = text[first : first + size]
                    out.append((anchor % shards, anchor, digest, n, part))
                    held += len(part)
                    if held > cm.BLOCK_BYTES:
                        yield _rows(out)
                        out, held = [], 0
            if out:
                yield _rows(out)

    def _rows(out):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=["shard", "anchor", "digest", "n", "text"])

    texts = docs.select(F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), F.col("__text").alias("text"))
    dealt = texts.join(where, ["k1", "k2"]).select("text", "runs").mapInArrow(cut, "shard long, anchor long, digest long, n long, text binary")
    dealt = dealt.repartition(int(min(-(-shards // TASK_SHARDS), 100_000)), "shard").sortWithinPartitions("shard", "anchor", "digest")

    def sort(batches):
        shard, current, before = None, None, None
        names = ["anchor", "digest", "spans"]

        def done():
            found = list(shard.repeated(length, step))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.binary()))], names=names)

        for batch in batches:
            numbers, anchors, digests, n = (batch.column(i).to_pylist() for i in range(4))
            texts = batch.column(4)
            for i in range(batch.num_rows):
                if numbers[i] != current:
                    if shard is not None:
                        yield from done()
                    shard, current, before = _Shard(memory), numbers[i], None
                if (anchors[i], digests[i]) == before:  # equal rows of documents hold one run twice
                    continue
                before = (anchors[i], digests[i])
                shard.add((anchors[i], digests[i], n[i]), texts[i].as_py())
        if shard is not None:
            yield from done()

    return dealt.mapInArrow(sort, "anchor long, digest long, spans binary")


def covered_spans(runs: DataFrame, distinct: DataFrame, shared: DataFrame) -> DataFrame:
    """(k1, k2, spans): the spans of each document covered by repeated windows."""
    found = distinct.filter("n > 1").select("anchor", "digest", F.lit(None).cast("binary").alias("spans")).unionByName(shared)

    def spread(batches):
        for batch in batches:
            cols = _flat(batch)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["k1", "k2", "first", "size", "anchor", "digest"])

    places = runs.mapInArrow(spread, "k1 long, k2 long, first long, size long, anchor long, digest long")

    def absolute(batches):
        for batch in batches:
            k1, k2, first, size = (batch.column(i).to_numpy() for i in range(4))
            spans = batch.column(4).to_pylist()
            each = [np.array([[0, s]]) if x is None else np.frombuffer(x, "<i8").reshape(-1, 2) for x, s in zip(spans, size.tolist())]
            many = np.array([len(x) for x in each], np.int64)
            if not len(many):
                continue
            flat = np.concatenate(each) + np.repeat(first, many)[:, None]
            cols = (np.repeat(k1, many), np.repeat(k2, many), flat[:, 0], flat[:, 1])
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in cols], names=["k1", "k2", "begin", "end"])

    joined = places.join(found, ["anchor", "digest"]).select("k1", "k2", "first", "size", "spans")
    flat = joined.mapInArrow(absolute, "k1 long, k2 long, begin long, end long")
    return flat.groupBy("k1", "k2").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))  # of one document


def remove(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of a text without the spans, the bytes removed and the number of maximal removed runs."""
    kept, at, removed, runs, end = [], 0, 0, 0, -1
    for lo, hi in sorted(spans):
        if lo > end:
            runs += 1
            kept.append(text[at:lo])
            removed += hi - lo
            at = end = hi
        elif hi > end:
            removed += hi - end
            at = end = hi
    kept.append(text[at:])
    return b"".join(kept), removed, runs


def repeated_spans(
    spark: SparkSession, docs: DataFrame, text_col: str = "text", length: int = LENGTH, seed: int = SEED, words: bool = False
) -> tuple[DataFrame, DataFrame]:
    """``docs`` with content keys, and (k1, k2, spans): every byte covered by a ``length``-byte string that starts at two places
    or more, in one text or in several. ``seed``, at most ``length``, is the size of the strings that anchor the windows.
    With ``words`` both count words, and the spans are those of ``word_strings``."""
    if not 0 < seed <= length:
        raise ValueError("the anchoring string must lie in the window")
    keyed = _keyed(docs, text_col)
    step = WORD if words else 1
    length, seed = length * step, seed * step
    runs = cm.written(run_table(keyed, length, seed, step, words), "suffix-runs")
    distinct = cm.written(distinct_runs(runs), "suffix-distinct")
    shared = cm.written(shared_spans(keyed, distinct, length, step=step, words=words), "suffix-shared")
    spans = cm.written(covered_spans(runs, distinct, shared), "suffix-spans")
    cm.discard(runs, distinct, shared)
    return keyed, spans


def dedup(
    spark: SparkSession, docs: DataFrame, columns: list[str], text_col: str = "text", texts: bool = False,
    length: int = LENGTH, seed: int = SEED, words: int | None = None, tell: bool = False,
) -> DataFrame:
    """``columns`` of every row of ``docs`` with n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 of the bytes that
    are left; with ``texts`` also these as ``kept_text`` (bytes that a cut leaves of a character go too).

    Repeated strings of ``length`` bytes go and, if ``words`` is given, repeated strings of so many words, with all that
    stands between the words; these also give n_passages (their maximal runs in the text) and passage_bytes. With ``tell``
    strings of words are only told in these two columns and stay. Texts are taken as UTF-8, null as empty; texts shorter than the window lose nothing, repeated
    rows lose what they share like any other copies, and all strings are judged on the input: no copy is kept. Names of
    ``columns`` may clash with the added ones; then the result has them twice."""
    keyed, spans = repeated_spans(spark, docs, text_col, length, seed)
    if words:
        by_words = repeated_spans(spark, docs, text_col, words, min(WORD_SEED, words), words=True)[1]
        spans = spans.join(by_words.withColumnRenamed("spans", "word_spans"), ["k1", "k2"], "full")
    else:
        spans = spans.withColumn("word_spans", F.lit(None).cast(spans.schema["spans"].dataType))
    own = [f"c{i}" for i in range(len(columns))]
    left = keyed.select(*(F.col(f"`{c}`").alias(o) for c, o in zip(columns, own)), "__text", "__k1", "__k2")
    joined = left.join(spans, (left["__k1"] == spans["k1"]) & (left["__k2"] == spans["k2"]), "left").select(*own, "__text", "spans", "word_spans")
    added = [("n_bytes", LongType()), ("n_removed", LongType()), ("n_spans", LongType()), ("kept_sha256", StringType())]
    added += [("kept_text", StringType())] if texts else []
    added += [("n_passages", LongType()), ("passage_bytes", LongType())] if words else []
    schema = StructType([StructField(o, docs.schema[c].dataType) for o, c in zip(own, columns)] + [StructField(n, t) for n, t in added])

    def cut(batches):
        for block in cm.text_blocks(batches, "__text"):
            part, raw = block.rows, list(block.texts())
            begin, end, bounds = spans_of(part.column("spans"))
            spans, at = list(zip(begin.tolist(), end.tolist())), bounds.tolist()
            begin, end, bounds = spans_of(part.column("word_spans"))
            by_words, of_words = list(zip(*(x.tolist() for x in in_bytes(raw, begin, end, bounds)))), bounds.tolist()
            rows = []
            for i, text in enumerate(raw):
                found, named = spans[at[i] : at[i + 1]], by_words[of_words[i] : of_words[i + 1]]
                kept, removed, runs = remove(text, found if tell else found + named)
                row = [len(text), removed, runs, hashlib.sha256(kept).hexdigest()]
                row += [kept.decode("utf-8", "ignore")] if texts else []
                row += remove(text, named)[:0:-1] if words else []
                rows.append(row)
            kinds = [pa.string() if isinstance(t, StringType) else pa.int64() for _, t in added]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(i) for i in range(len(own))), *(pa.array(x, t) for x, t in zip(zip(*rows), kinds))], names=schema.names
            )

    return joined.mapInArrow(cut, schema).toDF(*columns, *(n for n, _ in added))
