"""Phrase collocations: frequent phrases of 2 to 5 words that occur together more often than their parts explain.

Counts come level by level. A phrase of n words can only reach ``LEAST`` if both its parts of n - 1 words do, so a level only counts the places where
the level before passed a filter (a bit table of fixed size made from that level's frequent phrases; what it lets through wrongly
is counted like the rest and dropped by its count). Level 1 is an aggregate over words. Pairs, which are by far the most, are first counted
by a short hash code only (sorted codes take some two bytes each; codes that pairs share count too much, never too little). The
stretches of pairs whose code reaches ``LEAST`` are written once, and levels 2 and up count those exactly.

At each level a task gathers its phrases, builds a count automaton of each range of prefixes (a hash of the first two words, so a frequent
first word is spread) and sends them; a range's automata are united, counts summed, and the frequent phrases written.
Counts of a candidate's parts are looked up by composing an automaton of the wanted parts with that of the counts, by ranges again;
a range that is asked for by many candidates is split, its counts copied.

A word's label is 64 bits of hash of language and word, so languages don't mix; equal labels count as equal words.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canvass.llm import common as cm
from canvass.llm import count_automata as ca

LONGEST = 5
#: Occurrences a phrase must have.
LEAST = 100
#: Rows of the report for each language.
TOP = 2000
#: Phrases that a task gathers before it builds automata.
GATHER = 1 << 21
#: Words of the corpus for each range of prefixes.
RANGE_WORDS = 1 << 18
#: A range's automata are united in between when they exceed so many bytes.
FOLD_BYTES = 1 << 26
#: Bits of a filter, at most: 32 MB to each worker.
FILTER_BITS = 28
#: Requests of a look-up group, on average at most.
ASKED = 20_000
SALTS = 64

_U = np.uint64
_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_WORD = ~_BREAK
_WORD[[9, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def spans(block: cm.TextBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word, and whether the next word follows it within the piece."""
    data = block.data
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, bool)
    word = _WORD[data]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    full = block.bounds[1:] > block.bounds[:-1]  # words don't cross rows
    first, last = block.bounds[:-1][full], block.bounds[1:][full] - 1
    begins[first] = word[first]
    ends[last] = word[last]
    start = np.flatnonzero(begins)
    row = cm.owners(np.searchsorted(start, block.bounds))
    breaks = np.cumsum(_BREAK[data])[start]
    follows = np.zeros(len(start), bool)
    follows[:-1] = (row[1:] == row[:-1]) & (breaks[1:] == breaks[:-1])
    return start, np.flatnonzero(ends) + 1, row, follows


def _language(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")


def labelled(block: cm.TextBlock):
    """Labels (never 0), start, end and row of the words, and whether the next one follows."""
    start, end, row, follows = spans(block)
    langs = pa.array(block.rows.column("lang")).dictionary_encode()
    seeds = np.array([_language(x) for x in langs.dictionary.to_pylist()], _U)
    own = seeds[langs.indices.to_numpy(zero_copy_only=False)] if len(seeds) else np.zeros(0, _U)
    labels = cm.mix64(block.span_hashes(start, end) + own[row])
    labels[labels == 0] = 1
    return labels, start, end, row, follows


def texts_of(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))


def word_counts(texts: DataFrame) -> DataFrame:
    """``label``, ``lang``, ``word`` and ``f`` of all words (lower-cased A-Z)."""

    def run(batches: Iterator[pa.RecordBatch]):
        for block in cm.text_blocks(batches, "text"):
            labels, start, end, row, _ = labelled(block)
            own, at, n = np.unique(labels, return_index=True, return_counts=True)
            size = (end - start)[at]
            bounds = np.concatenate([[0], np.cumsum(size)])
            raw = _LOWER[block.data[np.arange(bounds[-1]) + np.repeat(start[at] - bounds[:-1], size)]]
            words = cm.binaries(raw, bounds).cast(pa.string())
            langs = block.rows.column("lang").take(pa.array(row[at]))
            yield pa.RecordBatch.from_arrays([pa.array(cm.signed(own)), langs.cast(pa.string()), words, pa.array(n, pa.int64())], names=["label", "lang", "word", "f"])

    rows = texts.mapInArrow(run, "label long, lang string, word string, f long")
    return rows.groupBy("label", "lang", "word").agg(F.sum("f").alias("f"))


# ---- filters ----------------------------------------------------------------


def phrase_hash(labels: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n labels from each place on, for all places that have as many."""
    size = len(labels) - n + 1
    if size <= 0:
        return np.zeros(0, _U)
    out = labels[:size].copy()
    for k in range(1, n):
        out = cm.mix64(out * _U(0x9FB21C651E98DF25) + labels[k : k + size])
    return out


class Filter:
    """Two bits for each key of a table of ``2 ** width``: keys that were put in always pass, others seldom."""

    def __init__(self, bits: np.ndarray, width: int):
        self.bits, self.mask = bits, _U((1 << width) - 1)

    def passes(self, key: np.ndarray) -> np.ndarray:
        out = np.ones(len(key), bool)
        for place in (key & self.mask, (key >> _U(32)) & self.mask):
            out &= (self.bits[(place >> _U(3)).astype(np.int64)] >> (place & _U(7)).astype(np.uint8)) & 1 == 1
        return out


def make_filter(keys: DataFrame, n: int) -> Filter:
    """A filter of the ``key`` column (``n`` rows): about 16 bits a key, 2 ** ``FILTER_BITS`` at most."""
    width = min(FILTER_BITS, max(15, (16 * n).bit_length()))
    mask, page = (1 << width) - 1, 1 << 15
    places = F.array(F.col("key").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("key", 32).bitwiseAND(F.lit(mask)))
    pages = (
        keys.select(F.explode(places).alias("place"))
        .groupBy(F.shiftright("place", 15).alias("page"))
        .agg(F.bitmap_construct_agg(F.col("place").bitwiseAND(F.lit(page - 1))).alias("bits"))
    )
    bits = np.zeros((1 << width) // 8, np.uint8)
    for r in pages.collect():  # 2 ** (width - 15) rows at most
        bits[r["page"] * (page // 8) :][: page // 8] = np.frombuffer(r["bits"], np.uint8)
    return Filter(bits, width)


# ---- counting a level -------------------------------------------------------


def places(labels: np.ndarray, follows: np.ndarray, n: int, passed: Filter) -> np.ndarray:
    """Where phrases of n words start whose two parts of n - 1 words both pass."""
    size = len(labels) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64)
    ok = passed.passes(phrase_hash(labels, n - 1))
    ok = ok[:-1] & ok[1:]
    for k in range(n - 1):
        ok &= follows[k : k + size]
    return np.flatnonzero(ok)


def prefix_range(phrases: np.ndarray, bits: int) -> np.ndarray:
    if not bits:
        return np.zeros(len(phrases), np.int64)
    return (cm.mix64(phrases[:, 0] * _U(0xA0761D6478BD642F) + phrases[:, 1]) >> _U(64 - bits)).astype(np.int64)


def range_automata(phrases: np.ndarray, bits: int) -> pa.RecordBatch:
    """A count automaton of the phrases of each range of prefixes."""
    own = prefix_range(phrases, bits)
    order = np.argsort(own, kind="stable")
    phrases, own = phrases[order], own[order]
    edges = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
    blobs = [ca.build(phrases[i:j]).dump() for i, j in zip(edges, edges[1:])]
    return pa.RecordBatch.from_arrays([pa.array(own[edges[:-1]]), pa.array(blobs, pa.binary())], names=["range", "automaton"])


def gathered(chunks: Iterator[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for x in chunks:
        if len(x):
            held.append(x)
            n += len(x)
        if n >= GATHER:
            yield range_automata(np.concatenate(held), bits)
            held, n = [], 0
    if n:
        yield range_automata(np.concatenate(held), bits)


def _windows(labels: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    return labels[at[:, None] + np.arange(n)[None, :]]


def united(automata: DataFrame, n: int, least: int, name: str) -> DataFrame:
    """Frequent phrases of a level, from the automata of all tasks: ``phrase`` (labels, 8 bytes each, high byte first), ``key``, ``f``."""

    def emit(parts: list[ca.Automaton]) -> pa.RecordBatch:
        found, f = ca.phrases(parts, least)
        key = np.zeros(0, _U) if not len(found) else _keys(found)
        raw = cm.binaries(found.astype(">u8").reshape(-1).view("<u8"), np.arange(len(found) + 1) * n)
        return pa.RecordBatch.from_arrays([raw, pa.array(cm.signed(key)), pa.array(f, pa.int64())], names=["phrase", "key", "f"])

    def run(batches: Iterator[pa.RecordBatch]):
        current, parts, size = None, [], 0
        for batch in batches:
            for own, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                if own != current and parts:
                    yield emit(parts)
                    parts, size = [], 0
                current = own
                parts.append(ca.Automaton.load(raw.as_py()))
                size += len(raw.as_buffer())
                if size > FOLD_BYTES:
                    parts = [ca.union(parts)]
                    size = len(parts[0].dump()) // 2  # the next folding comes after as much again
        if parts:
            yield emit(parts)

    parts = cm.shuffle_width(automata.sparkSession)
    ranged = automata.repartition(parts, "range").sortWithinPartitions("range")
    return cm.written(ranged.mapInArrow(run, "phrase binary, key long, f long"), name)


def _keys(phrases: np.ndarray) -> np.ndarray:
    out = phrases[:, 0].copy()
    for k in range(1, phrases.shape[1]):
        out = cm.mix64(out * _U(0x9FB21C651E98DF25) + phrases[:, k])
    return out


def pack_codes(codes: np.ndarray, count: np.ndarray) -> bytes:
    """Ascending codes (of 32 bits) as differences, a plane for each of their bytes, and counts up to 255; compressed."""
    steps = np.diff(codes, prepend=np.zeros(1, _U)).astype("<u4")
    raw = steps.view(np.uint8).reshape(-1, 4).T.tobytes() + np.minimum(count, 255).astype(np.uint8).tobytes()
    return struct.pack("<I", len(codes)) + pa.compress(raw, "zstd", asbytes=True)


def unpack_codes(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    (n,) = struct.unpack_from("<I", blob)
    raw = np.frombuffer(pa.decompress(blob[4:], 5 * n, "zstd", asbytes=True), np.uint8)
    steps = np.ascontiguousarray(raw[: 4 * n].reshape(4, n).T).view("<u4").reshape(-1)
    return np.cumsum(steps, dtype=_U), raw[4 * n :].astype(np.int64)


def frequent_pair_codes(texts: DataFrame, passed, total: int, bits: int, least: int) -> tuple[DataFrame, int]:
    """``key`` of the hash codes that pairs of frequent words reach ``least`` times together, and the width of the codes: some
    hundred codes for each word of the corpus, so few pairs share one."""
    if least > 255:
        raise ValueError("counts of codes end at 255")
    width = min(bits + 32, total.bit_length() + 7)
    low = width - bits

    def run(batches: Iterator[pa.RecordBatch]):
        def rows(codes):
            own, n = np.unique(codes, return_counts=True)
            part = (own >> _U(low)).astype(np.int64)
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            blobs = [pack_codes(own[i:j] & _U((1 << low) - 1), n[i:j]) for i, j in zip(edges, edges[1:])]
            return pa.RecordBatch.from_arrays([pa.array(part[edges[:-1]]), pa.array(blobs, pa.binary())], names=["range", "codes"])

        held, n = [], 0
        for block in cm.text_blocks(batches, "text"):
            labels, _, _, _, follows = labelled(block)
            at = places(labels, follows, 2, passed.value)
            if len(at):
                held.append(phrase_hash(labels, 2)[at] >> _U(64 - width))
                n += len(at)
            if n >= 2 * GATHER:
                yield rows(np.concatenate(held))
                held, n = [], 0
        if n:
            yield rows(np.concatenate(held))

    def add(batches: Iterator[pa.RecordBatch]):
        for own, blobs in _by_range(batches):
            codes, counts = (np.concatenate(x) for x in zip(*map(unpack_codes, blobs)))
            codes, at = np.unique(codes, return_inverse=True)
            codes = codes[np.bincount(at, counts) >= least]
            keys = cm.mix64(codes | _U(own << low))
            yield pa.RecordBatch.from_arrays([pa.array(cm.signed(keys))], names=["key"])

    sent = texts.mapInArrow(run, "range long, codes binary")
    parts = cm.shuffle_width(texts.sparkSession)
    keys = sent.repartition(parts, "range").sortWithinPartitions("range").mapInArrow(add, "key long")
    return cm.written(keys, "collocation-codes"), width


def _by_range(batches: Iterator[pa.RecordBatch]):
    """(range, its blobs) of rows sorted by range."""
    current, blobs = None, []
    for batch in batches:
        for own, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            if own != current and blobs:
                yield current, blobs
                blobs = []
            current = own
            blobs.append(blob.as_py())
    if blobs:
        yield current, blobs


def stretches(texts: DataFrame, words, codes, width: int) -> DataFrame:
    """Stretches of 2 words and more, all frequent, whose neighbours' codes are frequent too: labels (8 bytes each), a 0 behind each stretch."""

    def run(batches: Iterator[pa.RecordBatch]):
        for block in cm.text_blocks(batches, "text"):
            labels, _, _, _, follows = labelled(block)
            at = places(labels, follows, 2, words.value)
            if not len(at):
                continue
            at = at[codes.value.passes(cm.mix64(phrase_hash(labels, 2)[at] >> _U(64 - width)))]
            pair = np.zeros(len(labels), bool)
            pair[at] = True
            held = pair | np.append(False, pair[:-1])
            ends = held & ~pair
            at = np.cumsum(held + ends.astype(np.int64)) - 1 - ends
            out = np.zeros(int(held.sum() + ends.sum()), "<u8")
            out[at[held]] = labels[held]
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["labels"])

    return texts.mapInArrow(run, "labels binary")


def level_automata(runs: DataFrame, passed, n: int, bits: int) -> DataFrame:
    """Automata of the phrases of n words in ``runs``; above 2 words of those whose parts pass."""

    def run(batches: Iterator[pa.RecordBatch]):
        def chunks():
            for batch in batches:
                for raw in batch.column(0):
                    labels = np.frombuffer(raw.as_py(), "<u8")
                    word = labels != 0
                    follows = np.append(word[:-1] & word[1:], False)
                    at = places(labels, follows, n, passed.value) if n > 2 else np.flatnonzero(follows)
                    yield _windows(labels, at, n)

        yield from gathered(chunks(), bits)

    return runs.mapInArrow(run, "range long, automaton binary")


def frequent_phrases(spark: SparkSession, texts: DataFrame, words: DataFrame, total: int, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """All phrases of 1 to ``longest`` words with a count of ``least`` or more: ``phrase``, ``n`` (words), ``f``."""
    bits = max(4, (total // RANGE_WORDS).bit_length())
    letter = F.unhex(F.lpad(F.hex("label"), 16, "0"))
    level = words.filter(F.col("f") >= least).select(letter.alias("phrase"), F.col("label").alias("key"), "f")
    out = level.select("phrase", F.lit(1).alias("n"), "f")
    runs = None
    for n in range(2, longest + 1):
        known = level.count()
        if not known:
            break
        passed = spark.sparkContext.broadcast(make_filter(level, known))
        if n == 2:
            keys, width = frequent_pair_codes(texts, passed, total, bits, least)
            codes = spark.sparkContext.broadcast(make_filter(keys, keys.count()))
            runs = cm.written(stretches(texts, passed, codes, width), "collocation-stretches")
        level = united(level_automata(runs, passed, n, bits), n, least, f"collocation-level{n}")
        out = out.unionByName(level.select("phrase", F.lit(n).alias("n"), "f"))
    return out


# ---- parts and scores -------------------------------------------------------


def part_counts(found: DataFrame) -> DataFrame:
    """For each phrase of 2 words and more and each cut: ``phrase``, ``n``, ``a``, ``k`` (words before the cut), ``left`` (whether the part before), ``part``
    and its count ``weight``. ``found``: a written table of ``frequent_phrases``."""
    groups = max(1, found.count() // ASKED)
    bucket = lambda c: F.pmod(F.xxhash64(F.substring(c, 1, 16)), F.lit(groups))
    cuts = found.filter("n > 1").select(F.col("phrase"), "n", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    both = cuts.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("left"))
    part = F.expr("CASE WHEN left THEN substring(phrase, 1, 8 * k) ELSE substring(phrase, 8 * k + 1, 8 * (n - k)) END")
    asked = both.withColumn("part", part).withColumn("m", F.expr("CASE WHEN left THEN k ELSE n - k END"))
    asked = asked.withColumn("bucket", bucket("part"))
    # a bucket that is asked for very often is dealt over several groups, its counts copied to each
    heat = asked.groupBy("m", "bucket").agg(F.least(F.lit(SALTS), F.ceil(F.count(F.lit(1)) / ASKED)).cast("int").alias("salts"))
    asked = asked.join(heat, ["m", "bucket"]).withColumn("salt", F.pmod(F.xxhash64("phrase", "k"), F.col("salts")).cast("int")).drop("salts")
    have = found.select(F.col("n").alias("m"), F.col("phrase").alias("known"), "f", bucket("phrase").alias("bucket")).join(heat, ["m", "bucket"])
    have = have.select("m", "bucket", "known", "f", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))

    def look_up(requests: pa.Table, counts: pa.Table) -> pa.Table:
        n = requests.num_rows
        weight = np.zeros(n, np.int64)
        if n and counts.num_rows:
            wanted, number = np.unique(_labels(requests["part"]), axis=0, return_inverse=True)
            asks = ca.build(wanted, np.arange(1, len(wanted) + 1))
            weight = ca.compose(asks, ca.build(_labels(counts["known"]), counts["f"].to_numpy()), len(wanted))[number.reshape(-1)]
        return pa.table([*(requests[c] for c in ("phrase", "n", "a", "k", "left", "part")), pa.array(weight)], names=["phrase", "n", "a", "k", "left", "part", "weight"])

    keys = ["m", "bucket", "salt"]
    return (
        asked.groupBy(*keys)
        .cogroup(have.groupBy(*keys))
        .applyInArrow(look_up, "phrase binary, n int, a long, k int, left boolean, part binary, weight long")
    )


def _labels(column: pa.ChunkedArray) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, ">u8").astype(_U).reshape(len(column), -1)


def collocations(
    spark: SparkSession, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, longest: int = LONGEST
) -> DataFrame:
    """The best phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    Null languages are ``und``; null and empty texts have no words; an empty table gives no rows. Repeated rows count as often as they
    occur. Only the two named columns are read, so others can't clash."""
    texts = texts_of(docs, text_col, lang_col)
    words = cm.written(word_counts(texts), "collocation-words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("total"))
    total = words.agg(F.sum("f")).first()[0] or 0
    found = cm.written(frequent_phrases(spark, texts, words, total, least, longest), "collocation-phrases")
    parts = cm.written(part_counts(found), "collocation-parts")

    # a candidate within one that is longer by a word and as frequent goes; longer ones still have such a one between
    whole = ((F.col("k") == 1) & ~F.col("left")) | ((F.col("k") == F.col("n") - 1) & F.col("left"))
    covered = parts.filter((F.col("n") > 2) & whole & (F.col("weight") == F.col("a"))).select(F.col("part").alias("phrase")).distinct()
    by_cut = [
        F.max(F.when((F.col("k") == k) & (F.col("left") if left else ~F.col("left")), F.col("weight"))).alias(f"{'l' if left else 'r'}{k}")
        for k in range(1, longest)
        for left in (True, False)
    ]
    wide = parts.groupBy("phrase", F.col("n").alias("words")).agg(F.max("a").alias("a"), *by_cut).join(covered, "phrase", "left_anti")

    letters = F.expr("transform(sequence(0, words - 1), i -> substring(phrase, 8 * i + 1, 8))")
    known = words.filter(F.col("f") >= least).select(F.unhex(F.lpad(F.hex("label"), 16, "0")).alias("letter"), "lang", "word")
    spelled = (
        wide.select("phrase", F.posexplode(letters).alias("i", "letter")).join(known, "letter")
        .groupBy("phrase")
        .agg(F.max("lang").alias("lang"), *(F.max(F.when(F.col("i") == i, F.col("word"))).alias(f"w{i}") for i in range(longest)))
        .select("phrase", "lang", F.concat_ws(" ", *(F.col(f"w{i}") for i in range(longest))).alias("spelled"))
    )
    rows = wide.join(spelled, "phrase").join(totals, "lang")
    scores = [
        F.expr(
            f"CASE WHEN words > {k} THEN named_struct('score', (CAST(a AS DECIMAL(18,0)) * CAST(total AS DECIMAL(18,0)) * 1000) "
            f"div (CAST(l{k} AS DECIMAL(18,0)) * CAST(r{k} AS DECIMAL(18,0))), 'k', {k}, 'l', l{k}, 'r', r{k}) END"
        )
        for k in range(1, longest)
    ]
    scored = rows.withColumn("cut", F.array_min(F.array(*scores))).select(
        "lang", F.col("spelled").alias("phrase"), "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("total").alias("n"), F.col("cut.score").alias("score")
    )
    # the first of each language from the first of its slices, so no task sorts a whole language
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    sliced = scored.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).filter(F.col("rank") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
