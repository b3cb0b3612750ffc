"""Mixing sources to target weights by weighted sampling without replacement (Efraimidis-Spirakis).

Each document gets the key -ln(u) / weight, u in (0, 1) from a hash of the row, weight its quality;
the documents with the smallest keys are a weighted sample without replacement. Within its source a
document's place is the sum of the sizes before it in key order. A source's target is taken as whole
epochs (each document once) and then a fraction: the documents in key order up to the rest of
the budget. All of it is DataFrame expressions.

No window holds a source: keys are cut into ``BUCKETS`` ranges, the budget's last range is found on
the table of range totals, and only that range is ranked row by row. So a source with a third of
all documents is summed by many tasks, and what is ranked at once is a 1/BUCKETS part of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canvass.llm import common as cm

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
BUCKETS = 4096
#: Up to so many rows (one for each source) are broadcast; beyond, sources are joined salted.
BROADCAST_ROWS = 50_000
SALTS = 64


def words_in(text: Column) -> Column:
    """Number of words of the whole text, 0 if null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column, size: Column) -> Column:
    """Weight of a document from its text: 1 to 2 with its length up to 1000 words, half of that
    when it doesn't end like a sentence. Null and empty texts weigh 0.5."""
    ends = F.coalesce(text.rlike(r"[.!?][\x20\x09-\x0D]*$"), F.lit(False))
    return (1.0 + F.least(size, F.lit(1000)) / 1000.0) * F.when(ends, 1.0).otherwise(0.5)


def sampling_key(doc_id: Column, text: Column, weight: Column, seed: str) -> tuple[Column, Column]:
    """The exponential key and a tie-break; both follow from the row's content, so reruns agree.
    Only rows with equal id and text share both."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(16**13)
    return -F.ln(u) / weight, F.substring(digest, 14, 19)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """``sizes``: (source, source_size), a row for each source. Adds ``target``.

    Sources by code point (null last) weigh ``weights`` in turn. Resharing the excess over ``most`` times a source's
    size until none is above ends where target = least(most * size, level * weight): sources are full
    in order of most * size / weight, and the level is what is left for the others by weight.
    The windows hold a row for each source, no more."""
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weigh = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn % len(weights) + 1).cast("int"))
    cap = most * F.col("source_size").cast("double")
    fullest = Window.orderBy(F.col("cap") / F.col("weight"), "turn")
    before = fullest.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        sizes.withColumn("turn", turn)
        .withColumn("weight", weigh)
        .withColumn("cap", cap)
        .withColumn("goal", share * F.sum("source_size").over(everything))
        .withColumn("left", F.col("goal") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("heft", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("full", F.col("cap") * F.col("heft") <= F.col("left") * F.col("weight"))
        .withColumn("level", F.when(~F.col("full"), F.col("left") / F.col("heft")))
    )
    first = F.max("level").over(everything)  # the first source that isn't full sets it; it falls for later ones
    return level.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(first * F.col("weight"))).select("source", "source_size", "target")


def _by_source(rows: DataFrame, per_source: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Join a small table to all rows: broadcast below a checked size, else salted, so a source with most rows is dealt to many tasks."""
    if n <= BROADCAST_ROWS:
        per_source = F.broadcast(per_source)
        salted = rows
    else:
        salted = rows.withColumn("__salt", F.pmod(F.xxhash64("__tie", "__key"), F.lit(SALTS)).cast("int"))
        per_source = per_source.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        keys = [*keys, "__salt"]
    on = [salted[k].eqNullSafe(per_source[k]) for k in keys]
    out = salted.join(per_source, on)
    for k in keys:
        out = out.drop(per_source[k])
    return out.drop("__salt")


def plan_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = "mix",
    weights=WEIGHTS,
    share: float = SHARE,
) -> DataFrame:
    """All rows and columns of ``docs``, each with ``__size`` (words), ``__source_size``, ``__target``, ``__epochs`` (times the
    whole source is taken) and ``__part`` (words taken in the fraction: all, some of the document at the cut,
    or none). Epochs and parts of a source add up to the whole words of its target, but for repeated equal rows at
    the cut, which share the rest evenly (rounded down).

    A null source is a source of its own, last in order. Null and empty texts have size 0 and take none. An
    empty table gives an empty result. ``docs`` is read twice (all columns only at the end)."""
    size = words_in(F.col(text_col))
    key, tie = sampling_key(F.col(id_col), F.col(text_col), F.col("__weight"), seed)
    rows = (
        docs.withColumn("__size", size)
        .withColumn("__weight", quality(F.col(text_col), F.col("__size")))
        .withColumn("__key", key)
        .withColumn("__tie", tie)
        .withColumn("source", F.col(source_col))
    )
    if source_col != "source":
        raise ValueError("rename the source column to 'source'")
    small = cm.written(rows.select("source", "__size", "__key", "__tie"), "mix-keys")
    bucket = F.least(F.floor((1.0 - F.exp(-F.col("__key"))) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    keyed = small.filter("__size > 0").withColumn("__bucket", bucket)
    ranges = cm.written(keyed.groupBy("source", "__bucket").agg(F.sum("__size").alias("words")), "mix-ranges")
    none = small.groupBy("source").agg(F.sum("__size").alias("source_size"))
    targets = source_targets(none).withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    )
    targets = cm.written(
        targets.withColumn("budget", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")), "mix-targets"
    )
    n = targets.count()
    # the range in which each source's budget ends
    before = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    running = ranges.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    budget = targets.select("source", "budget")
    last = (
        running.join(F.broadcast(budget) if n <= BROADCAST_ROWS else budget, running["source"].eqNullSafe(budget["source"]))
        .drop(budget["source"])
        .filter("before <= budget and budget < before + words")
        .select("source", "__bucket", "before", "budget")
    )
    # rank its rows; equal rows count as one step
    inside = _by_source(keyed, last, ["source", "__bucket"], n)
    step = inside.groupBy("source", "__key", "__tie").agg(
        F.sum("__size").alias("words"), F.count(F.lit(1)).alias("copies"), F.first("before").alias("before"), F.first("budget").alias("budget")
    )
    ranked = Window.partitionBy("source").orderBy("__key", "__tie").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        step.withColumn("begin", F.col("before") + F.coalesce(F.sum("words").over(ranked), F.lit(0)))
        .filter("begin <= budget and budget < begin + words")
        .select("source", F.col("__key").alias("cut_key"), F.col("__tie").alias("cut_tie"), F.expr("(budget - begin) div copies").alias("cut_part"))
    )
    # without a cut the budget is 0 or everything; it is below the source's size, so 0 words
    goal = targets.join(cut, targets["source"].eqNullSafe(cut["source"]), "left").drop(cut["source"])
    goal = goal.select("source", *(F.col(c).alias("__" + c) for c in goal.columns if c != "source"))
    out = _by_source(rows, cm.written(goal, "mix-goals"), ["source"], n)
    at = F.col("__key") == F.col("__cut_key")
    earlier = (F.col("__key") < F.col("__cut_key")) | (at & (F.col("__tie") < F.col("__cut_tie")))
    at = at & (F.col("__tie") == F.col("__cut_tie"))
    part = F.when(F.col("__cut_key").isNull(), 0).when(earlier, F.col("__size")).when(at, F.least("__cut_part", "__size")).otherwise(0)
    return out.select(*docs.columns, "__size", "__source_size", "__target", "__epochs", part.cast("long").alias("__part"))


def mix_words(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row: how many of its words the mix takes, repeats counted."""
    taken = F.col("__epochs") * F.col("__size") + F.col("__part")
    return plan_mix(docs, **options).select(
        "doc_id",
        "source",
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        taken.cast("long").alias("taken"),
    )


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves: whole rows, each as often as the mix takes it. The document at a
    source's cut is taken whole if the budget reaches at least half of it. Documents without words
    go with the epochs alone."""
    copies = F.col("__epochs") + F.when((F.col("__part") > 0) & (2 * F.col("__part") >= F.col("__size")), 1).otherwise(0)
    planned = plan_mix(docs, **options).withColumn("__copies", copies.cast("int")).filter("__copies > 0")
    return planned.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)
