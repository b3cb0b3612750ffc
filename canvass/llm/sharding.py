"""Placing documents on shards by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a prime-sized table (an offset and a stride from
its name). The shards take turns; at its turn each claims the first free slot of its order, until all slots
are taken. A document's key hashes to a slot, whose owner is its shard. Shards get equal parts to within a
slot for each turn, and when a shard joins or leaves, few other slots change hands.
The table has a fixed size and is broadcast, so placing is one look-up without a shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots; a prime, at least a hundred times the shards for an even spread.
SLOTS = 65537


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The owner (place in ``shards``) of each slot. The result depends on the names and their order of turns only."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need different names, one at least")
    if not _prime(slots) or slots < len(shards):
        raise ValueError("the number of slots must be a prime, and no less than the shards")
    begin, stride = [], []
    for name in shards:
        digest = hashlib.sha256(name.encode()).digest()
        begin.append(int.from_bytes(digest[:8], "big") % slots)
        stride.append(int.from_bytes(digest[8:16], "big") % (slots - 1) + 1)  # a prime table makes any stride a permutation
    owner, at, taken = [-1] * slots, [0] * len(shards), 0
    while True:
        for s in range(len(shards)):
            slot = (begin[s] + at[s] * stride[s]) % slots
            while owner[slot] >= 0:
                at[s] += 1
                slot = (begin[s] + at[s] * stride[s]) % slots
            owner[slot] = s
            at[s] += 1
            taken += 1
            if taken == slots:
                return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 60 bits of its text's md5, modulo the slots. A null key counts as empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(spark: SparkSession, docs: DataFrame, shards: list[str], key: str = "doc_id", slots: int = SLOTS, suffix: str = "") -> DataFrame:
    """All rows and columns of ``docs`` with ``slot`` and ``shard`` (name; column names end in ``suffix``, which avoids clashes). Equal keys
    go to one shard; rows that repeat go with them. An empty table gives no rows."""
    owner = lookup_table(shards, slots)
    table = spark.createDataFrame([(i, shards[s]) for i, s in enumerate(owner)], "__slot int, __shard string")
    placed = docs.withColumn("__slot", slot_of(F.col(f"`{key}`"), slots)).join(F.broadcast(table), "__slot")  # slots rows
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return placed.select(*columns, F.col("__slot").alias("slot" + suffix), F.col("__shard").alias("shard" + suffix))
