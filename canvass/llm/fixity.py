"""Merkle fixity audit of web archives (WARC): find damaged records by comparing hash trees of two replicas.

A file's records are hashed; its byte offsets are cut into ranges of ``RANGE`` bytes, and a range's hash is that of the records
that begin in it, in order. ``FAN`` ranges make a node of the next level, up to one root for each file. The audit compares roots
first and then only the children of nodes that differ, so what is compared grows with the damage, not with the
archive. Only DataFrame functions; a node's group holds ``FAN`` children or a range's records, never more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canvass.llm import common as cm

RANGE = 1 << 16
FAN = 16
FILE_BYTES = 32 << 20


def record_text(page_id: Column, url: Column, html: Column) -> Column:
    """A page as the text of a WARC response record; nulls count as empty."""
    body = F.coalesce(html, F.lit(""))
    line = "\r\n"
    return F.concat(
        F.lit(f"WARC/1.1{line}WARC-Type: response{line}WARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(f">{line}WARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit(f"{line}Content-Length: "),
        F.octet_length(body).cast("string"),
        F.lit(line + line),
        body,
        F.lit(line + line),
    )


def lay_out(records: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Give the records of a written table (a column ``bytes``) their ``file`` and ``at``, the offset in it, and write that.

    Rows are dealt to files by their place in the table, so repeated rows or a frequent url don't swell a file. A
    file is laid out by one task; files hold about ``file_bytes`` each."""
    total = records.agg(F.sum("bytes")).first()[0] or 0
    files = max(1, -(-total // file_bytes))
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    rows = records.withColumn("row", F.monotonically_increasing_id()).withColumn("file", F.pmod(F.xxhash64("row"), F.lit(files)))
    placed = rows.withColumn("at", F.coalesce(F.sum("bytes").over(inside), F.lit(0)))
    return cm.written(placed.drop("row"), "warc-layout")


def archive(pages: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Pages as the records of archive files: (page_id, url, record, bytes, file, at)."""
    rows = pages.select("page_id", "url", record_text(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    return lay_out(cm.written(rows.withColumn("bytes", F.octet_length("record").cast("long")), "warc-records"), file_bytes)


def record_index(replica: DataFrame) -> DataFrame:
    """(file, at, bytes, digest) of a replica's records. Records with a null file or offset have no place and are left out."""
    return replica.filter("file is not null and at is not null").select(
        "file", "at", F.coalesce(F.octet_length("record"), F.lit(0)).cast("long").alias("bytes"), F.sha2(F.coalesce(F.col("record"), F.lit("")).cast("binary"), 256).alias("digest")
    )


def _hashed(children: Column) -> Column:
    return F.sha2(F.array_join(children, "\n").cast("binary"), 256)


def tree(index: DataFrame, name: str, levels: int) -> list[DataFrame]:
    """The nodes (file, node, hash) of each level, ranges first, one root for each file last."""
    ordered = F.array_sort(F.collect_list(F.struct("at", "bytes", "digest")))
    line = F.transform(ordered, lambda r: F.concat_ws(" ", r["at"].cast("string"), r["bytes"].cast("string"), r["digest"]))
    nodes = [index.groupBy("file", F.floor(F.col("at") / RANGE).alias("node")).agg(_hashed(line).alias("hash"))]
    nodes[0] = cm.written(nodes[0], f"{name}-0")
    for k in range(1, levels):
        own = F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda r: F.concat_ws(" ", r["node"].cast("string"), r["hash"]))
        up = nodes[-1].select("file", F.floor(F.col("node") / FAN).alias("up"), "node", "hash")
        nodes.append(cm.written(up.groupBy("file", F.col("up").alias("node")).agg(_hashed(own).alias("hash")), f"{name}-{k}"))
    return nodes


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Compare two replicas (file, at, record) by their indexes; see ``audit_indexes``."""
    return audit_indexes(record_index(a), record_index(b))


def audit_indexes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Compare the indexes (file, at, bytes, digest) of two replicas: (file, at, kind) of the records that differ; ``kind``: 'changed', 'missing' (only in
    ``a``) or 'extra' (only in ``b``). A record that repeats at a place is compared as often as it is there. Empty replicas give
    no rows, or all of the other's."""
    index = [cm.written(x.select("file", "at", "bytes", "digest"), f"warc-index-{n}") for x, n in ((a, "a"), (b, "b"))]
    top = max((i.agg(F.max("at")).first()[0] or 0) for i in index) // RANGE
    levels = 1
    while top:
        top //= FAN
        levels += 1
    trees = [tree(i, f"warc-tree-{n}", levels) for i, n in zip(index, "ab")]
    differ = None
    for k in range(levels - 1, -1, -1):
        left, right = trees[0][k], trees[1][k]
        if differ is not None:  # only below nodes that differ
            below = lambda t: t.withColumn("up", F.floor(F.col("node") / FAN)).join(differ, ["file", "up"], "left_semi")
            left, right = below(left), below(right)
        both = left.select("file", "node", F.col("hash").alias("x")).join(right.select("file", "node", F.col("hash").alias("y")), ["file", "node"], "full")
        level = both.filter(~F.col("x").eqNullSafe(F.col("y"))).select("file", F.col("node").alias("up"))
        differ = cm.written(level, f"warc-differ-{k}")
    inside = lambda i: i.withColumn("up", F.floor(F.col("at") / RANGE)).join(differ, ["file", "up"], "left_semi")
    counted = lambda i, n: inside(i).groupBy("file", "at", "bytes", "digest").agg(F.count(F.lit(1)).alias(n))
    places = counted(index[0], "na").join(counted(index[1], "nb"), ["file", "at", "bytes", "digest"], "full").fillna(0, ["na", "nb"])
    by_place = places.groupBy("file", "at").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"), F.max((F.col("na") != F.col("nb")).cast("int")).alias("off"))
    kind = F.when(F.col("nb") == 0, "missing").when(F.col("na") == 0, "extra").otherwise("changed")
    return by_place.filter("off = 1").select("file", "at", kind.alias("kind"))


#: A page in so many is damaged in one of four ways.
EVERY = 97


def draw(page_id: Column) -> Column:
    """A page's lot by a hash of its id: 0 changed, 1 lost, 2 cut short, 3 only in the replica; others are sound."""
    digest = F.md5(F.coalesce(page_id.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(EVERY))


def damage(page_id: Column, record: Column) -> Column:
    """A record as a poor disk returns it: for some pages with one character changed, without its last one, or null (lost)."""
    lot = draw(page_id)
    short = F.substring(record, F.lit(1), F.length(record) - 1)
    return F.when(lot == 0, F.concat(F.lit("X"), F.substring(record, 2, 1 << 30))).when(lot == 2, short).when(lot != 1, record)


def audit_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Lay the pages out as an archive, index it and a replica with damaged records, audit the two indexes, and name the
    pages found: (page_id, url, kind); a record that was cut short is changed. The texts are read once, hashed and not
    written again. Null ids are damaged as the empty text is; repeated rows share their fate; an empty table gives no rows."""
    record = record_text(F.col("page_id"), F.col("url"), F.col("html"))
    rows = pages.select("page_id", "url", record.alias("record")).withColumn("poor", damage(F.col("page_id"), F.col("record")))
    size = lambda c: F.octet_length(c).cast("long")
    hashed = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    rows = rows.select(
        "page_id", "url", size("record").alias("bytes"), hashed("record").alias("digest"), size("poor").alias("poor_bytes"), hashed("poor").alias("poor")
    )
    placed = lay_out(cm.written(rows, "warc-records"))
    original = placed.filter(draw(F.col("page_id")) != 3)
    replica = placed.filter("poor is not null").select("file", "at", F.col("poor_bytes").alias("bytes"), F.col("poor").alias("digest"))
    found = audit_indexes(original, replica)
    return placed.join(found, ["file", "at"]).select("page_id", "url", "kind")
