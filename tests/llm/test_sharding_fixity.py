from collections import Counter

import pytest
from pyspark.sql import functions as F

from canvass.llm import fixity, sharding
from tests.llm.helpers import documents


def by_turns(shards, slots):
    """The table with every shard's whole order of preference written out."""
    import hashlib

    orders = []
    for s in shards:
        d = hashlib.sha256(s.encode()).digest()
        first, step = int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:16], "big") % (slots - 1) + 1
        orders.append([(first + k * step) % slots for k in range(slots)])
    owner = {}
    while len(owner) < slots:
        for s, order in enumerate(orders):
            free = [x for x in order if x not in owner]
            if free:
                owner[free[0]] = s
    return [owner[i] for i in range(slots)]


@pytest.mark.parametrize("n, slots", [(1, 2), (3, 13), (7, 101), (13, 13)])
def test_table_equals_turns(n, slots):
    names = [f"n{i}" for i in range(n)]
    table = sharding.lookup_table(names, slots)
    assert table == by_turns(names, slots)
    sizes = Counter(table)
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_few_slots_move_when_a_shard_goes():
    names = [f"n{i}" for i in range(20)]
    a, b = sharding.lookup_table(names, 5003), sharding.lookup_table(names[:-1], 5003)
    moved = sum(x != y for x, y in zip(a, b) if x != 19)
    assert moved < 0.15 * 5003


def test_bad_tables():
    for names, slots in (([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sharding.lookup_table(names, slots)


def test_placement(spark):
    df = documents(spark, ["x"] * 6, ids=[1, 1, 2, None, None, 3]).withColumnRenamed("lang", "slot")
    rows = sharding.place(spark, df, ["a", "b", "c"], slots=101, suffix="_new").collect()
    assert len(rows) == 6 and rows[0].__fields__[-2:] == ["slot_new", "shard_new"]
    owner = sharding.lookup_table(["a", "b", "c"], 101)
    assert all("abc"[owner[r.slot_new]] == r.shard_new for r in rows)
    assert len({r.shard_new for r in rows if r.doc_id == 1}) == 1 == len({r.shard_new for r in rows if r.doc_id is None})
    assert sharding.place(spark, df.limit(0), ["a"]).count() == 0


def replica(spark, rows):
    return spark.createDataFrame(rows, "file long, at long, record string")


def test_audit_names_each_damaged_record(spark, monkeypatch):
    monkeypatch.setattr(fixity, "RANGE", 64)
    monkeypatch.setattr(fixity, "FAN", 3)
    good = [(f, 20 * k, f"record {f} {k}") for f in range(3) for k in range(200)]
    bad = [r for r in good if r[:2] not in {(0, 0), (2, 3980)}]
    bad = [(f, a, "x" + t[1:]) if (f, a) in {(0, 1000), (1, 20)} else (f, a, t) for f, a, t in bad] + [(1, 7, "new"), (9, 0, "file")]
    got = {tuple(r) for r in fixity.audit(replica(spark, good), replica(spark, bad)).collect()}
    assert got == {(0, 0, "missing"), (2, 3980, "missing"), (0, 1000, "changed"), (1, 20, "changed"), (1, 7, "extra"), (9, 0, "extra")}


def test_audit_of_odd_replicas(spark):
    good = [(0, 0, "a"), (0, 5, None), (None, 1, "q"), (0, 9, "b"), (0, 9, "b")]
    assert fixity.audit(replica(spark, good), replica(spark, good[::-1])).count() == 0
    got = {tuple(r) for r in fixity.audit(replica(spark, good), replica(spark, good[:4])).collect()}
    assert got == {(0, 9, "changed")}
    empty = replica(spark, [])
    assert fixity.audit(empty, empty).count() == 0
    assert {tuple(r) for r in fixity.audit(replica(spark, good[:1]), empty).collect()} == {(0, 0, "missing")}


def test_archive_offsets_and_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<p>é</p>"), (1, "u", "<p>é</p>"), (None, None, None), (2, "v", "")], "page_id long, url string, html string")
    rows = fixity.archive(pages, file_bytes=300).orderBy("file", "at").collect()
    end = {}
    for r in rows:
        assert r["at"] == end.get(r.file, 0) and r.bytes == len(r.record.encode())
        end[r.file] = r["at"] + r.bytes
    assert len(rows) == 4 and len(end) > 1
    assert fixity.archive(pages.limit(0)).count() == 0


def test_pages_found_are_the_damaged_ones(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("u"), "id").alias("url"), F.repeat(F.lit("x"), 200).alias("html"))
    got = {(r.page_id, r.kind) for r in fixity.audit_pages(spark, pages).collect()}
    import hashlib

    draw = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % 97 for i in range(3000)}
    kinds = ["changed", "missing", "changed", "extra"]
    assert got == {(i, kinds[d]) for i, d in draw.items() if d < 4} and {k for _, k in got} == set(kinds)


def test_audit_of_no_pages_and_of_null_ids(spark):
    pages = spark.createDataFrame([(None, None, None)] * 3, "page_id long, url string, html string")
    assert fixity.audit_pages(spark, pages).count() in (0, 3)
    assert fixity.audit_pages(spark, pages.limit(0)).count() == 0
