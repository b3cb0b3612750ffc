from pyspark.sql import functions as F

from canvass.operators import multiselect as ms


def _cells(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, q string")


def test_three_missing_states(spark):
    df = _cells(spark, [None, "", "a;b", "None", "N/A"])
    long = ms.unfold_long(df, "id", ["q"]).orderBy("id", "value").collect()
    assert [(r.id, r.value) for r in long] == [(2, "a"), (2, "b"), (3, "None"), (4, "N/A")]
    flags = [r[0] for r in df.select(*ms.answered_flags(df, ["q"])).orderBy("id").collect()]
    assert flags == [False, True, True, True, True]


def test_duplicate_and_empty_tokens(spark):
    df = _cells(spark, ["a;b;a", "a;;b", ""])
    long = ms.unfold_long(df, "id", ["q"])
    per_id = {r.id: r.n for r in long.groupBy("id").agg(F.count("*").alias("n")).collect()}
    assert per_id == {0: 3, 1: 2}
    vocab = ms.collect_vocabulary(long)
    wide = ms.multihot(df, ["id"], vocab).orderBy("id").collect()
    assert [(r["q__a"], r["q__b"], r["q__answered"]) for r in wide] == [(1, 1, True), (1, 1, True), (0, 0, True)]


def test_untrimmed_tokens(spark):
    df = _cells(spark, ["a; b"])
    assert sorted(r.value for r in ms.unfold_long(df, "id", ["q"]).collect()) == [" b", "a"]


def test_multihot_sum_equals_deduplicated_long(spark):
    df = _cells(spark, ["x;y", "y;y;z", None, "", "x"])
    long = ms.unfold_long(df, "id", ["q"])
    vocab = ms.collect_vocabulary(long)
    wide = ms.multihot(df, ["id"], vocab)
    sums = wide.agg(*[F.sum(f"q__{t}").alias(t) for t in vocab["q"]]).first().asDict()
    dedup = {r.value: r.n for r in long.dropDuplicates(["id", "value"]).groupBy("value").agg(F.count("*").alias("n")).collect()}
    assert sums == dedup


def test_detect_multiselect(spark):
    df = spark.createDataFrame([("a;b", "x", None), ("c", "y", None)], "m string, s string, e string")
    got = {r.column_name: r.is_multiselect for r in ms.detect_multiselect(df).collect()}
    assert got == {"m": True, "s": False, "e": False}


def test_derived_set_check_finds_mismatch(spark):
    df = spark.createDataFrame(
        [(1, "a;b", "b;c", "b"), (2, "a", "a", "x"), (3, None, None, None), (4, "", "a", "")],
        "id long, h string, w string, both string",
    )
    r = ms.derived_set_check(df, "id", "h", "w", "both").first()
    assert (r.n_rows, r.n_match, r.n_mismatch) == (4, 3, 1)


def test_more_options_than_a_bit_word_and_odd_names(spark, monkeypatch):
    options = [f"o'{i}\\" for i in range(150)]
    rows = [(i, None if i % 7 == 0 else ";".join(options[k] for k in range(150) if (k * 31 + i) % 11 == 0)) for i in range(40)]
    df = spark.createDataFrame([*rows, (40, ""), (41, f"{options[3]};{options[3]};unknown")], "id long, `q.1` string")
    wide = {r["id"]: r for r in ms.multihot(df, ["id"], {"q.1": options}).collect()}
    for i, cell in [*rows, (40, ""), (41, f"{options[3]};unknown")]:
        tokens = set((cell or "").split(";"))
        assert wide[i]["q.1__answered"] == (cell is not None)
        assert [wide[i][f"q.1__{o}"] for o in options] == [int(o in tokens) for o in options]


def test_partitioned_files_follow_size_not_tasks(spark, tmp_path):
    import glob

    from canvass.sources import sinks

    rows = spark.range(0, 3000, 1, 40).selectExpr("id", "if(id % 3 = 0, 'hot', concat('q', id % 20)) AS question", "'v' AS value")
    back = sinks.parquet_roundtrip(rows, str(tmp_path / "long"), ["question"])
    assert sorted(back.collect()) == sorted(rows.collect())
    assert all(len(glob.glob(f"{d}/*.parquet")) <= 2 for d in glob.glob(str(tmp_path / "long/question=*")))
