import os
import tempfile

from canvass.sources import csv as csvsrc


def test_exact_na_token(spark):
    d = tempfile.mkdtemp(prefix="canvass-csv-")
    path = os.path.join(d, "raw.csv")
    with open(path, "w") as f:
        f.write('id,a,b\n1,NA,x\n2,,"y;z"\n3,"",None\n4,N/A,"NA"\n')
    df = csvsrc.read_exact_na(spark, path).orderBy("id").collect()
    assert [(r.a, r.b) for r in df] == [(None, "x"), ("", "y;z"), ("", "None"), ("N/A", None)]


def test_codebook_rules(spark):
    book = spark.createDataFrame(
        [("What <b>do</b> you   *use*? Select all", "Lang Have Worked with"),
         ("Plain", ""),
         ("Gone", "(dropped)")],
        "question string, column_raw string",
    )
    out = csvsrc.clean_codebook(book).collect()
    assert [(r.column_silver, r.question_clean) for r in out] == [("LangHaveWorkedWith", "What do you use?")]


def test_gzip_fallback(spark):
    import gzip

    d = tempfile.mkdtemp(prefix="canvass-gz-")
    with gzip.open(os.path.join(d, "raw.csv.gz"), "wt") as f:
        f.write('id,a\n1,NA\n2,""\n3,x\n')
    path = csvsrc.resolve_raw_path(spark, os.path.join(d, "raw.csv"))
    assert path.endswith(".gz")
    rows = csvsrc.read_exact_na(spark, path, partitions=2).orderBy("id").collect()
    assert [r.a for r in rows] == [None, "", "x"]
