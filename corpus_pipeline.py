"""From raw ``documents`` to packed training sequences, in five stages of ``canvass.llm``.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; ``run`` writes each result as Parquet
and reads it again for the next. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm import common, mixing, ngram_join, packing, suffix_dedup, toxicity
from canvass.llm.queries import word_tokenizer


def _plain(docs: DataFrame) -> list[str]:
    """Names that no operator uses, for the columns of ``docs``."""
    return [f"c{i}" for i in range(len(docs.columns))]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity (op2): documents that are likelier toxic than not go. The grades are learned from the labelled documents. Null and empty
    texts stay; repeated rows share their fate; an empty table stays empty; columns of any names pass through."""
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"), "toxic", flags=True)
    return toxicity.keep_below(spark, docs, model)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (op3): of each group of near copies the document with the smallest id stays, of repeated rows one. Null and
    empty texts, and all without words, stay. Columns of any names pass through."""
    own = _plain(docs)
    at = dict(zip(docs.columns, own))
    return ngram_join.one_of_each(spark, docs.toDF(*own), at["doc_id"], at["text"]).toDF(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup (op1): passages of over 50 words, or of 400 bytes or more, that still occur twice are cut out of the texts.
    Documents of which nothing but white space is left by that go; others stay, null and empty texts among them. Extra columns may
    bear any names."""
    own = _plain(docs)
    text = own[docs.columns.index("text")]
    cut = suffix_dedup.dedup(spark, docs.toDF(*own), own, text_col=text, texts=True, words=suffix_dedup.PASSAGE_WORDS)
    changed = F.col("n_removed") > 0
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    kept = cut.filter(~changed | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.select(*(F.when(changed, new[c]).otherwise(F.col(o)).alias(c) if c in new else F.col(o).alias(c) for c, o in zip(docs.columns, own)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing (op4): whole documents, each as often as its source's target takes it. Documents without words go with whole epochs alone.
    The other columns travel as one, so their names can't clash with those of the plan."""
    read = ["doc_id", "text", "source"]
    others = [F.col(f"`{c}`") for c in docs.columns if c not in read]
    carried = docs.select(*read, F.struct(F.lit(0), *others).alias("row"))
    return mixing.mix_documents(carried).select(*(F.col(c if c in read else f"row.`{c}`") for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing (op10): the pieces of all documents in sequences of 2048 tokens. A null or empty text is one piece; repeated rows
    are packed each on its own; other columns aren't read."""
    return packing.pack_documents(spark, docs, word_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_of_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("mixing_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Learned grades, suffix arrays and a tokenizer are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
