"""The registered queries of the operators: each applies one with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from canvass.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn

    return register


def word_tokenizer() -> str:
    """The public tokenizer file of the packing query."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op10_best_fit_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from canvass.llm import packing

    return packing.pack_documents(spark, table(spark, sf_dir, "documents"), word_tokenizer())


@query("op1_suffix_array_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes are judged as removed; repeated strings of over 50 words, many of them shorter, are told beside."""
    from canvass.llm import suffix_dedup

    return suffix_dedup.dedup(spark, table(spark, sf_dir, "documents"), ["doc_id"], words=suffix_dedup.PASSAGE_WORDS, tell=True)


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, expected_severity, severity (0 to 3), p_toxic and is_toxic."""
    from pyspark.sql import functions as F

    from canvass.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic", flags=True)
    scored = toxicity.score(spark, docs, model, ["doc_id"])
    return scored.withColumn("is_toxic", F.col("p_toxic") >= toxicity.TOXIC)


@query("op3_ngram_jaccard_join")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from canvass.llm import ngram_join

    return ngram_join.join_groups(spark, table(spark, sf_dir, "documents"))


@query("op4_mixing_sources")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from canvass.llm import mixing

    return mixing.mix_words(table(spark, sf_dir, "documents"))


@query("op7_exact_top_k")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from canvass.llm import topk

    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(spark, vectors, vectors.filter("vec_id % 100 = 0"))


@query("op9_document_fingerprints")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from canvass.llm import fingerprint

    return fingerprint.fingerprint_edits(spark, table(spark, sf_dir, "documents"))


@query("op5_lm_scoring")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from canvass.llm import kneser_ney

    return kneser_ney.score_documents(spark, table(spark, sf_dir, "documents"))


@query("op6_sharding")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its slot and shard of 64, and its shard when the last one is gone."""
    from canvass.llm import sharding

    names = [f"shard-{i:03d}" for i in range(64)]
    docs = table(spark, sf_dir, "documents").select("doc_id")
    placed = sharding.place(spark, docs, names)
    return sharding.place(spark, placed, names[:-1], suffix="_after").drop("slot_after")


@query("op8_warc_fixity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from canvass.llm import fixity

    return fixity.audit_pages(spark, table(spark, sf_dir, "pages"))


@query("op11_importance_resampling")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from canvass.llm import importance

    out = importance.resample(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def byte_tokenizer() -> str:
    """The public tokenizer file of the second packing query."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op13_window_fit_packing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from canvass.llm import window_fit

    return window_fit.pack_documents(spark, table(spark, sf_dir, "documents"), byte_tokenizer())


@query("op12_phrase_collocations")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from canvass.llm import collocations

    return collocations.collocations(spark, table(spark, sf_dir, "documents"))
