"""From raw documents to packed sequences: five stages, each written and read again.

Every stage takes any columns besides doc_id, text and lang, and all but the last return all columns of
the rows that they keep. Null texts count as empty; an empty table gives no rows. Repeated rows are
judged alike by quality, language and decontamination, and are packed once each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirework.llm import bin_config, divergence, mixture_language, qgram_bands, shingle_join
from quirework.llm.registry import read
from quirework.session import configure, discard, fresh_dir

# A document whose largest language has a smaller share than this has no language of its own.
LEAST_LANGUAGE_SHARE = 0.4


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and resemble a language of the corpus (operator 1).

    Null, empty and short texts fail the base rule and go.
    """
    configure(spark)
    return divergence.keep(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which one of the labelled languages prevails (operator 5).

    Texts without a letter go; without any labelled language all go.
    """
    configure(spark)
    return mixture_language.keep(docs, mixture_language.learn(docs), LEAST_LANGUAGE_SHARE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles agree to four fifths (operator 8, checked exactly, and a join of shingle sets for what its radius misses).

    Of equal smallest ids the smallest set stays; texts without words are copies of each other.
    """
    configure(spark)
    return shingle_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark (operator 10); all stay if that is empty."""
    configure(spark)
    return qgram_bands.clean(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences (operator 6); an empty text is its end token."""
    configure(spark)
    return bin_config.packed(docs).withColumnRenamed("doc_key", "doc_id")


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

# Tokens, shingle hashes and likelihoods have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; the rows of the last one."""
    configure(spark)
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            discard(spark, before)
        before = path
    return docs
