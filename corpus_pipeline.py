"""A corpus from raw documents to token ids: language, quality, near duplicates, benchmark leaks, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mosaiq.llm import bpe_codec, crf_langid, latent_decontam, prob_minhash, quality_lm
from mosaiq.llm.common import lasting, scratch, table
from mosaiq.llm.queries import byte_vocabulary

#: A document whose words share no language this far is rejected.
LEAST_LANGUAGE_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: not ``und``, and not below the least score.

    Row by row: null and repeated ids and further columns do not matter; null texts and texts without a letter go."""
    return crf_langid.with_language(docs, LEAST_LANGUAGE_SCORE)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity their language's threshold admits.

    Each row by its own text, also where its id is null or repeated; null and blank texts go."""
    return quality_lm.kept_rows(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near copies.

    Rows with a null id stay; of rows with one id that with the least text is taken.  Null and blank texts are alike to none."""
    return prob_minhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item.

    Rows with a null id stay, as no leak is told of them; all rows of an id go if one of them leaks."""
    return latent_decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, row by row; a null text counts as empty."""
    return bpe_codec.digests(docs, byte_vocabulary())


STAGES = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: No stage but the last could be told in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again before the next, and what the stage wrote on the way
    to it goes."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch(spark):
            docs = lasting(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
