"""The registered queries of this subpackage: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm import bpe_codec, chat_format, crf_langid, divergence_rules, latent_decontam, licenses, link_trust, periodic_runs, prefix_trie, prob_minhash, quality_lm, token_counts, warc
from mosaiq.llm.common import shared_dir, table

Query = Callable[[SparkSession, str], DataFrame]


def byte_vocabulary() -> str:
    """The vocabulary file of the byte-level tokenizer, where the machines have it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), byte_vocabulary())


def op2_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lm.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark) + "/warc"
    warc.write(table(spark, sf_dir, "pages"), path)
    read = warc.read(spark, path)
    number = lambda c: F.col(c).cast("long").alias(c)
    sound = F.when(F.col("problem").isNull(), F.col("payload_digest")).alias("payload_digest")
    return read.select(number("page_id"), "payload_bytes", sound, "record_type", number("refers_to"), "n_segments", "problem")


def op4_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prob_minhash.classes(table(spark, sf_dir, "documents"))


def op5_crf_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf_langid.identify(table(spark, sf_dir, "documents"))


def op6_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = divergence_rules.judged(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_latent_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latent_decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_trust.judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digests(table(spark, sf_dir, "documents"), byte_vocabulary())


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.shared_beginnings(table(spark, sf_dir, "conversations"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find(periodic_runs.planted(table(spark, sf_dir, "documents"))).withColumn("best", periodic_runs.strongest())
    line = lambda x: F.concat_ws(",", x["start"], x["length"], x["period"])
    lines = F.array_join(F.transform("runs", lambda x: F.concat(line(x), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = chat_format.read_conversations(chat_format.format_conversations(chat_format.hostile(table(spark, sf_dir, "conversations"))))
    joined = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    learnt = F.array_join("learnt", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        "formatted_chars",
    )


QUERIES: dict[str, Query] = {
    "op1_token_counts": op1_token_counts,
    "op2_quality_lm": op2_quality_lm,
    "op3_warc": op3_warc,
    "op4_prob_minhash": op4_prob_minhash,
    "op5_crf_langid": op5_crf_langid,
    "op6_divergence_rules": op6_divergence_rules,
    "op7_licenses": op7_licenses,
    "op8_latent_decontam": op8_latent_decontam,
    "op9_link_trust": op9_link_trust,
    "op10_bpe_codec": op10_bpe_codec,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_chat_format": op13_chat_format,
}

ORACLE: dict[str, str] = {
    "op3_warc": warc.oracle_sql(),
    "op6_divergence_rules": divergence_rules.oracle_sql(),
    "op7_licenses": licenses.oracle_sql(),
    "op9_link_trust": link_trust.oracle_sql(),
    "op11_prefix_trie": prefix_trie.oracle_sql(),
    "op13_chat_format": chat_format.oracle_sql(),
}
