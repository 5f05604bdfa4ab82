"""Quality by the perplexity of an interpolated modified Kneser-Ney model of character 4-grams.

The model is trained on the whole trusted text (documents that labels call good and not toxic) and kept as sharded
tables of counts: 4-grams, continuation counts of the lower orders, and context totals.  A block is a set of
documents dealt by a hash of their ids.  Each block asks once for each distinct 4-gram of its texts, so the count
joins run over distinct 4-grams of blocks, not over characters; the answers, one log probability for each, meet the
block's texts again, and every whole text gets its perplexity.

The mean of few log probabilities is noisy, so a perplexity is first divided by exp(slack / sqrt(n)), n the number of
4-grams.  A document is kept if this is at most the threshold of its language: a high quantile of the trusted documents'
in that language times a margin (of all trusted documents, where a language has fewer than ``min_trusted``).  Null texts and texts without a character other than white space are not kept, and their perplexity
is null.  Without any trusted text nothing else is rejected.  Rows with equal ids are scored one by one; rows with a
null id are never trusted.  Control characters count as spaces; characters beyond the basic plane are folded onto the
private-use area.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import block_count, free_memory, freed, lasting, materialise, released_shuffles, row_key, scratch, small, text_bytes

ORDER = 4
BEGIN, END = "\x01", "\x02"
PIECE = 1_000_000


@dataclass(frozen=True)
class Limits:
    quantile: float = 0.995
    margin: float = 1.1
    slack: float = 5.0
    min_trusted: int = 20
    block_bytes: int = 8_000_000


def packed_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 4-grams of texts padded with begin marks and one end mark, as four 16-bit units, and the text of each."""
    padded = [BEGIN * (ORDER - 1) + t.replace(BEGIN, " ").replace(END, " ") + END for t in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where((codes < 0x20) & (codes > 2), 0x20, codes)
    codes = np.where(codes > 0xFFFF, 0xE000 + codes % 0x1900, codes).astype(np.uint64)
    if len(codes) < ORDER:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = codes[:-3] << np.uint64(48) | codes[1:-2] << np.uint64(32) | codes[2:-1] << np.uint64(16) | codes[3:]
    row = np.repeat(np.arange(len(padded)), [len(p) for p in padded])[ORDER - 1 :]
    real = codes[3:] != 1
    return grams[real].view(np.int64), row[real]


def _pieces(texts: list[str]):
    """Runs of texts of about PIECE characters: first, end."""
    a, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t)
        if chars >= PIECE:
            yield a, i + 1
            a, chars = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def _dealt(docs: DataFrame, trusted: DataFrame, blocks: int, id_column: str, text: str, lang: str) -> tuple[DataFrame, DataFrame]:
    key = lambda c, t: F.pmod(row_key(c, t), F.lit(blocks)).cast("int")
    dealt = docs.select(key(F.col(id_column), F.col(text)).alias("block"), F.col(id_column).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    return dealt.mapInArrow(freed(_bundles), "block int, bundle binary"), trusted.select(key(F.col("doc_id"), F.lit(None).cast("string")).alias("block"), "doc_id")


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each block in a batch as one compressed Arrow stream: the shuffle moves less than half of the text."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in batches:
        block = batch.column(0).to_numpy()
        order = np.argsort(block, kind="stable")
        rows = pa.Table.from_batches([batch]).drop_columns(["block"]).take(pa.array(order))
        found, at = np.unique(block[order], return_index=True)
        bundles = []
        for a, z in zip(at.tolist(), [*at.tolist()[1:], len(order)], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=options) as writer:
                writer.write_table(rows.slice(a, z - a))
            bundles.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(bundles, pa.binary())], names=["block", "bundle"])


def _unbundled(bundles: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(b.as_py()).read_all() for b in bundles["bundle"]])


def asked_grams(dealt: DataFrame, trusted: DataFrame) -> DataFrame:
    """``block``, ``gram``, ``trusted``: distinct 4-grams of each block, and how often its trusted texts have each."""

    def run(texts: pa.Table, good: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table({"block": pa.array([], pa.int32()), "gram": pa.array([], pa.int64()), "trusted": pa.array([], pa.int64())})
        block = np.int32(texts["block"][0].as_py())
        texts = _unbundled(texts)
        ids, good_ids = texts["doc_id"].to_pylist(), set(good["doc_id"].to_pylist())
        strings = [t or "" for t in texts["text"].to_pylist()]
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        for a, z in _pieces(strings):
            grams, row = packed_grams(strings[a:z])
            weight = np.array([i is not None and i in good_ids for i in ids[a:z]])[row]
            unique, inverse = np.unique(grams, return_inverse=True)
            kept.append((unique, np.bincount(inverse, weight, len(unique))))
        free_memory()
        grams, inverse = np.unique(np.concatenate([k[0] for k in kept]), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([k[1] for k in kept]), len(grams)).astype(np.int64)
        return pa.table({"block": np.full(len(grams), block), "gram": grams, "trusted": counts})

    return dealt.groupBy("block").cogroup(trusted.groupBy("block")).applyInArrow(run, "block int, gram long, trusted long")


def _mask(order: int) -> int:
    return (1 << 16 * order) - 1


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from the counts of counts 1 to 4."""
    n = [r or 0 for r in counts.agg(*[F.sum((F.col("c") == k).cast("long")).alias(f"n{k}") for k in range(1, 5)]).first()]
    if min(n) == 0:
        return 0.5, 0.75, 0.9
    y = n[0] / (n[0] + 2 * n[1])
    found = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), found, strict=True))


def log_probabilities(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """``gram``, ``logp`` for each of the asked 4-grams; counts has ``gram``, ``c`` of the trusted text."""
    level = materialise(counts.select(F.col("gram").alias("g"), "c"))
    levels = {ORDER: level}
    for order in range(ORDER - 1, 0, -1):  # continuation counts: distinct left neighbours
        level = materialise(level.groupBy(F.col("g").bitwiseAND(F.lit(_mask(order))).alias("g")).agg(F.count(F.lit(1)).alias("c")))
        levels[order] = level
    d = {order: discounts(level) for order, level in levels.items()}
    off = lambda c, o: F.when(c >= 3, d[o][2]).when(c == 2, d[o][1]).when(c == 1, d[o][0]).otherwise(0.0)
    total, kinds, n1, n2 = levels[1].agg(F.sum("c"), F.count(F.lit(1)), F.sum((F.col("c") == 1).cast("long")), F.sum((F.col("c") == 2).cast("long"))).first()
    if not kinds:
        return asked.select("gram", F.lit(None).cast("double").alias("logp"))
    left = (d[1][0] * n1 + d[1][1] * n2 + d[1][2] * (kinds - n1 - n2)) / total

    out = asked.select("gram")
    for order in range(1, ORDER + 1):
        part = levels[order].select(F.col("g").alias(f"g{order}"), F.col("c").alias(f"c{order}"))
        out = out.withColumn(f"g{order}", F.col("gram").bitwiseAND(F.lit(_mask(order))) if order < ORDER else F.col("gram")).join(part, f"g{order}", "left")
        c = F.coalesce(f"c{order}", F.lit(0))
        if order == 1:
            out = out.withColumn("p", (c - off(c, 1)) / total + left / (kinds + 1))
        else:
            context = levels[order].groupBy(F.shiftrightunsigned("g", 16).alias(f"x{order}")).agg(F.sum("c").alias("s"), *[F.sum(hit.cast("long")).alias(f"n{k}") for k, hit in ((1, F.col("c") == 1), (2, F.col("c") == 2), (3, F.col("c") >= 3))])
            out = out.withColumn(f"x{order}", F.shiftrightunsigned(f"g{order}", 16)).join(context, f"x{order}", "left")
            gamma = (d[order][0] * F.col("n1") + d[order][1] * F.col("n2") + d[order][2] * F.col("n3")) / F.col("s")
            out = out.withColumn("p", F.when(F.col("s").isNull(), F.col("p")).otherwise((c - off(c, order)) / F.col("s") + gamma * F.col("p")))
        out = out.select("gram", "p")
    return out.select("gram", F.log("p").alias("logp"))


def scored(dealt: DataFrame, answers: DataFrame, kind: str) -> DataFrame:
    """``doc_id`` (of this kind), ``lang``, ``text_hash``, ``n_grams`` (0 for a blank text), ``logp`` (sum) of each document;
    answers has ``block``, ``gram``, ``logp``."""

    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        texts = _unbundled(texts)
        strings = [t or "" for t in texts["text"].to_pylist()]
        grams, logp = known["gram"].to_numpy(), known["logp"].to_numpy(zero_copy_only=False)
        order = np.argsort(grams)
        grams, logp = grams[order], logp[order]
        counts, sums = np.zeros(len(strings), np.int64), np.zeros(len(strings))
        for a, z in _pieces(strings):
            asked, row = packed_grams(strings[a:z])
            counts[a:z] = np.bincount(row, minlength=z - a)
            sums[a:z] = np.bincount(row, logp[np.searchsorted(grams, asked)], z - a)
        blank = np.array([not t.strip() for t in strings], bool)
        counts[blank] = 0
        free_memory()
        return pa.table({"doc_id": texts["doc_id"].combine_chunks(), "lang": texts["lang"].combine_chunks(), "text_hash": texts["text_hash"].combine_chunks(), "n_grams": counts, "logp": pa.array(sums, pa.float64(), mask=blank | np.isnan(sums))})

    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, f"doc_id {kind}, lang string, text_hash long, n_grams long, logp double")


def perplexities(docs: DataFrame, trusted: DataFrame, limits: Limits = Limits(), id_column: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id``, ``lang``, ``text_hash``, ``n_grams``, ``perplexity`` (a written table); trusted has the ``doc_id`` of good documents."""
    spark = docs.sparkSession
    with released_shuffles(spark), scratch(spark):
        blocks = block_count(text_bytes(docs, text), limits.block_bytes)
        dealt, good = _dealt(docs, trusted, blocks, id_column, text, lang)
        asked = materialise(asked_grams(dealt, good))
        counts = asked.filter("trusted > 0").groupBy("gram").agg(F.sum("trusted").alias("c"))
        known = materialise(log_probabilities(counts, asked.select("gram").distinct()))
        answers = asked.select("block", "gram").join(known, "gram")
        return lasting(scored(dealt, answers, docs.schema[id_column].dataType.simpleString()).select("doc_id", "lang", "text_hash", "n_grams", F.exp(-F.col("logp") / F.nullif("n_grams", F.lit(0))).alias("perplexity")))


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()


def judged(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``doc_id``, ``lang``, ``text_hash``, ``n_grams``, ``perplexity``, ``adjusted``, ``threshold``, ``kept`` of every document."""
    trusted = trusted_ids(labels)
    scores = perplexities(docs, trusted, limits)
    scores = scores.withColumn("adjusted", F.col("perplexity") * F.exp(-limits.slack / F.sqrt(F.nullif("n_grams", F.lit(0)))))
    good = scores.filter("perplexity is not null").join(trusted, "doc_id", "left_semi")
    quantile = F.percentile_approx("adjusted", limits.quantile, 10_000)
    by_language = good.filter("lang is not null").groupBy("lang").agg(quantile.alias("of_language"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= limits.min_trusted).drop("n")
    of_all = good.agg(quantile.alias("q")).first()["q"]
    threshold = F.coalesce("of_language", F.lit(of_all).cast("double")) * limits.margin
    by_language = small(by_language)
    out = scores.join(by_language, "lang", "left").withColumn("threshold", threshold)
    if of_all is None:
        return out.select("doc_id", "lang", "text_hash", "n_grams", "perplexity", "adjusted", "threshold", (F.col("n_grams") > 1).alias("kept"))
    return out.select("doc_id", "lang", "text_hash", "n_grams", "perplexity", "adjusted", "threshold", F.coalesce(F.col("adjusted") <= F.col("threshold"), F.lit(False)).alias("kept"))


def kept_rows(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows, all columns as they are, that ``judged`` keeps.  Rows of one id are told apart by language and text; equal
    ones, and those with a null id, have one verdict."""
    good = judged(docs, labels, limits).filter("kept").select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), F.col("text_hash").alias("_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("lang").eqNullSafe(F.col("_lang")) & (F.xxhash64("text") == F.col("_hash"))
    return docs.join(good, same, "left_semi").select(*docs.columns)
