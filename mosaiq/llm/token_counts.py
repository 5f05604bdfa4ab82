"""Exact length histogram of encoded documents.

Documents are aggregated by their encoded length.  Suffix sums over that histogram (not over documents)
answer, for every context limit at once: how many documents and tokens there are in all, how many documents
are longer, how many tokens remain when each document is cut at the limit, and all quantiles.

Null or empty texts have length 0.  An empty table gives an empty histogram.  Rows are counted as they come,
repeated ones too, and only the text column is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.llm import bpe, wordhash
from mosaiq.llm.common import freed, materialise

#: Lengths that share one block of the suffix sums.
BLOCK = 1024


def encoded_lengths(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """``length``: the number of ids of each text, one row for each document."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.load(vocabulary)
        for batch in batches:
            for _, _, data, offsets in wordhash.pieces(batch.column(0)):
                _, bounds, _, _ = encoder.encode_rows(data, offsets)
                yield pa.RecordBatch.from_arrays([pa.array(bounds[1:] - bounds[:-1], pa.int64())], names=["length"])

    return docs.select(text).mapInArrow(freed(lengths), "length long")


def histogram(lengths: DataFrame) -> DataFrame:
    """``length``, ``n_docs``: rows are summed in each task before the shuffle, so no length is hot."""
    return lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length that occurs, taken as a context limit L: documents and tokens of length L or more, tokens
    left when each document is cut at L, totals, and the share of documents of length L at most.

    Blocks of lengths are summed first; only one row for each block of 1,024 lengths meets in one task (as many
    as the longest text has thousands of tokens, however many documents there are).
    """
    hist = hist.withColumn("block", F.floor(F.col("length") / BLOCK))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum(F.col("n_docs") * F.col("length")).alias("b_tokens"))
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("b_docs").over(later), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("b_tokens").over(later), F.lit(0)).alias("later_tokens"),
        F.sum("b_docs").over(every).alias("total_docs"),
        F.sum("b_tokens").over(every).alias("total_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_least = hist.join(blocks, "block").select(
        "length",
        "n_docs",
        (F.col("later_docs") + F.sum("n_docs").over(inside)).alias("docs_at_least"),
        (F.col("later_tokens") + F.sum(F.col("n_docs") * F.col("length")).over(inside)).alias("tokens_at_least"),
        "total_docs",
        "total_tokens",
    )
    return at_least.select(
        "length",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("length")).alias("truncated_tokens"),
        "total_docs",
        "total_tokens",
        ((F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("total_docs")).alias("docs_share"),
    )


def truncated_totals(hist: DataFrame, limits: list[int]) -> DataFrame:
    """Tokens left at each of some context limits, which need not occur as lengths."""
    frame = hist.sparkSession.createDataFrame([(int(x),) for x in limits], "context_limit long")
    sums = [F.sum(F.least("length", F.lit(int(x))) * F.col("n_docs")).alias(str(x)) for x in limits]
    row = hist.agg(F.map_from_arrays(F.array(*[F.lit(int(x)) for x in limits]), F.array(*sums)).alias("m"))
    return frame.join(row.select(F.explode("m").alias("context_limit", "truncated_tokens")), "context_limit", "left").fillna(0)


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """The least length that at least a share of all documents does not exceed."""
    found = [F.min(F.when(F.col("docs_share") >= q, F.col("length"))).alias(str(i)) for i, q in enumerate(shares)]
    row = sums.agg(F.array(*[F.struct(F.lit(float(q)).alias("share"), c.alias("length")) for q, c in zip(shares, found, strict=True)]).alias("a"))
    return row.select(F.inline("a"))


def token_counts(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """Suffix sums over the written histogram, so that texts are encoded once."""
    return suffix_sums(materialise(histogram(encoded_lengths(docs, vocabulary, text))))
