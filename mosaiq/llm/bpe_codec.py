"""Encoding of documents to token ids and back, with digests of both.

Null texts count as empty: no ids, and the digests of the empty string.  Rows are handled one by one, so
repeated rows, ties and other columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mosaiq.llm import bpe, wordhash
from mosaiq.llm.common import freed


def encode(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``ids`` for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.load(vocabulary)
        for batch in batches:
            for a, z, data, offsets in wordhash.pieces(batch.column(1)):
                ids, bounds, _, _ = encoder.encode_rows(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), lists], names=[id_column, "ids"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text).mapInArrow(freed(run), f"`{id_column}` {kind}, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str, id_column: str = "doc_id") -> DataFrame:
    """``text`` for each list of ids; null for a null list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.load(vocabulary)
        for batch in batches:
            texts = [None if x is None else encoder.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_column, "text"])

    kind = encoded.schema[id_column].dataType.simpleString()
    return encoded.select(id_column, "ids").mapInArrow(freed(run), f"`{id_column}` {kind}, text string")


def digests(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode each text, decode its ids, and return counts and SHA-256 digests of both."""

    def hexed(flat: np.ndarray, bounds: np.ndarray, without: int) -> list[str]:
        raw = memoryview(flat)
        return [hashlib.sha256(raw[a : max(a, z - without)]).hexdigest() for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.load(vocabulary)
        for batch in batches:
            for a, z, data, offsets in wordhash.pieces(batch.column(1)):
                ids, bounds, back, ends = encoder.encode_rows(data, offsets)
                columns = [
                    batch.column(0).slice(a, z - a),
                    pa.array(np.diff(bounds), pa.int64()),
                    pa.array(hexed(*encoder.decimal_rows(ids, bounds), 1), pa.string()),
                    pa.array(hexed(back, ends, 0), pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[id_column, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text).mapInArrow(freed(run), f"`{id_column}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
