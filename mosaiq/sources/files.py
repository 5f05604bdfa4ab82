"""Folders, readers and writers.

Folders are listed by Spark (names, sizes and times; contents are read only where they are asked for), so they can lie in any
file system that it reaches.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mosaiq.functions.names import has_extension
from mosaiq.operators.ranks import ranked


def listing(spark: SparkSession, folder: str, extensions: list[str] | None = None) -> DataFrame:
    """``file, directory, length, modified`` of every file below a folder; the directory is relative, "" for the folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", F.col("modificationTime").alias("modified"))
    tail = F.substring_index("path", _last(folder) + "/", -1)
    parts = F.split(tail, "/")
    out = files.select(F.element_at(parts, -1).alias("file"), F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("directory"), "length", "modified")
    return out if extensions is None else out.filter(has_extension(F.col("file"), extensions))


def _last(folder: str) -> str:
    return folder.rstrip("/").rsplit("/", 1)[-1]


def directory_ranks(files: DataFrame) -> DataFrame:
    """Files with ``rank``: d0, d1 ... by the order of their directories."""
    return files.join(ranked(files.select("directory").distinct(), ["directory"]).withColumn("rank", F.concat(F.lit("d"), F.col("rank").cast("string"))), "directory")


def preview(files: DataFrame, n: int, name: str = "file") -> DataFrame:
    """The first names, as a run would make them."""
    return files.select(name).orderBy(name).limit(n)


def total_size(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def by_size(files: DataFrame, limit: int) -> DataFrame:
    """Files with the path they take: ``small`` up to a limit of bytes, else ``large``."""
    return files.withColumn("route", F.when(F.col("length") <= limit, "small").otherwise("large"))


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Tables with a header line; without a schema types are inferred from all lines."""
    reader = spark.read.option("header", "true").option("multiLine", "false")
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", "true")).csv(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A table of numbers: what is none becomes null."""
    rows = spark.read.option("header", "true").csv(path)
    return rows.select(*[F.col(f"`{c}`").try_cast("double").alias(c) for c in rows.columns])


def read_documents(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON document in each line."""
    return spark.read.schema(schema).json(path)


def read_records(spark: SparkSession, path: str, tag: str, schema: StructType | str) -> DataFrame:
    """The XML elements of a name as rows."""
    return spark.read.schema(schema).option("rowTag", tag).format("xml").load(path)


def html_rows(html: Column) -> Column:
    """The rows of the tables of a page as arrays of the texts of their cells (header cells too)."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1))
    plain = lambda c: F.trim(F.replace(F.replace(F.replace(F.regexp_replace(c, r"(?s)<[^>]*>", ""), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&")))
    return F.transform(rows, lambda r: F.transform(cells(r), lambda c: plain(c)))


def arrow_files(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of Arrow files (also Feather of version 2) and streams below a path; columns are matched by name."""
    wanted = (StructType.fromDDL(schema) if isinstance(schema, str) else schema)
    names = wanted.fieldNames()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(wanted)
        for batch in batches:
            for content in batch.column(0):
                raw = pa.py_buffer(content.as_buffer())
                reader = pa.ipc.open_file(raw) if raw.to_pybytes()[:6] == b"ARROW1" else pa.ipc.open_stream(raw)
                for part in reader.read_all().select(names).cast(kinds).to_batches(max_chunksize=10_000):
                    yield part

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(rows, wanted)


def arrow_streams(df: DataFrame, rows_each: int = 100_000) -> DataFrame:
    """``part, content``: the rows as Arrow streams of bounded size, for a writer that stores bytes."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, part = [], 0, 0

        def out() -> pa.RecordBatch:
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, held[0].schema) as writer:
                for b in held:
                    writer.write_batch(b)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([sink.getvalue()], pa.binary())], names=["part", "content"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= rows_each:
                yield out()
                held, n, part = [], 0, part + 1
        if held:
            yield out()

    return df.mapInArrow(packed, "part int, content binary")


def write_arrow(df: DataFrame, folder: str) -> None:
    """Arrow files below a folder that all executors have mounted, each written under another name and then renamed, so a
    task that runs twice leaves one file."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import uuid

        from pyspark import TaskContext

        batches = iter(batches)
        first = next(batches, None)
        if first is not None:
            os.makedirs(folder, exist_ok=True)
            own = os.path.join(folder, f"part-{TaskContext.get().partitionId():05d}.arrow")
            passing = f"{own}.{uuid.uuid4().hex}"
            with pa.OSFile(passing, "wb") as sink, pa.ipc.new_file(sink, first.schema) as writer:
                writer.write_batch(first)
                for batch in batches:
                    writer.write_batch(batch)
            os.replace(passing, own)
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int32())], names=["done"])

    df.mapInArrow(store, "done int").count()


#: Writers by the name of their format.
SINKS = {
    "csv": lambda df, path: df.write.option("header", "true").csv(path),
    "parquet": lambda df, path: df.write.parquet(path),
    "json": lambda df, path: df.write.json(path),
    "arrow": write_arrow,
}


def write(df: DataFrame, path: str, kind: str) -> None:
    if kind not in SINKS:
        raise ValueError(f"no such format: {kind}")
    SINKS[kind](df, path)


def write_pretty(documents: DataFrame, column: str, path: str) -> None:
    """JSON values over several lines each, one document in a file's run of lines."""
    documents.select(F.to_json(column, {"pretty": "true"}).alias("value")).write.text(path)
