"""Rasters stored in chunks: a folder for each image and level, a file of compressed values for each chunk, and JSON that describes
them (version 2 of the layout of chunked arrays that viewers read).

A chunk is made by Spark from the pixels that lie in it, so a task has one chunk at a time.  The sink is a data source with a commit
in two steps: tasks write below a folder of the job's own, each file under a passing name and then renamed, so a task that
runs twice leaves one file; only when all have ended, the driver adds the descriptions and moves the folder to its place.  A
job that fails removes it.
"""

from __future__ import annotations

import json
import math
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "raster_chunks"
COLUMNS = "image string, level long, height long, width long, cy long, cx long, data binary"


def file_system(path: str):
    """The store that a path or URI names, and the path in it."""
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


@dataclass
class Written(WriterCommitMessage):
    #: Image, level, height and width of what a task has written chunks of.
    arrays: set[tuple[str, int, int, int]]
    chunks: int


class ChunkWriter(DataSourceWriter):
    def __init__(self, path: str, side: int, overwrite: bool) -> None:
        self.path, self.side, self.overwrite = path.rstrip("/"), side, overwrite
        self.passing = f"{self.path}._passing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        store, root = file_system(self.passing)
        arrays, chunks = set(), 0
        for row in iterator:
            folder = posixpath.join(root, quote(str(row.image), safe=""), str(row.level))
            if (key := (str(row.image), row.level, row.height, row.width)) not in arrays:
                store.create_dir(folder, recursive=True)
                arrays.add(key)
            name = posixpath.join(folder, f"{row.cy}.{row.cx}")
            own = f"{name}._{uuid.uuid4().hex}"
            with store.open_output_stream(own) as out:
                out.write(bytes(row.data))
            store.move(own, name)
            chunks += 1
        return Written(arrays, chunks)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = file_system(self.passing)
        store.create_dir(root, recursive=True)
        described = {".zgroup": {"zarr_format": 2}}
        for image, level, height, width in sorted(set().union(*(m.arrays for m in messages if m is not None))):
            name = quote(image, safe="")
            described[f"{name}/.zgroup"] = {"zarr_format": 2}
            described[f"{name}/{level}/.zarray"] = {"zarr_format": 2, "shape": [height, width], "chunks": [self.side, self.side], "dtype": "<i8", "compressor": {"id": "zlib", "level": 1}, "fill_value": 0, "order": "C", "filters": None}
        for name, what in described.items():
            with store.open_output_stream(posixpath.join(root, name)) as out:
                out.write(json.dumps(what, indent=1).encode())
        # all descriptions in one file, too, which a reader needs but one request for
        with store.open_output_stream(posixpath.join(root, ".zmetadata")) as out:
            out.write(json.dumps({"zarr_consolidated_format": 1, "metadata": described}).encode())
        from pyarrow import fs

        _, place = file_system(self.path)
        if store.get_file_info(place).type != fs.FileType.NotFound:
            if not self.overwrite:
                self.abort(messages)
                raise FileExistsError(self.path)
            store.delete_dir(place)
        store.move(root, place)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, root = file_system(self.passing)
        if store.get_file_info(root).type != fs.FileType.NotFound:
            store.delete_dir(root)


class ChunkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return COLUMNS

    def writer(self, schema: StructType, overwrite: bool) -> ChunkWriter:
        return ChunkWriter(self.options["path"], int(self.options["side"]), overwrite)


def chunked(pixels: DataFrame, side: int, level: int = 0) -> DataFrame:
    """The chunks of ``image, y, x, v`` (whole numbers; 0 where no pixel is): compressed, row by row, whole also at the edges."""
    shapes = pixels.groupBy("image").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))
    at = [F.expr(f"y div {side}").alias("cy"), F.expr(f"x div {side}").alias("cx")]
    places = F.struct((F.col("y") % side * side + F.col("x") % side).cast("int").alias("at"), F.col("v").cast("long").alias("v"))
    packed = pixels.groupBy("image", *at).agg(F.collect_list(places).alias("a")).join(shapes, "image")
    packed = packed.select(F.col("image").cast("string").alias("image"), F.lit(level).cast("long").alias("level"), "height", "width", "cy", "cx", F.col("a.at").alias("at"), F.col("a.v").alias("v"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for at, v in zip(frame["at"], frame["v"], strict=True):
                block = np.zeros(side * side, "<i8")
                block[at] = v
                found.append(zlib.compress(block.tobytes(), 1))
            yield frame.drop(columns=["at", "v"]).assign(data=found)

    return packed.mapInPandas(run, COLUMNS)


def write_chunks(chunks: DataFrame, path: str, side: int, overwrite: bool = False) -> None:
    chunks.sparkSession.dataSource.register(ChunkSource)
    chunks.write.format(FORMAT).mode("overwrite" if overwrite else "append").option("path", path).option("side", side).save()


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """``image, level, y, x, v`` of what is stored; the descriptions are read once, the chunks as binary files by Spark."""
    store, root = file_system(path.rstrip("/"))
    with store.open_input_stream(posixpath.join(root, ".zmetadata")) as f:
        described = json.loads(f.read())["metadata"]
    shapes = [(unquote(name.split("/")[0]), int(name.split("/")[1]), *what["shape"], what["chunks"][0]) for name, what in described.items() if name.endswith("/.zarray")]
    schema = "image string, level long, height long, width long, side long"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    part = lambda k: F.regexp_extract("path", r"([^/]+)/(\d+)/(\d+)\.(\d+)$", k)
    files = files.select(F.url_decode(part(1)).alias("image"), part(2).cast("long").alias("level"), part(3).cast("long").alias("cy"), part(4).cast("long").alias("cx"), "content")
    files = files.join(spark.createDataFrame(shapes, schema), ["image", "level"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                side = int(r.side)
                block = np.frombuffer(zlib.decompress(r.content), "<i8").reshape(side, side)[: r.height - r.cy * side, : r.width - r.cx * side]
                y, x = np.mgrid[: block.shape[0], : block.shape[1]]
                yield pd.DataFrame({"image": r.image, "level": r.level, "y": (y + r.cy * side).ravel(), "x": (x + r.cx * side).ravel(), "v": block.ravel()})

    return files.mapInPandas(run, "image string, level long, y long, x long, v long")


def levels_of(height: int, width: int, side: int) -> int:
    """Halves until an image fits one chunk."""
    return 1 + max(0, math.ceil(math.log2(max(height, width) / side)))
