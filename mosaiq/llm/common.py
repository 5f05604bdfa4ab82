"""What the operators share: table access, the shared folder, and written intermediates."""

from __future__ import annotations

import ctypes
import gc
import math
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The folder of the scratch block that is open, if any.
_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor and the driver can reach.

    Only where the cluster names none (tests), one in the warehouse folder is used instead.  Within a scratch block it lies
    in the block's folder.
    """
    if held := _scratch.get():
        return f"{held}/{uuid.uuid4().hex}"
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir") + "/_shared"
    return f"{base.rstrip('/')}/mosaiq-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


@contextmanager
def released_shuffles(spark: SparkSession):
    """Within this block, shuffle files go as soon as the action that made them has ended.

    The intermediates of a multi-pass operator are written tables, so no later action reads those files.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def materialise(df: DataFrame, *, compression: str = "snappy", by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder (in a folder for each value of ``by``) and read it back: lineage
    ends there, and a lost executor costs no more than a reread."""
    spark = df.sparkSession
    path = shared_dir(spark)
    with released_shuffles(spark):
        df.write.option("compression", compression).parquet(path, partitionBy=by)
    relieve(spark)
    return spark.read.schema(df.schema).parquet(path)


def relieve(spark: SparkSession, share: float = 0.5) -> bool:
    """Gives back what the plans of ended jobs held at the driver, once its heap has grown to a share of what it may have.

    Of that little is in use between jobs, but the heap grows to its limit before it is collected."""
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() <= share * heap.maxMemory():
        return False
    gc.collect()  # plans that only Python still names
    spark._jvm.java.lang.System.gc()
    free_memory()
    return True


@contextmanager
def scratch(spark: SparkSession):
    """Tables that are written within this block go when it ends, but for those of ``lasting``."""
    folder = shared_dir(spark)
    before = _scratch.set(folder)
    try:
        yield
    finally:
        _scratch.reset(before)
        remove(spark, folder)


def lasting(df: DataFrame) -> DataFrame:
    """Written outside any scratch block, so that it outlives all tables that it was made from."""
    before = _scratch.set(None)
    try:
        return materialise(df)
    finally:
        _scratch.reset(before)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Total bytes of a text column (0 for none)."""
    return docs.agg(F.sum(F.octet_length(column).cast("long")).alias("n")).first()["n"] or 0


def block_count(total_bytes: int, block_bytes: int) -> int:
    return max(1, math.ceil(total_bytes / block_bytes))


def row_key(id_col, text_col):
    """A hash that spreads rows evenly: by id, and by text where the id is null."""
    return F.xxhash64(F.coalesce(F.xxhash64(id_col) * id_col.isNotNull().cast("long"), F.lit(0)), F.when(id_col.isNull(), text_col))


def freed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, whose worker gives its free memory back when it ends: workers are used again by later stages."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            free_memory()

    return runs


def free_memory() -> None:
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU library
        trim(0)


#: Rows of a table that is broadcast after its size has been checked.
MOST_BROADCAST = 10_000


def small(df: DataFrame) -> DataFrame:
    """A written table with a broadcast hint if it has at most MOST_BROADCAST rows."""
    df = materialise(df)
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def hash_share(column: str) -> Column:
    """A hash of a column as a number from 0 to 1."""
    return F.pmod(F.xxhash64(column), F.lit(1 << 30)) / float(1 << 30)
