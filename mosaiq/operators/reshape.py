"""Tables and collections put together and taken apart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalised_columns(df: DataFrame, suffix: str = "", keys: tuple[str, ...] = ()) -> DataFrame:
    """Columns in order of their names, double underscores made one, leading ones dropped, and a suffix to all but keys."""
    def name(c: str) -> str:
        while "__" in c:
            c = c.replace("__", "_")
        return c.lstrip("_")

    rest = sorted(c for c in df.columns if c not in keys)
    return df.select(*keys, *[F.col(f"`{c}`").alias(name(c) + suffix) for c in rest])


def without_null_rows(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows with a value in a column that is no key."""
    return df.dropna("all", subset=[c for c in df.columns if c not in keys])


def split(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that fulfil a condition, and all others (also where it is null)."""
    hit = F.coalesce(condition, F.lit(False))
    return df.filter(hit), df.filter(~hit)


def catalogue(tables: list[DataFrame], key: str, dropped: tuple[str, ...] = ()) -> DataFrame:
    """All rows of some tables, of equal keys that of the first table."""
    rows = [t.drop(*dropped).withColumn("_order", F.lit(i)) for i, t in enumerate(tables)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    rest = [c for c in every.columns if c not in (key, "_order")]
    first = every.groupBy(key).agg(F.min(F.struct("_order", *rest)).alias("f"))
    return first.select(key, *[F.col(f"f.{c}").alias(c) for c in rest])


def side_by_side(tables: dict[str, DataFrame], keys: list[str], last: str | None = None) -> DataFrame:
    """One row for each key with the columns of all tables, ``_{name}`` after each; the column ``last`` once, at the end."""
    def named(name: str, t: DataFrame) -> DataFrame:
        return t.select(*keys, *[F.col(c).alias(f"{c}_{name}") for c in t.columns if c not in keys and c != last])

    items = list(tables.items())
    out = reduce(lambda a, b: a.join(b, keys, "full"), [named(n, t) for n, t in items])
    return out if last is None else out.join(items[0][1].select(*keys, last), keys, "left")


def stacked(files: DataFrame, by: list[str], along: str) -> DataFrame:
    """Each file's stack (its values of ``by``) and its plane in it: its rank among the stack's values of ``along``."""
    w = Window.partitionBy(*by).orderBy(along)
    return files.withColumn("plane", (F.dense_rank().over(w) - 1).cast("long"))


def planes(images: DataFrame, sizes: list[str]) -> DataFrame:
    """A row for each plane of an image with ``file`` and its numbers of planes; the file's new name tells them."""
    out = images
    for c in sizes:
        out = out.withColumn(c, F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1)))
    stem = F.regexp_replace("file", r"\..*$", "")
    return out.select("file", *sizes, F.concat(stem, *[F.concat(F.lit(f"_{c}"), F.col(c).cast("string")) for c in sizes], F.lit(".ome.tif")).alias("new_name"))


def zipped(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """Rows of equal name; names that only one side has are an error."""
    lone = left.select(name).exceptAll(right.select(name)).unionAll(right.select(name).exceptAll(left.select(name)))
    if odd := lone.limit(3).collect():
        raise ValueError(f"without a partner: {[r[0] for r in odd]}")
    return left.join(right, name)


def recycled(vector: DataFrame, files: DataFrame, shared: list[str], varying: list[str]) -> DataFrame:
    """Lines of a vector for files of another collection: files that agree with a line's file in the shared variables take
    its place, one new vector for each value of the varying ones (``vector`` counts from 1)."""
    place = vector.select(*shared, "corr", "pos_x", "pos_y", "grid_x", "grid_y")
    groups = files.select(*varying).distinct()
    numbered = groups.withColumn("vector", F.row_number().over(Window.orderBy(*varying)).cast("long"))  # one row for each new file
    return files.join(place, shared).join(numbered, varying).select("vector", "file", "corr", "pos_x", "pos_y", "grid_x", "grid_y")


def numbered_lines(lines: DataFrame, vector: str, order: list[str]) -> DataFrame:
    """``line`` of each row within its vector, from 0."""
    return lines.withColumn("line", (F.row_number().over(Window.partitionBy(vector).orderBy(*order)) - 1).cast("long"))


def best_share(df: DataFrame, by: list[str], score: Column, share: int = 4) -> DataFrame:
    """The first of ``share`` equal parts of each group, by score."""
    return df.withColumn("_part", F.ntile(share).over(Window.partitionBy(*by).orderBy(score))).filter("_part = 1").drop("_part")


def hashed_sample(df: DataFrame, key: str, percent: int, seed: int = 0) -> DataFrame:
    """The rows whose key's digest falls below a share: the same ones however the table is stored."""
    slot = F.conv(F.substring(F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long") % 100
    return df.filter(slot < percent)


def running_base(counts: DataFrame, by: str, order: str, n: str) -> DataFrame:
    """``base``: how many labels the tiles before have, so that labels of tiles can be made distinct."""
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("base", F.coalesce(F.sum(n).over(before), F.lit(0)).cast("long"))


def reconciled(current: DataFrame, other: DataFrame) -> DataFrame:
    """``image, label, new``: each label of a tile and the label of its neighbour that covers most of its pixels (the least
    of equal ones), or its own."""
    both = current.join(other.select("image", "y", "x", F.col("label").alias("_other")), ["image", "y", "x"])
    counts = both.groupBy("image", "label", "_other").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("image", "label").agg(F.max(F.struct("n", (-F.col("_other")).alias("k")))["k"].alias("k"))
    own = current.select("image", "label").distinct()
    return own.join(best, ["image", "label"], "left").select("image", "label", F.coalesce(-F.col("k"), "label").alias("new"))
