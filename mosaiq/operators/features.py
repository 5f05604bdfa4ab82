"""Nested feature documents: rectangles and points as features, collections as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rectangle(x: Column, y: Column, width: Column, height: Column) -> Column:
    """The closed ring of a rectangle."""
    corners = [(x, y), (x + width, y), (x + width, y + height), (x, y + height), (x, y)]
    return F.array(F.array(*[F.array(a.cast("double"), b.cast("double")) for a, b in corners]))


def rectangle_feature(x: Column, y: Column, width: Column, height: Column, texts: dict[str, Column], numbers: dict[str, Column]) -> Column:
    """A polygon feature with its text and number properties."""
    geometry = F.struct(F.lit("Polygon").alias("type"), rectangle(x, y, width, height).alias("coordinates"))
    return F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), _properties(texts, numbers).alias("properties"))


def point_feature(x: Column, y: Column, texts: dict[str, Column], numbers: dict[str, Column]) -> Column:
    geometry = F.struct(F.lit("Point").alias("type"), F.array(x.cast("double"), y.cast("double")).alias("coordinates"))
    return F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), _properties(texts, numbers).alias("properties"))


def _properties(texts: dict[str, Column], numbers: dict[str, Column]) -> Column:
    entries = lambda d, kind: F.create_map(*[v for k, c in d.items() for v in (F.lit(k), c.cast(kind))]) if d else F.create_map().cast(f"map<string,{kind}>")
    return F.struct(entries(texts, "string").alias("string"), entries(numbers, "double").alias("numeric"))


def well(row: Column, column: Column, width: int = 2) -> Column:
    """Plate address of a row and column counted from 0: A01 ... Z01, AA01 ..."""
    letters = F.when(row < 26, F.chr(65 + row)).otherwise(F.concat(F.chr(64 + F.floor(row / 26)), F.chr(65 + row % 26)))
    return F.concat(letters, F.lpad((column + 1).cast("string"), width, "0"))


def collections(features: DataFrame, key: str, feature: str = "feature") -> DataFrame:
    """One JSON document for each key; a key is one output file, and its features are what that file holds."""
    return features.groupBy(key).agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))).alias("json"))


def merged(documents: DataFrame, column: str = "json") -> Column:
    """One feature collection of the features of several, as an aggregate."""
    listed = F.collect_list(F.regexp_extract(F.get_json_object(column, "$.features"), r"(?s)^\[(.*)\]$", 1))
    return F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.filter(listed, lambda x: x != ""), ","), F.lit("]}"))


def scales(width: Column, height: Column, depth: Column, resolution: Column) -> Column:
    """The levels of a pyramid from the full size to one pixel: ``key``, ``size``, ``resolution`` of each; a level has half
    the width and height (rounded up) and twice the resolution of the one before."""
    levels = F.ceil(F.round(F.log2(F.greatest(width, height, depth)), 9))
    half = lambda n, i: F.ceil(n / F.pow(F.lit(2.0), i)).cast("long")
    level = lambda i: F.struct((levels - i).cast("string").alias("key"), F.array(half(width, i), half(height, i), depth.cast("long")).alias("size"), F.array(resolution * F.pow(F.lit(2.0), i), resolution * F.pow(F.lit(2.0), i), resolution.cast("double")).alias("resolution"))
    return F.transform(F.sequence(F.lit(0).cast("long"), levels), lambda i: level(i))


def tile_document(bounds: Column, fields: dict[str, str], most_zoom: int = 7) -> Column:
    """The description of a tiled layer: its bounds (``x0, y0, x1, y1``), centre and fields with their types."""
    centre = F.array(F.lit(0.0), (bounds[0] + bounds[2]) / 2, (bounds[1] + bounds[3]) / 2)
    layer = F.struct(F.lit("extracted-layer").alias("id"), F.create_map(*[F.lit(x) for kv in fields.items() for x in kv]).alias("fields"), F.lit(0).alias("minzoom"), F.lit(most_zoom).alias("maxzoom"))
    return F.to_json(F.struct(F.lit("3.0.0").alias("tilejson"), F.array(F.lit("{z}/{x}/{y}.pbf")).alias("tiles"), F.lit(0).alias("minzoom"), F.lit(most_zoom).alias("maxzoom"), bounds.alias("bounds"), centre.alias("center"), F.array(layer).alias("vector_layers")))
