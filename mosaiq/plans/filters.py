"""Queries over filters and measures of images."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.operators import filters, raster
from mosaiq.plans.common import RASTER, SIDE, Plans, lines_raster, table

plans = Plans()
P = f"WITH RECURSIVE {RASTER}, mask AS (SELECT image, y, x, CAST(v % 5 >= 2 AS BIGINT) AS v FROM px)"
_END = SIDE - 1


def _mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_raster(spark, sf_dir).select("image", "y", "x", (F.col("v") % 5 >= 2).cast("long").alias("v"))


def _add(name: str, sql: str | None, query: Callable[[DataFrame], DataFrame], digits: int | None = None, source=lines_raster) -> None:
    """A query over one raster; its values are rounded where they are not whole."""

    @plans.add(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = query(source(spark, sf_dir))
        return out if digits is None else out.withColumn("v", F.round("v", digits))


def _stencil(kernel: dict[tuple[int, int], float], source: str = "px") -> str:
    """Convolution in SQL: weights by their offset."""
    values = ", ".join(f"({dy}, {dx}, {k!r}::DOUBLE)" for (dy, dx), k in kernel.items())
    return f"SELECT p.image AS image, p.y AS y, p.x AS x, sum(q.v * k) AS v FROM {source} AS p, (VALUES {values}) AS w(dy, dx, k) JOIN {source} AS q ON q.image = p.image AND q.y = p.y - dy AND q.x = p.x - dx GROUP BY ALL"


def _product(down: list[float], across: list[float]) -> dict[tuple[int, int], float]:
    r, s = len(down) // 2, len(across) // 2
    return {(i - r, j - s): a * b for i, a in enumerate(down) for j, b in enumerate(across)}


def _gauss(sigma: float, down: int = 0, across: int = 0) -> dict[tuple[int, int], float]:
    return _product(filters.gauss_weights(sigma, down), filters.gauss_weights(sigma, across))


_ROUND = " SELECT image, y, x, round(v, 6) AS v FROM ({})"
_ELLIPSE = filters.ellipse(5)
_NEAR = "SELECT p.image AS image, p.y AS y, p.x AS x, {f}(q.v) AS v FROM {t} AS p, (VALUES " + ", ".join(map(str, _ELLIPSE)) + ") AS w(dy, dx) JOIN {t} AS q ON q.image = p.image AND q.y = p.y - dy AND q.x = p.x - dx GROUP BY ALL"
_CROSS = raster.cross(1)
_NEAR4 = "SELECT p.image AS image, p.y AS y, p.x AS x, {f}(q.v) AS v FROM {t} AS p JOIN {t} AS q ON q.image = p.image AND abs(p.y - q.y) + abs(p.x - q.x) <= 1 GROUP BY ALL"
_KERNEL = {(-1, -1): 1.0, (-1, 0): 2.0, (0, 0): 4.0, (0, 1): -1.0, (1, 1): 3.0}
_BLUR = {(dy, dx): (2 - abs(dy)) * (2 - abs(dx)) / 16 for dy in (-1, 0, 1) for dx in (-1, 0, 1)}

_add("invert_mask", P + " SELECT image, y, x, 1 - v AS v FROM mask", filters.inverted, source=_mask)
_add("invert_values", P + " SELECT px.image AS image, y, x, s - v AS v FROM px JOIN (SELECT image, max(v) + min(v) AS s FROM px GROUP BY image) AS e ON e.image = px.image", filters.mirrored)
_add("rotate_quarter", P + f" SELECT image, {_END} - x AS y, y AS x, v FROM px", filters.quarter_turn)
_add("pad_mirrored", P + f" SELECT image, a + 4 AS y, b + 4 AS x, v FROM px JOIN (SELECT range - 4 AS a FROM range({SIDE + 8})) ON y = CASE WHEN a < 0 THEN -1 - a WHEN a > {_END} THEN {2 * SIDE - 1} - a ELSE a END JOIN (SELECT range - 4 AS b FROM range({SIDE + 8})) ON x = CASE WHEN b < 0 THEN -1 - b WHEN b > {_END} THEN {2 * SIDE - 1} - b ELSE b END", lambda d: filters.padded(d, SIDE, SIDE, 4))
_add("dilate_ellipse", P + " " + _NEAR.format(f="max", t="px"), lambda d: raster.dilate(d, _ELLIPSE))
_add("erode_twice", P + ", a AS (" + _NEAR4.format(f="min", t="px") + ") " + _NEAR4.format(f="min", t="a"), lambda d: filters.repeated(d, raster.erode, _CROSS, 2))
_SKELETON = P
for _k in range(8):  # the blocks of the mask are gone after fewer erosions
    _SKELETON += f", e{_k} AS ({_NEAR4.format(f='min', t=f'e{_k - 1}' if _k else 'mask')}), o{_k} AS ({_NEAR4.format(f='max', t=f'e{_k}')})"
_SKELETON += " SELECT mask.image AS image, mask.y AS y, mask.x AS x, CAST(greatest(" + ", ".join(f"{f'e{k - 1}.v' if k else 'mask.v'} - o{k}.v" for k in range(8)) + ") > 0 AS BIGINT) AS v FROM mask " + " ".join(f"JOIN {t}{k} USING (image, y, x)" for k in range(8) for t in "eo")
_add("skeletonize", _SKELETON, lambda d: filters.skeleton(d, _CROSS), source=_mask)
_add(
    "fill_holes",
    P + f", bg AS (SELECT image, y, x FROM mask WHERE v = 0), r(image, y, x) AS (SELECT image, y, x FROM bg WHERE y IN (0, {_END}) OR x IN (0, {_END}) UNION SELECT bg.image, bg.y, bg.x FROM r JOIN bg ON bg.image = r.image AND abs(bg.y - r.y) + abs(bg.x - r.x) = 1) SELECT mask.image AS image, mask.y AS y, mask.x AS x, CAST(r.y IS NULL AS BIGINT) AS v FROM mask LEFT JOIN r ON r.image = mask.image AND r.y = mask.y AND r.x = mask.x",
    lambda d: filters.holes_filled(d, SIDE, SIDE),
    source=_mask,
)
_LAB = ", lab AS (SELECT image, y, x, (y // 4) * 6 + x // 4 + 1 AS label FROM px WHERE v % 5 >= 2)"


def _labelled(px: DataFrame) -> DataFrame:
    return px.filter("v % 5 >= 2").select("image", "y", "x", (F.floor(F.col("y") / 4) * 6 + F.floor(F.col("x") / 4) + 1).alias("label"))


_add(
    "grow_labels",
    P + _LAB + " SELECT px.image AS image, px.y AS y, px.x AS x, coalesce(max(CASE WHEN q.y = px.y AND q.x = px.x THEN q.label END), min(q.label)) AS label FROM px JOIN lab AS q ON q.image = px.image AND abs(q.y - px.y) + abs(q.x - px.x) <= 1 GROUP BY ALL",
    lambda d: filters.grown_labels(_labelled(d), d, _CROSS),
)
_BOX = "SELECT p.image AS image, p.y AS y, p.x AS x, any_value(p.v) AS v, avg(q.v) AS m, stddev_pop(q.v) AS s FROM px AS p JOIN px AS q ON q.image = p.image AND abs(q.y - p.y) <= {r} AND abs(q.x - p.x) <= {r} GROUP BY ALL"
_add("local_normalise", P + f" SELECT image, y, x, round(greatest(-1.5, least(1.5, CASE WHEN s > 1e-9 THEN (v - m) / s ELSE 0 END)), 6) AS v FROM ({_BOX.format(r=3)})", lambda d: filters.local_normalised(d, 3, 1.5), 6)
_add("local_response", P + f" SELECT image, y, x, round(CASE WHEN s > 1e-9 THEN (v - m) / s ELSE 0 END, 6) AS v FROM ({_BOX.format(r=1)})", lambda d: filters.local_normalised(d, 1), 6)
_add("filter_gauss", P + _ROUND.format(_stencil(_gauss(1.5))), lambda d: filters.gauss(d, 1.5), 6)
_add("filter_gauss_derivative", P + _ROUND.format(_stencil(_gauss(1.0, 1, 0))), lambda d: filters.gauss_derivative(d, 1.0, 1, 0), 6)
_DOG = {k: _gauss(1.0).get(k, 0.0) - v for k, v in _gauss(2.0).items()}
_add("filter_dog", P + _ROUND.format(_stencil(_DOG)), lambda d: filters.difference_of_gauss(d, 1.0, 2.0), 6)
_add("filter_convolve", P + _ROUND.format(_stencil(_KERNEL)), lambda d: raster.convolve(d, _KERNEL), 6)
_add("filter_correlate", P + _ROUND.format(_stencil({(-a, -b): k for (a, b), k in _KERNEL.items()})), lambda d: filters.correlate(d, _KERNEL), 6)
_add("filter_partial_derivative", P + " SELECT image, y, x, (coalesce(lead(v) OVER w, v) - coalesce(lag(v) OVER w, v)) / 2 AS v FROM px WINDOW w AS (PARTITION BY image, x ORDER BY y)", lambda d: filters.partial_derivative(d, "y"))
_HESSIAN = ", ".join(f"{n} AS ({_stencil(_gauss(1.0, *k))})" for n, k in (("hyy", (2, 0)), ("hxx", (0, 2)), ("hxy", (1, 1))))
_CURVES = P + f", {_HESSIAN}, cv AS (SELECT hyy.image AS image, hyy.y AS y, hyy.x AS x, (hyy.v + hxx.v) / 2 - sqrt(((hyy.v - hxx.v) / 2) ** 2 + hxy.v ** 2) AS lo, (hyy.v + hxx.v) / 2 + sqrt(((hyy.v - hxx.v) / 2) ** 2 + hxy.v ** 2) AS hi FROM hyy JOIN hxx USING (image, y, x) JOIN hxy USING (image, y, x))"
_add("filter_tubeness", _CURVES + " SELECT image, y, x, round(greatest(0, -lo), 6) AS v FROM cv", lambda d: filters.tubeness(d, 1.0), 6)
_add("filter_vesselness", _CURVES + ", o AS (SELECT image, y, x, CASE WHEN abs(lo) >= abs(hi) THEN lo ELSE hi END AS l, CASE WHEN abs(lo) >= abs(hi) THEN hi ELSE lo END AS s FROM cv) SELECT image, y, x, round(CASE WHEN l < 0 THEN exp(-((s / l) ** 2) / 0.5) * (1 - exp(-(s * s + l * l) / 450)) ELSE 0 END, 6) AS v FROM o", lambda d: filters.vesselness(d, 1.0), 6)


def _lucy(n: int) -> str:
    parts, now = [], "px"
    for k in range(n):
        parts += [f"c{k} AS ({_stencil(_BLUR, now)})", f"d{k} AS (SELECT px.image AS image, px.y AS y, px.x AS x, CASE WHEN c.v > 1e-12 THEN px.v / c.v ELSE 0 END AS v FROM px JOIN c{k} AS c USING (image, y, x))"]
        parts += [f"f{k} AS ({_stencil({(-a, -b): w for (a, b), w in _BLUR.items()}, f'd{k}')})", f"g{k} AS (SELECT f.image AS image, f.y AS y, f.x AS x, f.v * e.v AS v FROM f{k} AS f JOIN {now} AS e USING (image, y, x))"]
        now = f"g{k}"
    return P + ", " + ", ".join(parts) + f" SELECT image, y, x, round(v, 6) AS v FROM {now}"


_add("deconvolve_richardson_lucy", _lucy(3), lambda d: filters.richardson_lucy(d, _BLUR, 3), 6)
_BALL = ", ".join(f"({dy}, {dx}, {h!r}::DOUBLE)" for (dy, dx), h in filters.ball(3).items())
_OVER = "SELECT p.image AS image, p.y AS y, p.x AS x, {f} AS v FROM {t} AS p, (VALUES " + _BALL + ") AS w(dy, dx, h) JOIN {t} AS q ON q.image = p.image AND q.y = p.y - dy AND q.x = p.x - dx GROUP BY ALL"
_add("rolling_ball", P + ", a AS (" + _OVER.format(f="min(q.v - h)", t="px") + "), b AS (" + _OVER.format(f="max(q.v + h)", t="a") + ") SELECT px.image AS image, px.y AS y, px.x AS x, round(px.v - b.v, 6) AS v FROM px JOIN b USING (image, y, x)", lambda d: filters.without_background(d, 3), 6)
_SPIKE = "SELECT image, min({a}) AS hit FROM {t} WHERE round(gradient, 9) >= 0.02 GROUP BY image"


def _crop_sql() -> str:
    """Both axes from both sides: the same steps over strips that are numbered from either end."""
    parts = []
    for a in "yx":
        parts.append(f"e{a} AS (SELECT image, {a}, min(v) AS a, max(v) AS b FROM px GROUP BY image, {a}), bn{a} AS (SELECT px.image AS image, px.{a} AS {a}, least(floor((v - e.a) * 32 / (CASE WHEN b > e.a THEN b - e.a ELSE 1 END)), 31) AS bin, count(*) AS n FROM px JOIN e{a} AS e ON e.image = px.image AND e.{a} = px.{a} GROUP BY ALL), t{a}1 AS (SELECT image, {a} AS y, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS entropy FROM bn{a} GROUP BY image, {a}), t{a}2 AS (SELECT image, {_END} - y AS y, entropy FROM t{a}1)")
        for k in "12":
            t = f"{a}{k}"
            parts.append(f"p{t} AS ({_WINDOW.format(o='entropy', c='entropy', t='t' + t)}), q{t} AS (SELECT image, y, lead(entropy) OVER (PARTITION BY image ORDER BY y) - entropy AS step FROM p{t}), r{t} AS (SELECT * FROM q{t} WHERE step IS NOT NULL), g{t} AS ({_WINDOW.format(o='gradient', c='step', t='r' + t)}), s{t} AS ({_SPIKE.format(a='y', t='g' + t)})")
    ends = ", ".join(f"CAST(coalesce(s{a}1.hit, 0) AS BIGINT) AS {a}1, CAST({_END} - coalesce(s{a}2.hit, 0) AS BIGINT) AS {a}2" for a in "yx")
    return P + ", " + ", ".join(parts) + f" SELECT i.image AS image, {ends} FROM (SELECT DISTINCT image FROM px) AS i " + " ".join(f"LEFT JOIN s{a}{k} ON s{a}{k}.image = i.image" for a in "yx" for k in "12")


_add("value_bounds", P + " SELECT image, max(v) AS greatest, min(v) AS least, min(v) FILTER (v > 0) AS least_above_0 FROM px GROUP BY image", filters.value_bounds)
_add("without_blank", P + " SELECT image, y, x, CASE WHEN image = 'N' THEN 1 ELSE v END AS v FROM px WHERE image <> 'N'", lambda d: filters.without_blank(d.withColumn("v", F.when(F.col("image") == "N", 1).otherwise(F.col("v")))))
_add("exact_tiles", P + " SELECT image, y // 7 AS ty, x // 7 AS tx FROM px GROUP BY ALL HAVING count(*) = 49", lambda d: filters.exact_tiles(d, 7))
_add("bin_entropy", P + ", e AS (SELECT image, min(v) AS a, max(v) AS b FROM px GROUP BY image), b AS (SELECT px.image AS image, least(floor((v - a) * 128 / (CASE WHEN b > a THEN b - a ELSE 1 END)), 127) AS bin, count(*) AS n FROM px JOIN e ON e.image = px.image GROUP BY ALL) SELECT image, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 6) AS entropy FROM b GROUP BY image", lambda d: filters.bin_entropy(d, ["image"]).withColumn("entropy", F.round("entropy", 6)))
_STRIP = P + ", e AS (SELECT image, y, min(v) AS a, max(v) AS b FROM px GROUP BY image, y), b AS (SELECT px.image AS image, px.y AS y, least(floor((v - a) * 32 / (CASE WHEN b > a THEN b - a ELSE 1 END)), 31) AS bin, count(*) AS n FROM px JOIN e ON e.image = px.image AND e.y = px.y GROUP BY ALL), st AS (SELECT image, y, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 6) AS entropy FROM b GROUP BY image, y)"
_WINDOW = "SELECT image, row_number() OVER (PARTITION BY image ORDER BY y) - 1 AS y, abs(s) / 4 AS {o} FROM (SELECT image, y, sum({c}) OVER w AS s, count({c}) OVER w AS n FROM {t} WINDOW w AS (PARTITION BY image ORDER BY y ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)) WHERE n = 4"
_GRADIENT = _STRIP + f", s1 AS ({_WINDOW.format(o='entropy', c='entropy', t='st')}), s2 AS (SELECT image, y, lead(entropy) OVER (PARTITION BY image ORDER BY y) - entropy AS step FROM s1), s3 AS (SELECT * FROM s2 WHERE step IS NOT NULL), gr AS ({_WINDOW.format(o='gradient', c='step', t='s3')})"


def _strips(d: DataFrame) -> DataFrame:
    return filters.bin_entropy(d, ["image", "y"], 32).withColumn("entropy", F.round("entropy", 6))


def _gradients(d: DataFrame) -> DataFrame:
    return filters.smoothed_gradients(_strips(d), ["image"], "y", "entropy", 4).withColumnRenamed("entropy", "gradient")


_add("strip_entropy", _STRIP + " SELECT image, y, entropy FROM st", _strips)
_add("smoothed_gradients", _GRADIENT + " SELECT image, y, round(gradient, 6) AS gradient FROM gr", lambda d: _gradients(d).withColumn("gradient", F.round("gradient", 6)))
_add("first_spike", _GRADIENT + " SELECT image, min(y) AS y, round(round(arg_min(gradient, y), 9), 6) AS gradient FROM gr WHERE round(gradient, 9) >= 0.02 GROUP BY image", lambda d: filters.first_spike(_gradients(d).withColumn("gradient", F.round("gradient", 9)), ["image"], "y", "gradient", 0.02).withColumn("gradient", F.round("gradient", 6)))
_add("percentile_bounds", P + ", c AS (SELECT image, v, count(*) AS n FROM px WHERE v > 0 GROUP BY ALL), u AS (SELECT *, sum(n) OVER (PARTITION BY image ORDER BY v ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY image) AS total FROM c) SELECT image, min(v) FILTER (upto >= ceil(round(total * 0.05, 6))) AS low, min(v) FILTER (upto >= ceil(round(total * 0.95, 6))) AS high FROM u GROUP BY image", lambda d: filters.percentile_bounds(d, 0.05))
_WELLS = [(f"W{i}{j}", 6 + 11 * i, 5 + 12 * j, 5) for i in range(2) for j in range(2)]
_WELL = ", ws AS (SELECT * FROM (VALUES " + ", ".join(map(str, _WELLS)) + ") AS w(well, cy, cx, r))"


def _wells(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_WELLS, "well string, cy long, cx long, r long")


_add("well_intensity", P + _WELL + ", pa AS (SELECT image, well, list_sort(list(v)) AS vs FROM px JOIN ws ON y >= cy - r AND y < cy + r AND x >= cx - r AND x < cx + r GROUP BY ALL) SELECT image, well, CAST(trunc(list_aggregate(vs, 'avg') - list_aggregate(vs[:CAST(floor(len(vs) * 0.05) AS BIGINT)], 'median')) AS BIGINT) AS intensity FROM pa", lambda d: filters.well_intensity(d, _wells(d.sparkSession)))


@plans.add("well_disks", P + _WELL + ", dk AS (SELECT px.image AS image, px.y AS y, px.x AS x, min(well) AS well, px.v AS v FROM px JOIN ws ON (y - cy) ** 2 + (x - cx) ** 2 < r * r GROUP BY ALL) SELECT image, well, count(*) AS pixels, CAST(sum(v) AS BIGINT) AS total FROM dk GROUP BY image, well")
def well_disks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies within the disk of each well, in every image."""
    inside = lines_raster(spark, sf_dir).join(filters.disks(_wells(spark)), ["y", "x"])
    return inside.groupBy("image", "well").agg(F.count(F.lit(1)).alias("pixels"), F.sum("v").alias("total"))


_FLAT = ", ff AS (SELECT y, x, sum(v) + 1 AS b FROM px WHERE image = 'A' GROUP BY y, x)"


@plans.add("flat_field", P + _FLAT + " SELECT px.image AS image, px.y AS y, px.x AS x, round((w - d) / (b + 1e-8), 6) AS v FROM (SELECT p.image AS image, p.y AS y, p.x AS x, p.v AS w, q.v % 3 AS d FROM px AS p JOIN px AS q ON q.image = 'R' AND q.y = p.y AND q.x = p.x) AS px JOIN ff ON ff.y = px.y AND ff.x = px.x")
def flat_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = lines_raster(spark, sf_dir)
    bright = px.filter("image = 'A'").select("y", "x", (F.col("v") + 1).alias("v"))
    dark = px.filter("image = 'R'").select("y", "x", (F.col("v") % 3).alias("v"))
    return filters.flat_field(px, bright, dark).withColumn("v", F.round("v", 6))


@plans.add("cluster_frame", P + f" SELECT image, y, x, CASE WHEN y < 2 OR x < 2 OR y > {_END - 2} OR x > {_END - 2} THEN ascii(image) ELSE v END AS v FROM px")
def cluster_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = lines_raster(spark, sf_dir)
    return filters.framed(px, px.select("image").distinct().withColumn("cluster", F.ascii("image").cast("long")), 2)


_TINTS = [("A", 1.0, 9.0, 1.0, 0.0, 0.5), ("N", 0.0, 8.0, 0.0, 1.0, 0.0), ("R", 2.0, 12.0, 0.5, 0.5, 1.0)]


@plans.add("colour_blend", P + ", t AS (SELECT * FROM (VALUES " + ", ".join(map(str, _TINTS)) + ") AS t(image, lo, hi, r, g, b)), l AS (SELECT y, x, greatest(0.0, least(255.0, 255.0 * (v - lo::DOUBLE) / (hi::DOUBLE - lo::DOUBLE))) AS l, r, g, b FROM px JOIN t ON t.image = px.image) SELECT y, x, " + ", ".join(f"CAST(least(255, floor(round(sum(l * {c[0]}::DOUBLE), 6))) AS BIGINT) AS {c}" for c in ("red", "green", "blue")) + " FROM l GROUP BY y, x")
def colour_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.blended(lines_raster(spark, sf_dir), spark.createDataFrame(_TINTS, "image string, low double, high double, red double, green double, blue double"))


_SHAPES = "SELECT s_name AS image, 20 + s_suppkey % 50 AS height, 15 + s_suppkey % 40 AS width FROM supplier"


@plans.add("halo_tiles", f"WITH s AS ({_SHAPES}), t AS (SELECT *, unnest(range(0, height, 16)) AS y0 FROM s), u AS (SELECT *, unnest(range(0, width, 16)) AS x0 FROM t) SELECT image, y0, least(y0 + 16, height) AS y1, x0, least(x0 + 16, width) AS x1, greatest(0, y0 - 3) AS hy0, least(height, least(y0 + 16, height) + 3) AS hy1, greatest(0, x0 - 3) AS hx0, least(width, least(x0 + 16, width) + 3) AS hx1 FROM u")
def halo_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("image"), (20 + F.col("s_suppkey") % 50).alias("height"), (15 + F.col("s_suppkey") % 40).alias("width"))
    return filters.halo_tiles(shapes, 16, 3)


@plans.add("tiles_under_views", "WITH f AS (SELECT p_partkey, p_partkey * 7 % 300 AS pos_y, p_partkey * 13 % 400 AS pos_x FROM part), t AS (SELECT p_partkey AS file, unnest(range(pos_y // 64, (pos_y + 99) // 64 + 1)) AS ty, pos_x FROM f) SELECT file, ty, unnest(range(pos_x // 64, (pos_x + 79) // 64 + 1)) AS tx FROM t")
def tiles_under_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file"), (F.col("p_partkey") * 7 % 300).alias("pos_y"), (F.col("p_partkey") * 13 % 400).alias("pos_x"), F.lit(100).alias("height"), F.lit(80).alias("width"))
    return filters.tiles_under(views, 64)


_RING = [(2.5, 1.5), (20.5, 4.5), (14.5, 12.5), (21.5, 21.5), (4.5, 18.5), (9.5, 10.5), (2.5, 1.5)]
_CROSSINGS = " + ".join(f"CASE WHEN ({a[1]} > y) <> ({b[1]} > y) AND x < ({b[0]}::DOUBLE - {a[0]}) * (y - {a[1]}) / ({b[1]}::DOUBLE - {a[1]}) + {a[0]} THEN 1 ELSE 0 END" for a, b in zip(_RING[:-1], _RING[1:], strict=True))


@plans.add("polygon_mask", P + f" SELECT image, y, x, CAST(({_CROSSINGS}) % 2 = 1 AS BIGINT) AS v FROM px")
def polygon_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in _RING])
    return lines_raster(spark, sf_dir).select("image", "y", "x", filters.in_polygon(ring).cast("long").alias("v"))


@plans.add("pyramid_tiles", P + ", h AS (SELECT image, y // 2 AS y, x // 2 AS x, CAST(floor(avg(v)) AS BIGINT) AS v FROM px GROUP BY ALL), q AS (SELECT image, y // 2 AS y, x // 2 AS x, CAST(floor(avg(v)) AS BIGINT) AS v FROM h GROUP BY ALL), a AS (SELECT 0 AS level, * FROM px UNION ALL SELECT 1, * FROM h UNION ALL SELECT 2, * FROM q) SELECT CAST(level AS BIGINT) AS level, y // 5 AS ty, x // 5 AS tx, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM a GROUP BY ALL")
def pyramid_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of three levels, written and read again."""
    folder = f"{(spark.conf.get('spark.checkpoint.dir', None) or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/pyramid-{uuid.uuid4().hex}"
    raster.write_pyramid(raster.pyramid(lines_raster(spark, sf_dir), 3, 5), folder)
    tiles = spark.read.schema("image string, y long, x long, v long, level long, ty long, tx long").parquet(folder)
    return tiles.groupBy("level", "ty", "tx").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


_add("autocrop", _crop_sql(), lambda d: filters.autocrop(d, 4, 0.02))
