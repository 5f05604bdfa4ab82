"""Queries over distances, watersheds, outlines, hulls, flows and textures, on rasters that grow with their table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.operators import flows, objects, plates, raster, registration, shading, shapes, textures, watershed
from mosaiq.operators.iteration import saved
from mosaiq.plans.common import GROWN, Plans, grown_raster, table
from mosaiq.sources import chunks

plans = Plans()

_MASK = f"{GROWN}, mask AS (SELECT image, y, x, CASE WHEN v % 5 >= 1 THEN 1 ELSE 0 END AS v FROM px)"


def _mask(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    pixels, side = grown_raster(spark, sf_dir)
    return pixels.withColumn("v", (F.col("v") % 5 >= 1).cast("long")), side


@plans.add(
    "distance_transform",
    f"WITH {_MASK}, z AS (SELECT a.image AS image, a.y AS y, a.x AS x, min((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) AS d2 FROM mask AS a LEFT JOIN mask AS b ON a.image = b.image AND b.v = 0 GROUP BY ALL) SELECT * FROM z",
)
def distance_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watershed.squared_distance(_mask(spark, sf_dir)[0])


@plans.add("watershed_labels")
def watershed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flood goes edge by edge in order, which SQL cannot say; the tests flood by priority."""
    mask, side = _mask(spark, sf_dir)
    return watershed.split_touching(mask, side, radius=2)


#: Objects as blocks of a grid cut by a mask: with holes, in pieces, touching at corners.
_BLOCKS = f"WITH RECURSIVE {_MASK}, lab AS (SELECT image, y, x, (y // 8) * 1000 + x // 8 + 1 AS label FROM mask WHERE v > 0)"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask, _ = _mask(spark, sf_dir)
    return mask.filter("v > 0").select("image", "y", "x", (F.floor(F.col("y") / 8) * 1000 + F.floor(F.col("x") / 8) + 1).alias("label"))


_RINGS = """, d(s, ny, nx, ay, ax, cy, cx) AS (VALUES (0, -1, 0, 0, 1, -1, 1), (1, 0, 1, 1, 0, 1, 1), (2, 1, 0, 0, -1, 1, -1), (3, 0, -1, -1, 0, -1, -1)),
sd2 AS (SELECT l.image AS image, l.label AS label, (l.y * 100000 + l.x) * 4 + s AS e,
  CASE WHEN a.label IS NULL THEN (l.y * 100000 + l.x) * 4 + (s + 1) % 4 WHEN c.label IS NULL THEN ((l.y + ay) * 100000 + l.x + ax) * 4 + s ELSE ((l.y + cy) * 100000 + l.x + cx) * 4 + (s + 3) % 4 END AS nx
  FROM lab AS l CROSS JOIN d LEFT JOIN lab AS n ON n.image = l.image AND n.label = l.label AND n.y = l.y + ny AND n.x = l.x + d.nx
  LEFT JOIN lab AS a ON a.image = l.image AND a.label = l.label AND a.y = l.y + ay AND a.x = l.x + ax LEFT JOIN lab AS c ON c.image = l.image AND c.label = l.label AND c.y = l.y + cy AND c.x = l.x + cx WHERE n.label IS NULL),
w(image, label, st, e, nx, k) AS (SELECT image, label, e, e, nx, 0 FROM sd2 UNION ALL SELECT w.image, w.label, st, sd2.e, sd2.nx, k + 1 FROM w JOIN sd2 ON sd2.image = w.image AND sd2.label = w.label AND sd2.e = w.nx WHERE w.nx > st),
c AS (SELECT image, label, st, e % 4 AS over, row_number() OVER (PARTITION BY image, label ORDER BY st) - 1 AS ring FROM w WHERE nx = st),
r AS (SELECT w.*, ring, e % 4 AS s, coalesce(lag(e % 4) OVER (PARTITION BY w.image, w.label, w.st ORDER BY k), over) AS p FROM w JOIN c ON c.image = w.image AND c.label = w.label AND c.st = w.st),
ri AS (SELECT image, label, ring, row_number() OVER (PARTITION BY image, label, ring ORDER BY k) - 1 AS k, e // 4 // 100000 + CASE WHEN s >= 2 THEN 1 ELSE 0 END AS y, e // 4 % 100000 + CASE WHEN s IN (1, 2) THEN 1 ELSE 0 END AS x FROM r WHERE s <> p)"""


@plans.add("region_contours", _BLOCKS + _RINGS + " SELECT image, label, ring, k, y, x FROM ri")
def region_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.contours(_blocks(spark, sf_dir))


@plans.add("contour_areas", _BLOCKS + ", n AS (SELECT image, label, count(*) AS pixels FROM lab GROUP BY ALL) SELECT image, label, CAST(pixels AS DOUBLE) AS area FROM n")
def contour_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines less holes by the shoelace formula: as many as there are pixels."""
    return shapes.areas(shapes.contours(_blocks(spark, sf_dir))).groupBy("image", "label").agg(F.sum("area").alias("area"))


#: For each row the least and greatest place of any line between two points of the object.
_HULL = """, pt AS (SELECT image, label, 2 * lab.y + o.y AS y, min(2 * lab.x + o.x) AS lo, max(2 * lab.x + o.x) AS hi FROM lab, (VALUES (0, -1), (0, 1), (-1, 0), (1, 0)) AS o(y, x) GROUP BY ALL),
hr AS (SELECT a.image AS image, a.label AS label, r.y AS y, min(CASE WHEN a.y = b.y THEN a.lo ELSE a.lo + (b.lo - a.lo) * (r.y - a.y) / (b.y - a.y) END) AS l, max(CASE WHEN a.y = b.y THEN a.hi ELSE a.hi + (b.hi - a.hi) * (r.y - a.y) / (b.y - a.y) END) AS h
  FROM (SELECT DISTINCT image, label, 2 * range AS y FROM (SELECT image, label, unnest(range(min(y), max(y) + 1)) AS range FROM lab GROUP BY image, label)) AS r JOIN pt AS a ON a.image = r.image AND a.label = r.label AND a.y <= r.y JOIN pt AS b ON b.image = r.image AND b.label = r.label AND b.y >= r.y GROUP BY ALL),
hu AS (SELECT image, label, CAST(sum(floor(h / 2 + 1e-9) - ceil(l / 2 - 1e-9) + 1) AS BIGINT) AS convex_area FROM hr GROUP BY ALL),
so AS (SELECT hu.image AS image, hu.label AS label, area, convex_area, area / convex_area AS solidity FROM hu JOIN (SELECT image, label, count(*) AS area FROM lab GROUP BY ALL) AS n ON n.image = hu.image AND n.label = hu.label)"""


@plans.add("region_hull", _BLOCKS + _HULL + " SELECT image, label, area, convex_area, round(solidity, 6) AS solidity FROM so")
def region_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.solidity(_blocks(spark, sf_dir)).withColumn("solidity", F.round("solidity", 6))


def _agreement(name: str, values: list[str]) -> str:
    return f"list_transform(flatten([[{{'i': i, 'j': j}} FOR j IN range(i + 1, {len(values) + 1})] FOR i IN range(1, {len(values) + 1})]), lambda q: 1 - abs(1 - ({name})[q.i] / ({name})[q.j]))"


_AREAS = ["1.5 * r3 * rim / 6 * rim / 6", "1.5 * r3 * wide / 2 * wide / 2", "1.5 * r3 * narrow / r3 * narrow / r3", "3 * rim / 6 * r3 * wide / 4", "3 * rim / 6 * narrow / 2", "3 * wide / 2 * narrow / 2", "3 * hrim / 6 * r3 * rim / 12", "3 * hrim / 6 * r3 * wide / 4", "3 * hrim / 6 * narrow / 2", "hull", "area"]
_RIMS = ["sqrt(24 * area / r3)", "sqrt(24 * hull / r3)", "rim", "hrim", "3 * wide", "6 * narrow / r3", "2 * area / (r3 * rim / 12)", "2 * area / (r3 * wide / 4)", "2 * area / (narrow / 2)", "2 * area / (r3 * hrim / 12)", "2 * area / sqrt(4 * hull / (4.5 * r3))", "2 * hull / (r3 * rim / 12)", "2 * hull / (r3 * wide / 4)", "2 * hull / (narrow / 2)"]
_POLYGONALITY = f""", bo AS (SELECT a.image AS image, a.label AS label, a.y AS y, a.x AS x FROM lab AS a LEFT JOIN lab AS b ON a.image = b.image AND a.label = b.label AND abs(a.y - b.y) + abs(a.x - b.x) = 1 GROUP BY ALL HAVING count(b.y) < 4),
co AS (SELECT a.image AS image, a.label AS label, a.y AS y, a.x AS x, 1 + sum(CASE abs(a.y - b.y) + abs(a.x - b.x) WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 10 END) AS c FROM bo AS a JOIN bo AS b ON a.image = b.image AND a.label = b.label AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL),
pe AS (SELECT image, label, sum(CASE WHEN c IN (5, 7, 15, 17, 25, 27) THEN 1 WHEN c IN (21, 33) THEN sqrt(2) WHEN c IN (13, 23) THEN (1 + sqrt(2)) / 2 ELSE 0 END) AS rim FROM co GROUP BY image, label),
nb AS (SELECT a.image AS image, a.label AS label, count(DISTINCT b.label) AS n FROM lab AS a JOIN lab AS b ON a.image = b.image AND a.label <> b.label AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL),
fw AS (SELECT image, label, a, max(x * cos(radians(a)) + y * sin(radians(a))) - min(x * cos(radians(a)) + y * sin(radians(a))) + abs(cos(radians(a))) + abs(sin(radians(a))) AS w FROM lab, (SELECT range + 1 AS a FROM range(180)) GROUP BY image, label, a),
fe AS (SELECT image, label, min(w) AS narrow, max(w) AS wide FROM fw GROUP BY image, label),
al AS (SELECT so.image AS image, so.label AS label, so.area::DOUBLE AS area, so.convex_area::DOUBLE AS hull, 6 * sqrt(so.convex_area / (1.5 * sqrt(3))) AS hrim, rim, coalesce(n, 0) AS n, narrow, wide, sqrt(3) AS r3 FROM so JOIN pe ON pe.image = so.image AND pe.label = so.label JOIN fe ON fe.image = so.image AND fe.label = so.label LEFT JOIN nb ON nb.image = so.image AND nb.label = so.label),
ls AS (SELECT *, [{", ".join(_AREAS)}] AS va, [{", ".join(_RIMS)}] AS vr, 1 / tan(pi() / n) AS cot FROM al WHERE n > 2 AND rim > 0),
ag AS (SELECT *, {_agreement("va", _AREAS)} AS pa, {_agreement("vr", _RIMS)} AS pr FROM ls),
sc AS (SELECT image, label, 10 * (1 - abs(1 - rim / n / sqrt(4 * area / (n * cot))) + 1 - abs(1 - area / (0.25 * n * (rim / n) * (rim / n) * cot))) / 2 AS polygonality,
  10 * (list_avg(pa) + list_avg(pr)) / 2 AS hexagonality, sqrt((list_var_samp(pa) + list_var_samp(pr)) / 2) AS hexagonality_sd FROM ag)"""


@plans.add("region_polygonality", _BLOCKS + _HULL + _POLYGONALITY + " SELECT al.image AS image, al.label AS label, round(polygonality, 4) AS polygonality, round(hexagonality, 4) AS hexagonality, round(hexagonality_sd, 4) AS hexagonality_sd FROM al LEFT JOIN sc ON sc.image = al.image AND sc.label = al.label")
def region_polygonality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = saved(_blocks(spark, sf_dir))  # each part reads them, some twice
    on = ["image", "label"]
    parts = shapes.solidity(labels).join(objects.perimeter(labels), on).join(objects.neighbours(labels, 1), on).join(objects.feret(labels), on)
    return shapes.polygonality(parts).select(*on, *[F.round(c, 4).alias(c) for c in ("polygonality", "hexagonality", "hexagonality_sd")])


@plans.add("median_pixels", _BLOCKS + ", m AS (SELECT image, label, median(y) AS my, median(x) AS mx FROM lab GROUP BY ALL), o AS (SELECT lab.*, row_number() OVER (PARTITION BY lab.image, lab.label ORDER BY (y - my) ** 2 + (x - mx) ** 2, y, x) AS k FROM lab JOIN m ON m.image = lab.image AND m.label = lab.label) SELECT image, label, y, x FROM o WHERE k = 1")
def median_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.median_pixels(_blocks(spark, sf_dir))


@plans.add("flow_fields")
def flow_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heat goes on until it has come everywhere, which SQL cannot say; the tests do it pixel by pixel."""
    return flows.flow_fields(_blocks(spark, sf_dir))


@plans.add("labels_of_flows")
def labels_of_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions follow the field, which SQL cannot say; the tests go from labels to fields and back."""
    _, side = _mask(spark, sf_dir)
    return flows.labels_of_flows(flows.flow_fields(_blocks(spark, sf_dir)), side, side)


_LEVELS = 4
_TONES = f""", en AS (SELECT lab.image AS image, label, min(px.v) AS least, max(px.v) AS most FROM lab JOIN px ON px.image = lab.image AND px.y = lab.y AND px.x = lab.x GROUP BY ALL),
tn AS (SELECT lab.image AS image, lab.label AS label, lab.y AS y, lab.x AS x, CASE WHEN most > least THEN least(CAST(floor((px.v - least) * {_LEVELS} / (most - least)) AS BIGINT) + 1, {_LEVELS}) ELSE 1 END AS g
  FROM lab JOIN px ON px.image = lab.image AND px.y = lab.y AND px.x = lab.x JOIN en ON en.image = lab.image AND en.label = lab.label)"""


def _tones(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    pixels, side = grown_raster(spark, sf_dir)
    return textures.toned(_blocks(spark, sf_dir), pixels, _LEVELS), side


def _rounded(df: DataFrame) -> DataFrame:
    """A little more than each value, so that halves round alike however they were summed."""
    return df.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c, kind in df.dtypes if kind == "double"})


@plans.add(
    "texture_cooccurrence",
    _BLOCKS + _TONES + """, dr(angle, dy, dx) AS (VALUES (0, 0, 1), (45, -1, 1), (90, -1, 0), (135, -1, -1)),
h AS (SELECT a.image AS image, a.label AS label, angle, a.g AS i, b.g AS j FROM tn AS a CROSS JOIN dr JOIN tn AS b ON b.image = a.image AND b.label = a.label AND b.y = a.y + dy AND b.x = a.x + dx),
p AS (SELECT image, label, angle, i, j, count(*) / sum(count(*)) OVER (PARTITION BY image, label, angle) AS p FROM (SELECT * FROM h UNION ALL SELECT image, label, angle, j, i FROM h) GROUP BY image, label, angle, i, j),
s AS (SELECT image, label, angle, sum((i - j) ** 2 * p) AS contrast, sum(abs(i - j) * p) AS dissimilarity, sum(p / (1 + (i - j) ** 2)) AS homogeneity, sum(p * p) AS energy, -sum(p * log2(p)) AS entropy, sum(i * p) AS m, sum(i * i * p) AS q, sum(i * j * p) AS r FROM p GROUP BY ALL)
SELECT image, label, angle, round(contrast + 1e-9, 6) AS contrast, round(dissimilarity + 1e-9, 6) AS dissimilarity, round(homogeneity + 1e-9, 6) AS homogeneity, round(energy + 1e-9, 6) AS energy, round(entropy + 1e-9, 6) AS entropy, round(CASE WHEN q - m * m > 1e-12 THEN (r - m * m) / (q - m * m) ELSE 1 END + 1e-9, 6) AS correlation FROM s""",
)
def texture_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(textures.cooccurrence(_tones(spark, sf_dir)[0]))


def _emphases(keys: str) -> str:
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    return f"""c AS (SELECT {keys}, g, size, count(*) AS n FROM z GROUP BY ALL),
e AS (SELECT {keys}, sum(n / (size * size)) AS small, sum(n * size * size) AS large, sum(n / (g * g)) AS low, sum(n * g * g) AS high, sum(n) AS al, sum(n * size) AS px FROM c GROUP BY ALL),
ug AS (SELECT {keys}, sum(n * n) AS ug FROM (SELECT {keys}, g, sum(n) AS n FROM c GROUP BY ALL) GROUP BY ALL),
us AS (SELECT {keys}, sum(n * n) AS us FROM (SELECT {keys}, size, sum(n) AS n FROM c GROUP BY ALL) GROUP BY ALL)
SELECT {", ".join(f"a.{k} AS {k}" for k in keys.split(", "))}, round(small / al + 1e-9, 6) AS small_emphasis, round(large / al + 1e-9, 6) AS large_emphasis, round(low / al + 1e-9, 6) AS low_level_emphasis, round(high / al + 1e-9, 6) AS high_level_emphasis,
  round(ug / al + 1e-9, 6) AS level_nonuniformity, round(us / al + 1e-9, 6) AS size_nonuniformity, round(al / px + 1e-9, 6) AS percentage FROM e AS a JOIN ug AS b ON {on} JOIN us AS d ON {on.replace("b.", "d.")}"""


_LINES = """, ln AS (SELECT image, label, g, unnest([{'angle': 0, 'line': y, 'pos': x}, {'angle': 45, 'line': y + x, 'pos': x}, {'angle': 90, 'line': x, 'pos': y}, {'angle': 135, 'line': y - x, 'pos': x}]) AS o FROM tn),
lp AS (SELECT image, label, g, o.angle AS angle, o.line AS line, o.pos AS pos FROM ln),
ch AS (SELECT *, CASE WHEN pos = lag(pos) OVER w + 1 AND g = lag(g) OVER w THEN 0 ELSE 1 END AS fresh FROM lp WINDOW w AS (PARTITION BY image, label, angle, line ORDER BY pos)),
nr AS (SELECT *, sum(fresh) OVER (PARTITION BY image, label, angle, line ORDER BY pos) AS k FROM ch),
z AS (SELECT image, label, angle, g, count(*) AS size FROM nr GROUP BY image, label, angle, line, k, g), """


@plans.add("texture_runs", _BLOCKS + _TONES + _LINES + _emphases("image, label, angle"))
def texture_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(textures.emphases(textures.runs(_tones(spark, sf_dir)[0]), ["image", "label", "angle"]))


_ZONES = """, th AS (SELECT *, y * 100000 + x AS id FROM tn),
rc(image, label, g, id, seed) AS (SELECT image, label, g, id, id FROM th UNION SELECT b.image, b.label, b.g, b.id, rc.seed FROM rc JOIN th AS a ON a.image = rc.image AND a.id = rc.id JOIN th AS b ON b.image = a.image AND b.label = a.label AND b.g = a.g AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 AND rc.seed < b.id),
zo AS (SELECT image, label, g, id, min(seed) AS zone FROM rc GROUP BY image, label, g, id),
z AS (SELECT image, label, g, count(*) AS size FROM zo GROUP BY image, label, g, zone), """


@plans.add("texture_zones", _BLOCKS + _TONES + _ZONES + _emphases("image, label"))
def texture_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    tones, side = _tones(spark, sf_dir)
    return _rounded(textures.emphases(textures.zones(tones, side), ["image", "label"]))


_CHANNELS = f"""WITH {GROWN}, ch AS (SELECT CASE image WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS c, y, x, v::DOUBLE AS v FROM px),
o AS (SELECT a.range - 1 AS dy, b.range - 1 AS dx FROM range(3) AS a, range(3) AS b), t AS (SELECT range AS target FROM range(3)),
ft AS (SELECT target, p.y AS y, p.x AS x, 1 + (q.c - CASE WHEN q.c > target THEN 1 ELSE 0 END) * 9 + (dy + 1) * 3 + dx + 1 AS i, q.v AS v FROM t CROSS JOIN o JOIN ch AS p ON p.c = target JOIN ch AS q ON q.c <> target AND q.y = p.y + dy AND q.x = p.x + dx, sd WHERE p.y BETWEEN 1 AND side - 2 AND p.x BETWEEN 1 AND side - 2
  UNION ALL SELECT c, y, x, 0, 1 FROM ch, sd WHERE y BETWEEN 1 AND side - 2 AND x BETWEEN 1 AND side - 2 UNION ALL SELECT c, y, x, 19, v FROM ch, sd WHERE y BETWEEN 1 AND side - 2 AND x BETWEEN 1 AND side - 2)"""


def _channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels, _ = grown_raster(spark, sf_dir)
    channel = F.when(F.col("image") == "A", 0).when(F.col("image") == "N", 1).otherwise(2)
    return pixels.select(F.lit(0).alias("image"), "y", "x", channel.alias("channel"), "v")


@plans.add("bleed_through_sums", _CHANNELS + " SELECT a.target AS target, a.i AS i, b.i AS j, sum(a.v * b.v) AS s, count(*) AS n FROM ft AS a JOIN ft AS b ON a.target = b.target AND a.y = b.y AND a.x = b.x AND a.i <= b.i GROUP BY ALL")
def bleed_through_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shading.normal_equations(_channels(spark, sf_dir), [0, 1, 2])


@plans.add("bleed_through")
def bleed_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The solution of the sums above; the tests find a mixing that was put in."""
    found = shading.bleed_through(_channels(spark, sf_dir), [0, 1, 2])
    rows = [(t, k, float(v)) for t, x in found.items() for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "target long, term long, share double")


@plans.add("flat_field_estimate")
def flat_field_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fit by turns, which SQL cannot say; the tests find a shading that was put in."""
    side = 8
    keys = [(F.col(c) % n).alias(k) for c, n, k in (("l_suppkey", 40, "image"), ("l_orderkey", side, "y"), ("l_partkey", side, "x"))]
    images = raster.dense(table(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.sum("l_quantity").cast("double").alias("v")), side, side)
    noisy = shading.Fit(softness=0.2, settled=1e-4)  # few line items a place
    return shading.field_table(images, shading.flat_field(images, side, side, how=noisy)[0], "shading")


#: Line items as matches: where a fixed map puts them, but for two of five, which are put anywhere.
_MOVED = [1.02, 0.05, 12.0, -0.04, 0.97, -7.0, 1e-5, -2e-5, 1.0]
_MATCHES = """WITH m AS (SELECT l_returnflag AS pair, (l_partkey * 7 % 1000)::DOUBLE AS x, (l_orderkey * 13 % 997)::DOUBLE AS y, l_orderkey * 10 + l_linenumber AS m, (l_orderkey + l_linenumber) % 5 < 2 AS wrong, l_suppkey * 31 % 1000 AS u, l_partkey * 17 % 1000 AS w FROM lineitem),
h AS (SELECT *, 1e-5 * x - 2e-5 * y + 1 AS d FROM m), p AS (SELECT *, (1.02 * x + 0.05 * y + 12) / d AS gx, (-0.04 * x + 0.97 * y - 7) / d AS gy FROM h)"""


@plans.add("registration", _MATCHES + " SELECT pair, count(*) AS n, count(*) FILTER (NOT wrong OR sqrt((u - gx) ** 2 + (w - gy) ** 2) <= 2) AS agreeing FROM p GROUP BY pair")
def registration_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many matches agree with the map that is found as with the one that was put in."""
    lines = table(spark, sf_dir, "lineitem")
    a, b, c, d, e, f, g, k, _ = _MOVED
    x, y = (F.col("l_partkey") * 7 % 1000).cast("double"), (F.col("l_orderkey") * 13 % 997).cast("double")
    wrong = (F.col("l_orderkey") + F.col("l_linenumber")) % 5 < 2
    w = x * g + y * k + 1
    u = F.when(wrong, F.col("l_suppkey") * 31 % 1000).otherwise((x * a + y * b + c) / w)
    v = F.when(wrong, F.col("l_partkey") * 17 % 1000).otherwise((x * d + y * e + f) / w)
    matches = lines.select(F.col("l_returnflag").alias("pair"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("m"), x.alias("x1"), y.alias("y1"), u.alias("x2"), v.alias("y2"))
    return registration.homographies(matches).select("pair", "n", "agreeing")


@plans.add(
    "chunked_pyramid",
    f"WITH {GROWN}, h AS (SELECT image, y // 2 AS y, x // 2 AS x, CAST(floor(avg(v)) AS BIGINT) AS v FROM px GROUP BY ALL), q AS (SELECT image, y // 2 AS y, x // 2 AS x, CAST(floor(avg(v)) AS BIGINT) AS v FROM h GROUP BY ALL) "
    "SELECT image, 0 AS level, y, x, v FROM px UNION ALL SELECT image, 1, y, x, v FROM h UNION ALL SELECT image, 2, y, x, v FROM q",
)
def chunked_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image and its halves as stored chunks, read back; each level is made from what the one before has stored."""
    folder = f"{(spark.conf.get('spark.checkpoint.dir', None) or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/chunks-{uuid.uuid4().hex}"
    now, found = grown_raster(spark, sf_dir)[0], None
    for level in range(3):
        chunks.write_chunks(chunks.chunked(now, 16, level), f"{folder}/{level}", 16)
        stored = chunks.read_chunks(spark, f"{folder}/{level}")
        found = stored if found is None else found.unionByName(stored)
        now = raster.pyramid_mean(stored)
    return found


@plans.add(
    "rotate_raster",
    f"""WITH {GROWN}, an(image, a) AS (VALUES ('A', radians(30.0)), ('N', radians(-45.0)), ('R', radians(90.0))),
sr AS (SELECT px.image AS image, y, x, round((x - (side - 1) / 2) * sin(a) + (y - (side - 1) / 2) * cos(a) + (side - 1) / 2, 9) AS sy, round((x - (side - 1) / 2) * cos(a) - (y - (side - 1) / 2) * sin(a) + (side - 1) / 2, 9) AS sx FROM px JOIN an ON an.image = px.image, sd),
co AS (SELECT image, y, x, CAST(floor(sy) AS BIGINT) + i AS cy, CAST(floor(sx) AS BIGINT) + j AS cx, (CASE i WHEN 1 THEN sy - floor(sy) ELSE 1 - sy + floor(sy) END) * (CASE j WHEN 1 THEN sx - floor(sx) ELSE 1 - sx + floor(sx) END) AS w FROM sr, (SELECT range AS i FROM range(2)), (SELECT range AS j FROM range(2)))
SELECT co.image AS image, co.y AS y, co.x AS x, round(sum(w * coalesce(px.v, 0)) + 1e-9, 5) AS v FROM co LEFT JOIN px ON px.image = co.image AND px.y = cy AND px.x = cx GROUP BY co.image, co.y, co.x""",
)
def rotate_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels, side = grown_raster(spark, sf_dir)
    angles = spark.createDataFrame([("A", 30), ("N", -45), ("R", 90)], "image string, degrees int")
    return plates.rotated(pixels, angles, side, side).withColumn("v", F.round(F.col("v") + 1e-9, 5))


@plans.add("plate_wells")
def plate_wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plates of 24 wells that are brighter than what the table has counted there; the tests draw plates and find them."""
    height, width, at = 72, 104, lambda c: (F.col(c) % 16 - 8) * (F.col(c) % 16 - 8)
    keys = [F.col("l_returnflag").alias("image"), (F.col("l_orderkey") % height).alias("y"), (F.col("l_partkey") % width).alias("x")]
    pixels = raster.dense(table(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.count(F.lit(1)).alias("v")), height, width)
    well = (at("y") + at("x") <= 26) & (F.col("y") < 64) & (F.col("x") < 96)
    return plates.plates(pixels.withColumn("v", F.least("v", F.lit(50)) + F.when(well, 100).otherwise(0)), height, width)
