"""Queries over rasters and objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.operators import objects, raster, thresholds
from mosaiq.plans.common import RASTER, SIDE, Plans, lines_raster, table

plans = Plans()


@plans.add("raster_from_keys", f"WITH {RASTER} SELECT image, y, x, v FROM px")
def raster_from_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_raster(spark, sf_dir)


_SECOND = f"raw2 AS (SELECT l_returnflag AS image, l_suppkey % {SIDE} AS y, l_orderkey % {SIDE} AS x, count(*) AS v FROM lineitem GROUP BY ALL), px2 AS (SELECT px.image AS image, px.y AS y, px.x AS x, coalesce(raw2.v, 0) AS w FROM px LEFT JOIN raw2 ON px.image = raw2.image AND px.y = raw2.y AND px.x = raw2.x)"
_CALC = {"add": "v + w", "subtract": "v - w", "multiply": "v * w", "divide": "CASE WHEN w <> 0 THEN CAST(floor(v / w) AS BIGINT) ELSE 0 END", "and": "v & w", "or": "v | w", "xor": "xor(v, w)", "min": "least(v, w)", "max": "greatest(v, w)", "absdiff": "abs(v - w)"}


def _second(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("image"), (F.col("l_suppkey") % SIDE).alias("y"), (F.col("l_orderkey") % SIDE).alias("x")).agg(F.count(F.lit(1)).alias("v"))
    return raster.dense(counts, SIDE, SIDE)


def _calculator(operation: str) -> None:
    @plans.add(f"calc_{operation}", f"WITH {RASTER}, {_SECOND} SELECT px.image AS image, px.y AS y, px.x AS x, CAST({_CALC[operation]} AS BIGINT) AS v FROM px JOIN px2 ON px.image = px2.image AND px.y = px2.y AND px.x = px2.x")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return raster.calculate(lines_raster(spark, sf_dir), _second(spark, sf_dir), operation)


for _operation in raster.OPERATIONS:
    _calculator(_operation)


@plans.add("calc_wrapped", f"WITH {RASTER}, {_SECOND} SELECT px.image AS image, px.y AS y, px.x AS x, ((v - w) % 256 + 256) % 256 AS v FROM px JOIN px2 ON px.image = px2.image AND px.y = px2.y AND px.x = px2.x")
def calc_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.calculate(lines_raster(spark, sf_dir), _second(spark, sf_dir), "subtract", bits=8)


def _projection(how: str, sql: str) -> None:
    @plans.add(f"project_{how}", f"WITH {RASTER} SELECT y, x, {sql} AS v FROM px GROUP BY y, x")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return raster.project(lines_raster(spark, sf_dir), how)


for _how, _sql in (("max", "max(v)"), ("min", "min(v)"), ("mean", "CAST(floor(avg(v)) AS BIGINT)")):
    _projection(_how, _sql)

_NEAR = "SELECT p.image AS image, p.y AS y, p.x AS x, {f} AS v FROM {t} AS p JOIN {t} AS q ON p.image = q.image AND abs(p.y - q.y) <= 1 AND abs(p.x - q.x) <= 1 GROUP BY ALL"
_UP, _DOWN = _NEAR.replace("{f}", "max(q.v)"), _NEAR.replace("{f}", "min(q.v)")
_MORPH = {
    "dilate": (raster.dilate, f"WITH {RASTER} " + _UP.format(t="px")),
    "erode": (raster.erode, f"WITH {RASTER} " + _DOWN.format(t="px")),
    "gradient": (raster.gradient, f"WITH {RASTER} " + _NEAR.format(t="px", f="max(q.v) - min(q.v)")),
    "opened": (raster.opened, f"WITH {RASTER}, a AS ({_DOWN.format(t='px')}) " + _UP.format(t="a")),
    "closed": (raster.closed, f"WITH {RASTER}, a AS ({_UP.format(t='px')}) " + _DOWN.format(t="a")),
    "top_hat": (raster.top_hat, f"WITH {RASTER}, a AS ({_DOWN.format(t='px')}), b AS ({_UP.format(t='a')}) SELECT px.image AS image, px.y AS y, px.x AS x, px.v - b.v AS v FROM px JOIN b USING (image, y, x)"),
    "black_hat": (raster.black_hat, f"WITH {RASTER}, a AS ({_UP.format(t='px')}), b AS ({_DOWN.format(t='a')}) SELECT px.image AS image, px.y AS y, px.x AS x, b.v - px.v AS v FROM px JOIN b USING (image, y, x)"),
}


def _morphology(name: str) -> None:
    f, sql = _MORPH[name]

    @plans.add(f"morph_{name}", sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(lines_raster(spark, sf_dir))


for _name in _MORPH:
    _morphology(_name)


@plans.add(
    "sobel",
    f"""WITH {RASTER}, g AS (SELECT p.image AS image, p.y AS y, p.x AS x, sum(q.v * (q.x - p.x) * (2 - abs(q.y - p.y))) AS a, sum(q.v * (q.y - p.y) * (2 - abs(q.x - p.x))) AS b
FROM px AS p JOIN px AS q ON p.image = q.image AND abs(p.y - q.y) <= 1 AND abs(p.x - q.x) <= 1 GROUP BY ALL) SELECT image, y, x, round(sqrt(a * a + b * b), 6) AS v FROM g""",
)
def sobel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.sobel(lines_raster(spark, sf_dir)).withColumn("v", F.round("v", 6))


@plans.add("box_mean", f"WITH {RASTER} SELECT p.image AS image, p.y AS y, p.x AS x, round(avg(q.v), 6) AS v FROM px AS p JOIN px AS q ON p.image = q.image AND abs(p.y - q.y) <= 2 AND abs(p.x - q.x) <= 2 GROUP BY ALL")
def box_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.box_mean(lines_raster(spark, sf_dir), 2).withColumn("v", F.round("v", 6))


@plans.add("integral_image", f"WITH {RASTER}, r AS (SELECT image, y, x, sum(v) OVER (PARTITION BY image, y ORDER BY x) AS s FROM px) SELECT image, y, x, CAST(sum(s) OVER (PARTITION BY image, x ORDER BY y) AS BIGINT) AS v FROM r")
def integral_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.integral(lines_raster(spark, sf_dir))


@plans.add("pyramid_mean", f"WITH {RASTER} SELECT image, y // 2 AS y, x // 2 AS x, CAST(floor(avg(v)) AS BIGINT) AS v FROM px GROUP BY ALL")
def pyramid_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.pyramid_mean(lines_raster(spark, sf_dir))


@plans.add("pyramid_mode", f"WITH {RASTER}, c AS (SELECT image, y // 2 AS y, x // 2 AS x, v, count(*) AS n FROM px GROUP BY ALL) SELECT image, y, x, arg_max(v, (n, v)) AS v FROM c GROUP BY ALL")
def pyramid_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.pyramid_mode(lines_raster(spark, sf_dir))


@plans.add("crop_flip", f"WITH {RASTER} SELECT image, 9 - (y - 5) AS y, x - 3 AS x, v FROM px WHERE y >= 5 AND y < 15 AND x >= 3 AND x < 20")
def crop_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.flip(raster.crop(lines_raster(spark, sf_dir), (5, 15), (3, 20)), "y")


@plans.add(
    "assemble_tiles",
    f"WITH {RASTER}, t AS (SELECT y + CASE image WHEN 'A' THEN 0 WHEN 'N' THEN 20 ELSE 40 END AS y, x + CASE image WHEN 'A' THEN 0 WHEN 'N' THEN 5 ELSE 10 END AS x, image, v FROM px) SELECT y, x, arg_max(v, image) AS v FROM t GROUP BY y, x",
)
def assemble_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector = spark.createDataFrame([("A", 1, 0, 0), ("N", 2, 20, 5), ("R", 3, 40, 10)], "file string, line long, pos_y long, pos_x long")
    return raster.assemble(lines_raster(spark, sf_dir), vector)


_HIST = f"WITH {RASTER}, h AS (SELECT image, v, count(*) AS n FROM px GROUP BY ALL)"
_CAND = _HIST + ", c0 AS (SELECT image, v, n, sum(n) OVER u AS n0, sum(n * v) OVER u AS s0, sum(n) OVER e AS total, sum(n * v) OVER e AS s FROM h WINDOW u AS (PARTITION BY image ORDER BY v ROWS UNBOUNDED PRECEDING), e AS (PARTITION BY image)), c AS (SELECT image, v, n, n0::DOUBLE AS n0, (total - n0)::DOUBLE AS n1, total::DOUBLE AS total, s0 / n0 AS m0, (s - s0) / nullif(total - n0, 0) AS m1 FROM c0)"
_THRESHOLDS = {
    "otsu": _CAND + " SELECT image, arg_max(v, (k, -v)) AS threshold FROM (SELECT image, v, round(n0 * n1 * (m0 - m1) ** 2 / (total * total), 9) AS k FROM c WHERE n1 > 0) GROUP BY image",
    "mean": _HIST + " SELECT image, CAST(floor(sum(n * v) / sum(n)) AS BIGINT) AS threshold FROM h GROUP BY image",
    "isodata": _CAND + " SELECT image, min(v) AS threshold FROM c WHERE n1 > 0 AND v >= (m0 + m1) / 2 GROUP BY image",
    "maxentropy": _HIST + ", c AS (SELECT image, v, (sum(n) OVER u)::DOUBLE AS n0, sum(n * ln(n)) OVER u AS e0, (sum(n) OVER e)::DOUBLE AS total, sum(n * ln(n)) OVER e AS e1 FROM h WINDOW u AS (PARTITION BY image ORDER BY v ROWS UNBOUNDED PRECEDING), e AS (PARTITION BY image)) SELECT image, arg_max(v, (k, -v)) AS threshold FROM (SELECT image, v, round(ln(n0) - e0 / n0 + ln(total - n0) - (e1 - e0) / (total - n0), 9) AS k FROM c WHERE total > n0) GROUP BY image",
    "triangle": _HIST + ", p AS (SELECT image, arg_max(v, (n, -v)) AS pv, max(n) AS pn, max(v) AS ev, arg_max(n, v) AS en FROM h GROUP BY image) SELECT image, arg_max(v, (k, -v)) AS threshold FROM (SELECT h.image AS image, v, CASE WHEN ev > pv THEN round(pn + (en - pn) * (v - pv) / (ev - pv) - n, 9) ELSE 0 END AS k FROM h JOIN p ON h.image = p.image WHERE v >= pv) GROUP BY image",
}


_RUN = _HIST + ", p AS (SELECT *, n / (sum(n) OVER (PARTITION BY image))::DOUBLE AS p FROM h), c AS (SELECT image, v, p, sum(p) OVER u AS p0, sum(p) OVER e - sum(p) OVER u AS p1, sum(p * p) OVER u AS q0, sum(p * p) OVER e - sum(p * p) OVER u AS q1, sum(sqrt(p)) OVER u AS r0, sum(sqrt(p)) OVER e - sum(sqrt(p)) OVER u AS r1, sum(p * ln(p)) OVER u AS e0, sum(p * ln(p)) OVER e - sum(p * ln(p)) OVER u AS e1, sum(n) OVER u AS cu, sum(n) OVER e AS total, n, sum(p * v) OVER u AS s0, sum(p * v) OVER e - sum(p * v) OVER u AS s1, sum(p * v * v) OVER u AS z0, sum(p * v * v) OVER e - sum(p * v * v) OVER u AS z1, lead(v) OVER (PARTITION BY image ORDER BY v) AS after FROM p WINDOW u AS (PARTITION BY image ORDER BY v ROWS UNBOUNDED PRECEDING), e AS (PARTITION BY image))"
_ARGMIN = " SELECT image, arg_min(v, (round({k}, 9), v)) AS threshold FROM {t} WHERE {k} IS NOT NULL GROUP BY image"
_SIG = "(CASE WHEN z{k} / p{k} - (s{k} / p{k}) ** 2 > 1e-9 THEN p{k} * ln(z{k} / p{k} - (s{k} / p{k}) ** 2) - 2 * p{k} * ln(p{k}) END)"
_RENYI = {"half": "2 * ln(r0 * r1 / sqrt(p0 * p1))", "one": "ln(p0) - e0 / p0 + ln(p1) - e1 / p1", "two": "-ln(q0 * q1 / (p0 * p1) ** 2)"}
_THRESHOLDS |= {
    "rosin": _THRESHOLDS["triangle"],
    "li": _RUN + ", k AS (SELECT image, v, -(CASE WHEN s0 > 0 THEN s0 * ln(s0 / p0) ELSE 0 END + CASE WHEN s1 > 0 THEN s1 * ln(s1 / p1) ELSE 0 END) AS k FROM c WHERE cu < total)" + _ARGMIN.format(k="k", t="k"),
    "minerror": _RUN + f", k AS (SELECT image, v, 1 + {_SIG.format(k=0)} + {_SIG.format(k=1)} AS k FROM c WHERE cu < total)" + _ARGMIN.format(k="k", t="k"),
    "percentile": _RUN + _ARGMIN.format(k="abs(cu / total - 0.5)", t="c"),
    "yen": _RUN + ", k AS (SELECT image, v, ln(q0 * q1) - 2 * ln(p0 * p1) AS k FROM c WHERE q1 > 1e-15)" + _ARGMIN.format(k="k", t="k"),
    "moments": _RUN + ", m AS (SELECT image, sum(p * v) AS m1, sum(p * v ** 2) AS m2, sum(p * v ** 3) AS m3 FROM p GROUP BY image), k AS (SELECT image, m1, (m1 * m3 - m2 * m2) / (m2 - m1 * m1) AS c0, (m1 * m2 - m3) / (m2 - m1 * m1) AS c1 FROM m), d AS (SELECT image, ((-c1 + sqrt(c1 * c1 - 4 * c0)) / 2 - m1) / sqrt(c1 * c1 - 4 * c0) AS dark FROM k) SELECT c.image AS image, min(v) AS threshold FROM c JOIN d ON c.image = d.image WHERE round(cu / total - dark, 9) > 0 GROUP BY c.image",
    "ij1": _RUN + ", k AS (SELECT *, (s0 / p0 + s1 / p1) / 2 AS mid FROM c WHERE cu < total) SELECT image, CAST(floor(round(arg_min(mid, v), 9) + 0.5) AS BIGINT) AS threshold FROM k WHERE after + 1 > mid GROUP BY image",
    "huang": _RUN + ", s AS (SELECT image, max(v) - min(v) AS span FROM h GROUP BY image), f AS (SELECT c.image AS image, c.v AS v, h.n AS n, total, 1 / (1 + abs(h.v - CASE WHEN h.v <= c.v THEN s0 / p0 ELSE s1 / p1 END) / span) AS b FROM c JOIN h ON c.image = h.image JOIN s ON s.image = c.image WHERE cu < total), k AS (SELECT image, v, sum(n * CASE WHEN b < 1 - 1e-12 THEN -b * ln(b) - (1 - b) * ln(1 - b) ELSE 0 END) / any_value(total) AS k FROM f GROUP BY image, v)" + _ARGMIN.format(k="k", t="k"),
    "shanbhag": _RUN + ", k AS (SELECT c.image AS image, c.v AS v, abs(sum(CASE WHEN d.v <= c.v THEN -d.n / c.cu * ln(1 - 0.5 * (d.cu - d.n) / c.cu) END) - sum(CASE WHEN d.v > c.v THEN -d.n / (c.total - c.cu) * ln(1 - 0.5 * (c.total - d.cu) / (c.total - c.cu)) END)) / 2 AS k FROM c JOIN c AS d ON c.image = d.image WHERE c.cu < c.total GROUP BY c.image, c.v)" + _ARGMIN.format(k="k", t="k"),
    "renyi": _RUN + ", b AS (SELECT image, " + ", ".join(f"arg_max({{'v': v, 'p': p0}}, (round({f}, 9), -v)) AS {k}" for k, f in _RENYI.items()) + " FROM c WHERE p1 > 1e-12 AND q1 > 1e-15 GROUP BY image), t AS (SELECT image, list_sort([half, one, two]) AS t FROM b), g AS (SELECT image, t[1].v AS v1, t[2].v AS v2, t[3].v AS v3, t[1].p AS x1, t[3].p AS x3, (t[2].v - t[1].v <= 5) AS low, (t[3].v - t[2].v <= 5) AS high FROM t) SELECT image, CAST(floor(round(v1 * (x1 + 0.25 * (x3 - x1) * CASE WHEN low = high THEN 1 WHEN low THEN 0 ELSE 3 END) + 0.25 * v2 * (x3 - x1) * CASE WHEN low = high THEN 2 ELSE 1 END + v3 * (1 - x3 + 0.25 * (x3 - x1) * CASE WHEN low = high THEN 1 WHEN low THEN 3 ELSE 0 END), 9)) AS BIGINT) AS threshold FROM g",
}


def _threshold(name: str) -> None:
    @plans.add(f"threshold_{name}", _THRESHOLDS.get(name))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return thresholds.METHODS[name](thresholds.histogram(lines_raster(spark, sf_dir)))


for _name in thresholds.METHODS:
    _threshold(_name)

_MASK = f"{RASTER}, mu AS (SELECT image, floor(avg(v)) + 2 AS t FROM px GROUP BY image), mask AS (SELECT px.image AS image, y, x, CAST(v > t AS BIGINT) AS v FROM px JOIN mu ON px.image = mu.image)"
_LABELS = (
    f"WITH RECURSIVE {_MASK}, fg AS (SELECT image, y, x, y * {SIDE} + x + 1 AS id FROM mask WHERE v > 0), "
    "adj AS (SELECT a.image AS image, a.id AS u, b.id AS w FROM fg AS a JOIN fg AS b ON a.image = b.image AND abs(a.y - b.y) + abs(a.x - b.x) = 1), "
    "reach(image, id, seed) AS (SELECT image, id, id FROM fg UNION SELECT adj.image, adj.w, reach.seed FROM reach JOIN adj ON reach.image = adj.image AND reach.id = adj.u AND reach.seed < adj.w), "
    f"lab AS (SELECT image, (id - 1) // {SIDE} AS y, (id - 1) % {SIDE} AS x, min(seed) AS label FROM reach GROUP BY image, id)"
)


def _mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = lines_raster(spark, sf_dir)
    return thresholds.apply(pixels, thresholds.mean(thresholds.histogram(pixels)).withColumn("threshold", F.col("threshold") + 2))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects.components(_mask(spark, sf_dir), SIDE)


@plans.add("mask_above_mean", f"WITH {_MASK} SELECT image, y, x, v FROM mask")
def mask_above_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mask(spark, sf_dir)


@plans.add("row_runs", f"WITH {_MASK}, i AS (SELECT *, x - row_number() OVER (PARTITION BY image, y ORDER BY x) AS k FROM mask WHERE v > 0) SELECT image, y, min(x) AS x0, max(x) AS x1 FROM i GROUP BY image, y, k")
def row_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects.runs(_mask(spark, sf_dir))


@plans.add("components", _LABELS + " SELECT image, y, x, label FROM lab")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir)


@plans.add("relabel", _LABELS + " SELECT image, y, x, dense_rank() OVER (PARTITION BY image ORDER BY label) AS label FROM lab")
def relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects.relabel(_labels(spark, sf_dir))


@plans.add("remove_small", _LABELS + " SELECT image, y, x, label FROM (SELECT *, count(*) OVER (PARTITION BY image, label) AS n FROM lab) WHERE n >= 4")
def remove_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects.remove_by_size(_labels(spark, sf_dir), least=4)


@plans.add("remove_large", _LABELS + " SELECT image, y, x, label FROM (SELECT *, count(*) OVER (PARTITION BY image, label) AS n FROM lab) WHERE n <= 10")
def remove_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects.remove_by_size(_labels(spark, sf_dir), most=10)


@plans.add("clear_border", _LABELS + f" SELECT image, y, x, label FROM lab WHERE (image, label) NOT IN (SELECT (image, label) FROM lab WHERE y = 0 OR x = 0 OR y = {SIDE - 1} OR x = {SIDE - 1})")
def clear_border(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects.clear_border(_labels(spark, sf_dir), SIDE, SIDE)


_PROPS = _LABELS + ", m AS (SELECT image, label, count(*) AS area, min(y) AS y0, min(x) AS x0, max(y) AS y1, max(x) AS x1, avg(y) AS cy, avg(x) AS cx, var_pop(y) + 1 / 12 AS vy, var_pop(x) + 1 / 12 AS vx, covar_pop(y, x) AS cv FROM lab GROUP BY image, label), e AS (SELECT *, (vy + vx + sqrt((vy - vx) ** 2 + 4 * cv * cv)) / 2 AS l1, greatest(0, (vy + vx - sqrt((vy - vx) ** 2 + 4 * cv * cv)) / 2) AS l2 FROM m)"
_SHAPES = ["cy", "cx", "major_axis", "minor_axis", "eccentricity", "equivalent_diameter"]


@plans.add("region_properties", _PROPS + " SELECT image, label, area, y0, x0, y1, x1, round(cy, 5) AS cy, round(cx, 5) AS cx, round(4 * sqrt(l1), 5) AS major_axis, round(4 * sqrt(l2), 5) AS minor_axis, round(sqrt(greatest(0, 1 - l2 / l1)), 5) AS eccentricity, round(sqrt(4 * area / pi()), 5) AS equivalent_diameter FROM e")
def region_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects.properties(_labels(spark, sf_dir)).withColumns({c: F.round(c, 5) for c in _SHAPES})


@plans.add(
    "region_intensity",
    _LABELS + ", b AS (SELECT lab.image AS image, label, px.v AS v FROM lab JOIN px USING (image, y, x)), c AS (SELECT image, label, v, count(*) AS n FROM b GROUP BY ALL), h AS (SELECT image, label, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS entropy FROM c GROUP BY ALL), q AS (SELECT image, label, arg_max(v, (n, -v)) AS m FROM c GROUP BY ALL), d AS (SELECT image, label, v - avg(v) OVER (PARTITION BY image, label) AS d FROM b), k AS (SELECT d.image AS image, d.label AS label, any_value(m) AS m, CASE WHEN avg(d ** 2) > 1e-12 THEN avg(d ** 3) / avg(d ** 2) ** 1.5 ELSE 0 END AS sk, CASE WHEN avg(d ** 2) > 1e-12 THEN avg(d ** 4) / avg(d ** 2) ** 2 ELSE 0 END AS ku FROM d JOIN q ON q.image = d.image AND q.label = d.label GROUP BY ALL) "
    "SELECT b.image AS image, b.label AS label, round(avg(v), 6) AS mean, min(v) AS least, max(v) AS greatest, round(quantile_cont(v::DOUBLE, 0.5), 6) AS median, round(stddev_pop(v), 6) AS std, round(any_value(entropy), 6) AS entropy, any_value(m) AS mode, round(any_value(sk), 5) AS skewness, round(any_value(ku), 5) AS kurtosis FROM b JOIN k ON b.image = k.image AND b.label = k.label JOIN h ON b.image = h.image AND b.label = h.label GROUP BY ALL",
)
def region_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = objects.intensities(_labels(spark, sf_dir), lines_raster(spark, sf_dir))
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "median", "std", "entropy")} | {c: F.round(c, 5) for c in ("skewness", "kurtosis")})


@plans.add("region_neighbours", _LABELS + ", p AS (SELECT a.image AS image, a.label AS label, count(DISTINCT b.label) AS n FROM lab AS a JOIN lab AS b ON a.image = b.image AND a.label <> b.label AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY ALL) SELECT DISTINCT lab.image AS image, lab.label AS label, coalesce(n, 0) AS neighbours FROM lab LEFT JOIN p ON lab.image = p.image AND lab.label = p.label")
def region_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects.neighbours(_labels(spark, sf_dir), 2)


@plans.add("feret_diameters", _LABELS + ", w AS (SELECT image, label, a, max(x * cos(radians(a)) + y * sin(radians(a))) - min(x * cos(radians(a)) + y * sin(radians(a))) + abs(cos(radians(a))) + abs(sin(radians(a))) AS w FROM lab, (SELECT range + 1 AS a FROM range(180)) GROUP BY image, label, a) SELECT image, label, round(min(w), 5) AS feret_min, round(max(w), 5) AS feret_max FROM w GROUP BY image, label")
def feret_diameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects.feret(_labels(spark, sf_dir)).withColumns({c: F.round(c, 5) for c in ("feret_min", "feret_max")})


#: Objects as blocks of a grid cut by a mask, for measures that need no components.
_BLOCKS = f"WITH {RASTER}, lab AS (SELECT image, y, x, (y // 8) * 3 + x // 8 + 1 AS label FROM px WHERE v % 5 >= 1)"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_raster(spark, sf_dir).filter("v % 5 >= 1").select("image", "y", "x", (F.floor(F.col("y") / 8) * 3 + F.floor(F.col("x") / 8) + 1).alias("label"))


@plans.add("region_orientation", _BLOCKS + ", m AS (SELECT image, label, round(var_pop(x) * count(*), 9) AS uyy, round(var_pop(y) * count(*), 9) AS uxx, round(covar_pop(y, x) * count(*), 9) AS uxy FROM lab GROUP BY ALL), t AS (SELECT image, label, CASE WHEN uyy > uxx THEN uyy - uxx + sqrt((uyy - uxx) ** 2 + 4 * uxy ** 2) ELSE 2 * uxy END AS n, CASE WHEN uyy > uxx THEN 2 * uxy ELSE uxx - uyy + sqrt((uyy - uxx) ** 2 + 4 * uxy ** 2) END AS d FROM m) SELECT image, label, round(CASE WHEN n = 0 AND d = 0 THEN 0 WHEN d = 0 THEN -90 ELSE -degrees(atan(n / d)) END, 5) AS degrees FROM t")
def region_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects.orientation(_blocks(spark, sf_dir)).withColumn("degrees", F.round("degrees", 5))


@plans.add(
    "region_perimeter",
    _BLOCKS + ", bo AS (SELECT a.image AS image, a.label AS label, a.y AS y, a.x AS x FROM lab AS a LEFT JOIN lab AS b ON a.image = b.image AND a.label = b.label AND abs(a.y - b.y) + abs(a.x - b.x) = 1 GROUP BY ALL HAVING count(b.y) < 4), "
    "co AS (SELECT a.image AS image, a.label AS label, a.y AS y, a.x AS x, 1 + sum(CASE abs(a.y - b.y) + abs(a.x - b.x) WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 10 END) AS c FROM bo AS a JOIN bo AS b ON a.image = b.image AND a.label = b.label AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL) "
    "SELECT image, label, round(sum(CASE WHEN c IN (5, 7, 15, 17, 25, 27) THEN 1 WHEN c IN (21, 33) THEN sqrt(2) WHEN c IN (13, 23) THEN (1 + sqrt(2)) / 2 ELSE 0 END), 6) AS perimeter FROM co GROUP BY image, label",
)
def region_perimeter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects.perimeter(_blocks(spark, sf_dir)).withColumn("perimeter", F.round("perimeter", 6))


@plans.add(
    "region_euler",
    _BLOCKS + ", g AS (SELECT l.image AS image, l.label AS label, l.y + o.y AS y, l.x + o.x AS x, sum(CASE WHEN o.y = 0 AND o.x = 0 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN o.y = 0 AND o.x = 1 THEN 1 ELSE 0 END) AS b, sum(CASE WHEN o.y = 1 AND o.x = 0 THEN 1 ELSE 0 END) AS c, sum(CASE WHEN o.y = 1 AND o.x = 1 THEN 1 ELSE 0 END) AS d FROM lab AS l, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS o(y, x) GROUP BY ALL) "
    "SELECT image, label, CAST((count(*) FILTER (a + b + c + d = 1) - count(*) FILTER (a + b + c + d = 3) - 2 * count(*) FILTER (a + b + c + d = 2 AND (a = d))) / 4 AS BIGINT) AS euler FROM g GROUP BY image, label",
)
def region_euler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects.euler(_blocks(spark, sf_dir))
