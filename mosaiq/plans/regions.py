"""Queries over regions: matching of two segmentations, boxes, relabelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.operators import objects, regions
from mosaiq.plans.common import RASTER, Plans, lines_raster

plans = Plans()

_SHAPE = "SELECT *, 4 * sqrt(greatest(0, (vy + vx - sqrt((vy - vx) ** 2 + 4 * cv * cv)) / 2)) AS minor FROM (SELECT image, label, count(*) AS area, avg(y) AS cy, avg(x) AS cx, min(y) AS y1, min(x) AS x1, max(y) AS y2, max(x) AS x2, var_pop(y) + 1 / 12 AS vy, var_pop(x) + 1 / 12 AS vx, covar_pop(y, x) AS cv FROM {t} GROUP BY image, label)"
_TWO = (
    f"WITH {RASTER}, gt AS (SELECT image, y, x, (y // 4) * 6 + x // 4 + 1 AS label FROM px WHERE v % 5 >= 2), pr AS (SELECT image, y, x, ((y + 1) // 4) * 7 + (x + 1) // 4 + 1 AS label FROM px WHERE v % 5 >= 3), "
    f"gp AS ({_SHAPE.format(t='gt')}), pp AS ({_SHAPE.format(t='pr')}), "
    "near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image, l ORDER BY round(distance, 9), r) AS rank FROM (SELECT gp.image AS image, gp.label AS l, pp.label AS r, sqrt((gp.cy - pp.cy) ** 2 + (gp.cx - pp.cx) ** 2) AS distance FROM gp JOIN pp ON gp.image = pp.image)) WHERE rank <= 5), "
    "ov AS (SELECT c.image AS image, l, r, n, n / (gp.area + pp.area - n) AS iou FROM (SELECT gt.image AS image, gt.label AS l, pr.label AS r, count(*) AS n FROM gt JOIN pr ON gt.image = pr.image AND gt.y = pr.y AND gt.x = pr.x GROUP BY ALL) AS c JOIN gp ON gp.image = c.image AND gp.label = l JOIN pp ON pp.image = c.image AND pp.label = r), "
    "cl AS (SELECT near.image AS image, near.l AS l, near.r AS r, distance, coalesce(iou, 0) AS iou, distance < minor / 2 * 0.9 AND coalesce(iou, 0) > 0.1 AS ok FROM near JOIN gp ON gp.image = near.image AND gp.label = near.l LEFT JOIN ov ON ov.image = near.image AND ov.l = near.l AND ov.r = near.r WHERE rank = 1), "
    "ma AS (SELECT *, CASE WHEN ok AND row_number() OVER (PARTITION BY image, r, ok ORDER BY l) = 1 THEN 'TP' ELSE 'FN' END AS condition FROM cl)"
)


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two segmentations of the images: blocks of two grids, cut by two masks."""
    px = lines_raster(spark, sf_dir)
    block = lambda shift, n: (F.floor((F.col("y") + shift) / 4) * n + F.floor((F.col("x") + shift) / 4) + 1).alias("label")
    return px.filter("v % 5 >= 2").select("image", "y", "x", block(0, 6)), px.filter("v % 5 >= 3").select("image", "y", "x", block(1, 7))


def _nearest(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return regions.nearest(*map(objects.properties, _two(spark, sf_dir)), k, 4.0)


@plans.add("region_nearest", _TWO + " SELECT image, l AS left, r AS right, round(distance, 6) AS distance, rank FROM near")
def region_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, 5).withColumn("distance", F.round("distance", 6))


@plans.add("region_overlap", _TWO + " SELECT image, l AS left, r AS right, n AS common, round(iou, 6) AS iou FROM ov")
def region_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.overlaps(*_two(spark, sf_dir)).withColumn("iou", F.round("iou", 6))


@plans.add(
    "region_contained",
    _TWO + " SELECT near.image AS image, near.l AS left, near.r AS right FROM near JOIN pp ON pp.image = near.image AND pp.label = near.r JOIN gp ON gp.image = near.image AND gp.label = near.l WHERE pp.area > 2 AND (EXISTS (SELECT 1 FROM gt WHERE gt.image = near.image AND gt.label = near.l AND gt.y = floor(pp.cy) AND gt.x = floor(pp.cx)) OR EXISTS (SELECT 1 FROM pr WHERE pr.image = near.image AND pr.label = near.r AND pr.y = floor(gp.cy) AND pr.x = floor(gp.cx)))",
)
def region_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, pred = _two(spark, sf_dir)
    return regions.contained(_nearest(spark, sf_dir, 5), gt, pred, objects.properties(gt), objects.properties(pred))


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, pred = _two(spark, sf_dir)
    return regions.matched(_nearest(spark, sf_dir, 1), regions.overlaps(gt, pred), objects.properties(gt), 0.9, 0.1)


@plans.add("region_matches", _TWO + " SELECT image, l AS left, r AS right, round(distance, 6) AS distance, round(iou, 6) AS iou, condition FROM ma")
def region_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("distance", "iou")})


@plans.add("region_match_summary", _TWO + " SELECT image, count(*) FILTER (condition = 'TP') AS tp, count(*) FILTER (condition = 'FN') AS fn, round(coalesce(avg(distance) FILTER (condition = 'TP'), 0), 6) AS mean_distance, round(coalesce(avg(iou) FILTER (condition = 'TP'), 0), 6) AS mean_iou FROM ma GROUP BY image")
def region_match_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.match_summary(_matches(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("mean_distance", "mean_iou")})


_BOX = _TWO + ", bx AS (SELECT image, label, y1, x1, y2, x2, (y1 + y2) / 2 AS my, (x1 + x2) / 2 AS mx, sqrt((y2 - y1) ** 2 + (x2 - x1) ** 2) / 2 AS rad FROM gp), rg AS (SELECT a.image AS image, a.label AS a, b.label AS b, sqrt((a.my - b.my) ** 2 + (a.mx - b.mx) ** 2) AS distance, a.rad + b.rad AS reach FROM bx AS a JOIN bx AS b ON a.image = b.image AND a.label < b.label)"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.boxes(_two(spark, sf_dir)[0])


@plans.add("box_merge", _BOX + " SELECT image, label, y1, x1, y2, x2 FROM bx")
def box_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir)


@plans.add("box_superset", _BOX + " SELECT image, min(y1) AS y1, min(x1) AS x1, max(y2) AS y2, max(x2) AS x2 FROM bx GROUP BY image")
def box_superset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.superset(_boxes(spark, sf_dir))


@plans.add("box_in_range", _BOX + " SELECT image, a, b, round(distance, 6) AS distance FROM rg WHERE distance <= reach * 1.5")
def box_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.in_range(_boxes(spark, sf_dir), 1.5).withColumn("distance", F.round("distance", 6))


@plans.add("box_touching", _BOX.replace("bx AS", "bx0 AS", 1).replace(", rg AS", ", bx AS (SELECT image, label, y1, x1, y2 + label % 3 AS y2, x2 + label % 4 AS x2 FROM bx0), rg AS", 1).split(", rg AS")[0] + " SELECT a.image AS image, least(a.label, b.label) AS a, greatest(a.label, b.label) AS b FROM bx AS a JOIN bx AS b ON a.image = b.image AND (a.x1, a.y1, a.x2, a.y2, a.label) < (b.x1, b.y1, b.x2, b.y2, b.label) AND b.x1 BETWEEN a.x1 AND a.x2 AND b.y1 BETWEEN a.y1 AND a.y2")
def box_touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    wider = _boxes(spark, sf_dir).withColumns({"y2": F.col("y2") + F.col("label") % 3, "x2": F.col("x2") + F.col("label") % 4})
    return regions.touching(wider)


@plans.add("relabel_in_order", _BOX + " SELECT image, label, row_number() OVER (PARTITION BY image ORDER BY x1, y1, x2, y2, label) AS new FROM bx")
def relabel_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.in_order(_boxes(spark, sf_dir))


@plans.add("relabel_shuffled", _BOX + " SELECT image, label, row_number() OVER (PARTITION BY image ORDER BY md5(label || '-7')) AS new FROM bx")
def relabel_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.shuffled(_boxes(spark, sf_dir), 7)


@plans.add("relabel_bytes", _BOX + " SELECT image, label, row_number() OVER (PARTITION BY image ORDER BY md5(label || '-7')) % 255 + 1 AS new FROM bx")
def relabel_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.shuffled(_boxes(spark, sf_dir), 7, bytes_only=True)


@plans.add("relabel_coloured")
def relabel_coloured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy colouring goes node by node, which SQL cannot say; the tests do it one by one."""
    found = _boxes(spark, sf_dir)
    return regions.spread_colours(regions.coloured(found, regions.in_range(found, 1.0)), 65535)
