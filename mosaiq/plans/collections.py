"""Queries over file collections, stitching vectors, features, vectors and events."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.functions import distances, distogram, patterns, special
from mosaiq.operators import clustering, density, features, layout, neighbours, reshape, tables, vectors
from mosaiq.plans.common import Plans, table
from mosaiq.sources import files
from mosaiq.sources import vectors as stitching
from mosaiq.streaming import events as windows

plans = Plans()
CUSTOMER = patterns.FilePattern("Customer#{n:d+}")


@plans.add("pattern_extract", "SELECT c_name AS file, CAST(regexp_extract(c_name, '^Customer#([0-9]+)$', 1) AS BIGINT) AS n FROM customer WHERE regexp_matches(c_name, '^Customer#[0-9]+$')")
def pattern_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CUSTOMER.parse(table(spark, sf_dir, "customer").select(F.col("c_name").alias("file")))


@plans.add("pattern_rename", "SELECT c_name AS file, 'image_n' || lpad(CAST(CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) AS VARCHAR), greatest(length(CAST(CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) AS VARCHAR)), 6)::INT, '0') || '.ome.tif' AS new_name FROM customer WHERE regexp_matches(c_name, '^Customer#[0-9]+$')")
def pattern_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "customer").select(F.col("c_name").alias("file"))
    return patterns.rename(files, CUSTOMER, patterns.FilePattern("image_n{n:dddddd}.ome.tif")).select("file", "new_name")


_WORDS = "regexp_extract(p_name, '^([a-zA-Z]+) ([a-zA-Z]+)$', {})"


@plans.add(
    "pattern_letters_to_numbers",
    f"WITH f AS (SELECT p_partkey, p_name AS file, {_WORDS.format(1)} AS a, {_WORDS.format(2)} AS b FROM part WHERE regexp_matches(p_name, '^[a-zA-Z]+ [a-zA-Z]+$')), r AS (SELECT *, dense_rank() OVER (ORDER BY length(a), a) - 1 AS k FROM f) SELECT p_partkey, 'c' || lpad(k::VARCHAR, 3, '0') || '_' || b || '.tif' AS new_name FROM r",
)
def pattern_letters_to_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("file"))
    return patterns.rename(files, patterns.FilePattern("{a:c+} {b:c+}"), patterns.FilePattern("c{a:ddd}_{b:c+}.tif")).select("p_partkey", "new_name")


@plans.add("pattern_group", f"SELECT {_WORDS.format(2)} AS b, count(*) AS n, count(DISTINCT {_WORDS.format(1)}) AS n_a FROM part WHERE regexp_matches(p_name, '^[a-zA-Z]+ [a-zA-Z]+$') GROUP BY 1")
def pattern_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = patterns.FilePattern("{a:c+} {b:c+}").parse(table(spark, sf_dir, "part").select(F.col("p_name").alias("file")))
    return files.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("a").alias("n_a"))


@plans.add("pattern_subset", "SELECT page_id FROM pages WHERE regexp_matches(url, '/de/[0-9]+\\.html$')")
def pattern_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").filter(F.col("url").rlike(r"/de/[0-9]+\.html$")).select("page_id")


_GRID = "WITH s AS (SELECT p_partkey, p_size % 6 AS r, p_partkey % 8 AS c FROM part), g AS (SELECT *, dense_rank() OVER (ORDER BY r) - 1 AS gy, dense_rank() OVER (ORDER BY c) - 1 AS gx FROM s)"


@plans.add("montage_lines", _GRID + " SELECT p_partkey, 'file: p' || p_partkey || '.tif; corr: 0; position: (' || gx * 110 || ', ' || gy * 60 || '); grid: (' || gx || ', ' || gy || ');' AS line FROM g")
def montage_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 6).alias("r"), (F.col("p_partkey") % 8).alias("c"))
    placed = stitching.montage(files, "r", "c", 50, 100, 10)
    name = F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".tif"))
    return placed.select("p_partkey", stitching.format_line(name, F.lit(0), F.col("pos_x"), F.col("pos_y"), F.col("grid_x"), F.col("grid_y")).alias("line"))


@plans.add("vector_parse_merge", _GRID + ", l AS (SELECT 'p' || p_partkey || '.tif' AS file, gx * 110 AS pos_x, gy * 60 AS pos_y, gx AS grid_x, gy AS grid_y FROM g) SELECT file, pos_x, pos_y, grid_x, grid_y, 1 AS vector FROM l UNION ALL SELECT file, pos_x, pos_y, grid_x, grid_y, 2 AS vector FROM l WHERE grid_x = 0")
def vector_parse_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = stitching.parse_lines(montage_lines(spark, sf_dir), "line").drop("corr")
    return stitching.merge(parsed, parsed.filter("grid_x = 0"))


@plans.add("well_names", "SELECT DISTINCT CASE WHEN r < 26 THEN chr(65 + r::INT) ELSE chr(64 + (r // 26)::INT) || chr(65 + (r % 26)::INT) END || lpad((c + 1)::VARCHAR, 2, '0') AS well FROM (SELECT p_partkey % 32 AS r, p_size % 48 AS c FROM part)")
def well_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(features.well((F.col("p_partkey") % 32).cast("int"), F.col("p_size") % 48).alias("well")).distinct()


@plans.add("well_matrix", "SELECT l_linenumber, " + ", ".join(f"round(avg(l_quantity) FILTER (l_returnflag = '{k}'), 2) AS \"{k}\"" for k in "ANR") + " FROM lineitem GROUP BY 1")
def well_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "lineitem").groupBy("l_linenumber").pivot("l_returnflag", list("ANR")).agg(F.avg("l_quantity"))
    return wide.select("l_linenumber", *[F.round(k, 2).alias(k) for k in "ANR"])


@plans.add("feature_rectangles", "SELECT s_suppkey, s_suppkey % 10 * 20.0 AS x0, s_suppkey % 7 * 10.0 AS y0, s_suppkey % 10 * 20.0 + 20.0 AS x1, s_suppkey % 7 * 10.0 + 10.0 AS y1, s_name AS name, s_acctbal AS balance FROM supplier")
def feature_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier")
    feature = features.rectangle_feature(F.col("s_suppkey") % 10 * 20, F.col("s_suppkey") % 7 * 10, F.lit(20), F.lit(10), {"name": F.col("s_name")}, {"balance": F.col("s_acctbal")})
    ring = lambda i, j: F.col("f.geometry.coordinates")[0][i][j]
    return rows.select("s_suppkey", feature.alias("f")).select("s_suppkey", ring(0, 0).alias("x0"), ring(0, 1).alias("y0"), ring(2, 0).alias("x1"), ring(2, 1).alias("y1"), F.col("f.properties.string")["name"].alias("name"), F.col("f.properties.numeric")["balance"].alias("balance"))


_COLLECTION = "SELECT s_nationkey, 'FeatureCollection' AS type, s_name AS name, s_suppkey::DOUBLE AS x, s_nationkey::DOUBLE AS y FROM supplier"


def _collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    feature = features.point_feature(F.col("s_suppkey"), F.col("s_nationkey"), {"name": F.col("s_name")}, {})
    return features.collections(table(spark, sf_dir, "supplier").select("s_nationkey", feature.alias("feature")), "s_nationkey")


def _told(documents: DataFrame, *keys: str) -> DataFrame:
    """What the features of JSON documents say."""
    kind = "type string, features array<struct<geometry: struct<coordinates: array<double>>, properties: struct<string: map<string, string>>>>"
    read = documents.select(*keys, F.from_json("json", kind).alias("d")).select(*keys, "d.type", F.explode("d.features").alias("f"))
    return read.select(*keys, "type", F.col("f.properties.string")["name"].alias("name"), F.col("f.geometry.coordinates")[0].alias("x"), F.col("f.geometry.coordinates")[1].alias("y"))


@plans.add("feature_collections", _COLLECTION)
def feature_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(_collections(spark, sf_dir), "s_nationkey")


@plans.add("merge_documents", _COLLECTION.replace("s_nationkey, ", "s_nationkey % 3 AS part, ", 1))
def merge_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _collections(spark, sf_dir)
    return _told(documents.groupBy((F.col("s_nationkey") % 3).alias("part")).agg(features.merged(documents).alias("json")), "part")


@plans.add("pyramid_scales", "WITH s AS (SELECT s_suppkey, s_suppkey * 37 % 900 + 1 AS w, s_suppkey * 53 % 700 + 1 AS h FROM supplier), l AS (SELECT *, CAST(ceil(round(log2(greatest(w, h, 3)), 9)) AS BIGINT) AS n FROM s), e AS (SELECT *, unnest(range(n + 1)) AS i FROM l) SELECT s_suppkey, CAST(n - i AS VARCHAR) AS key, CAST(ceil(w / 2 ** i) AS BIGINT) AS width, CAST(ceil(h / 2 ** i) AS BIGINT) AS height, 0.5::DOUBLE * 2 ** i AS resolution FROM e")
def pyramid_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = (F.col("s_suppkey") * 37 % 900 + 1).cast("long"), (F.col("s_suppkey") * 53 % 700 + 1).cast("long")
    levels = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(features.scales(w, h, F.lit(3), F.lit(0.5))).alias("s"))
    return levels.select("s_suppkey", "s.key", F.col("s.size")[0].alias("width"), F.col("s.size")[1].alias("height"), F.col("s.resolution")[0].alias("resolution"))


@plans.add("tile_document", "SELECT s_nationkey, '3.0.0' AS version, min(s_suppkey)::DOUBLE AS x0, max(s_suppkey)::DOUBLE AS x1, (min(s_suppkey) + max(s_suppkey)) / 2 AS middle, 'Number' AS kind FROM supplier GROUP BY 1")
def tile_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda f, c: f(c).cast("double")
    bounds = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array(d(F.min, "s_suppkey"), d(F.min, "s_acctbal"), d(F.max, "s_suppkey"), d(F.max, "s_acctbal")).alias("b"))
    documents = bounds.select("s_nationkey", features.tile_document(F.col("b"), {"name": "String", "balance": "Number"}).alias("json"))
    number = lambda path: F.get_json_object("json", path).cast("double")
    return documents.select("s_nationkey", F.get_json_object("json", "$.tilejson").alias("version"), number("$.bounds[0]").alias("x0"), number("$.bounds[2]").alias("x1"), number("$.center[1]").alias("middle"), F.get_json_object("json", "$.vector_layers[0].fields.balance").alias("kind"))


_PAIR = "WITH p AS (SELECT a.vec_id AS vec_id, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b FROM embeddings AS a JOIN embeddings AS b ON b.vec_id = a.vec_id + 1), z AS (SELECT vec_id, unnest(a) AS x, unnest(b) AS y FROM p) SELECT vec_id, round({f}, 6) AS distance FROM z GROUP BY vec_id"
_MEANS = "WITH p AS (SELECT a.vec_id AS vec_id, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b FROM embeddings AS a JOIN embeddings AS b ON b.vec_id = a.vec_id + 1), z AS (SELECT vec_id, unnest(a) AS x, unnest(b) AS y FROM p) SELECT vec_id, round(1 - corr(x, y), 6) AS distance FROM z GROUP BY vec_id"
_EPS = "count(*) FILTER ((x >= 1e-6) <> (y >= 1e-6))"
_BOTH = "count(*) FILTER (x >= 1e-6 AND y >= 1e-6)"
_WEIGHTS = [1.0 + i % 3 for i in range(64)]
_DISTANCES = {
    "euclidean": (distances.euclidean, _PAIR.format(f="sqrt(sum((x - y) ** 2))")),
    "manhattan": (distances.manhattan, _PAIR.format(f="sum(abs(x - y))")),
    "chebyshev": (distances.chebyshev, _PAIR.format(f="max(abs(x - y))")),
    "minkowski": (lambda a, b: distances.minkowski(a, b, 3.0), _PAIR.format(f="pow(sum(pow(abs(x - y), 3)), 1.0 / 3)")),
    "canberra": (distances.canberra, _PAIR.format(f="sum(CASE WHEN abs(x) + abs(y) > 0 THEN abs(x - y) / (abs(x) + abs(y)) ELSE 0 END)")),
    "bray_curtis": (distances.bray_curtis, _PAIR.format(f="sum(abs(x - y)) / sum(abs(x + y))")),
    "cosine": (distances.cosine, _PAIR.format(f="1 - sum(x * y) / sqrt(sum(x * x) * sum(y * y))")),
    "correlation": (distances.correlation, _MEANS),
    "jaccard": (distances.jaccard, _PAIR.format(f=f"{_EPS} / nullif({_EPS} + {_BOTH}, 0)")),
    "dice": (distances.dice, _PAIR.format(f=f"{_EPS} / nullif({_EPS} + 2 * {_BOTH}, 0)")),
    "weighted_minkowski": (lambda a, b: distances.weighted_minkowski(a, b, _WEIGHTS, 2.0), "WITH p AS (SELECT a.vec_id AS vec_id, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b FROM embeddings AS a JOIN embeddings AS b ON b.vec_id = a.vec_id + 1), z AS (SELECT vec_id, unnest(a) AS x, unnest(b) AS y, unnest(range(64)) AS i FROM p) SELECT vec_id, round(sqrt(sum((x - y) ** 2 * (1 + i % 3))), 6) AS distance FROM z GROUP BY vec_id"),
    "categorical": (distances.categorical, "SELECT a.vec_id AS vec_id, CASE WHEN a.embedding[1] = b.embedding[1] THEN 0.0 ELSE 1.0 END::DOUBLE AS distance FROM embeddings AS a JOIN embeddings AS b ON b.vec_id = a.vec_id + 1"),
    "ordinal": (lambda a, b: distances.ordinal(F.transform(a, lambda x: x.cast("double")), F.transform(b, lambda x: x.cast("double")), 4.0), "SELECT a.vec_id AS vec_id, round(abs(a.embedding[1]::DOUBLE - b.embedding[1]::DOUBLE) / 4.0, 6) AS distance FROM embeddings AS a JOIN embeddings AS b ON b.vec_id = a.vec_id + 1"),
}


def _distance(name: str) -> None:
    f, sql = _DISTANCES[name]

    @plans.add(f"distance_{name}", sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
        pairs = rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
        return pairs.select("vec_id", F.round(f(F.col("embedding"), F.col("other")), 6).alias("distance"))


for _name in _DISTANCES:
    _distance(_name)


@plans.add("distance_levenshtein", "SELECT a.p_partkey AS p_partkey, levenshtein(a.p_name, b.p_name)::INT AS distance FROM part AS a JOIN part AS b ON b.p_partkey = a.p_partkey + 1")
def distance_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    pairs = rows.join(rows.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other")), "p_partkey")
    return pairs.select("p_partkey", distances.levenshtein(F.col("p_name"), F.col("other")).alias("distance"))


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(rows.filter("vec_id % 50 = 0"), rows, 5)


_KNN = "WITH d AS (SELECT a.vec_id AS query, b.vec_id AS item, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS distance FROM embeddings AS a JOIN embeddings AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, item) AS rank FROM d)"


@plans.add("nearest_vectors", _KNN + " SELECT query, item, round(distance, 4) AS distance, rank FROM k WHERE rank <= 5")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir).withColumn("distance", F.round("distance", 4))


@plans.add("neighbour_graph")
def neighbour_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearly the nearest, which SQL cannot say; the tests measure how many of them are found."""
    return neighbours.neighbour_graph(table(spark, sf_dir, "embeddings"), 5)


@plans.add("smooth_neighbour_scale")
def smooth_neighbour_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.smooth_distances(_neighbours(spark, sf_dir))


@plans.add("fuzzy_union", _KNN + ", r AS (SELECT query, min(distance) AS rho FROM k WHERE rank <= 5 AND distance > 0 GROUP BY query), w AS (SELECT k.query AS query, item, CASE WHEN distance <= rho THEN 1 ELSE exp(-(distance - rho) / 0.7) END AS w FROM k JOIN r ON k.query = r.query WHERE rank <= 5), b AS (SELECT query, item, w AS a, 0 AS b FROM w UNION ALL SELECT item, query, 0, w FROM w), s AS (SELECT query, item, max(a) AS a, max(b) AS b FROM b GROUP BY ALL) SELECT query, item, round((a + b - a * b)::DOUBLE, 4) AS weight FROM s")
def fuzzy_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _neighbours(spark, sf_dir)
    rho = near.filter("distance > 0").groupBy("query").agg(F.min("distance").alias("rho"))
    weights = near.join(rho, "query").select("query", "item", special.membership(F.col("distance"), F.col("rho"), F.lit(0.7)).alias("weight"))
    return vectors.fuzzy_union(weights).withColumn("weight", F.round("weight", 4))


@plans.add("layout")
def laid_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps along drawn edges, which SQL cannot say; the tests see that groups stay together."""
    near = neighbours.neighbour_graph(table(spark, sf_dir, "embeddings"), 5)
    weights = vectors.fuzzy_union(near.select("query", "item", (1 / F.col("rank")).alias("weight")))
    return layout.laid_out(weights, layout.Layout(epochs=20)).select("v", F.get("at", F.lit(0)).alias("x"), F.get("at", F.lit(1)).alias("y"))


@plans.add("covariance", "WITH e AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, unnest(range(64)) AS i FROM embeddings) SELECT a.i AS i, b.i AS j, round(covar_samp(a.x, b.x), 6) AS cov FROM e AS a JOIN e AS b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY ALL")
def covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.covariance(table(spark, sf_dir, "embeddings")).withColumn("cov", F.round("cov", 6))


@plans.add("principal_components")
def principal_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    _, directions = vectors.principal_components(rows, 3)
    return vectors.project(rows, directions).select("vec_id", "pc1", "pc2", "pc3")


@plans.add("k_means")
def k_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vectors.assign(rows, vectors.k_means(rows, 8)).select("vec_id", "cluster", "distance")


@plans.add("assign_clusters", "WITH c AS (SELECT vec_id AS c, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id < 6), d AS (SELECT v.vec_id AS vec_id, c, list_distance(v.embedding::DOUBLE[], e) AS d FROM embeddings AS v, c) SELECT vec_id, arg_min(c, (round(d, 9), c)) AS cluster, round(min(d), 4) AS distance FROM d GROUP BY vec_id")
def assign_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    centres = [list(r[0]) for r in rows.filter("vec_id < 6").orderBy("vec_id").select("embedding").collect()]
    return vectors.assign(rows, centres).select("vec_id", "cluster", F.round("distance", 4).alias("distance"))


@plans.add("density_clusters")
def density_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which cluster a point is in depends on all others at every density, which SQL cannot say."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(f"x{i}") for i in range(4)])
    return clustering.density_clusters(rows, [f"x{i}" for i in range(4)], 3, ["label"]).select("vec_id", "label", "cluster")


@plans.add("density_spread")
def density_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As above, over all components and rows at once and many tasks; the tests cut the whole tree from the top."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", *[F.get("embedding", F.lit(i)).alias(f"x{i}") for i in range(64)])
    return density.spread_labels(rows, [f"x{i}" for i in range(64)], 5, "vec_id")


@plans.add("unmix_channels")
def unmix_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 4).alias("embedding"))
    return clustering.unmixed(rows, 3, percent=40).select("vec_id", "cluster", "strength")


@plans.add("project_directions", "WITH e AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, unnest(range(64)) AS i FROM embeddings) SELECT vec_id, round(sum(x * (i % 3 - 1)), 6) AS pc1, round(sum(x * (0.5 - i % 2)), 6) AS pc2 FROM e GROUP BY vec_id")
def project_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projection on given directions, written as a table of numbers and read again."""
    directions = np.array([[i % 3 - 1, 0.5 - i % 2] for i in range(64)], float)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    folder = f"{(spark.conf.get('spark.checkpoint.dir', None) or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/matrix-{uuid.uuid4().hex}"
    files.write(vectors.project(rows, directions).select("vec_id", "pc1", "pc2"), folder, "csv")
    return files.read_matrix(spark, folder).select(F.col("vec_id").cast("long").alias("vec_id"), F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"))


@plans.add("sampled_neighbours", _KNN.replace("ON a.vec_id <> b.vec_id", "ON a.vec_id <> b.vec_id AND ('0x' || substr(md5(b.vec_id || '-1'), 1, 8))::BIGINT % 100 < 30") + " SELECT query, item, round(distance, 4) AS distance, rank FROM k WHERE rank <= 5")
def sampled_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(rows.filter("vec_id % 50 = 0"), reshape.hashed_sample(rows, "vec_id", 30, 1), 5).withColumn("distance", F.round("distance", 4))


@plans.add("sketch_quantiles", "SELECT l_returnflag, CAST(count(*) AS DOUBLE) AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high, true AS near FROM lineitem GROUP BY 1")
def sketch_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of each group: number and ends are exact, the median is within a twentieth of the range."""
    rows = table(spark, sf_dir, "lineitem")
    exact = tables.quantile(rows, ["l_returnflag"], "l_extendedprice", {"median": 0.5})
    found = distogram.sketches(rows, "l_returnflag", "l_extendedprice", shares={"middle": 0.5}).join(exact, "l_returnflag")
    near = F.abs(F.col("middle") - F.col("median")) < 0.05 * (F.col("high") - F.col("low"))
    return found.select("l_returnflag", F.round(F.aggregate("n", F.lit(0.0), lambda a, x: a + x), 6).alias("n"), "low", "high", near.alias("near"))


_STATS = "count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS greatest"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("total", F.round("total", 4))



@plans.add("events_tumbling", f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, {_STATS} FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(windows.tumbling(table(spark, sf_dir, "events"), "1 hour", ["event_type"]))


@plans.add("events_sliding", f"SELECT time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR * k AS window_start, event_type, {_STATS} FROM events, (SELECT range AS k FROM range(2)) GROUP BY ALL")
def events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(windows.sliding(table(spark, sf_dir, "events"), "2 hours", "1 hour", ["event_type"]))


@plans.add(
    "events_sessions",
    """WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g) SELECT min(ts) AS session_start, user_id, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""",
)
def events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(windows.sessions(table(spark, sf_dir, "events"), "6 hours", ["user_id"]))


@plans.add("events_deduplicated", "SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id, min(ts) AS ts FROM events GROUP BY ALL")
def events_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return windows.deduplicated(rows, ["user_id", "event_type"])


@plans.add("events_histogram", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, CAST(floor(value / 10) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY ALL")
def events_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.value_histogram(table(spark, sf_dir, "events"), "1 day", 10.0, ["event_type"])


@plans.add("events_json", "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events")
def events_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
