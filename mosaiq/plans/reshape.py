"""Queries over names and options, special functions, and tables put together and taken apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.functions import distances, names, special
from mosaiq.operators import reshape, tables
from mosaiq.operators.matching import subset_keys
from mosaiq.plans.collections import _neighbours, _KNN
from mosaiq.plans.common import RASTER, Plans, lines_raster, table

plans = Plans()


@plans.add("columns_by_type", "SELECT c_custkey, c_nationkey, c_acctbal, c_name || '|' || c_mktsegment AS texts FROM customer")
def columns_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    numbers = tables.numeric_columns(rows)
    return rows.select(*numbers, F.concat_ws("|", *[c for c in rows.columns if c not in numbers]).alias("texts"))


@plans.add("rename_columns", 'SELECT s_suppkey, s_acctbal AS "acct_bal_r1", s_name AS "s_name_r1" FROM supplier')
def rename_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("s__name"), F.col("s_acctbal").alias("__acct__bal"))
    return reshape.normalised_columns(rows, "_r1", ("s_suppkey",))


@plans.add("drop_null_rows", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN o_totalprice END AS large, CASE WHEN o_orderstatus = 'P' THEN o_orderstatus END AS open FROM orders WHERE o_totalprice > 200000 OR o_orderstatus = 'P'")
def drop_null_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_totalprice") > 200000, F.col("o_totalprice")).alias("large"), F.when(F.col("o_orderstatus") == "P", F.col("o_orderstatus")).alias("open"))
    return reshape.without_null_rows(rows, ("o_orderkey",))


@plans.add("split_tables", "SELECT c_custkey, 'track' AS kind FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT c_custkey, 'whole' FROM customer WHERE NOT c_acctbal >= 0 OR c_acctbal IS NULL")
def split_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside, outside = reshape.split(table(spark, sf_dir, "customer"), F.col("c_acctbal") >= 0)
    return inside.select("c_custkey", F.lit("track").alias("kind")).unionByName(outside.select("c_custkey", F.lit("whole").alias("kind")))


@plans.add("cast_to_text", "SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS nation, array_to_string([c_custkey, c_nationkey], ' ') AS keys FROM customer")
def cast_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.array(F.col("c_custkey").cast("long"), F.col("c_nationkey").cast("long")).alias("keys"))
    kinds = dict(rows.dtypes)
    return rows.select("c_custkey", *[names.text_of(F.col(c), kinds[c]).alias(c) for c in ("nation", "keys")])


@plans.add("enum_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'P')")
def enum_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter(names.checked("o_orderstatus", ["O", "P"], {"O", "P", "F"})).select("o_orderkey")


_OPTIONS = "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'bins = ' || p_size WHEN 1 THEN 'scale=' || (p_size / 4)::DOUBLE WHEN 2 THEN 'flag=True' WHEN 3 THEN 'name= ' || p_brand ELSE p_brand END AS o FROM part"


@plans.add("option_values", f"WITH o AS ({_OPTIONS}), k AS (SELECT p_partkey, trim(regexp_extract(o, '^([^=]*)=', 1)) AS key, trim(regexp_extract(o, '^[^=]*=(.*)$', 1)) AS raw FROM o WHERE contains(o, '=')) SELECT p_partkey, key, raw, CASE WHEN regexp_matches(raw, '^[+-]?[0-9]+$') THEN TRY_CAST(raw AS BIGINT) END AS whole, CASE WHEN NOT regexp_matches(raw, '^[+-]?[0-9]+$') THEN TRY_CAST(raw AS DOUBLE) END AS number, CASE WHEN TRY_CAST(raw AS DOUBLE) IS NULL AND lower(raw) IN ('true', 'false') THEN lower(raw) = 'true' END AS flag FROM k")
def option_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    size = F.col("p_size")
    text = F.when(k == 0, F.concat(F.lit("bins = "), size.cast("string"))).when(k == 1, F.concat(F.lit("scale="), (size / 4).cast("double").cast("string"))).when(k == 2, "flag=True").when(k == 3, F.concat(F.lit("name= "), F.col("p_brand"))).otherwise(F.col("p_brand"))
    found = table(spark, sf_dir, "part").select("p_partkey", names.option_value(text).alias("o")).filter("o is not null")
    return found.select("p_partkey", "o.*")


@plans.add("option_lists", "SELECT p_partkey, list_filter(list_transform(string_split(p_name || ' ,' || p_brand || ', ,', ','), lambda x: trim(x)), lambda x: x <> '')[2] AS second, len(list_filter(list_transform(string_split(p_name || ' ,' || p_brand || ', ,', ','), lambda x: trim(x)), lambda x: x <> '')) AS n FROM part")
def option_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = names.options(F.concat("p_name", F.lit(" ,"), "p_brand", F.lit(", ,")))
    return table(spark, sf_dir, "part").select("p_partkey", F.get(parts, F.lit(1)).alias("second"), F.size(parts).cast("long").alias("n"))


_GROUPS = {"PRICE": ["l_extendedprice", "l_discount", "l_tax"], "SIZE": ["l_quantity"]}


@plans.add("feature_groups", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def feature_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *names.expanded(["l_quantity,*PRICE*"], _GROUPS))


@plans.add("replace_extension", "SELECT page_id, regexp_replace(regexp_replace(url, '^.*/', ''), '\\..*$', '') || '.feather' AS name FROM pages WHERE regexp_matches(lower(url), '\\.(html|htm)$')")
def replace_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.regexp_replace("url", "^.*/", "")
    return table(spark, sf_dir, "pages").filter(names.has_extension(F.col("url"), [".HTML", ".htm"])).select("page_id", names.with_extension(last, ".feather").alias("name"))


@plans.add("plain_names", "SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(p_type || ' [' || p_size || '°] /mm^2', '°', '_deg_'), '/', '_per_'), '^2', '_sqd_'), '^3', '_cubed_'), '[^0-9a-zA-Z]+', '_', 'g'), '_+', '_', 'g'), '^_', '') AS name FROM part")
def plain_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", names.plain_name(F.concat("p_type", F.lit(" ["), F.col("p_size").cast("string"), F.lit("°] /mm^2"))).alias("name"))


@plans.add("sheet_names", "SELECT p_partkey, substr(p_type || ' ' || p_name, 1, 25) AS sheet FROM part")
def sheet_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", names.sheet_name(F.concat_ws(" ", "p_type", "p_name")).alias("sheet"))


@plans.add("image_names", "SELECT p_partkey, p_brand || '_y' || lpad(p_size::VARCHAR, greatest(3, length(p_size::VARCHAR))::INT, '0') || '_x' || lpad(p_partkey::VARCHAR, greatest(3, length(p_partkey::VARCHAR))::INT, '0') || '_c' || lpad((p_partkey % 4)::VARCHAR, 3, '0') || '.ome.tif' AS name FROM part")
def image_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", names.image_name(F.col("p_brand"), F.col("p_size"), F.col("p_partkey"), c=F.col("p_partkey") % 4).alias("name"))


@plans.add("unit_conversion", "WITH u AS (SELECT p_partkey, p_size::DOUBLE AS x, ['nm', 'µm', 'mm'][p_partkey % 3 + 1] AS xu, (p_size + 1)::DOUBLE AS y, ['µm', 'nm'][p_partkey % 2 + 1] AS yu FROM part), f AS (SELECT *, MAP {'nm': 1.0::DOUBLE, 'µm': 1e3, 'mm': 1e6}[xu] AS fx, MAP {'nm': 1.0::DOUBLE, 'µm': 1e3, 'mm': 1e6}[yu] AS fy FROM u) SELECT p_partkey, round(x * fx / 1e3, 9) AS micrometres, round((x * fx + y * fy) / 2 / least(fx, fy), 6) AS spacing, CASE WHEN fx < fy THEN xu ELSE yu END AS unit FROM f")
def unit_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("p_size").cast("double"), (F.col("p_size") + 1).cast("double")
    xu = F.element_at(F.array(*map(F.lit, ("nm", "µm", "mm"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    yu = F.element_at(F.array(*map(F.lit, ("µm", "nm"))), (F.col("p_partkey") % 2 + 1).cast("int"))
    both = names.common_spacing(x, xu, y, yu)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(names.converted(x, xu, "µm"), 9).alias("micrometres"), F.round(both["value"], 6).alias("spacing"), both["unit"].alias("unit"))


@plans.add("catalogue_union", "WITH t AS (SELECT c_nationkey AS nation, 'customer' AS kind, min(c_name) AS name, 1 AS o FROM customer WHERE c_acctbal > 9500 GROUP BY 1 UNION ALL SELECT s_nationkey, 'supplier', min(s_name), 2 FROM supplier GROUP BY 1 UNION ALL SELECT n_nationkey, 'nation', n_name, 3 FROM nation) SELECT nation, arg_min(kind, o) AS kind, arg_min(name, o) AS name FROM t GROUP BY nation")
def catalogue_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").filter("c_acctbal > 9500").groupBy(F.col("c_nationkey").alias("nation")).agg(F.lit("customer").alias("kind"), F.min("c_name").alias("name"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.lit("supplier").alias("kind"), F.min("s_name").alias("name"), F.count(F.lit(1)).alias("extra"))
    c = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.lit("nation").alias("kind"), F.col("n_name").alias("name"))
    return reshape.catalogue([a, b, c], "nation", ("extra",))


@plans.add("channels_wide", "WITH c AS (SELECT o_orderstatus AS image, o_orderkey AS label, o_totalprice AS q, o_custkey AS t FROM orders) SELECT a.image AS image, a.label AS label, a.q AS q_channel1, a.t AS t_channel1, a.q * 2 AS q_channel2, a.q > 90000 AS touching_border FROM c AS a")
def channels_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("image"), F.col("o_orderkey").alias("label"), F.col("o_totalprice").alias("q"), F.col("o_custkey").alias("t"))
    one = base.withColumn("touching_border", F.col("q") > 90000)
    two = base.select("image", "label", (F.col("q") * 2).alias("q"), (F.col("q") > 90000).alias("touching_border"))
    return reshape.side_by_side({"channel1": one, "channel2": two}, ["image", "label"], "touching_border")


@plans.add("concat_columns", "SELECT o_orderkey, o_totalprice AS o_totalprice_a, n AS n_b FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def concat_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    b = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n")).join(a.select("o_orderkey"), "o_orderkey", "left_semi")
    return reshape.side_by_side({"a": a, "b": b}, ["o_orderkey"])


@plans.add("left_index_merge", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 3")
def left_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(nations, "c_nationkey", "left").drop("c_nationkey")


@plans.add("constructed_name_join", "SELECT o_orderkey, c_acctbal FROM orders JOIN customer ON c_name = 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0')")
def constructed_name_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("c_name")
    return table(spark, sf_dir, "orders").select("o_orderkey", name).join(table(spark, sf_dir, "customer").select("c_name", "c_acctbal"), "c_name").select("o_orderkey", "c_acctbal")


@plans.add("many_to_many_match", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def many_to_many_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs are the square of the growth, so customers are spread first: a file may be one task.  They go by nation and by blocks of
    its suppliers, so that a task makes the same few hundred suppliers over and over, which takes few bytes where it is written."""
    b = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"))
    blocks = b.count() // 8192 + 1
    b = b.withColumn("block", F.pmod(F.xxhash64("s_suppkey"), F.lit(blocks)))
    a = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation")).repartitionByRange(4 * spark.sparkContext.defaultParallelism, "nation", "c_custkey")
    a = a.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).sortWithinPartitions("nation", "block")
    return subset_keys(a, b, ["c_custkey", "nation", "block"], ["nation", "block"]).select("c_custkey", "s_suppkey")


@plans.add("zip_by_name", "SELECT n_name AS name, n_regionkey, n_nationkey FROM nation")
def zip_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation")
    return reshape.zipped(rows.select(F.col("n_name").alias("name"), "n_regionkey"), rows.select(F.col("n_name").alias("name"), "n_nationkey"), "name")


@plans.add("intersect_collections", "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
def intersect_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select("s_nationkey"))


@plans.add("stack_planes", "SELECT p_partkey, p_brand, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) - 1 AS plane FROM part")
def stack_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.stacked(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), ["p_brand"], "p_size").drop("p_size")


@plans.add("split_planes", "WITH i AS (SELECT 'p' || p_partkey || '.ome.tif' AS file, p_size % 3 + 1 AS nc, p_size % 2 + 1 AS nz FROM part), c AS (SELECT *, unnest(range(nc)) AS c FROM i), z AS (SELECT file, c, unnest(range(nz)) AS z FROM c) SELECT file, c, z, regexp_replace(file, '\\..*$', '') || '_c' || c || '_z' || z || '.ome.tif' AS new_name FROM z")
def split_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".ome.tif")).alias("file"), (F.col("p_size") % 3 + 1).cast("long").alias("c"), (F.col("p_size") % 2 + 1).cast("long").alias("z"))
    return reshape.planes(images, ["c", "z"])


@plans.add("recycle_vector", "WITH v AS (SELECT p_partkey AS k, p_partkey * 10 AS pos_x, p_size * 10 AS pos_y FROM part) SELECT c + 1 AS vector, 'k' || k || '_c' || c || '.tif' AS file, 0.0::DOUBLE AS corr, pos_x, pos_y, k AS grid_x, 0 AS grid_y FROM v, (SELECT range AS c FROM range(3))")
def recycle_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("long")
    vector = parts.select(k.alias("k"), F.lit(0.0).alias("corr"), (k * 10).alias("pos_x"), (F.col("p_size") * 10).cast("long").alias("pos_y"), k.alias("grid_x"), F.lit(0).cast("long").alias("grid_y"))
    files = parts.select(k.alias("k"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("c"))
    files = files.withColumn("file", F.concat(F.lit("k"), F.col("k").cast("string"), F.lit("_c"), F.col("c").cast("string"), F.lit(".tif")))
    return reshape.recycled(vector, files, ["k"], ["c"])


@plans.add("line_numbers", "SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS line FROM part")
def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.numbered_lines(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", ["p_partkey"])


@plans.add("best_quarter", "SELECT c_nationkey, c_custkey FROM (SELECT *, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS q FROM customer) WHERE q = 1")
def best_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return reshape.best_share(rows, ["c_nationkey"], F.struct("c_acctbal", "c_custkey")).select("c_nationkey", "c_custkey")


@plans.add("hashed_sample", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE ('0x' || substr(md5(l_orderkey || '-3'), 1, 8))::BIGINT % 100 < 10")
def hashed_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.hashed_sample(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", 10, 3)


@plans.add("sort_by_temperature", "SELECT l_linenumber AS temperature, round(avg(l_quantity), 2) AS a FROM lineitem GROUP BY 1 ORDER BY 1")
def sort_by_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("temperature")).agg(F.round(F.avg("l_quantity"), 2).alias("a")).orderBy("temperature")


@plans.add("tile_label_base", "WITH n AS (SELECT l_returnflag AS image, l_linenumber AS tile, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY ALL) SELECT image, tile, n, CAST(coalesce(sum(n) OVER (PARTITION BY image ORDER BY tile ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM n")
def tile_label_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("image"), F.col("l_linenumber").alias("tile")).agg(F.countDistinct("l_suppkey").alias("n"))
    return reshape.running_base(counts, "image", "tile", "n")


@plans.add("reconcile_labels", f"WITH {RASTER}, a AS (SELECT image, y, x, (y // 4) * 6 + x // 4 + 1 AS label FROM px WHERE v % 5 >= 2), b AS (SELECT image, y, x, ((y + 1) // 4) * 7 + (x + 1) // 4 + 1 AS label FROM px WHERE v % 5 >= 3), c AS (SELECT a.image AS image, a.label AS label, b.label AS o, count(*) AS n FROM a JOIN b USING (image, y, x) GROUP BY ALL), m AS (SELECT image, label, arg_max(o, (n, -o)) AS o FROM c GROUP BY ALL) SELECT DISTINCT a.image AS image, a.label AS label, coalesce(o, a.label) AS new FROM a LEFT JOIN m ON m.image = a.image AND m.label = a.label")
def reconcile_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = lines_raster(spark, sf_dir)
    block = lambda shift, n: (F.floor((F.col("y") + shift) / 4) * n + F.floor((F.col("x") + shift) / 4) + 1).alias("label")
    return reshape.reconciled(px.filter("v % 5 >= 2").select("image", "y", "x", block(0, 6)), px.filter("v % 5 >= 3").select("image", "y", "x", block(1, 7)))


@plans.add("best_grouping", "SELECT 'flag,status' AS variables, 6 AS n")
def best_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").agg(F.countDistinct("l_returnflag").alias("flag"), F.countDistinct("l_linestatus").alias("status"), F.countDistinct("l_linenumber").alias("line")).first().asDict()
    group, n = names.best_grouping(counts, 6, "flag")
    return spark.createDataFrame([(",".join(group), n)], "variables string, n int")


@plans.add("resume_point", "SELECT event_type, strftime(max(ts), '%Y-%m-%d') AS since, count(*) FILTER (ts >= TIMESTAMP '2024-01-15') AS fresh FROM events GROUP BY 1")
def resume_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From which day each source is to be fetched again, and how many rows a fetch since a day brings."""
    rows = table(spark, sf_dir, "events")
    return rows.groupBy("event_type").agg(F.date_format(F.max("ts"), "yyyy-MM-dd").alias("since"), F.count_if(F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")).alias("fresh"))


_UNNEST = "WITH p AS (SELECT a.vec_id AS vec_id, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b FROM embeddings AS a JOIN embeddings AS b ON b.vec_id = a.vec_id + 1), z AS (SELECT vec_id, unnest(a) AS x, unnest(b) AS y, unnest(range(64)) AS i FROM p)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    return rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")


@plans.add("distance_standardised_euclidean", _UNNEST + " SELECT vec_id, round(sqrt(sum((x - y) ** 2 / (0.5 + i % 4))), 6) AS distance FROM z GROUP BY vec_id")
def distance_standardised_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    variances = [0.5 + i % 4 for i in range(64)]
    return _pairs(spark, sf_dir).select("vec_id", F.round(distances.standardised_euclidean(F.col("a"), F.col("b"), variances), 6).alias("distance"))


@plans.add("distance_mahalanobis", _UNNEST + ", d AS (SELECT vec_id, i, x - y AS d FROM z) SELECT p.vec_id AS vec_id, round(sqrt(sum(p.d * q.d * CASE WHEN p.i = q.i THEN 2.0 WHEN abs(p.i - q.i) = 1 THEN -0.5 ELSE 0 END)), 6) AS distance FROM d AS p JOIN d AS q ON p.vec_id = q.vec_id GROUP BY p.vec_id")
def distance_mahalanobis(spark: SparkSession, sf_dir: str) -> DataFrame:
    inverse = [[2.0 if i == j else -0.5 if abs(i - j) == 1 else 0.0 for j in range(64)] for i in range(64)]
    return _pairs(spark, sf_dir).select("vec_id", F.round(distances.mahalanobis(F.col("a"), F.col("b"), inverse), 6).alias("distance"))


_SERIES = "(CASE WHEN {x} - 1 < 1e-6 THEN 0 ELSE {x} * ln({x}) - {x} + 0.5 * ln(2 * pi() / {x}) + 1 / (12 * {x}) END)"
_BETA1 = "(ln(2) * (-2 * {x} + 0.5) + 0.5 * ln(2 * pi() / {x}) + 0.125 / {x})"


def _beta(x: str, y: str) -> str:
    low, high = f"least({x}, {y})", f"greatest({x}, {y})"
    product = f"-ln({high})" + "".join(f" + CASE WHEN {i} < floor({low}) THEN ln({i}) - ln({high} + {i}) ELSE 0 END" for i in range(1, 5))
    return f"(CASE WHEN {low} < 5 THEN {product} ELSE {_SERIES.format(x=x)} + {_SERIES.format(x=y)} - {_SERIES.format(x=f'({x} + {y})')} END)"


@plans.add("log_beta", f"WITH x AS (SELECT p_partkey, p_size::DOUBLE / 3 + 1 AS a, (p_partkey % 17 + 1)::DOUBLE AS b FROM part) SELECT p_partkey, round({_SERIES.format(x='a')}, 6) AS log_gamma, round({_beta('a', 'b')}, 6) AS log_beta FROM x")
def log_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("p_size").cast("double") / 3 + 1, (F.col("p_partkey") % 17 + 1).cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(special.log_gamma(a), 6).alias("log_gamma"), F.round(special.log_beta(a, b), 6).alias("log_beta"))


@plans.add(
    "distance_dirichlet",
    "WITH p AS (SELECT a.p_partkey AS k, [a.p_size % 7, a.p_partkey % 5, a.p_size % 3 + 2]::DOUBLE[] AS a, [b.p_size % 7, b.p_partkey % 5, b.p_size % 3 + 2]::DOUBLE[] AS b FROM part AS a JOIN part AS b ON b.p_partkey = a.p_partkey + 1), z AS (SELECT k, unnest(a) AS x, unnest(b) AS y FROM p), "
    f"s AS (SELECT k, sum(x) AS n1, sum(y) AS n2, sum(CASE WHEN x * y > 0.9 THEN {_beta('x', 'y')} ELSE 0 END) AS sh, sum(CASE WHEN x * y > 0.9 OR x > 0.9 THEN {_BETA1.format(x='x')} ELSE 0 END) AS o1, sum(CASE WHEN x * y > 0.9 OR y > 0.9 THEN {_BETA1.format(x='y')} ELSE 0 END) AS o2 FROM z GROUP BY k) "
    f"SELECT k AS p_partkey, round(sqrt(greatest(0, (sh - {_beta('n1', 'n2')} - (o2 - {_BETA1.format(x='n2')})) / n2 + (sh - {_beta('n1', 'n2')} - (o1 - {_BETA1.format(x='n1')})) / n1)), 6) AS distance FROM s",
)
def distance_dirichlet(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array(*[c.cast("double") for c in (F.col("p_size") % 7, F.col("p_partkey") % 5, F.col("p_size") % 3 + 2)]).alias("a"))
    pairs = rows.join(rows.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b")), "p_partkey")
    return pairs.select("p_partkey", F.round(special.dirichlet(F.col("a"), F.col("b")), 6).alias("distance"))


@plans.add(
    "distance_count",
    f"WITH p AS (SELECT a.p_partkey AS k, least(a.p_size, b.p_size) AS lo, greatest(a.p_size, b.p_size) AS hi FROM part AS a JOIN part AS b ON b.p_partkey = a.p_partkey + 1), f AS (SELECT *, CASE WHEN lo < 2 THEN 0 WHEN lo < 10 THEN coalesce(list_sum([ln(i) FOR i IN range(2, lo)]), 0) ELSE {_SERIES.format(x='(lo + 1)::DOUBLE')} END AS f FROM p) "
    "SELECT k AS p_partkey, round(coalesce(list_sum([k2 * ln(2.0) - 2.0 - f - coalesce(list_sum([ln(j) FOR j IN range(greatest(lo, 1), k2)]), 0) FOR k2 IN range(lo, hi)]), 0), 6) AS distance FROM f",
)
def distance_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array(F.col("p_size").cast("double")).alias("a"))
    pairs = rows.join(rows.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b")), "p_partkey")
    return pairs.select("p_partkey", F.round(special.count_distance(F.col("a"), F.col("b"), rate=2.0), 6).alias("distance"))


@plans.add("curve_fit", _KNN + " SELECT query, item, round(1 / (1 + 1.57694206 * distance ** (2 * 0.89506178)) + 1e-7, 4) AS weight FROM k WHERE rank <= 5")
def curve_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of neighbours by the curve that is fitted for the usual spread; in SQL with its published numbers."""
    a, b = special.curve(1.0, 0.1)
    return _neighbours(spark, sf_dir).select("query", "item", F.round(1 / (1 + a * F.pow("distance", 2 * b)) + 1e-7, 4).alias("weight"))


@plans.add("memberships", _KNN + ", r AS (SELECT query, min(distance) AS rho FROM k WHERE rank <= 5 AND distance > 0 GROUP BY query) SELECT k.query AS query, item, round(CASE WHEN distance <= rho THEN 1 ELSE exp(-(distance - rho) / 0.7) END, 4) AS weight FROM k JOIN r ON k.query = r.query WHERE rank <= 5")
def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _neighbours(spark, sf_dir)
    rho = near.filter("distance > 0").groupBy("query").agg(F.min("distance").alias("rho"))
    return near.join(rho, "query").select("query", "item", F.round(special.membership(F.col("distance"), F.col("rho"), F.lit(0.7)), 4).alias("weight"))
