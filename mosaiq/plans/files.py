"""Queries over files that they write first: what comes back must be what the table holds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.plans.common import Plans, table
from mosaiq.sources import files

plans = Plans()


def _folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors reach."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"


def _mounted(folder: str) -> str:
    return folder.removeprefix("file://").removeprefix("file:")


_CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


def _customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


def _round_trip(kind: str) -> None:
    @plans.add(f"read_{kind}", _CUSTOMER)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, folder = _customer(spark, sf_dir), _folder(spark)
        files.write(rows, _mounted(folder) if kind == "arrow" else folder, kind)
        if kind == "csv":
            return files.read_csv(spark, folder, rows.schema)
        if kind == "json":
            return files.read_documents(spark, folder, rows.schema)
        return files.arrow_files(spark, folder, rows.schema) if kind == "arrow" else spark.read.parquet(folder)


for _kind in files.SINKS:
    _round_trip(_kind)


@plans.add("read_csv_inferred", "SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def read_csv_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    files.write(_customer(spark, sf_dir), folder, "csv")
    return files.read_csv(spark, folder).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total")).withColumn("c_nationkey", F.col("c_nationkey").cast("int"))


@plans.add("read_matrix", "SELECT CAST(c_custkey AS DOUBLE) AS k, c_acctbal AS v, NULL::DOUBLE AS t FROM customer")
def read_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    files.write(_customer(spark, sf_dir).select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.concat(F.lit("x"), "c_mktsegment").alias("t")), folder, "csv")
    return files.read_matrix(spark, folder)


@plans.add("read_html_tables", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def read_html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = lambda c, tag="td": F.concat(F.lit(f"<{tag} class='x'><b>"), c, F.lit(f"</b> </{tag}>"))
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("<tr>"), cell(F.col("n_nationkey").cast("string")), cell(F.replace("n_name", F.lit("A"), F.lit("&amp;"))), cell(F.col("n_regionkey").cast("string")), F.lit("</tr>")).alias("r"))
    pages = rows.agg(F.concat(F.lit("<html><TABLE>\n<tr><th>key</th><th>name</th><th>region</th></tr>"), F.array_join(F.collect_list("r"), "\n"), F.lit("</TABLE></html>")).alias("html"))
    got = pages.select(F.explode(F.slice(files.html_rows(F.col("html")), 2, 1_000_000)).alias("c"))
    return got.select(F.col("c")[0].cast("int").alias("n_nationkey"), F.replace(F.col("c")[1], F.lit("&"), F.lit("A")).alias("n_name"), F.col("c")[2].cast("int").alias("n_regionkey"))


@plans.add("read_xml_records", "SELECT n_nationkey AS id, n_name AS title, '2024-01-' || lpad((n_nationkey % 28 + 1)::VARCHAR, 2, '0') AS datestamp FROM nation")
def read_xml_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("n_nationkey") % 28 + 1).cast("string"), 2, "0"))
    xml = F.concat(F.lit("<record><header><id>"), F.col("n_nationkey").cast("string"), F.lit("</id><datestamp>"), day, F.lit("</datestamp></header><title>"), "n_name", F.lit("</title></record>"))
    folder = _folder(spark)
    rows = table(spark, sf_dir, "nation").select(xml.alias("r"))
    rows.agg(F.concat(F.lit("<records>"), F.array_join(F.collect_list("r"), "\n"), F.lit("</records>")).alias("value")).write.text(folder)
    got = files.read_records(spark, folder, "record", "header struct<id: int, datestamp: string>, title string")
    return got.select("header.id", "title", "header.datestamp")


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two formats below a folder for each region."""
    folder = _folder(spark)
    rows = table(spark, sf_dir, "nation").select("n_regionkey", "n_name").repartition(1)
    rows.withColumn("r", F.col("n_regionkey")).write.partitionBy("r").json(f"{folder}/a")
    rows.filter("n_regionkey < 2").withColumn("r", F.col("n_regionkey")).write.partitionBy("r").option("header", "true").csv(f"{folder}/b")
    return files.listing(spark, folder)


@plans.add("list_directories", "SELECT 'a/r=' || r_regionkey AS directory, 'd' || r_regionkey AS rank, 1 AS files FROM region UNION ALL SELECT 'b/r=' || k, 'd' || (5 + k), 1 FROM (SELECT range AS k FROM range(2))")
def list_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.directory_ranks(_listed(spark, sf_dir)).groupBy("directory", "rank").agg(F.count(F.lit(1)).cast("int").alias("files"))


@plans.add("list_by_extension", "SELECT '.json' AS extension, 5 AS files UNION ALL SELECT '.csv', 2")
def list_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _listed(spark, sf_dir)
    return found.filter(files.has_extension(F.col("file"), [".JSON", ".csv"])).groupBy(F.regexp_extract("file", r"(\.[a-z]+)$", 1).alias("extension")).agg(F.count(F.lit(1)).cast("int").alias("files"))


@plans.add("total_size", "SELECT CAST(sum(strlen(p_name) + 1) AS BIGINT) AS bytes, 'small' AS route FROM part")
def total_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All names of parts as lines of text files: as many bytes as the names and their line ends have."""
    folder = _folder(spark)
    table(spark, sf_dir, "part").select("p_name").write.text(folder)
    found = files.by_size(files.listing(spark, folder), 500_000_000)
    return files.total_size(found.filter("route = 'small'")).select("bytes", F.lit("small").alias("route"))


@plans.add("preview_names", "SELECT 'image_' || lpad(p_partkey::VARCHAR, 6, '0') || '.ome.tif' AS file FROM part ORDER BY 1 LIMIT 10")
def preview_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.concat(F.lit("image_"), F.lpad(F.col("p_partkey").cast("string"), 6, "0"), F.lit(".ome.tif")).alias("file"))
    return files.preview(names, 10)


@plans.add("nested_documents", "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k, i AS item FROM events, (SELECT unnest(range(2)) AS i) WHERE i <= event_id % 2")
def nested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an array: written as JSON, read by a schema, one row for each element."""
    rows = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").alias("props"), F.transform(F.sequence(F.lit(0).cast("long"), F.col("event_id") % 2), lambda i: F.struct(i.alias("i"))).alias("items"))
    folder = _folder(spark)
    files.write(rows, folder, "json")
    got = files.read_documents(spark, folder, rows.schema)
    return got.select("event_id", "props.k", F.explode_outer("items.i").alias("item"))
