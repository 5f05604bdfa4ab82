"""Queries over feature tables: statistics, scaling, reshaping, metrics, joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.functions import metrics, statistics
from mosaiq.operators import matching, tables
from mosaiq.plans.common import Plans, table
from mosaiq.plans.predicates import compile_predicate, from_fields

plans = Plans()
LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount"]


@plans.add(
    "group_mean_join_back",
    """WITH k AS (SELECT *, regexp_extract(l_returnflag || '-' || l_linestatus, '^[A-Z]') AS "group" FROM lineitem),
m AS (SELECT "group", avg(l_quantity) AS qm, avg(l_extendedprice) AS pm, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM k GROUP BY 1)
SELECT l_orderkey, l_linenumber, k."group" AS "group", round(qm, 6) AS quantity_mean, round(pm, 4) AS price_mean,
  CASE WHEN hi > lo THEN CAST(round_even((l_extendedprice - lo) / (hi - lo) * 254 + 1, 0) AS BIGINT) ELSE 1 END AS level
FROM k JOIN m ON k."group" = m."group" """,
)
def group_mean_join_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice")
    key = F.regexp_extract(F.concat_ws("-", "l_returnflag", "l_linestatus"), "^[A-Z]", 0)
    joined = tables.group_mean_join_back(lines, key, ["l_quantity", "l_extendedprice"], bounds=["l_extendedprice"])
    return joined.select("l_orderkey", "l_linenumber", "group", F.round("l_quantity_mean", 6).alias("quantity_mean"), F.round("l_extendedprice_mean", 4).alias("price_mean"), statistics.levels("l_extendedprice", "l_extendedprice_min", "l_extendedprice_max").alias("level"))


_MOMENTS = """WITH c AS (SELECT *, avg({c}) OVER (PARTITION BY {k}) AS mu FROM {t}), m AS (SELECT {k}, count({c}) AS n, avg(({c} - mu) ** 2) AS m2, avg(({c} - mu) ** 3) AS m3, avg(({c} - mu) ** 4) AS m4 FROM c GROUP BY {k}) """
_SKEW = _MOMENTS.format(c="l_extendedprice", k="l_returnflag", t="lineitem")
_SIMPLE = {"mean": "avg({c})", "count": "count({c})", "var": "var_pop({c})", "std": "stddev_pop({c})", "median": "quantile_cont({c}, 0.5)"}
_ROUND = {"mean": 6, "count": 0, "var": 2, "std": 5, "median": 6, "skewness": 6, "kurtosis": 6, "kurtosis_pearson": 6}
_FORMULA = {"skewness": "m3 / m2 ** 1.5", "kurtosis": "m4 / m2 ** 2 - 3", "kurtosis_pearson": "m4 / m2 ** 2"}


def _statistic(method: str) -> None:
    if method in _SIMPLE:
        sql = f"SELECT l_returnflag, round(CAST({_SIMPLE[method].format(c='l_extendedprice')} AS DOUBLE), {_ROUND[method]}) AS value FROM lineitem GROUP BY 1"
    else:
        sql = _SKEW + f"SELECT l_returnflag, round({_FORMULA[method]}, {_ROUND[method]}) AS value FROM m"

    @plans.add(f"stat_{method}", sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = tables.group_statistics(table(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_extendedprice"], [method])
        return found.select("l_returnflag", F.round(F.col(f"l_extendedprice_{method}").cast("double"), _ROUND[method]).alias("value"))


for _method in statistics.METHODS:
    _statistic(_method)


@plans.add(
    "stat_iqr_hinge",
    """WITH s AS (SELECT l_returnflag, list_sort(list(l_extendedprice)) AS v FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(list_median(v[len(v) - len(v) // 2 + 1:]) - list_median(v[:len(v) // 2]), 6) AS l_extendedprice_iqr
FROM s""".replace("list_median(", "list_aggregate(").replace("2 + 1:])", "2 + 1:], 'median')").replace("// 2])", "// 2], 'median')"),
)
def stat_iqr_hinge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.hinge_iqr(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice").select("l_returnflag", F.round("l_extendedprice_iqr", 6).alias("l_extendedprice_iqr"))


@plans.add("value_range", "SELECT " + ", ".join(f"{f}({c}) AS {c}_{f}" for c in LINE_COLUMNS for f in ("min", "max")) + " FROM lineitem")
def value_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.value_range(table(spark, sf_dir, "lineitem"), LINE_COLUMNS)


@plans.add(
    "z_score",
    """WITH m AS (SELECT c_mktsegment, avg(c_acctbal) AS a, stddev_samp(c_acctbal) AS s FROM customer GROUP BY 1)
SELECT c_custkey, round(greatest(-1.5, least(1.5, CASE WHEN s > 0 THEN (c_acctbal - a) / s ELSE 0 END)), 6) AS z FROM customer JOIN m USING (c_mktsegment)""",
)
def z_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    stats = rows.groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("a"), F.stddev_samp("c_acctbal").alias("s"))
    return rows.join(stats, "c_mktsegment").select("c_custkey", F.round(statistics.z_score("c_acctbal", "a", "s", 1.5), 6).alias("z"))


@plans.add("significant_digits", "SELECT c_custkey, CASE WHEN c_acctbal = 0 THEN 0.0 ELSE round(c_acctbal * pow(10.0, 2 - floor(log10(abs(c_acctbal))))) / pow(10.0, 2 - floor(log10(abs(c_acctbal)))) END AS rounded FROM customer")
def significant_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", statistics.significant("c_acctbal", 3).alias("rounded"))


KINDS = ["click", "error", "purchase", "signup", "view"]


@plans.add("pivot_mean", "SELECT user_id, " + ", ".join(f"round(avg(value) FILTER (event_type = '{k}'), 6) AS \"{k}\"" for k in KINDS) + " FROM events GROUP BY user_id")
def pivot_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", KINDS).agg(F.avg("value"))
    return wide.select("user_id", *[F.round(k, 6).alias(k) for k in KINDS])


@plans.add("unpivot", "SELECT l_orderkey, l_linenumber, name, value FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) UNPIVOT (value FOR name IN (l_quantity, l_discount, l_tax))")
def unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "name", "value")


@plans.add("dedupe_first", "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, min(o_orderdate) AS o_orderdate FROM orders GROUP BY o_custkey")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return tables.keep_first(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@plans.add("drop_null_columns", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS large FROM orders")
def drop_null_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("large"), F.lit(None).cast("string").alias("empty"))
    return tables.drop_null_columns(rows)


@plans.add(
    "top_k_per_group",
    "SELECT c_nationkey, c_custkey, c_acctbal, rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 3",
)
def top_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return tables.top_k(rows, ["c_nationkey"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 3)


@plans.add(
    "gap_groups",
    """WITH g AS (SELECT user_id, ts, event_id, epoch(ts) AS t FROM events),
d AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) >= 86400 THEN 1 ELSE 0 END AS gap FROM g)
SELECT user_id, event_id, CAST(sum(gap) OVER (PARTITION BY user_id ORDER BY t RANGE UNBOUNDED PRECEDING) AS BIGINT) AS "group" FROM d""",
)
def gap_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return tables.gap_groups(rows, ["user_id"], "t", 86400.0).select("user_id", "event_id", F.col("group").cast("long").alias("group"))


@plans.add(
    "full_outer_link",
    """WITH a AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_acctbal > 9000 GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS nation, customers, suppliers FROM a FULL JOIN b ON a.k = b.k""",
)
def full_outer_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("customers"))
    b = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("suppliers"))
    return a.join(b, "nation", "full")


@plans.add(
    "as_of_join",
    """WITH p AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT e.event_id AS event_id, p.value AS last_value FROM (SELECT * FROM events WHERE event_type = 'view') AS e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts""",
)
def as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    views = events.filter("event_type = 'view'").select("event_id", "user_id", "ts")
    bought = events.filter("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("last_value"))
    return matching.as_of(views, bought, ["user_id"], "ts", "ts", ["last_value"]).select("event_id", "last_value")


@plans.add("split_by_sentinel", "SELECT l_returnflag, CASE WHEN l_discount < 0.05 THEN 'low' ELSE 'high' END AS side, count(*) AS n FROM lineitem GROUP BY ALL")
def split_by_sentinel(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("l_discount") < 0.05, "low").otherwise("high").alias("side")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", side).agg(F.count(F.lit(1)).alias("n"))


@plans.add("rollup_counts", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@plans.add("predicate_tree", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice >= 50000 AND o_totalprice <= 200000 AND NOT (o_orderstatus = 'P')")
def predicate_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = {"AND": [from_fields(o_orderpriority=["1-URGENT", "2-HIGH"], o_totalprice=(50000, 200000)), {"NOT": {"=": {"o_orderstatus": "P"}}}]}
    return table(spark, sf_dir, "orders").filter(compile_predicate(tree)).select("o_orderkey")


@plans.add("offset_first", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 10")
def offset_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").orderBy(F.col("c_acctbal").desc(), "c_custkey").offset(10).limit(20)


@plans.add("concat_features", "SELECT 'customer' AS kind, c_nationkey AS nation, c_acctbal AS balance, NULL AS name FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_acctbal, s_name FROM supplier")
def concat_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    b = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"))
    return a.unionByName(b, allowMissingColumns=True)


@plans.add("unique_values", "SELECT p_brand, count(*) AS n, count(DISTINCT p_type) AS n_types FROM part GROUP BY 1")
def unique_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p_type").alias("n_types"))


@plans.add("correlation", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1")
def correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"))


@plans.add("percentile_range", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.9) - quantile_cont(l_extendedprice, 0.1), 4) AS spread FROM lineitem GROUP BY 1")
def percentile_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.quantile(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", {"low": 0.1, "high": 0.9})
    return found.select("l_returnflag", F.round(F.col("high") - F.col("low"), 4).alias("spread"))


@plans.add(
    "histogram_entropy",
    """WITH b AS (SELECT l_returnflag, CAST(floor(l_extendedprice / 1000.0) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY ALL), t AS (SELECT l_returnflag, sum(n) AS total FROM b GROUP BY 1)
SELECT l_returnflag, round(-sum(n / total * ln(n / total)), 6) AS entropy FROM b JOIN t USING (l_returnflag) GROUP BY 1""",
)
def histogram_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.floor(F.col("l_extendedprice") / 1000.0).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return bins.groupBy("l_returnflag").agg(F.round(F.ln(F.sum("n")) - F.sum(F.col("n") * F.ln("n")) / F.sum("n"), 6).alias("entropy"))


_COUNTS = "{k} count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 0 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic = 0) AS fn, count(*) FILTER (quality = 0 AND toxic = 0) AS tn"
_DIV = lambda a, b: f"(CASE WHEN ({b}) <> 0 THEN ({a}) / ({b}) ELSE 0 END)"


def _pixel_sql() -> dict[str, str]:
    r, p, s, npv, fpr = _DIV("tp", "tp + fn"), _DIV("tp", "tp + fp"), _DIV("tn", "tn + fp"), _DIV("tn", "tn + fn"), _DIV("fp", "fp + tn")
    n, c2 = "(tp + fp + fn + tn)", lambda x: f"(({x}) * (({x}) - 1) / 2)"
    acc = _DIV("tp + tn", n)
    exp = _DIV("(tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)", f"{n} * {n}")
    rows, cols = f"({c2('tp + fp')} + {c2('fn + tn')})", f"({c2('tp + fn')} + {c2('fp + tn')})"
    chance = _DIV(f"{rows} * {cols}", c2(n))
    mirkin = "((tp + fn) ** 2 + (fp + tn) ** 2 + (tp + fp) ** 2 + (fn + tn) ** 2 - 2 * (tp ** 2 + fp ** 2 + fn ** 2 + tn ** 2))"
    return {
        "iou": _DIV("tp", "tp + fp + fn"), "sensitivity": r, "precision": p, "specificity": s, "npv": npv, "fnr": _DIV("fn", "tp + fn"), "fpr": fpr, "fdr": _DIV("fp", "tp + fp"), "for": _DIV("fn", "tn + fn"),
        "prevalence": _DIV("tp + fn", n), "accuracy": acc, "balanced_accuracy": f"({r} + {s}) / 2", "f05": _DIV("1.25 * tp", "1.25 * tp + 0.25 * fn + fp"), "f1": _DIV("2 * tp", "2 * tp + fn + fp"),
        "prevalence_threshold": _DIV(f"sqrt({r} * {fpr}) - {fpr}", f"{r} - {fpr}"), "mcc": _DIV("tp * tn - fp * fn", "sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))"), "fmi": f"sqrt({p} * {r})",
        "informedness": f"{r} + {s} - 1", "markedness": f"{p} + {npv} - 1", "kappa": _DIV(f"{acc} - {exp}", f"1 - {exp}"), "mirkin": mirkin, "adjusted_mirkin": _DIV(mirkin, f"{n} * {n}"),
        "adjusted_rand": _DIV(f"({c2('tp')} + {c2('fp')} + {c2('fn')} + {c2('tn')}) - {chance}", f"({rows} + {cols}) / 2 - {chance}"),
    }


def _confusion(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumn("image", F.col("doc_id") % 7)
    hit = lambda q, t: F.count_if((F.col("quality") == q) & (F.col("toxic") == t))
    return labels.groupBy(*keys).agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"))


_DOUBLE = "CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, CAST(fn AS DOUBLE) AS fn, CAST(tn AS DOUBLE) AS tn"


@plans.add("pixel_metrics", f"WITH c AS (SELECT {_COUNTS.format(k='doc_id % 7 AS image,')} FROM labels GROUP BY 1), d AS (SELECT image, {_DOUBLE} FROM c) SELECT image, " + ", ".join(f'round({v}, 6) AS "{k}"' for k, v in _pixel_sql().items()) + " FROM d")
def pixel_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.pixel_metrics(*map(F.col, ("tp", "fp", "fn", "tn")))
    return _confusion(spark, sf_dir, "image").select("image", *[F.round(v, 6).alias(k) for k, v in found.items()])


@plans.add("pixel_metrics_total", f"WITH c AS (SELECT {_COUNTS.format(k='')} FROM labels), d AS (SELECT {_DOUBLE} FROM c) SELECT " + ", ".join(f'round({v}, 6) AS "{k}"' for k, v in _pixel_sql().items()) + " FROM d")
def pixel_metrics_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.pixel_metrics(*map(F.col, ("tp", "fp", "fn", "tn")))
    return _confusion(spark, sf_dir).select(*[F.round(v, 6).alias(k) for k, v in found.items()])


@plans.add(
    "region_metrics_average",
    f"WITH c AS (SELECT {_COUNTS.format(k='doc_id % 7 AS image,')} FROM labels GROUP BY 1), d AS (SELECT image, {_DOUBLE} FROM c) SELECT "
    + ", ".join(f'round(avg({_pixel_sql()[k]}), 6) AS "{k}"' for k in ("iou", "sensitivity", "precision", "fnr", "fdr", "f05", "f1", "fmi"))
    + " FROM d",
)
def region_metrics_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.region_metrics(*map(F.col, ("tp", "fp", "fn")))
    return _confusion(spark, sf_dir, "image").agg(*[F.round(F.avg(v), 6).alias(k) for k, v in found.items()])


@plans.add(
    "over_under_segmentation",
    """WITH p AS (SELECT DISTINCT l_partkey AS gt, l_suppkey * 100 + l_partkey % 7 AS pred FROM lineitem),
g AS (SELECT *, count(*) OVER (PARTITION BY gt) AS a, count(*) OVER (PARTITION BY pred) AS b FROM p)
SELECT count(DISTINCT gt) FILTER (a > 1) AS over, count(DISTINCT pred) FILTER (b > 1) AS under FROM g""",
)
def over_under_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("gt"), (F.col("l_suppkey") * 100 + F.col("l_partkey") % 7).alias("pred")).distinct()
    over = pairs.groupBy("gt").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("over"))
    under = pairs.groupBy("pred").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("under"))
    return over.select(F.lit(1).alias("k"), "over").join(under.select(F.lit(1).alias("k"), "under"), "k").drop("k")


@plans.add(
    "match_first",
    """WITH f AS (SELECT l_orderkey, min((l_linenumber, l_partkey)) AS m, count(*) AS n_candidates FROM lineitem GROUP BY 1)
SELECT o_orderkey, m[1] AS l_linenumber, m[2] AS l_partkey, n_candidates FROM orders JOIN f ON o_orderkey = l_orderkey""",
)
def match_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    return matching.first_match(orders, lines, ["o_orderkey"], ["l_linenumber"])


@plans.add("match_subset_keys", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def match_subset_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    fields = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), "n_name")
    return matching.subset_keys(images, fields, ["c_custkey", "nation"], ["nation"]).select("c_custkey", "n_name")


@plans.add("match_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def match_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.unmatched(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@plans.add("match_substring", "WITH n AS (SELECT DISTINCT substr(p_name, 1 + p_partkey % 4, 2 + p_partkey % 5) AS name FROM part) SELECT name, min(p_partkey) AS p_partkey FROM n JOIN part ON contains(p_name, name) GROUP BY name")
def match_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    name = F.substring("p_name", (1 + F.col("p_partkey") % 4).cast("int"), (2 + F.col("p_partkey") % 5).cast("int"))
    return matching.by_substring(parts.select(name.alias("name")).distinct(), parts, "name", "p_name", "p_partkey")


@plans.add(
    "registration_groups",
    """WITH f AS (SELECT p_partkey % 30 AS z, p_size % 5 AS c, min(p_name) AS file FROM part GROUP BY 1, 2), t AS (SELECT z, min(file) AS template FROM f WHERE c = 0 GROUP BY z)
SELECT f.z AS z, f.c AS c, template, file AS moving_file FROM f JOIN t ON f.z = t.z WHERE c <> 0""",
)
def registration_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 30).alias("z"), (F.col("p_size") % 5).alias("c")).agg(F.min("p_name").alias("file"))
    return matching.cross_registration(files, ["z"], ["c"], {"c": 0})
