"""URL verdicts by rules, and by trust that spreads over host links.

A rule has a host and a path; it fits a URL whose host is the rule's or below it and whose path starts with the
rule's, and the longest fitting rule decides.  Where no rule fits, the host decides: hosts with allowed pages are
trusted seeds, hosts with blocked pages are distrusted ones, each weighted by its pages.  Personalised PageRank carries
trust along links and, over reversed links, distrust to those that link to blocked hosts.  A host whose distrust
exceeds its trust is blocked.  Rank spreads until no host is newly reached and none changes by more than ``TOLERANCE`` of
its rank, ``ROUNDS`` times at least; the SQL has just those.

Links are the absolute and scheme-relative ``href`` targets of a page, counted for each pair of different hosts; rank
that reaches a host without links is not carried on.  Null URLs and URLs without ``://`` have an empty host and path; an
empty host is never a seed and is allowed.  Null html has no links.  Rows are judged one by one, repeated ones too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import materialise, released_shuffles

#: The rules of the registered query.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
DAMPING = 0.85
ROUNDS = 12
TOLERANCE = 1e-9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
HREF = r"(?i)\bhref\s*=\s*[\"']?(?:https?:)?//([^/?#\"'<>\s]+)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.regexp_extract(url, URL, 2)


def best_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict (both null if none does).  Rules are a parameter of the plan."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(f"/{rest}"))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """``src``, ``dst``, ``weight``: links between different hosts; pages has ``host``, ``html``."""
    found = pages.select("host", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(HREF), F.lit(1))).alias("dst"))
    found = found.select(F.col("host").alias("src"), F.translate("dst", UPPER, LOWER).alias("dst"))
    return found.filter((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """``host``, ``rank`` by personalised PageRank, after so many rounds and as many more as it takes to settle; edges has
    ``src``, ``dst``, ``weight``, seeds ``host``, ``seed``."""
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    steps = materialise(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    base = seeds.select("host", (F.col("seed") * (1 - damping)).alias("rank"))
    rank, before, k = base, None, 0
    while True:
        moved = steps.join(rank, steps["src"] == rank["host"]).select(F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank"))
        rank, k = moved.unionByName(base).groupBy("host").agg(F.sum("rank").alias("rank")), k + 1
        if k % 4:
            continue
        rank = materialise(rank)
        if k >= rounds and before is not None:
            both = rank.join(before.select("host", F.col("rank").alias("old")), "host", "left")
            if both.filter(F.abs(F.col("rank") - F.coalesce("old", F.lit(0.0))) > TOLERANCE * F.col("rank")).isEmpty():
                return rank
        before = rank


def host_scores(hosts: DataFrame, edges: DataFrame) -> DataFrame:
    """``host``, ``trust``, ``distrust``; hosts has ``host``, ``n_allow``, ``n_block``."""
    a, b = (x or 0 for x in hosts.agg(F.sum("n_allow"), F.sum("n_block")).first())
    seeds = {c: hosts.filter(F.col(c) > 0).select("host", (F.col(c) / max(n, 1)).alias("seed")) for c, n in (("n_allow", a), ("n_block", b))}
    if edges.isEmpty():
        trust, distrust = (s.select("host", (F.col("seed") * (1 - DAMPING)).alias("rank")) for s in seeds.values())
    else:
        back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
        trust, distrust = propagate(edges, seeds["n_allow"]), propagate(back, seeds["n_block"])
    both = trust.select("host", F.col("rank").alias("trust"), F.lit(0.0).alias("distrust")).unionByName(distrust.select("host", F.lit(0.0).alias("trust"), F.col("rank").alias("distrust")))
    return both.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))


def judged(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``trust``, ``distrust`` of every page."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    placed = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    rule, says = best_rule(F.col("host"), F.col("path"), rules)
    ruled = placed.drop("html").select("page_id", "host", "path", rule.alias("rule"), says.alias("says"))
    with released_shuffles(spark):
        sums = [F.sum((F.col("says") == s).cast("long")).alias(f"n_{s}") for s in ("allow", "block")]
        hosts = materialise(ruled.filter("host <> '' and says is not null").groupBy("host").agg(*sums))
        edges = materialise(host_edges(placed))
        scores = materialise(host_scores(hosts, edges))
    out = ruled.join(scores, "host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    verdict = F.coalesce("says", F.when(distrust > trust, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def _links_sql(name: str, start: str, n: int) -> str:
    """One personalised rank in SQL: rounds as a chain of common table expressions."""
    src, dst = ("src", "dst") if name == "t" else ("dst", "src")
    parts = [
        f"{name}_step AS (SELECT {src} AS a, {dst} AS b, weight / (sum(weight) OVER (PARTITION BY {src}))::DOUBLE AS share FROM edges)",
        f"{name}_base AS (SELECT host, {start} / greatest(1, (SELECT sum({start}) FROM hosts))::DOUBLE * {1 - DAMPING!r} AS r FROM hosts WHERE {start} > 0)",
        f"{name}_0 AS (SELECT host, r FROM {name}_base)",
    ]
    for k in range(1, n + 1):
        parts.append(f"{name}_{k} AS (SELECT host, sum(r) AS r FROM (SELECT b AS host, r * share * {DAMPING!r} AS r FROM {name}_step JOIN {name}_{k - 1} ON a = host UNION ALL SELECT host, r FROM {name}_base) GROUP BY host)")
    return ",\n".join(parts)


def oracle_sql(rules: list[tuple[str, str]] = RULES) -> str:
    longest = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    fits = lambda r: f"(host = '{r.partition('/')[0]}' OR host LIKE '%.{r.partition('/')[0]}') AND starts_with(path, '/{r.partition('/')[2]}')"
    case = lambda k: "CASE " + " ".join(f"WHEN {fits(r[0])} THEN '{r[k]}'" for r in longest) + " END"
    low = lambda x: f"translate({x}, '{UPPER}', '{LOWER}')"
    return f"""
WITH placed AS (
  SELECT page_id, html, {low("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")} AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
ruled AS (SELECT page_id, host, path, {case(0)} AS rule, {case(1)} AS says FROM placed),
hosts AS (SELECT host, count(*) FILTER (says = 'allow') AS n_allow, count(*) FILTER (says = 'block') AS n_block
  FROM ruled WHERE host <> '' AND says IS NOT NULL GROUP BY host),
links AS (SELECT host AS src, {low("unnest(regexp_extract_all(coalesce(html, ''), '(?i)\\bhref\\s*=\\s*[\"'']?(?:https?:)?//([^/?#\"''<>\\s]+)', 1))")} AS dst FROM placed),
edges AS (SELECT src, dst, count(*) AS weight FROM links WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
{_links_sql("t", "n_allow", ROUNDS)},
{_links_sql("d", "n_block", ROUNDS)}
SELECT page_id, ruled.host AS host, path, rule,
  coalesce(says, CASE WHEN coalesce(d.r, 0) > coalesce(t.r, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN t_{ROUNDS} AS t ON ruled.host = t.host LEFT JOIN d_{ROUNDS} AS d ON ruled.host = d.host
"""
