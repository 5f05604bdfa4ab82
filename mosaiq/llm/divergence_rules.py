"""Quality rules with distribution divergence, in DataFrame functions only.

Base rules look at words, symbols and repetition.  The method then compares two histograms of each text with
references of its language by Jensen-Shannon distance: classes of characters, and the common words of the language
against all other words.  Common words and references are learnt: from all documents of the language that pass the base
rules and have ``min_words`` words, the most frequent words and the summed histograms.
A text too short for a stable histogram (``min_words``) is not judged by its words, and one below ``min_chars`` not by
its characters; nor is a text without a language, or of one that no such document is in.

Null texts count as empty: every count is 0, ``base_failed`` is true and ``kept`` false.  Rows are judged one by one, so
repeated rows keep their number; an empty table gives an empty result; other columns are ignored.  Of words that are
equally frequent the least is the more common.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.llm.common import materialise, small

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Limits:
    char_distance: float = 0.25
    #: By chance alone a sample of n words is some 1 / sqrt(n) from its source: the bound is base + slack / sqrt(n).
    word_base: float = 0.12
    word_slack: float = 2.6
    min_chars: int = 100
    min_words: int = 50
    #: Words of each language that have bins of their own.
    common_words: int = 18


def base_counts(docs: DataFrame, limits: Limits = Limits(), id_column: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The counts of the contract for each text, its histogram of characters, and its words (one text, as that takes less room) if it is
    judged by them."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.select(F.col(id_column).alias("doc_id"), F.col(lang).alias("lang"), t.alias("t"))
    out = out.withColumn("w", F.regexp_extract_all("t", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.select(
        "doc_id",
        "lang",
        "t",
        "w",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.when(F.size("w") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("w") - WINDOW), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(WINDOW)]))).alias("h"),
        F.regexp_extract_all(F.lower("t"), F.lit(r"\p{L}+"), F.lit(0)).alias("plain"),
    )
    out = out.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda x, j: F.coalesce(F.get("s", j)["h"] == x["h"], F.lit(False))
    out = out.withColumn("p", F.sort_array(F.transform(F.filter("s", lambda x, j: F.when(j > 0, same(x, j - 1)).otherwise(False) | same(x, j + 1)), lambda x: x["i"])))
    covered = F.aggregate(F.transform("p", lambda x, j: F.when(j > 0, F.least(x - F.get("p", j - 1), F.lit(WINDOW))).otherwise(WINDOW)), F.lit(0).cast("long"), lambda a, x: a + x)
    gone = lambda pattern: F.length("t") - F.length(F.regexp_replace("t", pattern, ""))
    out = out.select(
        "doc_id",
        "lang",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.length("t").cast("long").alias("n_chars"),
        gone(r"\p{Ll}+").cast("long").alias("c_lower"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("c_upper"),
        F.regexp_count("t", F.lit(r"\p{Nd}")).cast("long").alias("c_digit"),
        F.regexp_count("t", F.lit(r"[.,;:!?'\"()-]")).cast("long").alias("c_point"),
        F.size("plain").cast("long").alias("n_plain"),
        F.when(F.col("lang").isNotNull() & (F.size("plain") >= limits.min_words), F.array_join("plain", " ")).alias("plain"),
    )
    space = F.col("n_chars") - F.col("word_chars")
    known = ("c_lower", "c_upper", "c_digit", "c_point", "n_symbols")
    rest = F.greatest(F.lit(0), F.col("word_chars") - sum((F.col(c) for c in known), F.lit(0)))
    return out.select(
        "doc_id",
        "lang",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "n_chars",
        "n_plain",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        F.array(*[F.col(c) for c in known], space, rest).alias("char_counts"),
        "plain",
    )


def common_words(counts: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``lang, listed``: the most frequent words of each language, summed in each task before they meet."""
    words = counts.filter(~F.col("base_failed")).select("lang", F.explode(F.split("plain", " ")).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "word"))
    top = words.withColumn("r", rank).filter(F.col("r") <= limits.common_words)
    return top.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda x: x["word"]).alias("listed"))


def with_word_counts(counts: DataFrame, listed: DataFrame) -> DataFrame:
    """Counts with ``word_counts``: how often each listed word occurs, and how many other words there are."""
    common = F.transform("listed", lambda x: (F.size("plain") - F.size(F.array_remove("plain", x))).cast("long"))
    out = counts.join(listed, "lang", "left").withColumn("plain", F.split("plain", " ")).withColumn("common", F.when(F.col("plain").isNotNull(), common))
    rest = F.col("n_plain") - F.aggregate("common", F.lit(0).cast("long"), lambda a, x: a + x)
    return out.withColumn("word_counts", F.when(F.col("common").isNotNull(), F.concat("common", F.array(rest)))).drop("plain", "listed", "common")


def references(counts: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``lang, rc, rw``: the shares of the summed histograms of each language."""
    good = counts.filter(F.col("word_counts").isNotNull() & ~F.col("base_failed"))
    bins = {"char_counts": 7, "word_counts": 1 + limits.common_words}
    sums = {c: [F.sum(F.get(c, F.lit(i))) for i in range(n)] for c, n in bins.items()}
    found = good.groupBy("lang").agg(*[F.filter(F.array(*x), lambda v: v.isNotNull()).alias(c) for c, x in sums.items()])
    share = lambda c: F.transform(c, lambda x: x / F.greatest(F.lit(1), F.aggregate(c, F.lit(0).cast("long"), lambda a, y: a + y)))
    return found.select("lang", share("char_counts").alias("rc"), share("word_counts").alias("rw"))


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (square root of the divergence in bits) of a histogram of counts from a distribution;
    null where either is null or the histogram is empty."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    term = lambda a, b: F.when(a > 0, a * F.log2(2.0 * a / (a + b))).otherwise(0.0)
    parts = F.zip_with(counts, reference, lambda x, q: 0.5 * (term(x / total, q) + term(q, x / total)))
    return F.when(total > 0, F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda a, x: a + x))))


def judged(docs: DataFrame, limits: Limits = Limits(), id_column: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Counts, distances and verdict of every document."""
    counts = materialise(base_counts(docs, limits, id_column, text, lang), compression="zstd")
    counts = materialise(with_word_counts(counts, small(common_words(counts, limits))))
    out = counts.join(small(references(counts, limits)), "lang", "left")
    out = out.withColumn("char_distance", F.when(F.col("n_chars") >= limits.min_chars, distance(F.col("char_counts"), F.col("rc"))))
    out = out.withColumn("word_distance", F.when(F.col("n_plain") >= limits.min_words, distance(F.col("word_counts"), F.col("rw"))))
    fine = F.coalesce(F.col("char_distance") <= limits.char_distance, F.lit(True)) & F.coalesce(F.col("word_distance") <= limits.word_base + limits.word_slack / F.sqrt("n_plain"), F.lit(True))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & fine).alias("kept"), "char_distance", "word_distance")


def oracle_sql(limits: Limits = Limits()) -> str:
    """Counts and verdict in SQL."""
    blank = "[^\\x20\\x09-\\x0D]"
    gone = lambda x: f"length(t) - length(regexp_replace(t, '{x}', '', 'g'))"
    term = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2(2.0 * {a} / ({a} + {b})) ELSE 0 END"
    far = lambda c, r: f"CASE WHEN list_sum({c}) > 0 THEN sqrt(greatest(0.0, list_sum([0.5 * ({term(f'({c}[i] / list_sum({c}))', f'({r}[i] / list_sum({r}))')} + {term(f'({r}[i] / list_sum({r}))', f'({c}[i] / list_sum({c}))')}) FOR i IN range(1, len({c}) + 1)]))) END"
    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{blank}+') AS w, regexp_extract_all(lower(coalesce(text, '')), '\\p{{L}}+') AS plain FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT range AS k FROM range(5)) GROUP BY doc_id),
lin AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{blank}') GROUP BY doc_id),
f AS (SELECT d.doc_id AS doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, length(array_to_string(w, '')) AS word_chars, {gone("[#*$%&|<>]")} AS n_symbols, coalesce(lin.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
  length(t) AS n_chars, len(plain) AS n_plain, {gone(chr(92) + "p{Ll}+")} AS c_lower, {gone(chr(92) + "p{Lu}+")} AS c_upper, {gone(chr(92) + "p{Nd}+")} AS c_digit, {gone("[.,;:!?''" + chr(34) + "()-]")} AS c_point,
  CASE WHEN lang IS NOT NULL AND len(plain) >= {limits.min_words} THEN plain END AS plain
  FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id LEFT JOIN lin ON d.doc_id = lin.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  [c_lower, c_upper, c_digit, c_point, n_symbols, n_chars - word_chars, greatest(0, word_chars - c_lower - c_upper - c_digit - c_point - n_symbols)] AS cc FROM f),
wo AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(plain) AS word FROM b WHERE NOT base_failed) GROUP BY ALL),
li AS (SELECT lang, list(word ORDER BY r) AS listed FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS r FROM wo) WHERE r <= {limits.common_words} GROUP BY lang),
m AS (SELECT b.*, CASE WHEN plain IS NOT NULL AND listed IS NOT NULL THEN [len(list_filter(plain, lambda p: p = x)) FOR x IN listed] END AS common FROM b LEFT JOIN li ON li.lang = b.lang),
c AS (SELECT *, CASE WHEN common IS NOT NULL THEN list_append(common, n_plain - list_sum(common)) END AS wc FROM m),
u AS (SELECT lang, unnest(range(1, 8)) AS i, unnest(cc) AS v, 'c' AS k FROM c WHERE wc IS NOT NULL AND NOT base_failed
  UNION ALL SELECT lang, unnest(range(1, len(wc) + 1)), unnest(wc), 'w' FROM c WHERE wc IS NOT NULL AND NOT base_failed),
s AS (SELECT lang, k, i, sum(v)::DOUBLE AS v FROM u GROUP BY ALL),
r AS (SELECT lang, list(v ORDER BY i) FILTER (k = 'c') AS rc, list(v ORDER BY i) FILTER (k = 'w') AS rw FROM s GROUP BY lang),
j AS (SELECT c.*, CASE WHEN n_chars >= {limits.min_chars} THEN {far("cc", "rc")} END AS cd, CASE WHEN n_plain >= {limits.min_words} THEN {far("wc", "rw")} END AS wd FROM c LEFT JOIN r ON c.lang = r.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(cd <= {limits.char_distance}, true) AND coalesce(wd <= {limits.word_base} + {limits.word_slack} / sqrt(n_plain), true) AS kept, round(cd, 6) AS char_distance, round(wd, 6) AS word_distance
FROM j
"""
