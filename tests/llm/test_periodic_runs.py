"""Periodic runs of words, against all stretches of all periods."""

import hashlib
import random
import zlib

from mosaiq.llm import periodic_runs
from mosaiq.llm.periodic_runs import Limits
from mosaiq.llm.queries import op12_periodic_runs


def plain_runs(x, limits=Limits()):
    """Every maximal stretch of every period, the smallest period of each."""
    n, found = len(x), {}
    for q in range(1, n // limits.min_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j + q - i >= limits.least(q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e, q) for (s, e), q in found.items())


def sequences(r):
    for _ in range(400):
        n, letters = r.randint(0, 150), r.choice([1, 2, 3, 30])
        x = [r.randrange(letters) for _ in range(n)]
        for _ in range(r.randint(0, 3)):
            if x:
                a = r.randrange(len(x))
                block = x[a : a + r.randint(1, 40)]
                x[a:a] = block * r.randint(1, 9)
        yield x


def test_runs_are_all_maximal_stretches():
    for x in sequences(random.Random(1)):
        for limits in (Limits(), Limits(6, 2), Limits(4, 3)):
            assert sorted(periodic_runs.runs(x, limits)) == plain_runs(x, limits)


def test_words_of_runs_survive_the_mask():
    assert Limits().overlap == 16
    assert all(limits.overlap == min(limits.least(q) - q for q in range(1, 400)) for limits in (Limits(), Limits(6, 2), Limits(50, 4), Limits(2, 3)))


def expected(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    number = {}
    found = sorted((s, e - s, q) for s, e, q in plain_runs([number.setdefault(w, len(number)) for w in words]))
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda f: (-f[1] / f[2], f[0], f[2]), default=None)
    digest = lambda x: hashlib.sha256(x).hexdigest()
    return {
        "doc_id": doc_id,
        "n_runs": len(found),
        "start": best and best[0],
        "length": best and best[1],
        "period": best and best[2],
        "exponent_milli": best and 1000 * best[1] // best[2],
        "runs_sha256": digest("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()),
        "collapsed_sha256": digest(b" ".join(w for i, w in enumerate(words) if i not in gone)),
    }


def test_query_equals_brute_force(spark, tmp_path):
    r = random.Random(2)
    texts = [" ".join(f"w{k}" for k in x) for x in sequences(r)]
    odd = [None, "", " \t\n", "a", "\x1cx\x85 \xa0y　z\n" * 30, "same " * 1_000, "one two three four five six seven eight " * 3, "a b " * 30 + "c " * 30 + "é ü ß " * 9]
    rows = [(i, t, i) for i, t in enumerate(texts + odd)] + [(None, "x " * 40, 0), (7, texts[7], 0), (7, texts[7], 0)]
    spark.createDataFrame(rows, "doc_id long, text string, runs int").write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_periodic_runs(spark, str(tmp_path))
    assert got.columns == list(expected(1, "a"))
    key = lambda row: str(sorted(row.items(), key=lambda kv: kv[0]))
    assert sorted((x.asDict() for x in got.collect()), key=key) == sorted((expected(i, t) for i, t, _ in rows), key=key)


def test_kinds_and_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_periodic_runs(spark, str(tmp_path))
    assert got.count() == 0
    assert dict(got.dtypes) == {"doc_id": "bigint"} | dict.fromkeys(("n_runs", "start", "length", "period", "exponent_milli"), "bigint") | dict.fromkeys(("runs_sha256", "collapsed_sha256"), "string")


def test_a_very_long_text_is_searched_whole(spark):
    words = [f"w{i}" for i in range(200_000)]
    words[150_000:] = [words[150_000 + i % 7_000] for i in range(50_000)]
    words[100_000:100_040] = ["la"] * 40
    row = periodic_runs.find(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert [tuple(x) for x in row.runs] == [(100_000, 40, 1), (150_000, 50_000, 7_000)]
    assert row.collapsed.split() == words[:100_001] + words[100_040:157_000]


def test_runs_and_texts(spark):
    docs = spark.createDataFrame([("d", "so " + "la la li " * 9 + "end")], "doc_id string, text string")
    row = periodic_runs.find(docs).first()
    assert [tuple(x) for x in row.runs] == [(1, 27, 3)] and row.collapsed == "so la la li end" and row.n_words == 29
