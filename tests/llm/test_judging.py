"""Language identification, quality model, quality rules, licences, link trust."""

import collections
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from mosaiq.llm import crf_langid, divergence_rules, licenses, link_trust, quality_lm

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = crf_langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == docs.count() and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_odd_texts_have_no_language(spark):
    rows = [(1, "the and of that with this", "en"), (2, "der die und nicht", "de"), (3, None, "en"), (4, "", None), (5, "12 -- ☃", "en"), (6, "12 ☃ und", None), (None, "the of", "en"), (1, "the and", "en")]
    rows += [(100 + i, "the and of that with this", "en") for i in range(6)] + [(200 + i, "der die und nicht ist", "de") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = crf_langid.identify(docs).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert [by[i]["lang_pred"] for i in (3, 4, 5)] == ["und"] * 3 and [by[i]["score"] for i in (3, 4, 5)] == [0.0] * 3
    assert by[6]["lang_pred"] == "de"
    assert crf_langid.identify(docs.limit(0)).count() == 0
    nothing = crf_langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def test_words_of_mixed_text_have_their_own_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = crf_langid.fit(*crf_langid.training_sample(docs))
    got = crf_langid.label_words(model, "the and of that with this on are der die und nicht ist auf mit dem")
    assert [w for w, _, _ in got][:2] == ["the", "and"] and [x for _, x, _ in got] == ["en"] * 8 + ["de"] * 8
    assert all(0.25 <= p <= 1 for _, _, p in got)


def brute_perplexity(trusted, text):
    """Interpolated modified Kneser-Ney on 4-grams, straight from the definition."""
    pad = lambda t: "\x01" * 3 + re.sub(r"[\x00-\x1f]", " ", t) + "\x02"
    grams = lambda t: [pad(t)[i - 3 : i + 1] for i in range(3, len(pad(t)))]
    level = {4: collections.Counter(g for t in trusted for g in grams(t))}
    for n in (3, 2, 1):
        level[n] = collections.Counter(g[1:] for g in level[n + 1])
    d = {}
    for n, c in level.items():
        k = [sum(v == i for v in c.values()) for i in range(1, 5)]
        if min(k) == 0:
            d[n] = (0.5, 0.75, 0.9)
        else:
            y = k[0] / (k[0] + 2 * k[1])
            d[n] = [min(max(i - (i + 1) * y * k[i] / k[i - 1], 0.05), i - 0.05) for i in (1, 2, 3)]
    off = lambda n, c: d[n][min(c, 3) - 1] if c else 0.0

    def p(n, g):
        if n == 0:
            return 1 / (len(level[1]) + 1)
        rest = {k: v for k, v in level[n].items() if k[:-1] == g[:-1]}
        if not rest:
            return p(n - 1, g[1:])
        s = sum(rest.values())
        gamma = sum(off(n, v) for v in rest.values()) / s
        c = level[n].get(g, 0)
        return (c - off(n, c)) / s + gamma * p(n - 1, g[1:])

    logs = [math.log(p(4, g)) for g in grams(text)]
    return math.exp(-sum(logs) / len(logs))


def test_perplexity_is_that_of_the_definition(spark):
    trusted = ["the cat sat on the mat", "a cat and a dog", "the dog ran\nover the hill", "äöü the end"]
    others = ["the cat ran", "zzz qqq 😀", "on", "x" * 50]
    rows = [(i, t, "en") for i, t in enumerate(trusted + others)] + [(20, None, "en"), (21, "", "en"), (22, " \n", "xx"), (None, "the cat", None), (0, "the cat sat on the mat", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"block": F.lit(1), "gram": F.lit("clash")})
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 4)] + [(0, 1, None), (5, 0, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")
    once = docs.filter("doc_id <> 0").unionByName(docs.filter("doc_id = 0").limit(1))
    for frame in (once, once.repartition(5)):
        limits = quality_lm.Limits(block_bytes=40)
        got = {r["doc_id"]: r for r in quality_lm.judged(frame, labels, limits).collect()}
        for i, t in enumerate(trusted + others):
            assert got[i]["perplexity"] == pytest.approx(brute_perplexity(trusted, t), rel=1e-9), t
        assert all(got[i]["perplexity"] is None and not got[i]["kept"] for i in (20, 21, 22))
        assert all(got[i]["kept"] for i in range(4)) and not got[7]["kept"]
    assert quality_lm.judged(docs, labels).count() == len(rows)
    assert quality_lm.judged(docs.limit(0), labels).count() == 0
    untrained = {r["doc_id"]: r["kept"] for r in quality_lm.judged(once, labels.limit(0)).collect()}
    assert untrained[5] and not untrained[21]


def test_quality_tells_junk_from_clean(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_lm.judged(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", F.length("text").alias("n")), "doc_id").collect()
    clean, junk = ([r for r in got if r["quality"] == q and r["toxic"] == 0] for q in (1, 0))
    assert sum(r["kept"] for r in clean) / len(clean) > 0.99 and sum(r["kept"] for r in junk) / len(junk) < 0.15


def brute_base(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = collections.defaultdict(list)
    for i in range(len(words) - 4):
        wins[tuple(words[i : i + 5])].append(i)
    repeat = {i + k for at in wins.values() if len(at) > 1 for i in at for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeat)


def test_base_rules_are_those_of_brute_force(spark):
    odd = [None, "", " ", "a b c d", "a b c d e", "a b c d e " * 3, "x\n\nx\n \nx", "über\x0bdie\x0cBrücke | # 😀", "w " * 5000, "a b c d", "a b c d e f g a b c d e"]
    rows = [(i, t, "en") for i, t in enumerate(odd)] + [(i, t, "en") for i, t in enumerate(odd)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("t", F.lit("clash"))
    got = divergence_rules.judged(docs.unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id") + 1000, "text", "lang", F.lit("x").alias("t")).toDF("doc_id", "text", "lang", "t")))
    texts = dict(enumerate(odd)) | {r["doc_id"] + 1000: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    seen = 0
    for r in got.collect():
        n, chars, symbols, dup, rep = brute_base(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, rep), r["doc_id"]
        assert r["base_failed"] == (n < 10 or 100 * rep > 20 * n) and not (r["base_failed"] and r["kept"])
        seen += 1
    assert seen == 2 * len(odd) + 200
    assert divergence_rules.judged(docs.limit(0)).count() == 0


def test_rules_keep_clean_text(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = divergence_rules.judged(docs).join(labels, "doc_id").filter("not base_failed").collect()
    clean = [r["kept"] for r in got if r["quality"] == 1]
    assert sum(clean) / len(clean) > 0.99 and sum(r["kept"] for r in got if r["quality"] == 0) < 0.7 * sum(r["quality"] == 0 for r in got)


def test_common_words_are_learnt_for_any_language(spark):
    import random

    r = random.Random(6)
    common, rare = [f"k{c}" for c in "abcdefgh"], [c * 3 + d for c in "mnopqrst" for d in "uvwxyz"]
    text = lambda: " ".join(r.choice(common) if r.random() < 0.7 else r.choice(rare) for _ in range(200))
    rows = [(i, text(), "xx") for i in range(60)] + [(100, " ".join(r.choice(rare) for _ in range(200)), "xx"), (101, " ".join(r.choice(rare) for _ in range(200)), None), (102, text(), "yy")]
    got = {x["doc_id"]: x for x in divergence_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["kept"] for i in range(60)) and not got[100]["kept"] and not got[100]["base_failed"]
    assert got[101]["kept"] and got[101]["word_distance"] is None and got[102]["kept"] and got[102]["word_distance"] == 0.0


def test_licences_by_canonical_digest(spark):
    mit = "The MIT Licence (MIT)\n\nCopyright (c) 2019 Some One\n\n" + licenses.MIT_GRANT.upper().replace("\n\n", "\n   ")
    rows = [(1, mit), (2, "prose\nReleased under the M.I.T. license\nlicensed under the apache licence, version 2.0"), (3, licenses.MIT_GRANT + " And more."), (4, None), (5, ""), (6, "--"), (1, mit)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("clash"))
    got = licenses.scan(docs).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 7 and by[1]["license_id"] == "MIT" and by[3]["license_id"] is None
    assert by[2]["license_id"] is None and by[2]["notices"] == "Apache-2.0"
    assert by[4]["digest"] == by[5]["digest"] == by[6]["digest"] and by[4]["license_id"] is None
    assert licenses.scan(docs.limit(0)).count() == 0


def test_whole_licence_texts_and_further_ones(spark):
    texts = dict(reversed(licenses.whole_texts()))
    assert {"Apache-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0", "Unlicense"} <= texts.keys()
    apache = texts["Apache-2.0"]
    cut = apache[: apache.index("APPENDIX")]
    rows = [(1, apache), (2, cut), (3, texts["GPL-3.0"].upper().replace("\n", "\r\n ")), (4, apache + " More."), (5, "House terms, 1st edition."), (6, "x\nHouse licence"), (7, "")]
    rows += [(10 + i, t) for i, t in enumerate(texts.values())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    further = spark.createDataFrame([("House", "HOUSE TERMS 1st edition"), ("House", "house license"), ("None", ""), ("None", None)], "license_id string, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs, further=further).collect()}
    assert [got[i]["license_id"] for i in range(1, 8)] == ["Apache-2.0", "Apache-2.0", "GPL-3.0", None, "House", None, None]
    assert got[6]["notices"] == "House" and [got[10 + i]["license_id"] for i in range(len(texts))] == list(texts)
    assert licenses.scan(docs).filter("license_id = 'House'").isEmpty()


def test_trust_spreads_over_links(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">l</a>' for h in hosts)
    rows = [
        (1, "http://Good.Org/a?q", link("news.net", "NEWS.net")),
        (2, "https://news.net/p", link("far.net")),
        (3, "http://far.net", None),
        (4, "http://spam.net/p", link("bad.com")),
        (5, "http://bad.com/de/1", "<a href='/self'>"),
        (6, None, ""),
        (7, "no scheme", link("news.net")),
        (8, "http://a.example.org/en/17", ""),
        (8, "http://a.example.org/en/17", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: r for r in link_trust.judged(pages).collect()}
    assert [(got[i]["host"], got[i]["path"]) for i in (1, 3, 6, 7)] == [("good.org", "/a"), ("far.net", ""), ("", ""), ("", "")]
    assert [got[i]["rule"] for i in (1, 2, 5, 8)] == ["org/", None, "com/de/", "example.org/en/1"]
    assert [got[i]["verdict"] for i in range(1, 9)] == ["allow", "allow", "allow", "block", "block", "allow", "allow", "block"]

    def rank(edges, seeds, d=link_trust.DAMPING):
        now = {h: s * (1 - d) for h, s in seeds.items()}
        for _ in range(link_trust.ROUNDS):
            nxt = {h: s * (1 - d) for h, s in seeds.items()}
            for (a, b), share in edges.items():
                nxt[b] = nxt.get(b, 0) + now.get(a, 0) * share * d
            now = nxt
        return now

    trust = rank({("good.org", "news.net"): 1.0, ("news.net", "far.net"): 1.0}, {"good.org": 1.0})
    distrust = rank({("bad.com", "spam.net"): 1.0}, {"bad.com": 1 / 3, "a.example.org": 2 / 3})
    for i in (1, 2, 3, 4, 5):
        assert got[i]["trust"] == pytest.approx(trust.get(got[i]["host"], 0)) and got[i]["distrust"] == pytest.approx(distrust.get(got[i]["host"], 0))
    assert link_trust.judged(pages.limit(0)).count() == 0


def test_distrust_reaches_hosts_far_upstream(spark):
    hosts = [f"h{i}.net" for i in range(20)] + ["bad.com"]
    rows = [(i, f"http://{a}/p", f'<a href="https://{b}/x">l</a>') for i, (a, b) in enumerate(zip(hosts, hosts[1:]))] + [(20, "http://bad.com/de/1", ""), (21, "http://apart.net/", "")]
    got = {r["page_id"]: r for r in link_trust.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i]["verdict"] for i in range(22)] == ["block"] * 21 + ["allow"]
    assert all(got[i]["distrust"] == pytest.approx((1 - link_trust.DAMPING) * link_trust.DAMPING ** (20 - i)) for i in range(21))


def test_posteriors_are_those_of_all_label_paths():
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    states = 3
    model = crf_langid.Model(["a", "b", "c"], *(np.zeros((states, 1), np.float32) for _ in range(3)), rng.normal(size=states), rng.normal(size=(states, states)))
    lengths = [1, 2, 5, 0, 7]
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    scores = rng.normal(size=(bounds[-1], states)).astype(np.float32)
    got = crf_langid.posteriors(model, scores, bounds)
    for a, z in zip(bounds[:-1], bounds[1:], strict=True):
        want, total = np.zeros((z - a, states)), 0.0
        for path in itertools.product(range(states), repeat=int(z - a)):
            if path:
                weight = np.exp(model.start[path[0]] + sum(scores[a + t, k] for t, k in enumerate(path)) + sum(model.step[i, j] for i, j in itertools.pairwise(path)))
                total += weight
                for t, k in enumerate(path):
                    want[t, k] += weight
        if z > a:
            assert np.allclose(got[a:z], want / total, atol=1e-4)


def test_the_sample_has_its_bound_of_rows(spark):
    """One id that is repeated, equal and different rows of it, and too many labels."""
    a, b = [i for i in range(20) if zlib.crc32(str(i).encode()) % 3 != 1][:2]
    rows = [(a, f"word{i} text of one id", "en") for i in range(600)] + [(a, "the same row", "en")] * 600 + [(b, "un texte", "fr"), (None, "no id", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts, labels = crf_langid.training_sample(docs, crf_langid.Sampling(docs_per_language=50))
    assert labels.count("en") <= 50 and len(set(texts)) == len(texts) and labels.count("fr") == 1 and "en" in labels
    with pytest.raises(ValueError):
        crf_langid.training_sample(docs, crf_langid.Sampling(most_languages=1))
