"""WARC archives, near duplicates, decontamination, the pipeline."""

import gzip
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mosaiq.llm import bpe_codec, components, latent_decontam, prob_minhash, quality_lm, warc, wordhash
from mosaiq.llm.common import shared_dir
from mosaiq.llm.queries import byte_vocabulary


def test_archives_give_back_every_payload(spark):
    body = "".join(chr(random.Random(1).randint(32, 0x2FFF)) for _ in range(3000)) + "\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "http://a/", "same"), (2, "http://b/", "same"), (3, "http://c/", body * 9), (4, None, None), (5, "x\r\ny", ""), (6, "http://d/", body), (6, "http://d/", body), (None, "http://e/", "lost id"), (7, "http://f/", "0\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit("clash"))
    path = shared_dir(spark)
    warc.write(pages, path, warc.Layout(segment_bytes=1000, chunk_bytes=77, records_per_file=3))
    got = warc.read(spark, path).collect()
    assert len(got) == len(rows) and all(r["problem"] is None for r in got)
    by = {r["page_id"]: r for r in got if r["page_id"] != "6"}
    assert (by["1"]["record_type"], by["1"]["refers_to"]) == ("revisit", "2") and by["2"]["record_type"] == "response"
    assert (by["4"]["record_type"], by["4"]["refers_to"], by["4"]["payload_bytes"]) == ("revisit", "5", 0)
    assert sorted(r["record_type"] for r in got if r["page_id"] == "6") == ["response", "revisit"]
    assert by["3"]["payload"].decode() == body * 9 and by["3"]["n_segments"] > 9
    for i, _, html in rows:
        raw = (html or "").encode()
        for r in (r for r in got if r["page_id"] == (None if i is None else str(i))):
            assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), warc.digest(raw))
    warc.write(pages.limit(0), path + "-none")
    assert warc.read(spark, path + "-none").count() == 0


def test_damage_is_told(spark, tmp_path):
    layout = warc.Layout(segment_bytes=200, chunk_bytes=50)
    whole = list(warc.records("1", 0, "http://a/", b"z" * 700, None, layout))
    end = b"\r\n\r\n"
    for name, kept, says in (("gap", whole[:1] + whole[2:], "missing"), ("cut", whole[:-1], "last segment"), ("bad", [whole[0].replace(b"zzz", b"zzy", 1), *whole[1:]], "digest")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc.gz").write_bytes(gzip.compress(b"".join(r + end for r in kept)))
        assert says in warc.read(spark, str(tmp_path / name)).first()["problem"]
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")
    assert warc.dechunked(warc.chunked(b"", 7)) == b""


def test_archives_of_others_are_read(spark, tmp_path):
    """Other identifiers, records without a payload, a member for each record, and damage in the middle."""
    end, page = b"\r\n\r\n", b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"

    def record(kind, name, block, **fields):
        head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{name}>"} | {k.replace("_", "-"): v for k, v in fields.items()} | {"Content-Length": str(len(block))}
        return b"WARC/1.0\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items()) + b"\r\n" + block + end

    whole = page + b"<p>first half, second half"
    records = [
        record("warcinfo", "0", b"software: other"),
        record("request", "1", b"GET / HTTP/1.1\r\n\r\n"),
        record("response", "a-b:c", page + b"<html>one", WARC_Payload_Digest="sha1:" + warc.digest(b"<html>one")),
        record("response", "long", whole[:60], WARC_Segment_Number="1"),
        record("continuation", "long-2", whole[60:], WARC_Segment_Number="2", WARC_Segment_Origin_ID="<urn:uuid:long>", WARC_Segment_Total_Length=str(len(whole))),
        record("response", "md5", page + b"two", WARC_Payload_Digest="md5:xyz"),
        record("revisit", "again", b"", WARC_Refers_To="<urn:uuid:md5>"),
    ]
    for name, content in (("plain", b"".join(records)), ("members", b"".join(map(gzip.compress, records)))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_bytes(content)
        got = {r["record_id"]: r for r in warc.read(spark, str(tmp_path / name)).collect()}
        assert set(got) == {"urn:uuid:a-b:c", "urn:uuid:long", "urn:uuid:md5", "urn:uuid:again"} and not any(r["problem"] for r in got.values())
        assert got["urn:uuid:a-b:c"]["payload"] == b"<html>one" and got["urn:uuid:long"]["payload"] == whole[len(page) :] and got["urn:uuid:long"]["n_segments"] == 2
        assert got["urn:uuid:again"]["refers_to"] == "urn:uuid:md5" and got["urn:uuid:md5"]["page_id"] is None
    hurt = list(records)
    hurt[2] = hurt[2].replace(b"Content-Length: ", b"Content-Length: 9")
    members = [gzip.compress(r) for r in records]
    members[2] = members[2][:25] + b"\0\0\0\0\0\0" + members[2][31:]
    for name, content in (("hurt", b"".join(hurt)), ("hurt-members", b"".join(members))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_bytes(content)
        rows = warc.read(spark, str(tmp_path / name)).collect()
        assert {r["record_id"] for r in rows if not r["problem"]} == {"urn:uuid:long", "urn:uuid:md5", "urn:uuid:again"} and any(r["problem"] for r in rows)
    named = spark.createDataFrame([("a:b", "u", "x" * 50), ("a:b:7", "u", "x" * 50), ("c", None, "y")], "page_id string, url string, html string")
    warc.write(named, str(tmp_path / "named"))
    got = {r["page_id"]: r for r in warc.read(spark, str(tmp_path / "named")).collect()}
    assert set(got) == {"a:b", "a:b:7", "c"} and got["a:b"]["refers_to"] == "a:b:7"


def near_copies(n_groups=12, seed=3):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(3000)]
    rows, at = [], 0
    for _ in range(n_groups):
        base = [r.choice(words) for _ in range(r.randint(40, 300))]
        for _ in range(r.randint(1, 6)):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((at, " ".join(copy)))
            at += 1
    return rows


def brute_classes(rows, threshold=0.8):
    def shingles(t):
        w = (t or "").split()
        out = {}
        for s in [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else []):
            out[s] = out.get(s, 0) + 1
        return out

    def j(a, b):
        if not a or not b:
            return 0.0
        union = a.keys() | b.keys()
        return sum(1 / sum(max(a.get(k, 0) / a[i], b.get(k, 0) / b[i]) for k in union) for i in a.keys() & b.keys())

    sets, parent = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and j(sets[a], sets[b]) >= threshold - 1e-9:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_classes_are_those_of_all_pairs(spark):
    rows = near_copies() + [(900, "short text"), (901, "short  text"), (902, "other text"), (903, ""), (904, ""), (905, None), (906, "a b " * 300), (907, "a b " * 310)]
    docs = spark.createDataFrame([*rows, (900, "short text"), (None, "no id")], "doc_id long, text string").withColumns({"u": F.lit(1), "bucket": F.lit("clash")})
    got = {r["doc_id"]: r["class_id"] for r in prob_minhash.classes(docs.repartition(3)).collect()}
    assert got == brute_classes(rows)
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in prob_minhash.deduplicate(docs).collect())
    assert kept == sorted([(False, i) for i, c in brute_classes(rows).items() if i == c] + [(True, 0)])
    assert prob_minhash.deduplicate(docs).columns == docs.columns
    assert prob_minhash.classes(docs.limit(0)).count() == 0


def test_every_link_of_a_crowded_bucket_is_found(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    texts = [[word() for _ in range(100)] for _ in range(20)]
    for _ in range(3):  # copies of copies: only neighbours in this order are linked
        drift = [word() for _ in range(100)]
        for k in range(8):
            texts.append(list(drift))
            for at in (5 + 12 * k, 11 + 12 * k):
                drift[at] = word()
    rows = list(enumerate(" ".join(t) for t in texts[:1] + r.sample(texts[1:], len(texts) - 1)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    parts = prob_minhash.linked_parts(docs.select("doc_id", F.array(F.lit(1).cast("long")).alias("bands")), docs, 0.8)
    got = {i: i for i, _ in rows} | {r["node"]: r["component"] for r in parts.collect()}
    assert got == brute_classes(rows)
    assert len(set(got.values())) == 23


def _classes_by_all_pairs(texts):
    """The least index of each text's class, by comparing all pairs."""
    shingles = []
    for t in texts:
        data, offsets = wordhash.buffers(pa.array([t], pa.string()))
        hashes, _, weights = prob_minhash.weighted_shingles(data, offsets)
        shingles.append((hashes, weights))
    found = list(range(len(texts)))

    def root(i):
        while found[i] != i:
            i = found[i]
        return i

    links = 0
    for i in range(len(texts)):
        for j in range(i):
            if len(shingles[i][0]) and len(shingles[j][0]) and prob_minhash.similarity(shingles[i], shingles[j]) >= 0.8 - 1e-9:
                a, b = sorted((root(i), root(j)))
                found[b], links = a, links + 1
    return [root(i) for i in range(len(texts))], links


def test_pairs_inside_a_crowd_of_like_texts_are_all_found(spark):
    """150 pairs at about 0.82 whose members are about 0.75 from everything else, in one bucket with one leader."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(400)]
    texts = [" ".join(base)]
    for k in range(150):
        one = list(base)
        for place in rng.sample(range(0, 395, 6), 8):
            one[place] = f"x{k}_{place}"
        other = list(one)
        for place in rng.sample(range(3, 395, 6), 7):
            other[place] = f"y{k}_{place}"
        texts += [" ".join(one), " ".join(other)]
    want, links = _classes_by_all_pairs(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    parts = prob_minhash.linked_parts(docs.select("doc_id", F.array(F.lit(1).cast("long")).alias("bands")), docs, 0.8)
    got = {r["node"]: r["component"] for r in parts.collect()}
    assert links >= 150
    assert [got.get(i, i) for i in range(len(texts))] == want


def test_changes_rule_out_no_link(spark):
    """Repeated words, so that weights differ, and texts near and far from the leader."""
    rng = random.Random(8)
    texts = []
    for _ in range(6):
        base = [rng.choice(["a", "b", "c", f"w{rng.randrange(60)}"]) for _ in range(60)]
        for _ in range(14):
            own = list(base)
            for _ in range(rng.randrange(0, 5)):
                own[rng.randrange(60)] = rng.choice(["a", "b", f"w{rng.randrange(60)}"])
            texts.append(" ".join(own * rng.choice([1, 1, 1, 2])))
    texts = sorted(set(texts))
    want, _ = _classes_by_all_pairs(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    parts = prob_minhash.linked_parts(docs.select("doc_id", F.array(F.lit(1).cast("long")).alias("bands")), docs, 0.8)
    got = {r["node"]: r["component"] for r in parts.collect()}
    assert [got.get(i, i) for i in range(len(texts))] == want


def test_rows_of_one_id_are_one_document(spark):
    long = " ".join(f"l{i % 5000}" for i in range(60_000))
    rows = [(1, "b " * 20), (1, "a " * 20), (1, None), (2, "a " * 20), (3, long), (4, long + " end"), (None, "a a")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r["doc_id"]: r["class_id"] for r in prob_minhash.classes(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3}
    kept = prob_minhash.deduplicate(docs).collect()
    assert sorted((r["doc_id"] or 0, len(r["text"])) for r in kept) == [(0, 3), (1, 40), (3, len(long))]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(200, 200)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


def test_leaks_are_found_and_clean_text_left_alone(spark):
    r = random.Random(8)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(4000)]
    text = lambda n: [r.choice(words) for _ in range(n)]
    items = [text(n) for n in (12, 18, 25, 33, 48, 60)]
    rows = [(i, " ".join(text(r.randint(5, 400)))) for i in range(60)]
    wanted = set()
    for i, item in enumerate(items):
        copy = list(item)
        if i >= 2:  # a paraphrase: some words differ
            for k in r.sample(range(len(copy)), len(copy) // 6):
                copy[k] = r.choice(words)
        a, b = text(r.randint(0, 200)), text(r.randint(0, 200))
        rows.append((100 + i, ". ".join([" ".join(a), " ".join(copy).title(), " ".join(b)])))
        wanted.add((100 + i, i))
    rows += [(200, None), (201, ""), (None, " ".join(items[0])), (100, rows[60][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(50, None), (51, ""), (None, "x")], "item_id long, text string")
    got = latent_decontam.leaks(docs, bench).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == wanted and len(got) == len(wanted) + 1
    kept = {x["doc_id"] for x in latent_decontam.decontaminate(docs, bench).collect()}
    assert kept == {i for i, _ in rows} - {d for d, _ in wanted}
    assert latent_decontam.leaks(docs.limit(0), bench).count() == 0 and latent_decontam.leaks(docs, bench.limit(0)).count() == 0


def test_the_latent_space_is_that_of_all_passages_of_all_documents(spark):
    r, ld = random.Random(11), latent_decontam
    topics = [[f"t{k}w{i}" for i in range(40)] for k in range(5)]
    share = (30, 16, 8, 4, 2)  # uneven, so that the leading directions are far apart
    about = r.choices(range(5), share, k=1500)
    rows = [(i, " ".join(r.choice(topics[r.choice((k, k, k, 0))]) for _ in range(r.choice((3, 30, 200))))) for i, k in enumerate(about)]
    rows += [(2000 + i, " ".join([r.choice(topics[0]) for _ in range(300)] + [f"last{i}" for _ in range(60)])) for i in range(3)] + [(3000, None), (3001, " ")]
    items = [" ".join(r.choice(topics[k]) for _ in range(50)) for k in range(5)]
    settings = ld.Settings(rank=3, oversample=1000)  # as many directions as there are words: an exact decomposition
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    (index,) = ld.build_indexes(docs.repartition(3), bench, settings)

    def hashed(text):
        return ld.buckets(ld.text_words(*wordhash.buffers(pa.array([text]))).hashes)

    held = [hashed(t) for _, t in rows if t and t.strip()]
    frequencies = np.bincount(np.concatenate([np.unique(x) for x in held]), minlength=ld.BUCKETS)
    weights = ld.idf(frequencies, len(held))
    assert np.allclose(index.weights, weights)
    known = np.unique(np.concatenate([*held, *map(hashed, items)]))
    assert (index.at[known] < len(index.terms) - 1).all()  # no word of any document is outside the space
    lines = [hashed(t) for t in items]
    for x in held:
        n = -(-len(x) // 40)
        lines += [x[[j * n // len(x) == k for j in range(len(x))]] for k in range(n)]
    matrix = np.array([np.bincount(np.searchsorted(known, x), minlength=len(known)) * weights[known] for x in lines])
    wanted = np.linalg.svd(matrix / np.linalg.norm(matrix, axis=1)[:, None], full_matrices=False)[2][:3]
    got = index.terms[index.at[known]] / weights[known, None]
    assert np.linalg.norm(wanted @ got, 2) < 1.001 and np.linalg.svd(wanted @ got, compute_uv=False).min() > 0.999


def test_the_driver_holds_one_matrix_of_the_latent_space(spark):
    r, ld = random.Random(12), latent_decontam
    rows = [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(400))) for i in range(250)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, rows[0][1][:200])], "item_id long, text string")
    tracemalloc.start()
    basis, weights = ld.fitted(docs.select("text"), bench)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    settings, known = ld.Settings(), int(basis.any(axis=1).sum())
    matrix = known * (settings.rank + settings.oversample) * 4
    assert known > 45_000 and most < basis.nbytes + 1.5 * matrix


def windows_of(bounds, size):
    """Rows and first words of windows of ``size`` words, a quarter apart; the last of a row ends with it."""
    stride, words = max(1, size // 4), np.diff(bounds)
    n = np.where(words > 0, 1 + np.maximum(0, -(-(words - size) // stride)), 0)
    row = np.repeat(np.arange(len(words)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, bounds[row] + np.minimum(step * stride, np.maximum(0, words[row] - size))


def test_leaks_among_few_or_equal_documents_and_frequent_words(spark):
    r = random.Random(7)
    item = " ".join(f"w{i}" for i in range(30))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    alone = spark.createDataFrame([(5, item)], "doc_id long, text string")
    assert [x["item_id"] for x in latent_decontam.leaks(alone, bench).collect()] == [1]
    everywhere = spark.createDataFrame([(i, " ".join(f"v{r.randrange(9999)}" for _ in range(60)) + " " + item) for i in range(50)], "doc_id long, text string")
    assert latent_decontam.leaks(everywhere, bench).count() == 50
    common = [f"c{i}" for i in range(40)]
    frequent = " ".join(r.choice(common) for _ in range(25))
    bench = spark.createDataFrame([(2, frequent)], "item_id long, text string")
    rare = lambda: " ".join(f"r{r.randrange(10**6)}" for _ in range(20))
    rows = [(i, f"{rare()} {frequent} {rare()}") for i in range(50)] + [(100 + i, " ".join(common)) for i in range(200)]
    rows.append((999, " ".join(rare() for _ in range(5000)) + " " + frequent))  # a very long one
    got = {x["doc_id"] for x in latent_decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {*range(50), 999}


def test_items_in_blocks_are_found_as_at_once(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i + k}" for k in range(40))) for i in range(0, 300, 10)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(f"w{i + k}" for k in range(5, 25))) for i in range(0, 300, 30)], "item_id long, text string")
    got = [{(x["doc_id"], x["item_id"]) for x in latent_decontam.leaks(docs, bench, latent_decontam.Settings(block_items=n)).collect()} for n in (3, 1000)]
    assert got[0] == got[1] and {(i, i) for i in range(0, 300, 30)} <= got[0]


def test_paraphrases_are_found_as_far_as_the_confirmation_reaches():

    r, ld, settings = random.Random(5), latent_decontam, latent_decontam.Settings()
    words = ["".join(r.choice("abcdefgh") for _ in range(7)) for _ in range(6000)]
    items = [[r.choice(words) for _ in range(n)] for n in range(9, 60, 2)]
    texts = []
    for i in range(len(items) * 3):
        copy, n = list(items[i // 3]), len(items[i // 3])
        for k in r.sample(range(max(1, n - 8)), min(max(1, n - 8), int(n * (0.3, 0.4, 0.5)[i % 3]))):
            copy[k] = r.choice(words)
        texts.append(" ".join([r.choice(words) for _ in range(r.randint(0, 300))] + copy + [r.choice(words) for _ in range(r.randint(0, 300))]))
    hashed = lambda ts: ld.text_words(*ld.wordhash.buffers(pa.array(ts)))
    held, found = hashed([" ".join(x) for x in items]), hashed(texts)
    held = [held.hashes[a:z] for a, z in zip(held.bounds[:-1], held.bounds[1:], strict=True)]
    basis = np.random.default_rng(1).standard_normal((ld.BUCKETS, 64)) / 8
    index = ld.indexed(basis, np.ones(ld.BUCKETS), list(range(len(items))), held)
    wanted = {}
    for i, w in enumerate(held):  # every window against every item of its size
        item, size = ld.prepared(w, settings), int(index.window[i])
        for row, start in zip(*(x.tolist() for x in windows_of(found.bounds, size)), strict=True):
            low, high = max(found.bounds[row], start - size // 4), min(found.bounds[row + 1], start + size + size // 4)
            if share := ld.confirm(item, found.hashes[low:high].tolist(), settings):
                wanted[row, i] = max(share, wanted.get((row, i), 0))
    got = ld.search(*ld.wordhash.buffers(pa.array(texts)), index, settings)
    assert {k: v[1] for k, v in got.items()} == wanted and len(wanted) > 50


def test_only_windows_that_can_be_confirmed_are_candidates():
    r, ld, settings = random.Random(6), latent_decontam, latent_decontam.Settings()
    words = [f"w{i}" for i in range(400)]
    items = [r.sample(words, 40) for _ in range(30)] + [r.choices(words[:12], k=40) for _ in range(10)]  # the last with repeated words
    texts = [" ".join(["x"] * 30 + (item[:24] if few else item[:16] + item[-8:]) + ["y"] * 30) for item in items for few in (True, False)]
    hashed = lambda ts: ld.text_words(*ld.wordhash.buffers(pa.array(ts)))
    held, found = hashed([" ".join(x) for x in items]), hashed(texts)
    held = [held.hashes[a:z] for a, z in zip(held.bounds[:-1], held.bounds[1:], strict=True)]
    index = ld.indexed(np.ones((ld.BUCKETS, 2)), np.ones(ld.BUCKETS), list(range(len(items))), held)
    got, wanted = set(), set()
    for _, rows, _, able in ld.rare_windows(found, index):
        got |= set(zip(rows.tolist(), able.tolist(), strict=True))
    for row in range(len(texts)):
        there = set(found.hashes[found.bounds[row] : found.bounds[row + 1]].tolist())
        for i, w in enumerate(held):
            all_words, answer = (np.isin(x, list(there)).sum() for x in (w, w[-settings.answer_words :]))
            if all_words >= settings.common * len(w) or all_words >= settings.common_with_answer * len(w) and answer >= settings.answer_share * settings.answer_words:
                wanted.add((row, i))
    # 24 of 40 words without the answer confirm nothing, and with it they do
    assert got == wanted and {(2 * i + 1, i) for i in range(30)} == {(row, i) for row, i in got if row < 60}


def test_words_of_texts_are_told_apart():
    r = random.Random(9)
    letters = "abzABZ09\u00e9\u00c9\u00d7\u4e2d"
    words = ["".join(r.choice(letters) for _ in range(r.choice((1, 2, 7, 8, 9, 16, 17, 30, 33, 200)))) for _ in range(500)]
    words += [w[:-1] + r.choice(letters) for w in words]
    lower = lambda w: "".join(c.lower() if ord(c) < 256 else c for c in w)
    texts = [" -".join(words[a : a + 7]) for a in range(0, 1000, 7)] + ["", None, ".", "ab"]
    found = latent_decontam.text_words(*wordhash.buffers(pa.array(texts)))
    wanted = [lower(w) for w in words] + ["ab"]
    assert found.row.tolist() == [i // 7 for i in range(1000)] + [len(texts) - 1]
    assert found.length.tolist() == [len(w.encode()) for w in wanted]
    assert len(set(found.hashes.tolist())) == len(set(wanted)) == len(set(zip(found.hashes.tolist(), wanted, strict=True)))
    assert not len(latent_decontam.text_words(*wordhash.buffers(pa.array([None], pa.string()))).hashes)


def test_only_rare_words_that_stand_together_are_looked_at():
    r = np.random.default_rng(3)
    least, reach = r.integers(1, 6, 12), r.integers(3, 40, 12)
    for n in (0, 1, 40, 600):
        hits = np.unique(np.stack([r.integers(0, 2000, n), r.integers(0, 12, n)], axis=1), axis=0)  # of places and items
        place, item = hits[:, 0], hits[:, 1]
        row = place // 150
        wanted = []
        for k in range(len(place)):
            own = np.flatnonzero((item == item[k]) & (row == row[k]))
            near = [own[(place[own] >= place[a]) & (place[own] < place[a] + reach[item[k]])] for a in own]
            wanted.append(any(k in x and len(x) >= least[item[k]] for x in near))
        got = latent_decontam.together(place, row, item, least, reach)
        assert sorted(got.tolist()) == np.flatnonzero(wanted).tolist()
    assert 0 < len(got) < len(place)


def test_longest_common_subsequence():
    r = random.Random(2)
    for _ in range(50):
        a, b = ([r.randint(0, 5) for _ in range(r.randint(1, 40))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    
        assert latent_decontam.common_subsequence(latent_decontam.masks(np.array(a)), len(a), b) == table[-1][-1]


def test_pipeline_is_its_stages_one_after_another(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    columns, at = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, at, sf)
        assert after.columns == columns, name
        before, now = {r["doc_id"] for r in at.collect()}, {r["doc_id"] for r in after.collect()}
        assert now <= before
        if name == "quality":
            labels = spark.read.parquet(f"{sf}/labels.parquet")
            assert now == {r["doc_id"] for r in quality_lm.judged(at, labels).filter("kept").collect()}
        if name == "near_duplicates":
            classes = brute_classes([(i, texts[i]) for i in sorted(before)])
            assert now == {i for i, c in classes.items() if i == c}
        if name == "decontamination":
            bench = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert not any(b in texts[i] for i in now for b in bench)
        at = after
    got = corpus_pipeline.run(spark, sf).collect()
    wanted = bpe_codec.digests(at, byte_vocabulary()).collect()
    assert sorted(got) == sorted(wanted)


def test_pipeline_fits_its_latent_space_on_all_words_of_its_documents(spark, monkeypatch):
    sf, made, indexed = "/root/testdata/sf0.001", [], latent_decontam.indexed
    monkeypatch.setattr(latent_decontam, "indexed", lambda *a: made.append(indexed(*a)) or made[-1])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    corpus_pipeline.decontamination(spark, docs, sf)
    found = latent_decontam.text_words(*wordhash.buffers(pa.array([r["text"] for r in docs.collect()], pa.string())))
    (index,) = made
    assert (index.at[latent_decontam.buckets(found.hashes)] < len(index.terms) - 1).all()


def test_stages_have_defined_rows_for_odd_input(spark):
    """Null and repeated ids, null and blank texts, equal rows and a column with a clashing name."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("kept", F.lit("x")).withColumn("_0", F.lit(7))
    clean = docs.filter("lang is not null and length(text) > 300").orderBy("doc_id").limit(3)
    first = clean.first()
    same = spark.createDataFrame([(first["doc_id"], " \n", "en", "s", 2, "x", 7), (first["doc_id"], None, None, None, None, "x", 7)], docs.schema)
    nameless = clean.withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType))
    odd = docs.unionByName(nameless).unionByName(nameless).unionByName(same).select(docs.columns)
    stages = dict(corpus_pipeline.STAGES)
    sf = "/root/testdata/sf0.001"
    for name in ("language", "quality"):
        kept = stages[name](spark, odd, sf)
        assert kept.columns == docs.columns
        rows = kept.filter("doc_id is null").count()
        plain = stages[name](spark, docs, sf).join(clean.select("doc_id"), "doc_id", "left_semi").count()
        assert rows == 2 * plain  # as their namesakes with an id
        assert kept.filter(F.col("text").isNull() | (F.trim(F.regexp_replace("text", "\\s", "")) == "")).count() == 0
    kept = stages["near_duplicates"](spark, odd, sf)
    assert kept.filter("doc_id is null").count() == 6 and kept.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").count() == 0
    assert stages["decontamination"](spark, odd, sf).filter("doc_id is null").count() == 6
    assert stages["encoding"](spark, odd, sf).count() == odd.count()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
