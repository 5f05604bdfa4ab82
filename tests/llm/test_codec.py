"""Byte-pair encoding, token counts."""

import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mosaiq.llm import bpe, bpe_codec, token_counts, wordhash
from mosaiq.llm.queries import byte_vocabulary

ODD = "ab the é ß\t\n\r\x0b\x0c\x1c\x1f\x85\xa0 　 1²Ⅷ٣漢字😀's'll'S!!<|endoftext|>  "


def texts():
    r = random.Random(5)
    made = ["".join(r.choice([*ODD, "<|endoftext|>"]) for _ in range(r.randint(0, 120))) for _ in range(400)]
    return [*made, "", "x" * 3000, "thethe" * 500, " " * 100, "a  b", "a <|endoftext|> b", "the cat sat. " * 2000]


@pytest.fixture(scope="module")
def known():
    return Tokenizer.from_file(byte_vocabulary())


def test_columns_encode_as_the_library_does(known):
    own, rows = bpe.Bpe(byte_vocabulary()), texts()
    for _ in range(2):  # what is new, then what is held
        got = []
        for _, _, data, offsets in wordhash.pieces(pa.array(rows), 5_000):
            ids, bounds, back, ends = own.encode_rows(data, offsets)
            got += [ids[a:z].tolist() for a, z in zip(bounds[:-1], bounds[1:])]
            assert [back[a:z].tobytes() for a, z in zip(ends[:-1], ends[1:])] == [data[a:z].tobytes() for a, z in zip(offsets[:-1], offsets[1:])]
        assert got == [e.ids for e in known.encode_batch(rows, add_special_tokens=False)]


def test_trees_merge_the_leftmost_lowest_rank():
    own = bpe.Bpe(byte_vocabulary())

    def plainly(raw):
        ids = own.first_ids[list(raw)].tolist() if raw else []
        while pairs := [(own.rank_of[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in own.rank_of]:
            rank, i = min(pairs)
            ids[i : i + 2] = [int(own.made[rank])]
        return ids

    r = random.Random(6)
    words = [bytes(r.choice(b"aethn ing") for _ in range(n)) for n in (1, 2, 3, 5, 8, 13, 33, 64, 65, 200) for _ in range(20)]
    assert own.merge_many(words) == [plainly(w) for w in words] == [own.merge_one(w) for w in words]


def test_a_shared_hash_cannot_change_a_result(monkeypatch):
    own = bpe.Bpe(byte_vocabulary())
    monkeypatch.setattr(bpe, "span_hashes", lambda data, start, length: start.astype("uint64") * 0)
    data, offsets = wordhash.buffers(pa.array(["one two", "three"]))
    ids, bounds, _, _ = own.encode_rows(data, offsets)
    assert [own.decode(ids[a:z].tolist()) for a, z in zip(bounds[:-1], bounds[1:])] == ["one two", "three"]


def test_digests(spark, known):
    rows = [(i, t) for i, t in enumerate(texts())] + [(9999, None), (3, "twice"), (3, "twice"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe_codec.digests(docs, byte_vocabulary()).collect())
    wanted = []
    for i, t in rows:
        ids = known.encode(t or "", add_special_tokens=False).ids
        wanted.append((i is None, i or 0, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(known.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(wanted)
    assert bpe_codec.digests(docs.limit(0), byte_vocabulary()).count() == 0
    back = bpe_codec.decode(bpe_codec.encode(docs.filter("doc_id < 50 and doc_id <> 3"), byte_vocabulary()), byte_vocabulary())
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: t or "" for i, t in rows if i is not None and i < 50 and i != 3}


def test_token_counts_answer_every_limit(spark, known):
    rows = [t[: 4 * i] for i, t in enumerate(texts())] + [None, "", "the cat sat. " * 900]
    docs = spark.createDataFrame([(t,) for t in rows], "text string")
    n = [len(known.encode(t or "", add_special_tokens=False).ids) for t in rows]
    got = token_counts.token_counts(docs, byte_vocabulary()).collect()
    assert {r["length"]: r["n_docs"] for r in got} == {x: n.count(x) for x in set(n)}
    for r in got:
        at = r["length"]
        assert r["docs_at_least"] == sum(x >= at for x in n) and r["tokens_at_least"] == sum(x for x in n if x >= at)
        assert r["truncated_tokens"] == sum(min(x, at) for x in n) and (r["total_docs"], r["total_tokens"]) == (len(n), sum(n))
        assert r["docs_share"] == pytest.approx(sum(x <= at for x in n) / len(n))
    hist = token_counts.histogram(token_counts.encoded_lengths(docs, byte_vocabulary()))
    assert {r["context_limit"]: r["truncated_tokens"] for r in token_counts.truncated_totals(hist, [0, 10, 5000]).collect()} == {x: sum(min(y, x) for y in n) for x in (0, 10, 5000)}
    middle = token_counts.quantiles(token_counts.suffix_sums(hist), [0.5]).first()["length"]
    assert sum(x <= middle for x in n) >= len(n) / 2 > sum(x < middle for x in n)
    assert token_counts.token_counts(docs.limit(0), byte_vocabulary()).count() == 0


def test_other_kinds_of_vocabulary_are_refused():
    plain = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, "model": {"type": "BPE"}}
    bpe.expect_byte_level(plain)
    for other in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": None}, {"pre_tokenizer": plain["pre_tokenizer"] | {"add_prefix_space": True}}, {"model": {"type": "Unigram"}}):
        with pytest.raises(ValueError):
            bpe.expect_byte_level(plain | other)
