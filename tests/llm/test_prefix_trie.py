"""The trie of conversations, against whole sequences compared in plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from mosaiq.llm import prefix_trie
from mosaiq.llm.queries import op11_prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def expected(rows, share=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256((hashlib.sha256(role.encode()).hexdigest() + text).encode()).digest()[:16]
            own[conv].append((turn is not None, turn or 0, mark, role, text))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if share else 0
        source = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(source, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in sorted(whole.items()):
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        below = [sums[c] for c in children[node]]
        words = len(node[-1][1].encode().split()) if node else 0
        sums[node] = (sum(b[0] for b in below) or 1, sum(b[1] for b in below) + (len(members[node]) - 1) * words)
    over = {n: hashlib.sha256(",".join(str(c) for c in m if whole[c] == n).encode()).hexdigest() for n, m in members.items()}
    return sorted((m[0], len(n), members[n[:-1]][0] if n else None, len(m), len(children[n]), *sums[n], over[n]) for n, m in members.items())


def conversations(r, n, longest):
    """Some share beginnings beyond their families, some are copies, some have many turns."""
    rows, texts = [], ["", None, "a", "a b", "a\tb  c é", "x y z", "the same beginning of many"]
    for c in range(-3, n):
        kind = r.random()
        length = r.randint(1, longest) if kind < 0.1 else r.randint(1, 7)
        for t in range(length):
            text = texts[-1] if t < 2 and kind > 0.6 else "z" if kind < 0.1 and t < longest - 3 else r.choice(texts)
            rows.append((c * (1 if kind < 0.9 else 3), r.choice([t, t, t, None]), r.choice(["user", None, "assistant"]) if t > 3 else "user", text))
    return rows + [(None, 0, "user", "x"), (None, None, None, None)] + rows[:2]


def put(spark, rows, folder):
    made = [(*x, i) for i, x in enumerate(rows)]
    spark.createDataFrame(made, "conv_id long, turn int, role string, text string, depth int").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def got(df):
    assert sorted(df.columns) == sorted(COLUMNS)
    return sorted(tuple(x[c] for c in COLUMNS) for x in df.collect())


@pytest.mark.parametrize(("block", "hot", "n", "longest"), [(4096, 1000, 150, 30), (4, 3, 60, 90)])
def test_query_equals_whole_sequences(spark, tmp_path, monkeypatch, block, hot, n, longest):
    """Also where conversations and paths take many blocks, and where most nodes meet by hash."""
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "HOT", hot)
    rows = conversations(random.Random(n), n, longest)
    assert got(op11_prefix_trie(spark, put(spark, rows, tmp_path))) == expected(rows)


def test_conversations_as_they_are(spark, tmp_path):
    rows = conversations(random.Random(9), 40, 9)
    read = spark.read.parquet(put(spark, rows, tmp_path) + "/conversations.parquet")
    assert got(prefix_trie.trie(prefix_trie.with_roots(prefix_trie.turns(read)))) == expected(rows, share=False)


def test_turnless_and_none(spark, tmp_path):
    rows = [(c, 0, "user", "hello there") for c in range(21, 40)]  # without 20, those with h >= 1 have no turn left
    assert got(op11_prefix_trie(spark, put(spark, rows, tmp_path / "a"))) == expected(rows)
    assert got(op11_prefix_trie(spark, put(spark, [], tmp_path / "b"))) == []
    assert got(op11_prefix_trie(spark, put(spark, [(None, 0, "user", "x")], tmp_path / "c"))) == []
