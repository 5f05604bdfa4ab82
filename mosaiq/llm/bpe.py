"""Byte-pair encoding and decoding by a segment tree over the ranks of adjacent pairs.

The leaves of the tree are the positions of a pretoken, each with the rank of the pair that begins there
(infinite if that pair never merges).  An inner node holds the lower rank of its children, so a descent
from the root that prefers the left child at a tie finds the leftmost pair of lowest rank.  A merge changes
three leaves at most, each mended on its path to the root, until the root is infinite.

The trees of many pretokens are held as the rows of one array and take their merges together; a very long
pretoken has a tree of its own.  The vocabulary file is a parameter and is never trained.
"""

from __future__ import annotations

import functools
import json
import numpy as np
import regex

from mosaiq.llm.wordhash import span_hashes

#: How the byte-level scheme cuts a text before it merges (fixed value).
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NEVER = np.int32(2**31 - 1)
TREES_TOGETHER = 64
#: White space of one byte, and first bytes of characters of which some are white space (U+0085, U+2003 and so on).
WHITE = np.zeros(256, bool)
WHITE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
MAY_BE_WHITE = np.zeros(256, bool)
MAY_BE_WHITE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
#: So many chunks are held by a Python worker before it starts anew.
CACHED = 1_000_000


def byte_names() -> dict[int, str]:
    """The printable character by which byte-level vocabularies name each byte: itself where it prints, else
    the next free code point from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    named, free = {}, 256
    for b in range(256):
        named[b] = chr(b) if b in plain else chr(free)
        free += b not in plain
    return named


def expect_byte_level(spec: dict) -> None:
    """An error if a vocabulary file asks for other steps before the merges than those of this module."""
    cut = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") is not None or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or spec["model"].get("type", "BPE") != "BPE":
        raise ValueError("not a byte-level vocabulary without a normaliser and with the usual cuts")


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        expect_byte_level(spec)
        vocab = spec["model"]["vocab"]
        names = byte_names()
        back = {v: k for k, v in names.items()}
        self.bytes_of = {i: bytes(back[c] for c in s) for s, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.added.items()}
        self.first_ids = np.array([vocab[names[b]] for b in range(256)], np.int32)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_rank = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.rank_of = {(int(a), int(b)): r for r, (a, b) in enumerate(zip(left, right, strict=True))}
        of_byte = self.first_ids.astype(np.int64)
        self.first_ranks = self.ranks(of_byte[:, None], of_byte[None, :])
        self.cut = regex.compile(PRETOKEN)
        self.cut_added = regex.compile("|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True))) if self.added else None
        by_id = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.byte_table, self.decimal_table = laid(by_id), laid([b"%d," % i for i in range(len(by_id))])
        self.held = Held()

    # -- one pretoken -----------------------------------------------------------------------------------

    def merge_one(self, raw: bytes) -> list[int]:
        """The ids of one pretoken, by a tree of its own."""
        ids = [int(x) for x in self.first_ids[np.frombuffer(raw, np.uint8)]]
        n = len(ids)
        if n < 2:
            return ids
        size = 1 << (n - 1).bit_length()
        never, rank_of = int(NEVER), self.rank_of
        tree = [never] * (2 * size)
        for i in range(n - 1):
            tree[size + i] = rank_of.get((ids[i], ids[i + 1]), never)
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        after, before, made = [*range(1, n), -1], [*range(-1, n - 1)], self.made

        def put(leaf: int, rank: int) -> None:
            node = size + leaf
            tree[node] = rank
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        while (rank := tree[1]) != never:
            node = 1
            while node < size:
                node = 2 * node + (tree[2 * node] > tree[2 * node + 1])
            i = node - size
            j = after[i]
            ids[i], ids[j], k = int(made[rank]), -1, after[j]
            after[i] = k
            put(j, never)
            if k >= 0:
                before[k] = i
            put(i, rank_of.get((ids[i], ids[k]), never) if k >= 0 else never)
            if (p := before[i]) >= 0:
                put(p, rank_of.get((ids[p], ids[i]), never))
        return [x for x in ids if x >= 0]

    # -- many pretokens together ------------------------------------------------------------------------

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], NEVER)

    def merge_many(self, raws: list[bytes]) -> list[list[int]]:
        """The ids of pretokens of any length; those of at most TREES_TOGETHER bytes share arrays of trees."""
        out: list[list[int]] = [[]] * len(raws)
        lengths = np.array([len(r) for r in raws], np.int64)
        low, size = 0, 2
        while low < TREES_TOGETHER:
            of = np.flatnonzero((lengths > low) & (lengths <= size))
            low, size = size, size * 2
            if len(of):
                ids, n = self._merge_rows([raws[i] for i in of.tolist()], lengths[of], low)
                flat, ends = ids.tolist(), np.cumsum(n).tolist()
                for i, a, z in zip(of.tolist(), [0, *ends], ends, strict=False):
                    out[i] = flat[a:z]
        for i in np.flatnonzero(lengths > TREES_TOGETHER).tolist():
            out[i] = self.merge_one(raws[i])
        return out

    def _merge_rows(self, raws: list[bytes], n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The trees of all rows in one array, each with ``2 * size`` nodes; ids row by row, and how many each row has."""
        b, levels = len(raws), size.bit_length() - 1
        data = np.frombuffer(b"".join(r.ljust(size, b"\0") for r in raws), np.uint8).reshape(b, size)
        ids = np.full((b, size + 1), -1, np.int32)  # the spare column takes what falls outside: no pair has id -1
        there = np.arange(size)[None, :] < n[:, None]
        ids[:, :size][there] = self.first_ids[data[there]]
        tree = np.full((b, 2 * size), NEVER, np.int32)
        tree[:, size : 2 * size - 1][there[:, 1:]] = self.first_ranks[data[:, :-1][there[:, 1:]], data[:, 1:][there[:, 1:]]]
        for level in range(levels, 0, -1):
            w = 1 << level
            np.minimum(tree[:, w : 2 * w : 2], tree[:, w + 1 : 2 * w : 2], out=tree[:, w // 2 : w])
        after = np.broadcast_to(np.arange(1, size + 2, dtype=np.int32), (b, size + 1)).copy()
        after[:, :size][np.arange(size)[None, :] >= (n - 1)[:, None]] = size
        before = np.broadcast_to(np.arange(-1, size, dtype=np.int32), (b, size + 1)).copy()
        tree, ids, after, before = tree.ravel(), ids.ravel(), after.ravel(), before.ravel()

        def put(base: np.ndarray, leaf: np.ndarray, rank: np.ndarray) -> None:
            node = leaf + size
            tree[base + node] = rank
            for _ in range(levels):
                node = node >> 1
                child = base + 2 * node
                tree[base + node] = np.minimum(tree[child], tree[child + 1])

        rows = np.arange(b)
        while True:
            root = tree[rows * (2 * size) + 1]
            rows = rows[live := root != NEVER]
            if not len(rows):
                break
            rank, base, line = root[live], rows * (2 * size), rows * (size + 1)
            node = np.ones(len(rows), np.int64)
            for _ in range(levels):
                node *= 2
                node += tree[base + node] > tree[base + node + 1]
            i = node - size
            j = after[line + i]
            k = after[line + j]
            made = self.made[rank]
            ids[line + i] = made
            ids[line + j] = -1
            after[line + i] = k
            before[line + k] = i
            put(base, j, NEVER)
            put(base, i, self.ranks(made, ids[line + k]))
            p = before[line + i]
            has = np.flatnonzero(p >= 0)
            put(base[has], p[has], self.ranks(ids[line[has] + p[has]], made[has]))
        ids = ids.reshape(b, size + 1)
        live = ids >= 0
        return ids[live], live.sum(axis=1)

    # -- texts ------------------------------------------------------------------------------------------

    def pretokens(self, text: str) -> list[str | int]:
        """Pretokens, and the ids of added tokens where their strings stand in the text."""
        if self.cut_added is None or not self.cut_added.search(text):
            return self.cut.findall(text)
        out: list[str | int] = []
        at = 0
        for m in self.cut_added.finditer(text):
            out += self.cut.findall(text[at : m.start()])
            out.append(self.added[m[0]])
            at = m.end()
        return out + self.cut.findall(text[at:])

    def encode(self, texts: list[str]) -> list[list[int]]:
        parts = [self.pretokens(t) for t in texts]
        raws = {p: p.encode() for ps in parts for p in ps if isinstance(p, str)}
        done = dict(zip(raws, self.merge_many(list(raws.values())), strict=True))
        return [[x for p in ps for x in (done[p] if isinstance(p, str) else (p,))] for ps in parts]

    def decode(self, ids: list[int]) -> str:
        """Bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    # -- whole columns ----------------------------------------------------------------------------------

    def encode_rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all rows of a run of UTF-8 bytes, where each row's begin (one more than rows), and the bytes
        decoded from the ids with their places.

        A single space between two characters that are no white space always begins a pretoken, so rows may be
        cut there.  Equal chunks are encoded once; their ids are found again by the chunk's hash.  Should two
        different chunks share a hash, the decoded bytes differ from the row's, and the row is encoded anew.
        """
        start, hashes = chunks(data, offsets)
        if not len(start):
            none = np.zeros(len(offsets), np.int64)
            return np.zeros(0, np.int32), none, data, none
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        off, n = self.held.find(unique)
        if len(new := np.flatnonzero(n < 0)):
            end = np.append(start[1:], len(data))
            raw = data.tobytes()
            strings = [raw[a:z].decode() for a, z in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)]
            off[new], n[new] = self.held.add(unique[new], self.encode(strings))
        counts = n[inverse]
        ids = gather(self.held.ids, off[inverse], counts)
        bounds = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(start, offsets)]
        back, ends = self.decode_rows(ids, bounds)
        if not np.array_equal(back, data):
            ids, bounds = self._encode_exactly(data, offsets)
            back, ends = self.decode_rows(ids, bounds)
        self.held.trim()
        return ids, bounds, back, ends

    def _encode_exactly(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        rows = self.encode([raw[a:z].decode() for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
        return np.array([x for r in rows for x in r], np.int32), np.cumsum([0, *map(len, rows)])

    def decode_rows(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all rows' ids, and where each row's begin."""
        return self._laid_out(self.byte_table, ids, bounds)

    def decimal_rows(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids as decimal numbers, each with a comma after it, and where each row's begin."""
        return self._laid_out(self.decimal_table, ids, bounds)

    @staticmethod
    def _laid_out(table: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat, off, n = table
        counts = n[ids]
        return gather(flat, off[ids], counts), np.concatenate([[0], np.cumsum(counts)])[bounds]


def laid(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte strings end to end, with the place and length of each."""
    n = np.array([len(v) for v in values], np.int64)
    return np.frombuffer(b"".join(values), np.uint8), np.cumsum(n) - n, n


def gather(flat: np.ndarray, off: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``flat[off[i] : off[i] + counts[i]]`` for all i, end to end."""
    total = np.cumsum(counts)
    n = int(total[-1]) if len(total) else 0
    kind = np.int32 if max(n, len(flat)) < 2**31 else np.int64
    return flat[np.repeat((off - (total - counts)).astype(kind), counts) + np.arange(n, dtype=kind)]


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and hashes of the chunks into which rows are cut before single spaces."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    white, lead = WHITE[data], MAY_BE_WHITE[data]
    # a character of white space beyond ASCII has 2 or 3 bytes; near its possible lead bytes no cut is made
    near = white.copy()
    near[1:] |= lead[:-1]
    near[2:] |= lead[:-2]
    near[:1] |= lead[:1]
    cut = data == 0x20
    cut[1:] &= ~near[:-1]
    cut[:-1] &= ~(white[1:] | lead[1:])
    cut[-1] = False
    cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    start = np.flatnonzero(cut)
    length = np.diff(np.append(start, len(data)))
    return start, span_hashes(data, start, length)


class Held:
    """Ids by the hash of a chunk: sorted arrays rather than a dictionary, so a million chunks take some 50 MB."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.keys, self.off, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and counts; a count of -1 where the key is not held."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.off[at], np.where(self.keys[at] == keys, self.n[at], -1)

    def add(self, keys: np.ndarray, rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        n = np.array([len(r) for r in rows], np.int64)
        total = int(n.sum())
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(self.used, total) + total, np.int32)])
        self.ids[self.used : self.used + total] = np.fromiter((x for r in rows for x in r), np.int32, total)
        off = self.used + np.cumsum(n) - n
        self.used += total
        at = np.searchsorted(self.keys, keys)
        self.keys, self.off, self.n = np.insert(self.keys, at, keys), np.insert(self.off, at, off), np.insert(self.n, at, n)
        return off, n

    def trim(self) -> None:
        if len(self.keys) > CACHED:
            self.clear()


@functools.lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    """The encoder of a vocabulary file, held by each Python worker."""
    return Bpe(path)
