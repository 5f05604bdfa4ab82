"""Periodic runs of words: stretches that repeat a block of words back to back.

A run is a stretch with smallest period q (words q apart are identical) and at least ``max(min_length, min_exponent * q)``
words that no neighbouring word extends.  Two copies of a run, one moved by q, overlap in all but q of its words, and
``Limits.overlap`` is the least such overlap over all periods.  So every word of a run lies in some k-gram, k being that overlap,
that occurs twice in the text.  Words outside such k-grams are masked, and what survives between masked words is searched by the
divide-and-conquer of Main and Lorentz: at each middle, longest common extensions give, for each period, the stretch that
crosses it.  Grams are compared by hashes, words by their bytes; a shared hash unmasks a word, which changes no result.

Each row is searched on its own, so nothing is shuffled, and a hot source, copies and repeated rows cost what they cost one by
one.  A null text has no words, no runs and an empty ``collapsed``, as has an empty one.  A text is searched whole, however
long.  Null or repeated ids are returned as they are; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.llm import wordhash
from mosaiq.llm.common import freed

RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
RUNS_SQL = "array<struct<start: bigint, length: bigint, period: bigint>>"


@dataclass(frozen=True)
class Limits:
    min_length: int = 24
    min_exponent: int = 3

    def least(self, period: int) -> int:
        return max(self.min_length, self.min_exponent * period)

    @property
    def overlap(self) -> int:
        """The fewest words that a run shares with itself moved by its period.  Beyond min_length the overlap only grows."""
        return min(self.least(q) - q for q in range(1, self.min_length + 1))

    @property
    def lone(self) -> int:
        """Within a run of a period up to this there is no other run: one of period p and n words would have n < p + q (two
        periods of one stretch), so p <= q / 2, and n < 1.5 q."""
        return 2 * self.min_length // 3


def extensions(x: list[int]) -> list[int]:
    """For each place, how many items from there equal those from the start."""
    n = len(x)
    found = [n] * n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = found[i - left]
            if k < right - i:
                found[i] = k
                continue
            k = right - i
        while i + k < n and x[i + k] == x[k]:
            k += 1
        found[i] = k
        left, right = i, i + k
    return found


def runs(x: list[int], limits: Limits = Limits()) -> list[tuple[int, int, int]]:
    """``(start, end, period)`` of all runs of a sequence of numbers from 0 on."""
    n, found = len(x), {}
    todo: list[tuple[int, int, tuple[int, int]]] = [(0, n, (0, 0))]
    while todo:
        lo, hi, lone = todo.pop()
        if hi - lo < limits.min_length or lone[0] <= lo and hi <= lone[1]:
            continue
        mid = (lo + hi) // 2
        whole, left, right = x[lo:hi], x[lo:mid], x[mid:hi]
        a, b = len(left), len(right)
        after, before = extensions(right), extensions(left[::-1])
        ends = extensions(left[::-1] + [-1] + whole[::-1])  # common ends of the left half and what ends q later
        starts = extensions(right + [-1] + whole)  # common starts of the right half and what starts q earlier
        for q in range(1, (hi - lo) // limits.min_exponent + 1):
            least, pair = limits.least(q), []
            if q <= b:
                pair.append((mid - ends[a + 1 + b - q], mid + q + (after[q] if q < b else 0)))
            if q <= a:
                pair.append((mid - q - (before[q] if q < a else 0), mid + starts[b + 1 + a - q]))
            for s, e in pair:
                if e - s < least or s and x[s - 1] == x[s - 1 + q] or e < n and x[e] == x[e - q]:
                    continue
                if found.setdefault((s, e), q) > q:
                    found[s, e] = q
                if q <= limits.lone and e - s > lone[1] - lone[0]:
                    lone = (s, e)
        todo += [(lo, mid, lone), (mid, hi, lone)]
    return [(s, e, q) for (s, e), q in found.items()]


def surviving(words: wordhash.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end word of each stretch whose words all lie in runs of ``size`` words that their row has twice."""
    n = len(words.hashes) - size + 1
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = np.zeros(n, np.uint64)
    for k in range(size):
        grams += words.hashes[k : k + n] * wordhash._R[k]
    inside = np.flatnonzero(words.row[:n] == words.row[size - 1 :])
    keys = wordhash.mix64(wordhash.mix64(grams[inside]) + words.row[inside].astype(np.uint64) * wordhash._FAR)
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = inside[order[twice]]
    edges = np.zeros(len(words.hashes) + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + size, -1)
    covered = np.cumsum(edges[:-1]) > 0
    first, last = covered.copy(), covered.copy()
    first[1:] &= ~covered[:-1] | (words.row[1:] != words.row[:-1])
    last[:-1] &= ~covered[1:] | (words.row[1:] != words.row[:-1])
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _searched(batch: pa.RecordBatch, limits: Limits) -> Iterator[pa.RecordBatch]:
    for a, z, data, offsets in wordhash.pieces(batch.column(1)):
        words = wordhash.words(data, offsets)
        raw, bounds = data.tobytes(), words.bounds.tolist()
        of_row: dict[int, list[tuple[int, int, int]]] = {}
        for s, e in zip(*(x.tolist() for x in surviving(words, limits.overlap)), strict=True):
            if e - s < limits.min_length:
                continue
            number: dict[bytes, int] = {}
            starts = words.start[s:e].tolist()
            stops = (words.start[s:e] + words.length[s:e]).tolist()
            found = runs([number.setdefault(raw[i:j], len(number)) for i, j in zip(starts, stops, strict=True)], limits)
            if found:
                row = int(words.row[s])
                base = s - bounds[row]
                of_row.setdefault(row, []).extend((base + i, j - i, q) for i, j, q in found)
        lists, texts = [], []
        for r, (i, j) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            own = raw[i:j].split()
            found = sorted(of_row.get(r, ()), key=lambda x: (x[0], x[2]))
            if found:
                keep = np.ones(len(own), bool)
                for start, length, period in found:
                    keep[start + period : start + length] = False
                own = [own[k] for k in np.flatnonzero(keep).tolist()]
            lists.append([{"start": s, "length": n, "period": q} for s, n, q in found])
            texts.append(b" ".join(own))
        columns = [batch.column(0).slice(a, z - a), pa.array(np.diff(words.bounds), pa.int64()), pa.array(lists, RUNS), pa.array(texts, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=[batch.schema.names[0], "n_words", "runs", "collapsed"])


def find(docs: DataFrame, limits: Limits = Limits(), id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``n_words``, ``runs`` by start and period (start and length in words), and ``collapsed``: the text's words without those
    that follow the first period of a run, joined by blanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _searched(batch, limits)

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text).mapInArrow(freed(run), f"`{id_column}` {kind}, n_words long, runs {RUNS_SQL}, collapsed string")


def strongest(found: str = "runs") -> Column:
    """The run of the greatest exact length / period; of equals that of the least start, then period; null for none."""
    more = lambda x, y: x["length"] * y["period"] - y["length"] * x["period"]
    after = lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["period"] - y["period"])
    order = lambda x, y: F.when(more(x, y) != 0, -F.signum(more(x, y))).otherwise(F.signum(after(x, y))).cast("int")
    return F.get(F.array_sort(found, order), F.lit(0))


def planted(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts with runs for the check of the search: where h = crc32(decimal id) is divisible by 10, the words from a = g % n on
    repeat the first p of them, g = h // 10, n words, p = 1 + (n - a) // (3 + g % 8).  All other texts stay."""
    h = F.crc32(F.col(id_column).cast("string"))
    chosen = F.when(h % 10 == 0, F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    out = docs.select(F.col(id_column), F.col(text), F.floor(h / 10).alias("g"), chosen.alias("w"))
    out = out.withColumn("n", F.when(F.size("w") > 0, F.size("w"))).withColumn("a", (F.col("g") % F.col("n")).cast("int"))
    rest = F.col("n") - F.col("a")
    out = out.withColumn("p", (1 + F.floor(rest / (3 + F.col("g") % 8))).cast("int"))
    copies = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    repeated = F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(copies, F.lit(1), rest))
    return out.select(id_column, F.when(F.col("n").isNotNull(), F.array_join(repeated, " ")).otherwise(F.col(text)).alias(text))
