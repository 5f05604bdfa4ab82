"""Benchmark decontamination by latent semantic retrieval.

Passages are vectors of hashed words weighted by inverse document frequency; the frequencies are counted over all
documents.  A randomised singular value decomposition, whose products run in Spark, gives the latent space: it is
fitted on every benchmark item and every passage of every document, each word in one passage.  All documents are then
searched: windows a little longer than an item are compared with it by cosine, both within the latent space and over
the full norm of the window (relative to the item's own share in that space).  A candidate is confirmed by the longest common subsequence of words: most of the item's words, in order; or half of them
if the item's answer (its last words) is there as well.

A paraphrase that fulfils this can have any cosine, as its window is longer than the item and its words differ in weight.
So windows are candidates, too, that hold enough of an item's rare words (``RareWords``), and enough of its words at all:
so many as confirm a leak without the answer, or fewer and enough of the answer.  No window that can be confirmed holds fewer, so the result is that of confirming every window against every item of its
size.  For the same reason only windows that hold enough of some item's words are projected into the latent space.

Null or empty texts and items match nothing.  An item of fewer than ``min_words`` words counts only if all its words
are there in order.  Items with equal words are found under each of their ids; items with a null id are left out.
Documents are searched one by one: repeated rows give repeated results, rows with a null id are left out, and other
columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm import wordhash
from mosaiq.llm.common import block_count, free_memory, freed, materialise, scratch

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS


@dataclass(frozen=True)
class Settings:
    rank: int = 128
    oversample: int = 16
    power_steps: int = 1
    #: Most words of the passages that documents are cut into to fit the latent space; an item is one passage.
    passage_words: int = 40
    cosine: float = 0.55
    common: float = 0.7
    common_with_answer: float = 0.5
    answer_words: int = 8
    answer_share: float = 0.75
    min_words: int = 8
    #: Items that are broadcast at once; more are searched for block by block.
    block_items: int = 10_000


@dataclass
class RareWords:
    """For each item its rarest words, and how many of them every window holds that can be confirmed.

    A leak holds ``need[1]`` of an item's words, or ``need[0]`` of them and ``need[2]`` of its answer's.  Of n words at most
    n - need are missing; so of some different ones all but as many as can be missing are there: ``least``, in the same order.
    ``words`` is sorted; the items that have ``words[k]`` among these are ``items[bounds[k]:bounds[k + 1]]``, and ``in_answer``
    tells whether it is in the item's answer."""

    words: np.ndarray
    bounds: np.ndarray
    items: np.ndarray
    in_answer: np.ndarray
    least: np.ndarray
    need: np.ndarray

    @staticmethod
    def enough(bound: np.ndarray, words: np.ndarray, answers: np.ndarray) -> np.ndarray:
        return (words >= bound[1]) | (words >= bound[0]) & (answers >= bound[2])


@dataclass
class Index:
    """Items with their vectors and window sizes; weights of all buckets, and latent vectors of those in ``at`` (the
    last line of terms is empty)."""

    weights: np.ndarray
    at: np.ndarray
    terms: np.ndarray
    item_ids: list
    item_words: list[np.ndarray]
    vectors: np.ndarray
    window: np.ndarray
    rare: RareWords
    settings: Settings

    @functools.cached_property
    def held(self) -> list[Item]:
        """What confirming needs of each item; made once in each worker."""
        return [prepared(w, self.settings) for w in self.item_words]

    @functools.cached_property
    def vocabulary(self) -> np.ndarray:
        return np.unique(np.concatenate(self.item_words))

    @functools.cached_property
    def in_vocabulary(self) -> np.ndarray:
        """Of each bucket, whether a word of the vocabulary is in it."""
        out = np.zeros(BUCKETS, bool)
        out[buckets(self.vocabulary)] = True
        return out

    @functools.cached_property
    def in_rare(self) -> np.ndarray:
        """Of each bucket, whether a word of ``rare`` is in it."""
        out = np.zeros(BUCKETS, bool)
        out[buckets(self.rare.words)] = True
        return out

    @functools.cached_property
    def holds(self) -> np.ndarray:
        """How often items (first line) and their answers (second line) have words of the vocabulary, by ``place_of``.  Of two
        pairs that share a place the larger number stands, which only lets through a candidate more."""
        n = sum(map(len, self.item_words))
        out = np.zeros((2, 1 << max(16, (16 * n).bit_length(), min(22, (64 * n).bit_length()))), np.int32)
        for i, w in enumerate(self.item_words):
            for line, some in zip(out, (w, answer_of(w, self.settings)), strict=True):
                words, count = np.unique(some, return_counts=True)
                np.maximum.at(line, self.place_of(np.array([i]), np.searchsorted(self.vocabulary, words)[None, :], len(line))[0], count.astype(np.int32))
        return out

    @staticmethod
    def place_of(items: np.ndarray, words: np.ndarray, size: int) -> np.ndarray:
        return (items[:, None] * 2654435761 + words * 40503) & (size - 1)


#: Longest word, in bytes, that is hashed by eight bytes at once.
LANE_BYTES = 32
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def text_words(data: np.ndarray, offsets: np.ndarray) -> wordhash.Words:
    """Words of letters, digits and non-ASCII characters, in lower case (ASCII and Latin-1, as ``wordhash.lower_utf8``)."""
    padded = np.zeros(len(data) + 8, np.uint8)
    lower = padded[: len(data)]
    np.bitwise_or(data, (data - np.uint8(65) < 26).view(np.uint8) << 5, out=lower)
    if (lead := data[:-1] == 0xC3).any():
        lower[1:] += (lead & (data[1:] - np.uint8(0x80) <= 0x1E) & (data[1:] != 0x97)).view(np.uint8) << 5
    inside = (lower - np.uint8(97) < 26) | (lower - np.uint8(48) < 10) | (lower >= 128)
    first, last = inside.copy(), inside.copy()
    first[1:] = inside[1:] > inside[:-1]
    last[:-1] = inside[:-1] > inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]  # no word crosses a row
    first[edges], last[edges - 1] = inside[edges], inside[edges - 1]
    start = np.flatnonzero(first)
    length = np.flatnonzero(last) + 1 - start
    bounds = np.searchsorted(start, offsets)
    return wordhash.Words(_word_hashes(padded, start, length), np.repeat(np.arange(len(offsets) - 1), np.diff(bounds)), start, length, bounds)


def _word_hashes(padded: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of words; eight bytes follow the last.  Those of up to eight bytes are all different, as no word has a byte 0."""
    lanes = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    out = wordhash.mix64(lanes[start] & _FIRST_BYTES[np.minimum(length, 8)])
    longer = np.flatnonzero((length > 8) & (length <= LANE_BYTES))
    for k in range(8, LANE_BYTES, 8):
        lane = lanes[start[longer] + k] & _FIRST_BYTES[np.minimum(length[longer] - k, 8)]
        out[longer] = wordhash.mix64(out[longer] + lane)
        longer = longer[length[longer] > k + 8]
    longest = np.flatnonzero(length > LANE_BYTES)
    out[longest] = wordhash.span_hashes(padded, start[longest], length[longest])
    return out


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def bucketed(rows: DataFrame, text: str = "text") -> DataFrame:
    """The buckets of each row's words, two bytes each: what the fit reads several times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z, data, offsets in wordhash.pieces(batch.column(0)):
                found = text_words(data, offsets)
                parts = [None, pa.py_buffer((2 * found.bounds).astype(np.int32)), pa.py_buffer(buckets(found.hashes).astype(np.uint16))]
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), z - a, parts)], names=["words"])

    return rows.select(text).mapInArrow(freed(run), "words binary")


def bucket_pieces(column: pa.Array, most: int = 150_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets and bounds of the rows of ``bucketed``, for runs of whole rows of about ``most`` words; a longer row stands
    alone."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] // 2 if len(column) else np.zeros(1, np.int64)
    found = np.frombuffer(data, np.uint16, bounds[-1]) if bounds[-1] else np.zeros(0, np.uint16)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1)
        yield found[bounds[i] : bounds[j]].astype(np.int64), bounds[i : j + 1] - bounds[i]
        i = j


def document_frequencies(words: DataFrame) -> tuple[np.ndarray, int]:
    """In how many rows of ``bucketed`` each bucket of words occurs, and how many have a word.  Each task sums its rows
    first; the result has a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for found, bounds in bucket_pieces(batch.column(0)):
                length = np.diff(bounds)
                pairs = np.sort(np.repeat(np.arange(len(length)), length) * BUCKETS + found)
                first = np.ones(len(pairs), bool)
                first[1:] = pairs[1:] != pairs[:-1]
                total += np.bincount(pairs[first] % BUCKETS, minlength=BUCKETS)
                n += int((length > 0).sum())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(total[some], n), pa.int64())], names=["bucket", "n"])

    rows = words.mapInArrow(freed(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    at, n = rows["bucket"].to_numpy(), rows["n"].to_numpy()
    out = np.zeros(BUCKETS, np.int64)
    out[at[at >= 0]] = n[at >= 0]
    return out, int(n[at < 0].sum())


def idf(frequencies: np.ndarray, n_docs: int) -> np.ndarray:
    """Above 0 even for words that all documents have."""
    return np.log((2.0 + n_docs) / (1.0 + frequencies))


#: Passages that are multiplied at once (as a power of 2), and terms whose sums stand in one row.
CHUNK_BITS = 3
PART_TERMS = 64
#: Different words of rows, summed over rows, for which a task is worth its sums over all terms (38 MB).
TASK_WORDS = 4_000_000


@dataclass
class Passages:
    """TF-IDF weights of passages, each of unit length, in chunks of 1 << CHUNK_BITS passages.  Chunk c has the terms
    ``terms[columns[c]:columns[c + 1]]``, and of its matrix the entries ``at[c]`` to ``at[c + 1]`` of ``row`` (passage in the
    chunk), ``column`` (place in ``terms``) and ``weight``."""

    row: np.ndarray
    column: np.ndarray
    weight: np.ndarray
    at: np.ndarray
    terms: np.ndarray
    columns: np.ndarray

    def chunks(self) -> Iterator[tuple[np.ndarray, slice]]:
        """The matrix of each chunk, and where its terms stand in ``terms``."""
        for a, z, low, high in zip(self.at[:-1].tolist(), self.at[1:].tolist(), self.columns[:-1].tolist(), self.columns[1:].tolist(), strict=True):
            matrix = np.zeros((1 << CHUNK_BITS, high - low), np.float32)
            matrix[self.row[a:z], self.column[a:z] - low] = self.weight[a:z]
            yield matrix, slice(low, high)


def passages(found: np.ndarray, bounds: np.ndarray, most_words: int, weights: np.ndarray) -> Passages:
    """All words of some rows in passages of at most ``most_words``, of nearly one length within a row."""
    length = np.diff(bounds)
    n = -(-length // most_words)
    row = np.repeat(np.arange(len(length)), length)
    passage = (np.cumsum(n) - n)[row] + (np.arange(len(found)) - bounds[row]) * n[row] // length[row]
    inner = (1 << CHUNK_BITS) - 1
    # sorted by chunk, term and passage
    key, count = np.unique((((passage >> CHUNK_BITS) << BUCKET_BITS | found) << CHUNK_BITS) | passage & inner, return_counts=True)
    chunk, term, inside = key >> (BUCKET_BITS + CHUNK_BITS), (key >> CHUNK_BITS) % BUCKETS, key & inner
    weight, passage = count * weights[term], chunk << CHUNK_BITS | inside
    weight /= np.maximum(np.sqrt(np.bincount(passage, weight * weight)), 1e-12)[passage]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] >> CHUNK_BITS != key[:-1] >> CHUNK_BITS
    column = np.cumsum(new) - 1
    at = np.searchsorted(chunk, np.arange(-(-int(n.sum()) >> CHUNK_BITS) + 1))
    return Passages(inside, column, weight.astype(np.float32), at, term[new], np.append(column, new.sum())[at])


def _gram_times(tables: list[tuple[DataFrame, int]], weights: np.ndarray, known: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Puts A^T (A right) in the place of ``right`` and returns right^T A^T A right, for the matrix A of all passages of the
    tables (of ``bucketed``, with the most words of a passage) over the known terms: partial sums of each task, then of each
    part of the terms.  The driver takes one partition of these parts at a time and holds no second matrix."""
    spark, width = tables[0][0].sparkSession, right.shape[1]
    place = np.zeros(BUCKETS, np.int64)
    place[known] = np.arange(len(known))
    shared = spark.sparkContext.broadcast((weights, place, right))
    schema = "part int, v binary"

    def partial(most_words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, place, right = shared.value
        total = np.zeros_like(right)
        for batch in batches:
            for found, bounds in bucket_pieces(batch.column(0)):
                held = passages(found, bounds, most_words, weights)
                terms = place[held.terms]
                lines, sums = np.empty((2, int(np.diff(held.columns).max(initial=0)), right.shape[1]), np.float32)  # of one chunk
                for matrix, here in held.chunks():
                    part = np.take(right, terms[here], axis=0, out=lines[: here.stop - here.start], mode="clip")
                    np.matmul(matrix.T, matrix @ part, out=part)
                    part += np.take(total, terms[here], axis=0, out=sums[: here.stop - here.start], mode="clip")
                    total[terms[here]] = part
        for a in range(0, len(total), 16 * PART_TERMS):
            parts = {k // PART_TERMS: total[k : k + PART_TERMS] for k in range(a, min(a + 16 * PART_TERMS, len(total)), PART_TERMS)}
            parts = {k: part.tobytes() for k, part in parts.items() if part.any()}
            yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array(list(parts.values()), pa.binary())], names=["part", "v"])

    def summed(part: pa.Table) -> pa.Table:
        total = functools.reduce(lambda t, v: t + np.frombuffer(v.as_buffer(), np.float32), part["v"], np.float64(0))
        return pa.table({"part": part["part"].slice(0, 1), "v": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    sums = [rows.mapInArrow(freed(functools.partial(partial, most_words)), schema) for rows, most_words in tables]
    rows = materialise(functools.reduce(DataFrame.unionByName, sums).groupBy("part").applyInArrow(summed, schema))
    shared.destroy()
    gram, absent = np.zeros((width, width)), set(range(0, len(right), PART_TERMS))
    for part, v in rows.toLocalIterator():
        a = part * PART_TERMS
        product = np.frombuffer(v, np.float32).reshape(-1, width)
        gram += right[a : a + PART_TERMS].T.astype(np.float64) @ product
        right[a : a + PART_TERMS] = product
        absent.remove(a)
    for a in absent:
        right[a : a + PART_TERMS] = 0
    return gram


def _tall_gram(tall: np.ndarray) -> np.ndarray:
    """tall^T tall in double precision, without a copy."""
    return sum(tall[a : a + 4096].T.astype(np.float64) @ tall[a : a + 4096] for a in range(0, len(tall), 4096))


def _turned(tall: np.ndarray, by: np.ndarray) -> np.ndarray:
    """tall by, in the place of ``tall``."""
    for a in range(0, len(tall), 4096):
        tall[a : a + 4096, : by.shape[1]] = tall[a : a + 4096].astype(np.float64) @ by
    return tall[:, : by.shape[1]]


def _whitening(gram: np.ndarray, least: float) -> np.ndarray:
    """B with B^T gram B = 1 for the directions above ``least`` of the largest, the largest first."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    some = np.flatnonzero(values > max(least * values[-1], 0))[::-1]
    return vectors[:, some] / np.sqrt(values[some])


def latent_terms(tables: list[tuple[DataFrame, int]], weights: np.ndarray, known: np.ndarray, settings: Settings = Settings(), seed: int = 11) -> np.ndarray:
    """The leading right singular vectors of the matrix of all passages (all buckets by rank), by a randomised
    decomposition: of Y = A^T A q, with q^T Y, comes the Nystroem form Y (q^T Y)^-1 Y^T of A^T A.  What meets at the driver has
    a fixed size: buckets by rank."""
    width = min(settings.rank + settings.oversample, len(known))
    if not width:
        return np.zeros((BUCKETS, settings.rank), np.float32)
    y = np.random.default_rng(seed).standard_normal((len(known), width), np.float32)
    gram = _gram_times(tables, weights, known, y)
    for _ in range(settings.power_steps):
        y = np.ascontiguousarray(_turned(y, _whitening(_tall_gram(y), 1e-10)))  # orthonormal columns
        gram = _gram_times(tables, weights, known, y)
    y = _turned(y, _whitening(gram, 1e-6))  # A^T A is y y^T
    found = _turned(y, _whitening(_tall_gram(y), 1e-10)[:, : settings.rank])
    out = np.zeros((BUCKETS, settings.rank), np.float32)
    out[known, : found.shape[1]] = found
    return out


def window_size(n_words: np.ndarray) -> np.ndarray:
    """Window sizes: a quarter more than the item, on a geometric scale, so few sizes serve all items."""
    return np.ceil(8 * 1.5 ** np.ceil(np.log(np.maximum(n_words * 1.25 / 8, 1)) / np.log(1.5))).astype(np.int64)


def fitted(docs: DataFrame, items: DataFrame, settings: Settings = Settings(), text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The latent space of all documents and items, and the weights of all buckets."""
    with scratch(docs.sparkSession):
        words, held = materialise(bucketed(docs, text)), materialise(bucketed(items))
        frequencies, n_docs = document_frequencies(words)
        weights = idf(frequencies, n_docs)
        of_items, _ = document_frequencies(held)
        words, held = (rows.coalesce(block_count(int(n.sum()), TASK_WORDS)) for rows, n in ((words, frequencies), (held, of_items)))
        known = np.flatnonzero(frequencies + of_items)
        known = known[np.argsort(-(frequencies + of_items)[known], kind="stable")]  # what is read most stands together
        basis = latent_terms([(words, settings.passage_words), (held, np.iinfo(np.int32).max)], weights, known, settings)
    free_memory()
    return basis, weights


def build_indexes(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id", text: str = "text") -> Iterator[Index]:
    """The items in blocks of some ``block_items``, all with one latent space."""
    items = materialise(benchmark.filter("item_id is not null and text is not null").select("item_id", "text"))
    basis, weights = fitted(docs.select(text), items.select("text"), settings, text)
    blocks = block_count(items.count(), settings.block_items)
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()
        data, offsets = wordhash.buffers(pa.array([r["text"] for r in rows], pa.string()))
        found = text_words(data, offsets)
        keep = [i for i in range(len(rows)) if found.bounds[i + 1] > found.bounds[i]]
        yield indexed(basis, weights, [rows[i]["item_id"] for i in keep], [found.hashes[found.bounds[i] : found.bounds[i + 1]] for i in keep], settings)


def answer_of(words: np.ndarray, settings: Settings) -> np.ndarray:
    """The last words of an item."""
    return words[max(0, len(words) - settings.answer_words) :]


def fewest(share: float, n: int) -> int:
    """The least number that can be ``share`` of n."""
    return math.ceil(share * n - 1e-9)


def sure(counts: np.ndarray, missing: int) -> int:
    """How many different words are there at least if ``missing`` of all that are counted are not."""
    return len(counts) - int(np.searchsorted(np.cumsum(np.sort(counts)), missing, "right"))


def rare_words(weights: np.ndarray, item_words: list[np.ndarray], settings: Settings) -> RareWords:
    words, items, in_answer, least, needed = [], [], [], [], []
    for i, w in enumerate(item_words):
        n, answer = len(w), answer_of(w, settings)
        if n < settings.min_words:
            need = (n, n, len(answer))
        else:
            shares = (settings.common_with_answer, max(settings.common, settings.common_with_answer))
            need = (*(max(1, fewest(x, n)) for x in shares), fewest(settings.answer_share, len(answer)))
        own, count = np.unique(w, return_counts=True)
        rarest = np.lexsort((own, -weights[buckets(own)]))[: n - need[0] + max(1, need[0] // 3)]
        own, count = own[rarest], count[rarest]
        of_answer = (answer[None, :] == own[:, None]).sum(axis=1)
        words.append(own)
        items.append(np.full(len(own), i))
        in_answer.append(of_answer > 0)
        least.append((sure(count, n - need[0]), sure(count, n - need[1]), sure(of_answer[of_answer > 0], len(answer) - need[2])))
        needed.append(need)
    words, items, in_answer = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((words, np.uint64), (items, np.int64), (in_answer, bool)))
    order = np.argsort(words, kind="stable")
    distinct, first = np.unique(words[order], return_index=True)
    return RareWords(distinct, np.append(first, len(words)), items[order], in_answer[order], *(np.array(x, np.int64).reshape(-1, 3).T for x in (least, needed)))


def indexed(basis: np.ndarray, weights: np.ndarray, item_ids: list, item_words: list[np.ndarray], settings: Settings = Settings()) -> Index:
    known = np.flatnonzero(basis.any(axis=1))
    at = np.full(BUCKETS, len(known))
    at[known] = np.arange(len(known))
    terms = np.zeros((len(known) + 1, basis.shape[1]), np.float32)
    for a in range(0, len(known), 4096):
        some = known[a : a + 4096]
        terms[a : a + len(some)] = basis[some]
        terms[a : a + len(some)] *= weights[some, None]
    vectors = np.array([terms[at[buckets(w)]].sum(axis=0) for w in item_words]).reshape(len(item_words), terms.shape[1])
    full = np.sqrt([(weights[buckets(w)] ** 2).sum() for w in item_words])[:, None]
    # window . vector / norm of the window = cosine / cosine of the item with itself
    vectors = vectors * full / np.maximum(np.einsum("ij,ij->i", vectors, vectors)[:, None], 1e-12)
    return Index(weights, at, terms, item_ids, item_words, vectors.astype(np.float32), window_size(np.array([len(w) for w in item_words], np.int64)), rare_words(weights, item_words, settings), settings)


def common_subsequence(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence of an item (of n words, as the places of each word) and words."""
    ones = (1 << n) - 1
    row = ones
    for m in filter(None, map(masks.get, words)):
        hit = row & m
        row = ((row + hit) | (row - hit)) & ones
    return n - row.bit_count()


def masks(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | 1 << i
    return out


def _ordering(numbers: np.ndarray) -> np.ndarray:
    """A stable order of numbers from 0; small kinds of numbers are sorted by their digits, which is faster."""
    return np.argsort(numbers.astype(np.uint16) if len(numbers) and numbers.max() < 1 << 16 else numbers, kind="stable")


def together(place: np.ndarray, row: np.ndarray, item: np.ndarray, least: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Which of the words at ``place`` (ascending), each rare for an item, can be in a window with enough of them: those with
    ``least`` of their item, themselves included, within ``reach`` words of one row."""
    order = _ordering(item)
    place, row, item = place[order], row[order], item[order]
    last = np.arange(len(item)) + least[item] - 1
    first = np.flatnonzero(last < len(item))
    last = last[first]
    close = (item[last] == item[first]) & (row[last] == row[first]) & (place[last] - place[first] < reach[item[first]])
    runs = np.bincount(first[close], minlength=len(item) + 1) - np.bincount(last[close] + 1, minlength=len(item) + 1)
    return order[np.cumsum(runs[:-1]) > 0]


def rare_windows(found: wordhash.Words, index: Index) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each size: rows, first words and items of the windows that hold enough of an item's words and of its answer's, a
    quarter beyond included."""
    rare, n_items = index.rare, len(index.item_ids)
    place = np.flatnonzero(index.in_rare[buckets(found.hashes)])
    at = np.minimum(np.searchsorted(rare.words, found.hashes[place]), len(rare.words) - 1)
    same = rare.words[at] == found.hashes[place]
    place, at = place[same], at[same]
    n = np.diff(rare.bounds)[at]
    entry = np.repeat(rare.bounds[at] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))  # a word of an item
    place = np.repeat(place, n)
    some = together(place, found.row[place], rare.items[entry], rare.least[0], index.window + 2 * (index.window // 4))
    some.sort()
    place, entry = place[some], entry[some]
    item = rare.items[entry]
    size = index.window[item]
    # where the word stood last, or -1
    order = np.argsort(entry, kind="stable")
    before = np.full(len(place), -1)
    same = entry[order[1:]] == entry[order[:-1]]
    before[order[1:][same]] = place[order[:-1][same]]
    for k in np.unique(size).tolist():
        of_size = np.flatnonzero(size == k)
        here, i, previous, in_answer = place[of_size], item[of_size], before[of_size], rare.in_answer[entry[of_size]]
        stride, row = max(1, k // 4), found.row[here]
        begin, length = found.bounds[row], found.bounds[row + 1] - found.bounds[row]
        q, previous, last = here - begin, previous - begin, -(-np.maximum(0, length - k) // stride)
        keys, of_answer = [], []
        for back in range(-2, k // stride + 3):  # windows that may reach to the word, and to no earlier place of it
            step = q // stride - back
            start = np.minimum(step * stride, np.maximum(0, length - k))
            low = np.maximum(0, start - k // 4)
            reached = np.flatnonzero((step >= 0) & (step <= last) & (low <= q) & (previous < low) & (q < start + k + k // 4))
            keys.append((begin[reached] + start[reached]) * n_items + i[reached])
            of_answer.append(in_answer[reached])
        keys, of_answer = np.concatenate(keys), np.concatenate(of_answer)
        keys = np.sort(keys * 2 + of_answer)
        new = np.flatnonzero(np.append(True, keys[1:] >> 1 != keys[:-1] >> 1)[: len(keys)])
        count, answers = np.diff(new, append=len(keys)), np.add.reduceat(keys & 1, new)
        keys = keys[new] >> 1
        keys = keys[rare.enough(rare.least[:, keys % n_items], count, answers)]
        first, items = keys // n_items, keys % n_items
        keep = np.zeros(len(first), bool)
        for a in range(0, len(first), 4096):
            part = slice(a, a + 4096)
            keep[part] = rare.enough(rare.need[:, items[part]], *held_words(found, index, first[part], k, items[part]))
        yield k, found.row[first[keep]], first[keep], items[keep]


def held_words(found: wordhash.Words, index: Index, first: np.ndarray, size: int, items: np.ndarray) -> list[np.ndarray]:
    """How many words of its item, and of the item's answer, each window of ``size`` holds, a quarter beyond included: each
    word of the window counts as often as the item or the answer has it."""
    row = found.row[first]
    low, high = np.maximum(found.bounds[row], first - size // 4), np.minimum(found.bounds[row + 1], first + size + size // 4)
    n = high - low
    window = np.repeat(np.arange(len(first)), n)
    hashes = found.hashes[np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
    some = np.flatnonzero(index.in_vocabulary[buckets(hashes)])
    window, hashes = window[some], hashes[some]
    word = np.minimum(np.searchsorted(index.vocabulary, hashes), len(index.vocabulary) - 1)
    same = index.vocabulary[word] == hashes
    pairs = np.sort(window[same] * len(index.vocabulary) + word[same])
    pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)]]
    window, word = pairs // len(index.vocabulary), pairs % len(index.vocabulary)
    at = index.place_of(items[window], word[:, None], index.holds.shape[1])[:, 0]
    return [np.bincount(window, line[at], len(first)) for line in index.holds]


@dataclass
class Item:
    words: np.ndarray
    masks: dict[int, int]
    answer: dict[int, int]
    counts: dict[int, int]


def prepared(words: np.ndarray, settings: Settings) -> Item:
    held = masks(words)
    return Item(words, held, masks(answer_of(words, settings)), {w: m.bit_count() for w, m in held.items()})


def confirm(item: Item, words: list[int], settings: Settings) -> float:
    """Share of the item's words in the common subsequence if that confirms a leak, else 0."""
    n = len(item.words)
    if sum(map(item.counts.__getitem__, item.counts.keys() & words)) < settings.common_with_answer * n:
        return 0.0  # no subsequence can be longer than what is common in any order
    share = common_subsequence(item.masks, n, words) / n
    if n < settings.min_words:
        return share if share == 1.0 else 0.0
    if share >= settings.common:
        return share
    k = min(settings.answer_words, n)
    if share >= settings.common_with_answer and common_subsequence(item.answer, k, words) >= settings.answer_share * k:
        return share
    return 0.0


def search(data: np.ndarray, offsets: np.ndarray, index: Index, settings: Settings) -> dict[tuple[int, int], tuple[float, float]]:
    """(row, item) -> (cosine, share) of confirmed leaks in a run of rows."""
    found = text_words(data, offsets)
    out: dict[tuple[int, int], tuple[float, float]] = {}
    if not len(found.hashes) or not len(index.item_ids):
        return out
    bucket = buckets(found.hashes)
    mass = np.concatenate([[0.0], np.cumsum(index.weights[bucket] ** 2)])
    term = np.append(index.at[bucket], len(index.terms) - 1)
    for size, rows, starts, able in rare_windows(found, index):
        first, window = np.unique(starts, return_inverse=True)
        items = np.flatnonzero(index.window == size)
        wanted = index.vectors[items]
        norms = np.linalg.norm(wanted, axis=1)
        end = np.minimum(first + size, found.bounds[found.row[first] + 1])
        full = np.sqrt(np.maximum(mass[end] - mass[first], 1e-12))
        cosines, close = np.zeros(len(starts)), np.zeros(len(starts), bool)
        order = np.argsort(window, kind="stable")
        for a in range(0, len(first), 512):
            part = slice(a, a + 512)
            place = first[part, None] + np.arange(size)[None, :]
            vectors = index.terms[term[np.where(place < end[part, None], place, len(term) - 1)]].sum(axis=1)
            near = vectors @ wanted.T
            latent = np.maximum(np.linalg.norm(vectors, axis=1)[:, None] * norms[None, :], 1e-12)
            of = order[np.searchsorted(window[order], a) : np.searchsorted(window[order], a + 512)]
            w, i = window[of] - a, np.searchsorted(items, able[of])
            cosines[of] = near[w, i] / latent[w, i]
            close[of] = (near[w, i] >= settings.cosine * full[part][w]) & (cosines[of] >= settings.cosine)
        # near ones first; the others can only be paraphrases that the cosine does not show
        for at in np.argsort(~close, kind="stable").tolist():
            r, start, item = int(rows[at]), int(starts[at]), int(able[at])
            low, high = max(int(found.bounds[r]), start - size // 4), min(int(found.bounds[r + 1]), start + size + size // 4)
            share = confirm(index.held[item], found.hashes[low:high].tolist(), settings)
            if share and share > out.get((r, item), (0, 0))[1]:
                out[r, item] = (float(cosines[at]), share)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``item_id``, ``cosine``, ``common_share``: a row for each document and each item that it leaks."""
    item_kind, kind = benchmark.schema["item_id"].dataType.simpleString(), docs.schema[id_column].dataType.simpleString()
    item_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[item_kind]

    def searched(index: Index) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(index)  # a fixed table of terms, and a block of the benchmark

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            names = ["doc_id", "item_id", "cosine", "common_share"]
            for batch in batches:
                for a, z, data, offsets in wordhash.pieces(batch.column(1)):
                    got = search(data, offsets, index, settings)
                    if got:
                        rows = batch.column(0).slice(a, z - a).take(pa.array([r for r, _ in got], pa.int64()))
                        ids = pa.array([index.item_ids[i] for _, i in got], item_type)
                        yield pa.RecordBatch.from_arrays([rows, ids, pa.array([v[0] for v in got.values()], pa.float64()), pa.array([v[1] for v in got.values()], pa.float64())], names=names)

        return docs.filter(F.col(id_column).isNotNull()).select(id_column, text).mapInArrow(freed(run), f"doc_id {kind}, item_id {item_kind}, cosine double, common_share double")

    return functools.reduce(DataFrame.unionByName, map(searched, build_indexes(docs, benchmark, settings, id_column, text)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id") -> DataFrame:
    """The documents that leak no item; rows with a null id stay."""
    found = leaks(docs, benchmark, settings, id_column).select(F.col("doc_id").alias(id_column)).distinct()
    return docs.join(found, id_column, "left_anti").select(*docs.columns)
