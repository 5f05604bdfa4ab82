"""Language of words and documents by a linear-chain conditional random field.

Every word of a text (a run of letters) has one state, its language.  A state's score is the sum of learned
weights of the word's features: hashed letter n-grams with marked word ends, affixes, and the word itself where
a learned lexicon has it; learned transition weights tie neighbours.  Forward-backward gives each word's
posterior, so a code-switched text gets a label for each word; a document's language is the one with the largest
mean posterior, which is its score.

The model is fitted by stochastic gradients on a bounded sample (``Sampling``): at most so many documents of each
language and so many letters of each.  Some of the training sequences are spliced from texts of several languages,
so transitions between languages are learned too.

The recursions run over segments of 64 words: the segments' transfer matrices are multiplied first, so a text of
any length needs few steps.  Null texts and texts without a letter are ``und`` with score 0, as is every text if
nothing could be learned.  Rows are predicted one by one: repeated rows, ties and other columns do not matter
(equal posteriors: the first language in alphabetical order).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.llm import wordhash
from mosaiq.llm.common import freed, small

TABLE_BITS = 16
SEGMENT = 64
UNKNOWN = "und"


@dataclass(frozen=True)
class Sampling:
    """Bounds of what the model is fitted on."""

    docs_per_language: int = 250
    #: Labels beyond this number are an error: the model and its sample grow with them.
    most_languages: int = 200
    chars_per_doc: int = 1500
    lexicon_words: int = 20_000
    batches: int = 160
    sequence_words: int = 60
    sequences_per_batch: int = 48


@dataclass
class Features:
    """Rows of the weight tables for each word; n-grams lie end to end, from ``gram_at``."""

    grams: np.ndarray
    gram_at: np.ndarray
    affixes: np.ndarray  # (words, 4)
    lexicon: np.ndarray
    bounds: np.ndarray


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray
    affixes: np.ndarray
    words: np.ndarray
    start: np.ndarray
    step: np.ndarray
    lexicon: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))


def features(data: np.ndarray, offsets: np.ndarray, lexicon: np.ndarray) -> Features:
    data = wordhash.lower_utf8(data)
    found = wordhash.words(data, offsets, wordhash.NON_LETTERS)
    start, length = found.start, found.length
    if not len(start):
        none = np.zeros(0, np.int64)
        return Features(none, none, np.zeros((0, 4), np.int64), none, found.bounds)
    gram_at = np.cumsum(length) - length
    at = np.arange(int(length.sum())) + np.repeat(start - gram_at, length)
    here = data[at].astype(np.uint32)
    back, ahead = np.empty_like(here), np.empty_like(here)
    back[1:], ahead[:-1] = here[:-1], here[1:]
    back[gram_at] = 32
    ahead[gram_at + length - 1] = 32
    grams = ((back << np.uint32(16) | here << np.uint32(8) | ahead) * np.uint32(2654435761)) >> np.uint32(32 - TABLE_BITS)
    end = start + length - 1
    padded = np.concatenate([data, np.full(4, 32, np.uint8)]).astype(np.uint32)
    affixes = np.empty((len(start), 4), np.int64)
    for column, (size, front) in enumerate(((3, True), (4, True), (3, False), (4, False))):
        code = np.full(len(start), column, np.uint32)
        for k in range(size):
            byte = np.where(k < length, padded[start + k] if front else padded[end - k], 32)
            code = code * np.uint32(16777619) ^ byte
        affixes[:, column] = (code * np.uint32(2654435761)) >> np.uint32(32 - TABLE_BITS)
    place = np.minimum(np.searchsorted(lexicon, found.hashes), max(len(lexicon) - 1, 0))
    known = lexicon[place] == found.hashes if len(lexicon) else np.zeros(len(start), bool)
    return Features(grams.astype(np.int64), gram_at, affixes, np.where(known, place, len(lexicon)), found.bounds)


def emissions(model: Model, f: Features) -> np.ndarray:
    """Scores of all states for each word."""
    n = len(f.gram_at)
    out = np.empty((n, len(model.languages)), np.float32)
    for k in range(out.shape[1]):
        out[:, k] = np.add.reduceat(model.grams[k][f.grams], f.gram_at) if n else 0
        out[:, k] += model.affixes[k][f.affixes].sum(axis=1) + model.words[k][f.lexicon]
    return out


def posteriors(model: Model, scores: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The probability of each state for each word, given its whole row."""
    n, states = scores.shape
    if not n:
        return scores
    step, begin = np.exp(model.step - model.step.max()).astype(np.float32), np.exp(model.start - model.start.max()).astype(np.float32)
    likely = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float32)
    words = np.diff(bounds)
    of_row = -(-words // SEGMENT)
    first_seg = np.concatenate([[0], np.cumsum(of_row)])
    m = int(first_seg[-1])
    row = np.repeat(np.arange(len(words)), of_row)
    at = bounds[row] + (np.arange(m) - first_seg[row]) * SEGMENT
    place = at[:, None] + np.arange(SEGMENT)[None, :]
    there = place < bounds[row + 1][:, None]
    e = likely[np.minimum(place, n - 1)]
    opening = np.arange(m) == first_seg[row]
    # the product of each segment's matrices
    p = np.where(opening[:, None, None], begin[None, None, :], step[None]) * e[:, :1, :]
    for t in range(1, SEGMENT):
        p = np.where(there[:, t, None, None], (p @ step) * e[:, t, None, :], p)
        p /= p.sum(axis=(1, 2), keepdims=True)
    # from segment to segment, all rows together
    enter, leave = np.full((m, states), 1.0 / states, np.float32), np.ones((m, states), np.float32)
    order = np.argsort(-of_row, kind="stable")
    active = np.searchsorted(-of_row[order], -np.arange(int(of_row.max())), "left")
    v = np.full((len(words), states), 1.0 / states, np.float32)
    for k, a in enumerate(active):
        seg = first_seg[order[:a]] + k
        enter[seg] = v[:a]
        v[:a] = np.einsum("ij,ijk->ik", v[:a], p[seg])
        v[:a] /= v[:a].sum(axis=1, keepdims=True)
    v[:] = 1.0
    for k in range(len(active) - 1, -1, -1):
        a = active[k]
        seg = first_seg[order[:a]] + k
        leave[seg] = v[:a]
        v[:a] = np.einsum("ijk,ik->ij", p[seg], v[:a])
        v[:a] /= v[:a].sum(axis=1, keepdims=True)
    # within segments
    forward = np.empty((m, SEGMENT, states), np.float32)
    now = enter
    for t in range(SEGMENT):
        moved = now @ step
        if t == 0:
            moved[opening] = begin
        now = np.where(there[:, t, None], moved * e[:, t], now)
        now = now / now.sum(axis=1, keepdims=True)
        forward[:, t] = now
    now = leave
    for t in range(SEGMENT - 1, -1, -1):
        forward[:, t] *= now
        moved = (now * e[:, t]) @ step.T
        now = np.where(there[:, t, None], moved, now)
        now = now / now.sum(axis=1, keepdims=True)
    out = np.empty((n, states), np.float32)
    out[place[there]] = forward[there]
    return out / out.sum(axis=1, keepdims=True)


def fit(texts: list[str], labels: list[str], sampling: Sampling = Sampling(), seed: int = 7) -> Model:
    """Fit on whole sample texts with one label each."""
    languages = sorted(set(labels))
    data, offsets = wordhash.buffers(pa.array(texts, pa.string()))
    lowered = wordhash.lower_utf8(data)
    hashes = wordhash.words(lowered, offsets, wordhash.NON_LETTERS).hashes
    unique, seen = np.unique(hashes, return_counts=True)
    often = unique[np.argsort(-seen, kind="stable")[: sampling.lexicon_words]]
    lexicon = np.sort(often[np.isin(often, unique[seen > 1])])
    f = features(data, offsets, lexicon)
    n, size = len(languages), 1 << TABLE_BITS
    model = Model(languages, np.zeros((n, size), np.float32), np.zeros((n, size), np.float32), np.zeros((n, len(lexicon) + 1), np.float32), np.zeros(n), np.zeros((n, n)), lexicon)
    usable = [i for i in range(len(texts)) if f.bounds[i + 1] > f.bounds[i]]
    if n < 2 or not usable:
        return model
    number = {x: i for i, x in enumerate(languages)}
    gram_end = np.append(f.gram_at[1:], len(f.grams))
    rng = np.random.default_rng(seed)
    by_language = [[i for i in usable if number[labels[i]] == k] for k in range(n)]
    by_language = [x for x in by_language if x]
    squares = [np.full_like(x, 1e-2) for x in (model.grams, model.affixes, model.words, model.start, model.step)]

    def stretch(words: int) -> np.ndarray:
        group = by_language[rng.integers(len(by_language))]
        i = group[rng.integers(len(group))]
        a, z = f.bounds[i], f.bounds[i + 1]
        at = a + rng.integers(max(1, z - a - words + 1))
        return np.arange(at, min(z, at + words))

    of_word = np.repeat([number[x] for x in labels], np.diff(f.bounds))
    for _ in range(sampling.batches):
        sequences = []
        for s in range(sampling.sequences_per_batch):
            parts = [stretch(sampling.sequence_words)] if s % 3 else [stretch(int(rng.integers(4, 25))) for _ in range(3)]
            sequences.append(np.concatenate(parts))
        words = np.concatenate(sequences)
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in sequences])])
        grams_of = gram_end[words] - f.gram_at[words]
        pick = np.repeat(f.gram_at[words] - (np.cumsum(grams_of) - grams_of), grams_of) + np.arange(int(grams_of.sum()))
        part = Features(f.grams[pick], np.cumsum(grams_of) - grams_of, f.affixes[words], f.lexicon[words], bounds)
        scores = emissions(model, part)
        wanted, pairs = posteriors(model, scores, bounds), _expected_pairs(model, scores, bounds)
        truth = of_word[words]
        g = -wanted
        g[np.arange(len(words)), truth] += 1.0
        gradients = [np.zeros_like(x) for x in (model.grams, model.affixes, model.words, model.start, model.step)]
        for k in range(n):
            gradients[0][k] = np.bincount(part.grams, np.repeat(g[:, k], grams_of), size)
            gradients[1][k] = np.bincount(part.affixes.ravel(), np.repeat(g[:, k], 4), size)
            gradients[2][k] = np.bincount(part.lexicon, g[:, k], len(lexicon) + 1)
        np.add.at(gradients[3], truth[bounds[:-1]], 1.0)
        gradients[3] -= wanted[bounds[:-1]].sum(axis=0)
        inner = np.setdiff1d(np.arange(len(words) - 1), bounds[1:-1] - 1)
        np.add.at(gradients[4], (truth[inner], truth[inner + 1]), 1.0)
        gradients[4] -= pairs
        for weights, grad, square in zip((model.grams, model.affixes, model.words, model.start, model.step), gradients, squares, strict=True):
            grad = grad / len(sequences) - 1e-5 * weights
            square += grad * grad
            weights += 0.15 * grad / np.sqrt(square)
    return model


def _expected_pairs(model: Model, scores: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Expected number of transitions between states, for short rows."""
    step, begin = np.exp(model.step - model.step.max()), np.exp(model.start - model.start.max())
    likely = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64)
    words, longest = np.diff(bounds), int(np.diff(bounds).max())
    place = np.minimum(bounds[:-1, None] + np.arange(longest)[None, :], len(scores) - 1)
    there = np.arange(longest)[None, :] < words[:, None]
    e = likely[place]
    forward = np.empty_like(e)
    now = begin[None] * e[:, 0]
    forward[:, 0] = now = now / now.sum(axis=1, keepdims=True)
    for t in range(1, longest):
        now = (now @ step) * e[:, t]
        forward[:, t] = now = now / now.sum(axis=1, keepdims=True)
    total = np.zeros_like(step)
    back = np.ones_like(now)
    for t in range(longest - 1, 0, -1):
        both = forward[:, t - 1, :, None] * step[None] * (e[:, t] * back)[:, None, :]
        both *= there[:, t, None, None] / both.sum(axis=(1, 2), keepdims=True)
        total += both.sum(axis=0)
        moved = (e[:, t] * back) @ step.T
        back = np.where(there[:, t, None], moved / moved.sum(axis=1, keepdims=True), 1.0)
    return total


def label_words(model: Model, text: str) -> list[tuple[str, str, float]]:
    """Each word of a text with its language and posterior."""
    data, offsets = wordhash.buffers(pa.array([text], pa.string()))
    f = features(data, offsets, model.lexicon)
    p = posteriors(model, emissions(model, f), f.bounds)
    start, length = wordhash.spans(data, offsets, wordhash.NON_LETTERS)
    raw = data.tobytes()
    best = p.argmax(axis=1) if len(p) else []
    return [(raw[a : a + n].decode("utf-8", "replace"), model.languages[k], float(q[k])) for a, n, k, q in zip(start, length, best, p, strict=True)]


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of the id as text leaves 1 modulo 3."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def training_sample(docs: DataFrame, sampling: Sampling = Sampling(), id_column: str = "doc_id", text: str = "text", label: str = "lang") -> tuple[list[str], list[str]]:
    """At most ``docs_per_language`` documents of each label, those with the least hash of id and text, and
    ``chars_per_doc`` characters from anywhere in each; held-out documents never.  Equal rows count once."""
    able = docs.filter(F.col(label).isNotNull() & F.col(id_column).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(id_column)))
    able = able.select(F.col(id_column).alias("i"), F.col(label).alias("l"), F.col(text).alias("t"), F.xxhash64(id_column, text).alias("h"))
    counts = small(able.groupBy("l").agg(F.count(F.lit(1)).alias("n")))
    if counts.limit(sampling.most_languages + 1).count() > sampling.most_languages:
        raise ValueError(f"more than {sampling.most_languages} labels")
    # of a frequent label, only some twice as many rows as are wanted come to its window
    share = F.pmod(F.col("h"), F.lit(1 << 30)) / float(1 << 30)
    few = able.select("l", "i", "h").join(counts, "l").filter(share <= 2.0 * sampling.docs_per_language / F.col("n") + 1e-9).select("l", "i", "h").distinct()
    rank = F.row_number().over(Window.partitionBy("l").orderBy("h", "i"))
    drawn = few.withColumn("r", rank).filter(F.col("r") <= sampling.docs_per_language).select("l", "i", "h")
    start = F.pmod(F.col("h"), F.greatest(F.length("t") - sampling.chars_per_doc, F.lit(0)) + 1) + 1
    rows = able.join(small(drawn), ["l", "i", "h"], "left_semi").select("l", "i", "h", F.substring("t", start.cast("int"), F.lit(sampling.chars_per_doc)).alias("t"))
    found = rows.groupBy("l", "i", "h").agg(F.min("t").alias("t")).collect()
    found = sorted(found, key=lambda r: (r["l"], r["i"], r["h"]))
    return [r["t"] for r in found], [r["l"] for r in found]


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text", carried: Sequence[str] = ()) -> DataFrame:
    """``held_out``, ``lang_pred``, ``score``, ``n_words``, ``n_switches`` (neighbouring words of different
    languages) for every whole text, row by row; columns to be carried along are named ``_0``, ``_1`` ..."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # tables of a fixed size for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for batch in batches:
            for a, z, data, offsets in wordhash.pieces(batch.column(2)):
                f = features(data, offsets, model.lexicon)
                n = np.diff(f.bounds)
                rows = z - a
                best, score, switches = np.full(rows, len(model.languages)), np.zeros(rows), np.zeros(rows, np.int64)
                lettered = n > 0
                for i in np.flatnonzero(lettered & ~_ascii_letters(data, offsets)):
                    lettered[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
                if model.languages and lettered.any():
                    p = posteriors(model, emissions(model, f), f.bounds)
                    sums = np.add.reduceat(p.astype(np.float64), f.bounds[:-1][n > 0], axis=0)
                    means = np.zeros((rows, p.shape[1]))
                    means[n > 0] = sums / n[n > 0, None]
                    best = np.where(lettered, means.argmax(axis=1), best)
                    score = np.where(lettered, np.minimum(means.max(axis=1), 1.0), 0.0)
                    state = p.argmax(axis=1)
                    row = np.repeat(np.arange(rows), n)
                    change = (state[1:] != state[:-1]) & (row[1:] == row[:-1])
                    switches = np.bincount(row[1:][change], minlength=rows)
                columns = [batch.column(0).slice(a, z - a), batch.column(1).slice(a, z - a), pa.array(names[best], pa.string()), pa.array(score, pa.float64()), pa.array(n, pa.int64()), pa.array(switches, pa.int64())]
                columns += [batch.column(k).slice(a, z - a) for k in range(3, batch.num_columns)]
                yield pa.RecordBatch.from_arrays(columns, names=[id_column, "held_out", "lang_pred", "score", "n_words", "n_switches", *(f"_{k}" for k in range(len(carried)))])

    kind = docs.schema[id_column].dataType.simpleString()
    more = "".join(f", _{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(carried))
    rows = docs.select(id_column, held_out(F.col(id_column)).alias("held_out"), text, *[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(carried)])
    return rows.mapInArrow(freed(run), f"`{id_column}` {kind}, held_out boolean, lang_pred string, score double, n_words long, n_switches long" + more)


def _ascii_letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each row has an ASCII letter."""
    letter = np.concatenate([[0], np.cumsum(~wordhash.NON_LETTERS[data] & (data < 128))])
    return letter[offsets[1:]] > letter[offsets[:-1]]


def identify(docs: DataFrame, sampling: Sampling = Sampling()) -> DataFrame:
    """Fit on the sample and predict every document."""
    return predict(docs, fit(*training_sample(docs, sampling), sampling))


def with_language(docs: DataFrame, least_score: float, sampling: Sampling = Sampling()) -> DataFrame:
    """The rows, all columns as they are, whose text has a language with a score of at least so much; each row by its own
    text, whether or not its id is null or repeated."""
    hashed = docs.select(F.col("doc_id"), F.col("text"), F.xxhash64("text").alias("hash"))
    found = predict(hashed, fit(*training_sample(docs, sampling), sampling), carried=["hash"])
    good = found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)).select(F.col("doc_id").alias("_id"), F.col("_0").alias("_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    return docs.join(good, same, "left_semi").select(*docs.columns)
