"""Near duplicates by ProbMinHash of weighted word shingles, banding, and verification.

A text's shingles (five words; the words of a shorter text are one shingle) are weighted by how often they occur.
Each shingle is a Poisson process whose rate is its weight; arrivals fall on random components of the signature, and
a component keeps its first arrival.  Two texts agree in a component with the probability Jaccard similarity of
their weights.  A shingle's process stops as soon as its next arrival is later than all kept ones.

Texts that are equal word for word are one *text class* first, so only one of them is banded and compared.  Within a
band's bucket no pairs of all members are made.  The bucket's most central text (the one that shares buckets with most
texts; of an original and its edited copies, the original) is compared with all members, and components of the verified
links are found.  What is left are pairs of different components in one bucket, and each is compared unless one of two
exact filters rules it out; nothing is stopped early.  A link is a probability Jaccard similarity of 0.8 or more, computed
from the texts themselves.

Where both texts are like the bucket's central text (``NEAR``), they are told apart by what each changes in it
(``changed_pairs``).  Let D be the shingles that only one of a text and the central one has.  Two texts that share s of
their D differ in at least |D1| + |D2| - 2 s shingles, and the larger weights of all shingles add up to the central
text's weight and what either text adds to it at most; a link allows differences of a fifth of that.  So s is bounded
from below, and texts of different components meet only if their rarest changes leave room for s common ones.  Copies of
one source that were edited independently share few changes, so a large group of them leaves few pairs.

Of the other pairs one text is unlike the central one, so the other is less than NEAR + 0.2 similar to it (1 - similarity is
a metric, as similarity is the probability that hashes agree).  Such texts list their shingles, rarest first, as far as a
link can have its first common shingle there, and texts of different components that meet in one are compared
(``open_pairs``).

The bound there: let a and b be the odds (share by weight, divided by the rest) of what each of two texts has outside the other.
Their similarity is at most 1 / (1 + a + b), as each common shingle adds a concave, homogeneous function of its two
shares.  In any order of the shingles, all that a text has before the first common one is outside the other text.

Null texts and texts without a word have no shingle and are classes of their own.  Rows with equal ids are one
document, whose text is the least of theirs; rows with a null id are left out.  Other columns are ignored.  Ties are broken
by the least id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.llm import wordhash
from mosaiq.llm.common import freed, lasting, materialise, released_shuffles, scratch, small
from mosaiq.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 20
BAND_ROWS = 5
#: Counters of the shingles' frequencies; they only order the shingles, so that two may share one.
SLOT_BITS = 18
#: Texts that are so similar to their bucket's central text are told apart by their changes of it.
NEAR = 0.5


def weighted_shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row, row by row: hash, row, weight."""
    found = wordhash.words(data, offsets)
    hashes, rows = wordhash.windows(found.hashes, found.bounds, size)
    if not len(hashes):
        return hashes, rows, np.zeros(0)
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    first = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])]))
    return hashes[first], rows[first], np.diff(np.append(first, len(hashes))).astype(np.float64)


def signatures(hashes: np.ndarray, rows: np.ndarray, weights: np.ndarray, n_rows: int, size: int) -> np.ndarray:
    """ProbMinHash signatures, one line for each row; the lines of rows without a shingle are 0."""
    best = np.full(n_rows * size, np.inf)
    owner = np.zeros(n_rows * size, np.uint64)
    limit = np.full(n_rows, np.inf)
    seed, time, live_rows, rate = wordhash.mix64(hashes), np.zeros(len(hashes)), rows, weights
    arrival = 0
    while len(seed):
        arrival += 1
        seed = wordhash.mix64(seed + np.uint64(0x9E3779B97F4A7C15))
        time = time - np.log(wordhash.unit(seed)) / rate
        # early termination: no later arrival of this shingle can be kept
        keep = np.flatnonzero(time < limit[live_rows])
        seed, time, live_rows, rate, hashes = seed[keep], time[keep], live_rows[keep], rate[keep], hashes[keep]
        slot = live_rows * size + (wordhash.mix64(seed ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(size)).astype(np.int64)
        order = np.lexsort((time, slot))
        lead = order[np.concatenate([[True], slot[order][1:] != slot[order][:-1]])] if len(order) else order
        won = lead[time[lead] < best[slot[lead]]]
        best[slot[won]] = time[won]
        owner[slot[won]] = hashes[won]
        touched = np.unique(live_rows)
        limit[touched] = best.reshape(n_rows, size)[touched].max(axis=1)
    return owner.reshape(n_rows, size)


def band_hashes(signature: np.ndarray, bands: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows)
    out = np.zeros((len(signature), bands), np.uint64)
    for r in range(rows):
        out = wordhash.mix64(out + parts[:, :, r] + np.uint64(r + 1))
    return wordhash.mix64(out + np.arange(1, bands + 1, dtype=np.uint64)[None, :])


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard similarity of two texts, each given as sorted shingle hashes and weights."""
    (ha, wa), (hb, wb) = a, b
    common, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    if len(common) == len(ha) == len(hb) and np.array_equal(wa * wb.sum(), wb * wa.sum()):
        return 1.0
    if wa.max() == wa.min() == wb.max() == wb.min():  # sets
        return len(common) / (len(ha) + len(hb) - len(common))
    # sum over common i of 1 / sum_j max(a_j / a_i, b_j / b_i): with the ratio r_j = a_j / b_j sorted, the inner sum is
    # (mass of a where r_j > r_i) / a_i + (mass of b where r_j <= r_i) / b_i
    union = np.union1d(ha, hb)
    xa, xb = np.zeros(len(union)), np.zeros(len(union))
    xa[np.searchsorted(union, ha)], xb[np.searchsorted(union, hb)] = wa, wb
    with np.errstate(divide="ignore"):
        ratio = np.where(xb > 0, xa / np.where(xb > 0, xb, 1.0), np.inf)
    order = np.argsort(ratio, kind="stable")
    low = np.concatenate([[0.0], np.cumsum(xb[order])])
    high = xa.sum() - np.concatenate([[0.0], np.cumsum(xa[order])])
    r = wa[ia] / wb[ib]
    upto = np.searchsorted(ratio[order], r, "right")
    return float((1.0 / (high[upto] / wa[ia] + low[upto] / wb[ib])).sum())


def sketch(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``text_class`` (128-bit hash of the words in order; null without a word), ``bands``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z, data, offsets in wordhash.pieces(batch.column(1)):
                n = z - a
                found = wordhash.words(data, offsets)
                counts = np.diff(found.bounds)
                order = (np.arange(len(found.hashes)) - np.repeat(found.bounds[:-1], counts)).astype(np.uint64)
                digest = np.zeros((n, 2), np.uint64)
                some = np.flatnonzero(counts)
                for k in range(2):
                    mixed = wordhash.mix64(found.hashes ^ wordhash.mix64(order * np.uint64(2) + np.uint64(k)))
                    if len(some):
                        digest[some, k] = np.add.reduceat(mixed, found.bounds[:-1][some])
                bands = band_hashes(signatures(*weighted_shingles(data, offsets), n, BANDS * BAND_ROWS)).view(np.int64)
                classes = pa.array([digest[i].tobytes() if counts[i] else None for i in range(n)], pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(bands.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), classes, lists], names=["doc_id", "text_class", "bands"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.filter(F.col(id_column).isNotNull()).select(id_column, text).mapInArrow(freed(run), f"doc_id {kind}, text_class binary, bands array<long>")


def _with_texts(pairs: DataFrame, docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """Pairs ``u``, ``v`` with the texts ``tu``, ``tv`` of both; only texts of some pair are moved."""
    ids = small(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct())
    texts = docs.select(F.col(id_column).alias("id"), F.col(text).alias("t")).join(ids, "id", "left_semi")
    return pairs.join(texts.select(F.col("id").alias("v"), F.col("t").alias("tv")), "v").join(texts.select(F.col("id").alias("u"), F.col("t").alias("tu")), "u")


def _row_shingles(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted hashes and weights of each row's shingles."""
    out = []
    for a, z, data, offsets in wordhash.pieces(column):
        hashes, rows, weights = weighted_shingles(data, offsets)
        at = np.searchsorted(rows, np.arange(z - a + 1))
        out += [(hashes[at[i] : at[i + 1]], weights[at[i] : at[i + 1]]) for i in range(z - a)]
    return out


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, as the shingles of all rows of one are held at once."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def verify(pairs: DataFrame, docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The pairs ``u``, ``v`` with the ``similarity`` of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found = [similarity(a, b) for a, b in zip(_row_shingles(batch.column(2)), _row_shingles(batch.column(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["u", "v", "similarity"])

    kind = docs.schema[id_column].dataType.simpleString()
    return _with_texts(pairs, docs, id_column, text).select("u", "v", "tu", "tv").mapInArrow(freed(run), f"u {kind}, v {kind}, similarity double")


def linked(threshold: float) -> Column:
    return F.col("similarity") >= threshold - 1e-9


def _text_shingles(column: pa.Array) -> Iterator[np.ndarray]:
    for _, _, data, offsets in wordhash.pieces(column):
        yield weighted_shingles(data, offsets)[0]


def _listed_shingles(column: pa.Array) -> Iterator[np.ndarray]:
    yield column.flatten().to_numpy().view(np.uint64)


def _frequencies(rows: DataFrame, shingles: Callable[[pa.Array], Iterator[np.ndarray]]) -> np.ndarray:
    """How many of the rows of one column have a shingle of each slot; each task sums its own, the result has a fixed
    size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            for hashes in shingles(batch.column(0)):
                total += np.bincount(_slots(hashes), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["slot", "n"])

    rows = rows.mapInArrow(freed(run), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << SLOT_BITS, np.int64)
    out[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return out


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def most_odds(threshold: float) -> float:
    """The most that the odds of what two linked texts have outside each other can sum up to."""
    return 1.0 / (threshold - 1e-9) - 1.0 + 1e-9


def prefix(hashes: np.ndarray, rows: np.ndarray, weights: np.ndarray, frequencies: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, odds of the weight before it, of each row's shingles in which a link can have its first common one."""
    order = np.lexsort((hashes, frequencies[_slots(hashes)], rows))
    hashes, rows, weights = hashes[order], rows[order], weights[order]
    before = np.cumsum(weights) - weights
    first = np.searchsorted(rows, rows)
    before = before - before[first]
    total = np.bincount(rows, weights)[rows] if len(rows) else before
    odds = before / (total - before)
    keep = odds <= most
    return hashes[keep], rows[keep], odds[keep]


def open_pairs(texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``u``, ``v`` of texts (``id``, ``t``, ``part``) of different parts that can be linked."""
    most, kind = most_odds(threshold), texts.schema["id"].dataType.simpleString()
    shared = texts.sparkSession.sparkContext.broadcast(_frequencies(texts.select("t"), _text_shingles))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z, data, offsets in wordhash.pieces(batch.column(1)):
                hashes, rows, odds = prefix(*weighted_shingles(data, offsets), shared.value, most)
                ids, parts = (batch.column(k).slice(a, z - a).take(pa.array(rows, pa.int64())) for k in (0, 2))
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64), pa.int64()), ids, parts, pa.array(odds, pa.float64())], names=["shingle", "id", "part", "odds"])

    entries = materialise(texts.select("id", "t", "part").mapInArrow(freed(run), f"shingle long, id {kind}, part {kind}, odds double"))
    # parts meet first, so the texts of one part are never paired with each other
    heads = entries.groupBy("shingle", "part").agg(F.min("odds").alias("least"))
    mixed = heads.groupBy("shingle").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a <> b").select("shingle")
    heads = materialise(heads.join(mixed, "shingle"))
    low, high = (heads.select("shingle", F.col("part").alias(f"part_{k}"), F.col("least").alias(f"least_{k}")) for k in "ab")
    couples = low.join(high, "shingle").filter((F.col("part_a") < F.col("part_b")) & (F.col("least_a") + F.col("least_b") <= most))
    one, other = (entries.select("shingle", F.col("part").alias(f"part_{k}"), F.col("id").alias(f"id_{k}"), F.col("odds").alias(f"odds_{k}")) for k in "ab")
    met = couples.join(one, ["shingle", "part_a"]).filter(F.col("odds_a") + F.col("least_b") <= most).join(other, ["shingle", "part_b"]).filter(F.col("odds_a") + F.col("odds_b") <= most)
    return met.select(F.least("id_a", "id_b").alias("u"), F.greatest("id_a", "id_b").alias("v")).distinct()


def changes(central: tuple[np.ndarray, np.ndarray], own: tuple[np.ndarray, np.ndarray], threshold: float) -> tuple[np.ndarray, float, float]:
    """The shingles that only one of two texts has; their number less a fifth of what ``own`` adds in weight, and a fifth
    of the weight of ``central`` (a fifth is 1 - threshold)."""
    (hc, wc), (ho, wo) = central, own
    common, ic, io = np.intersect1d(hc, ho, assume_unique=True, return_indices=True)
    more = wo.sum() - wo[io].sum() + np.maximum(wo[io] - wc[ic], 0).sum()
    part = 1.0 - threshold + 1e-9
    d = np.setxor1d(hc, ho, assume_unique=True)
    return d, len(d) - part * more, part * wc.sum()


def changed_pairs(near: DataFrame, docs: DataFrame, threshold: float, id_column: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The pairs ``u``, ``v`` of different parts that their changes of one ``leader`` do not tell apart; and the leaders
    of which a text has more weight of repeated shingles than these counts allow for.

    near has ``leader``, ``id``, ``part``, ``similarity``.  A pair needs (extra1 + extra2 - room) / 2 common changes; one of
    two texts of different parts is not linked to the leader, so its extra is beyond the room."""
    kind = docs.schema[id_column].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found = [changes(c, o, threshold) for o, c in zip(_row_shingles(batch.column(4)), _row_shingles(batch.column(5)), strict=True)]
            bounds = np.cumsum([0, *(len(f[0]) for f in found)])
            flat = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat.view(np.int64), pa.int64()))
            extra, room = (pa.array([f[k] for f in found], pa.float64()) for k in (1, 2))
            yield pa.RecordBatch.from_arrays([lists, *batch.columns[:4], extra, room], names=["changed", "leader", "id", "part", "linked", "extra", "room"])

    pairs = near.select(F.col("id").alias("u"), F.col("leader").alias("v"), "part", linked(threshold).alias("linked"))
    both = _with_texts(pairs, docs, id_column, text).select("v", "u", "part", "linked", "tu", "tv")
    found = materialise(both.mapInArrow(freed(compare), f"changed array<long>, leader {kind}, id {kind}, part {kind}, linked boolean, extra double, room double"))
    loose = found.filter("extra < 0 or (not linked and extra <= room)").select("leader").distinct()
    shared = docs.sparkSession.sparkContext.broadcast(_frequencies(found.select("changed"), _listed_shingles))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, flat = np.diff(batch.column(0).offsets.to_numpy()), batch.column(0).flatten().to_numpy().view(np.uint64)
            row = np.repeat(np.arange(len(lengths)), lengths)
            order = np.lexsort((flat, shared.value[_slots(flat)], row))
            left = lengths[row] - (np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths))
            extra, room = (batch.column(k).to_numpy() for k in (5, 6))
            least = (extra - np.where(batch.column(4).to_numpy(zero_copy_only=False), 0.0, room)) / 2 - 1e-6
            keep = np.flatnonzero(left >= np.maximum(least, 1)[row])
            rows = pa.array(row[keep], pa.int64())
            columns = [batch.column(k).take(rows) for k in (1, 2, 3, 5, 6)]
            yield pa.RecordBatch.from_arrays([pa.array(flat[order][keep].view(np.int64), pa.int64()), pa.array(left[keep], pa.int64()), *columns], names=["shingle", "room_left", "leader", "id", "part", "extra", "room"])

    entries = materialise(found.mapInArrow(freed(heads), f"shingle long, room_left long, leader {kind}, id {kind}, part {kind}, extra double, room double"))
    place = ["leader", "shingle"]
    tops = entries.groupBy(*place, "part").agg(F.max("room_left").alias("most"), F.min("extra").alias("least"), F.max("room").alias("room"))
    mixed = tops.groupBy(*place).agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a <> b").select(*place)
    tops = materialise(tops.join(mixed, place))
    meets = lambda a, b, x, y: F.least(a, b) >= (F.col(x) + F.col(y) - F.col("room")) / 2 - 1e-6
    one = tops.select(*place, F.col("part").alias("part_a"), F.col("most").alias("most_a"), F.col("least").alias("least_a"), "room")
    two = tops.select(*place, F.col("part").alias("part_b"), F.col("most").alias("most_b"), F.col("least").alias("least_b"))
    couples = one.join(two, place).filter((F.col("part_a") < F.col("part_b")) & meets("most_a", "most_b", "least_a", "least_b"))
    a, b = (entries.select(*place, F.col("part").alias(f"part_{k}"), F.col("id").alias(f"id_{k}"), F.col("room_left").alias(f"left_{k}"), F.col("extra").alias(f"extra_{k}")) for k in "ab")
    met = couples.join(a, [*place, "part_a"]).filter(meets("left_a", "most_b", "extra_a", "least_b")).join(b, [*place, "part_b"]).filter(meets("left_a", "left_b", "extra_a", "extra_b"))
    return met.select(F.least("id_a", "id_b").alias("u"), F.greatest("id_a", "id_b").alias("v")).distinct(), loose


def linked_parts(firsts: DataFrame, docs: DataFrame, threshold: float, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``node``, ``component`` of the texts that have a link; firsts has ``doc_id``, ``bands``."""
    buckets = firsts.select("doc_id", F.explode("bands").alias("bucket"))
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = materialise(buckets.join(sizes, "bucket"))
    central = members.groupBy("doc_id").agg(F.sum("n").alias("central"))
    members = materialise(members.drop("n").join(central, "doc_id"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.col("central").desc(), "doc_id"))
    leaders = materialise(members.withColumn("r", rank).filter("r = 1").select("bucket", F.col("doc_id").alias("leader")))
    led = members.join(leaders, "bucket").filter(F.col("doc_id") != F.col("leader"))
    tried = materialise(verify(led.select(F.least("doc_id", "leader").alias("u"), F.greatest("doc_id", "leader").alias("v")).distinct(), docs, id_column, text))
    parts = materialise(components(tried.filter(linked(threshold)).select("u", "v")))
    # the pairs that are neither compared nor of one component are of members that do not lead their bucket
    placed = materialise(led.select("bucket", "doc_id", "leader").join(parts, F.col("doc_id") == F.col("node"), "left").select("bucket", "leader", F.col("doc_id").alias("id"), F.coalesce("component", "doc_id").alias("part")))
    mixed = placed.groupBy("bucket").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a <> b").select("bucket")
    unsettled = placed.join(small(mixed), "bucket").select("leader", "id", "part").distinct()
    unsettled = unsettled.withColumn("u", F.least("id", "leader")).withColumn("v", F.greatest("id", "leader"))
    unsettled = materialise(unsettled.join(tried, ["u", "v"]).select("leader", "id", "part", "similarity"))
    if unsettled.isEmpty():
        return parts
    changed, loose = changed_pairs(unsettled.filter(F.col("similarity") >= NEAR), docs, threshold, id_column, text)
    far = unsettled.filter(F.col("similarity") < NEAR).select("leader").distinct()
    unlike = unsettled.filter(F.col("similarity") < NEAR + 1.0 - threshold + 1e-6).join(far, "leader", "left_semi").unionByName(unsettled.join(loose, "leader", "left_semi"))
    unlike = small(unlike.select("id", "part").distinct())
    texts = materialise(docs.select(F.col(id_column).alias("id"), F.col(text).alias("t")).join(unlike, "id").select("id", "t", "part"))
    pairs = materialise(open_pairs(texts, threshold).unionByName(changed).distinct().join(tried.select("u", "v"), ["u", "v"], "left_anti"))
    more = verify(pairs, docs, id_column, text).filter(linked(threshold)).select("u", "v")
    return components(more.unionByName(parts.select(F.col("node").alias("u"), F.col("component").alias("v"))))


def classes(docs: DataFrame, threshold: float = THRESHOLD, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``class_id`` (the least id of the class), ``text_class_id`` (the least id with the same words) of
    every document."""
    spark = docs.sparkSession
    if _repeats(docs, id_column):
        docs = materialise(docs.groupBy(id_column).agg(F.min(text).alias(text)))
    with released_shuffles(spark):
        sketches = materialise(sketch(docs, id_column, text))
        firsts = materialise(sketches.filter(F.col("text_class").isNotNull()).groupBy("text_class").agg(F.min(F.struct("doc_id", "bands")).alias("f")).select("text_class", "f.*"))
        with scratch(spark):
            parts = lasting(linked_parts(firsts, docs, threshold, id_column, text))
        of_text = firsts.join(parts, firsts["doc_id"] == parts["node"], "left").select("text_class", F.col("doc_id").alias("text_class_id"), F.coalesce("component", "doc_id").alias("class_id"))
    placed = sketches.select("doc_id", "text_class").join(of_text, "text_class", "left")
    return placed.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("text_class_id", "doc_id").alias("text_class_id"))


def _repeats(docs: DataFrame, id_column: str) -> bool:
    """Whether an id occurs twice; only ids are read."""
    ids = docs.filter(F.col(id_column).isNotNull()).groupBy(id_column).agg(F.count(F.lit(1)).alias("n"))
    return not ids.filter("n > 1").isEmpty()


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one, that of the least id, of each class; rows with a null id stay as they are.  Of rows with
    one id that with the least text stays."""
    keep = classes(docs, id_column=id_column, text=text).filter(F.col("doc_id") == F.col("class_id")).select(F.col("doc_id").alias(id_column)).distinct()
    kept = docs.filter(F.col(id_column).isNotNull())
    if _repeats(docs, id_column):
        first = Window.partitionBy(id_column).orderBy(F.col(text).asc_nulls_last(), F.xxhash64(*docs.columns))
        kept = kept.withColumn("_row", F.row_number().over(first)).filter("_row = 1")
    return kept.join(keep, id_column, "left_semi").select(*docs.columns).unionByName(docs.filter(F.col(id_column).isNull()))
