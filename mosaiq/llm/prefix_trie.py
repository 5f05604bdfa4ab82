"""Conversations as a trie of shared beginnings, with sums over subtrees by heavy paths.

A node is a sequence of turns with which one conversation or more begin.  Nodes are told apart by a polynomial of their turns'
digests modulo a prime of 127 bits, whose sums are taken in blocks of a conversation, so that a conversation of any length is
spread over tasks.  The heavy child of a node is that with the most conversations (of equals that with the least of them), and
heavy children form paths.  A light child has at most half of its parent's conversations, so no node is below more than log2 of their
number of light ones.  Going along a conversation tells the path and the number of light nodes above each of its nodes; then the
paths are summed from the deepest level up, each as one array of depths (in blocks), and the totals of light paths are added
to their parents, one round for each level.

What meets by node (many conversations at one node, many children of one parent) is summed in each task first, or joined with a
broadcast of at most ``HOT`` nodes, which are all that have more than one of ``HOT`` shares of the rows.  Conversations that end at a node are
hashed in order: their numbers meet in blocks of ids, whose texts run through a hash one after another.

Turns of a conversation are in order of ``turn``, null first; of one turn by the digest of role and text, and repeated rows are
repeated turns.  A null role or text counts as empty.  Rows with a null id belong to no conversation.  Without any
conversation there is no node.  Texts may be very long; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.llm.common import freed, lasting, materialise, scratch

PRIME = (1 << 127) - 1
BASE = int.from_bytes(hashlib.sha256(b"prefix trie").digest()[:15], "big")
#: Turns of a conversation, and nodes of a path, that meet in one task.
BLOCK = 4096
#: Nodes that are broadcast, at most.
HOT = 1000
#: Conversations of the contract share up to HEADS - 1 turns with the first of each FAMILY ids.
HEADS, FAMILY = 4, 20

ROOT = b"\0" * 16


def _block() -> Column:
    return F.expr(f"depth div {BLOCK}").alias("block")


def turns(conversations: DataFrame, id_column: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id``, ``depth`` (from 1), ``mark`` (digest of role and text) and ``words`` of each turn.

    The turns are sorted by ranges of conversation and turn, one beside the other, so a conversation may take many ranges."""
    role, text = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    mark = F.unhex(F.substring(F.sha2(F.concat(F.sha2(role, 256), text), 256), 1, 32))
    rows = conversations.select(F.col(id_column).cast("long").alias("conv_id"), F.col(turn).alias("turn"), mark.alias("mark"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    rows = materialise(rows.filter(F.col("conv_id").isNotNull())).withColumn("tie", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "mark", "tie"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialise(placed.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    ranges = ranges.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return placed.join(ranges, ["conv_id", "part"]).select("conv_id", (F.col("at") - F.col("first") + F.col("base") + 1).alias("depth"), "mark", "words")


def rebuilt(found: DataFrame) -> DataFrame:
    """Conversations that begin as their family's first does: the first h turns of conversation c - c % FAMILY (as many as there
    are), then c's own without its first h; h = crc32(decimal c) % HEADS.  Each has a row of depth 0, too."""
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    found = materialise(found)
    head = F.when(F.col("depth") < HEADS, F.struct("depth", "mark", "words"))
    convs = found.groupBy("conv_id").agg(F.max("depth").alias("n"), F.array_sort(F.collect_list(head)).alias("heads"))
    convs = materialise(convs.withColumn("h", h).withColumn("source", F.col("conv_id") - F.col("conv_id") % FAMILY))
    sources = convs.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("source"), F.col("heads").alias("given"))
    begun = convs.join(sources, "source", "left").withColumn("given", F.slice(F.coalesce("given", F.slice("heads", 1, 0)), F.lit(1), F.col("h")))
    root = F.array(F.struct(F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("mark"), F.lit(0).cast("long").alias("words")))
    first = begun.select("conv_id", F.inline(F.concat(root, "given")))
    # what is not given moves the own turns up; a long conversation meets its shift in several places
    span = 1 << 16
    shift = begun.withColumn("shift", F.size("given") - F.col("h")).filter("shift < 0").select("conv_id", "shift", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"n div {span}"))).alias("salt"))
    own = found.filter(F.col("depth") > h).withColumn("salt", F.expr(f"depth div {span}"))
    own = own.join(shift, ["conv_id", "salt"], "left").select("conv_id", (F.col("depth") + F.coalesce("shift", F.lit(0))).alias("depth"), "mark", "words")
    return materialise(first.unionByName(own))


def with_roots(found: DataFrame) -> DataFrame:
    """Conversations as they are, with their rows of depth 0."""
    roots = found.select("conv_id").distinct().select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("mark"), F.lit(0).cast("long").alias("words"))
    return materialise(roots.unionByName(found))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Polynomials of the turns up to each within its block; rows come in order of conversation, block and depth."""
    last, total, power = None, 0, 0
    for batch in batches:
        keys, before = [], []
        for conv, block, depth, mark in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (conv, block) != last:
                last, total, power = (conv, block), 0, pow(BASE, depth, PRIME)
            before.append(total.to_bytes(16, "big"))
            if depth:
                total = (total + int.from_bytes(mark, "big") % PRIME * power) % PRIME
            power = power * BASE % PRIME
            keys.append(total.to_bytes(16, "big"))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(4), pa.array(keys, pa.binary()), pa.array(before, pa.binary())], names=["conv_id", "block", "depth", "words", "key", "before"])


def _carries(rows: pd.DataFrame) -> pd.DataFrame:
    """What the blocks before each come to; one row for each block of a conversation."""
    rows, total, found = rows.sort_values("block"), 0, []
    for key in rows["key"]:
        found.append(total.to_bytes(16, "big"))
        total = (total + int.from_bytes(key, "big")) % PRIME
    return rows[["conv_id", "block"]].assign(carry=found)


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        carry = [int.from_bytes(x, "big") for x in batch.column(6).to_pylist()]
        moved = [pa.array([((int.from_bytes(x, "big") + c) % PRIME).to_bytes(16, "big") for x, c in zip(batch.column(i).to_pylist(), carry, strict=True)], pa.binary()) for i in (4, 5)]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), *moved], names=batch.schema.names[:6])


def keyed(steps: DataFrame) -> tuple[DataFrame, bool]:
    """Steps with the ``key`` of their node and that of its parent (``before``), and whether any has more than one block."""
    rows = steps.select("conv_id", _block(), "depth", "mark", "words").repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "depth")
    rows = materialise(rows.mapInArrow(freed(_sums), "conv_id long, block long, depth long, words long, key binary, before binary"))
    long = rows.filter("block > 0").select("conv_id").distinct()
    if long.isEmpty():
        return rows, False
    sums = rows.groupBy("conv_id", "block").agg(F.max_by("key", "depth").alias("key")).join(long, "conv_id")
    carries = sums.groupBy("conv_id").applyInPandas(_carries, "conv_id long, block long, carry binary").filter("block > 0")
    both = materialise(rows.join(carries, ["conv_id", "block"], "left").select(*rows.columns, "carry"))
    return materialise(both.filter("carry is null").drop("carry").unionByName(both.filter("carry is not null").mapInArrow(freed(_carried), rows.schema.simpleString()[7:-1]))), True


def _joined(rows: DataFrame, nodes: DataFrame, weight: str, on: list[str], n_rows: int) -> DataFrame:
    """Each row with its node, where ``weight`` says how many rows a node has: those with more than one of HOT shares are broadcast
    (fewer than HOT, as the weights add up to the rows), the others meet by hash."""
    hot = F.col(weight) > n_rows / HOT
    often = F.broadcast(nodes.filter(hot).drop(weight))
    rest = rows.join(F.broadcast(nodes.filter(hot).select(on)), on, "left_anti").join(nodes.filter(~hot).drop(weight), on)
    return rows.join(often, on).unionByName(rest)


def _above(rows: DataFrame, long: bool) -> DataFrame:
    """``path`` (key of the last light node at or above) and ``level`` (light nodes so far, the root apart) along each
    conversation."""
    within = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    key = F.when(F.col("light"), F.col("key"))
    rows = rows.withColumns({"path": F.last(key, ignorenulls=True).over(within), "level": F.sum(F.col("light").cast("long")).over(within)})
    if long:
        blocks = rows.groupBy("conv_id", "block").agg(F.max_by("path", "depth").alias("p"), F.max("level").alias("l"))
        before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        blocks = blocks.select("conv_id", "block", F.last("p", ignorenulls=True).over(before).alias("p"), F.sum("l").over(before).alias("l")).filter("block > 0")
        rows = rows.join(blocks, ["conv_id", "block"], "left")
        rows = rows.withColumns({"path": F.coalesce("path", "p"), "level": F.col("level") + F.coalesce("l", F.lit(0))}).drop("p", "l")
    return rows.withColumn("level", F.col("level") - 1)


def _below(nodes: DataFrame, sums: list[str], long: bool) -> DataFrame:
    """Sums from each node of a path to its end."""
    within = Window.partitionBy("path", "block").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = nodes.withColumns({c: F.sum(c).over(within) for c in sums})
    if long:
        after = Window.partitionBy("path").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
        blocks = nodes.groupBy("path", "block").agg(*[F.sum(c).alias(c) for c in sums])
        blocks = blocks.select("path", "block", *[F.sum(c).over(after).alias(f"after_{c}") for c in sums]).filter(f"after_{sums[0]} is not null")
        found = found.join(blocks, ["path", "block"], "left")
        found = found.withColumns({c: F.col(c) + F.coalesce(f"after_{c}", F.lit(0)) for c in sums}).drop(*[f"after_{c}" for c in sums])
    return found


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each key of what comes in order of key and part."""
    last, state = None, None
    for batch in batches:
        keys, digests = [], []
        for key, listed in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if key == last:
                state.update(b",")
            else:
                if state:
                    keys.append(last)
                    digests.append(state.hexdigest())
                last, state = key, hashlib.sha256()
            state.update(listed.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], names=["key", "ends_sha256"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["key", "ends_sha256"])


def ends(rows: DataFrame) -> DataFrame:
    """``ends_sha256`` of each node at which conversations end: the hash of their ids in order.  Up to BLOCK ids meet in one text;
    the texts of a node run through one task one by one, as a hash must."""
    last = rows.groupBy("conv_id").agg(F.max_by("key", "depth").alias("key"))
    lists = last.groupBy("key", F.shiftright("conv_id", 12).alias("part")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("listed"))
    return lists.repartition("key").sortWithinPartitions("key", "part").mapInArrow(_hashed, "key binary, ends_sha256 string")


def trie(steps: DataFrame) -> DataFrame:
    """One row for each node of the conversations ``conv_id, depth, mark, words`` (one for each depth from 0)."""
    rows, long = keyed(steps)
    n_rows = rows.count()
    nodes = rows.groupBy("depth", "key").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"), F.min("before").alias("before"))
    nodes = materialise(nodes)
    first = F.max_by("key", F.struct("n_convs", F.bitwise_not("conv_id"))).alias("heavy")
    of_parent = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("before").alias("key")).agg(F.count(F.lit(1)).alias("n_children"), first)
    nodes = materialise(nodes.join(of_parent, ["depth", "key"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    parents = nodes.filter("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("key").alias("before"), F.col("conv_id").alias("parent_conv_id"), "heavy", "n_children")
    children = _joined(nodes.filter("depth > 0").drop("heavy"), parents.withColumnRenamed("n_children", "weight"), "weight", ["depth", "before"], n_rows)
    children = children.select("depth", "key", "conv_id", "n_convs", "words", "before", "n_children", "parent_conv_id", (F.col("key") != F.col("heavy")).alias("light"))
    root = nodes.filter("depth = 0").select("depth", "key", "conv_id", "n_convs", "words", F.lit(None).cast("binary").alias("before"), "n_children", F.lit(None).cast("long").alias("parent_conv_id"), F.lit(True).alias("light"))
    nodes = materialise(children.unionByName(root).join(ends(rows), "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))))

    flags = nodes.select("depth", "key", "light", F.col("conv_id").alias("owner"), "n_convs")
    chains = _above(_joined(rows.select("conv_id", "block", "depth", "key"), flags, "n_convs", ["depth", "key"], n_rows), long)
    placed = chains.filter("conv_id = owner").select("key", "path", "level")
    own = nodes.join(placed, "key").withColumns({"block": _block(), "n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")})
    own = materialise(own.drop("light", "words"), by=["level"])

    sums, more, found = ["n_leaves", "saved_tokens"], None, None
    for level in range(own.agg(F.max("level")).first()[0] or 0, -1, -1):
        here = own.filter(F.col("level") == level)
        if more is not None:
            added = {c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in sums}
            here = here.join(more, "key", "left").withColumns(added).drop(*[f"more_{c}" for c in sums])
        here = materialise(_below(here, sums, long))
        more = here.filter("key = path").groupBy(F.col("before").alias("key")).agg(*[F.sum(c).alias(f"more_{c}") for c in sums])
        found = here if found is None else found.unionByName(here)
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *sums, "ends_sha256")


def shared_beginnings(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations; what is written on the way to it goes."""
    with scratch(conversations.sparkSession):
        return lasting(trie(rebuilt(turns(conversations))))


def oracle_sql() -> str:
    """Nodes by their whole sequences, subtrees by comparing beginnings."""
    crc = "xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), 4294967295), 4294967295)"
    return f"""
WITH m AS (SELECT conv_id, turn, sha256(sha256(coalesce(role, '')) || coalesce(text, '')) AS mark, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(mark, 32)) AS k FROM m),
c AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS src, {crc} % {HEADS} AS h FROM (SELECT DISTINCT conv_id FROM t)),
s AS (SELECT c.*, least(h, coalesce(x.n, 0)) AS given FROM c LEFT JOIN (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id) AS x ON x.conv_id = src),
r AS (SELECT s.conv_id, k AS depth, mark, words FROM s JOIN t ON t.conv_id = src AND k <= h
  UNION ALL SELECT s.conv_id, k - h + given, mark, words FROM s JOIN t ON t.conv_id = s.conv_id AND k > h
  UNION ALL SELECT conv_id, 0, '', 0 FROM s),
p AS (SELECT conv_id, depth, words, string_agg(mark, '') OVER (PARTITION BY conv_id ORDER BY depth) AS key, depth = max(depth) OVER (PARTITION BY conv_id) AS over FROM r),
n AS (SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (over), '')) AS ends_sha256 FROM p GROUP BY depth, key),
k AS (SELECT n.*, u.conv_id AS parent FROM n LEFT JOIN p AS q ON q.conv_id = n.conv_id AND q.depth = n.depth - 1 LEFT JOIN n AS u ON u.depth = q.depth AND u.key = q.key),
f AS (SELECT k.*, coalesce(w.n, 0) AS n_children FROM k LEFT JOIN (SELECT parent, depth - 1 AS depth, count(*) AS n FROM k WHERE depth > 0 GROUP BY ALL) AS w ON w.parent = k.conv_id AND w.depth = k.depth),
b AS (SELECT q.depth, q.key, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * f.words) AS BIGINT) AS saved FROM f JOIN p AS q ON q.conv_id = f.conv_id AND q.depth <= f.depth GROUP BY q.depth, q.key)
SELECT conv_id, CAST(f.depth AS BIGINT) AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, saved AS saved_tokens, ends_sha256 FROM f JOIN b USING (depth, key)
"""
