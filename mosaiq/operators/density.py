"""Clusters by density of any number of rows: a spanning tree by Borůvka's rounds and a condensed tree, over many tasks.

1. Equal points become one with a weight.  The points are cut into cells by medians of a bounded sample; cells have boxes.
2. A point's core distance is that to its ``least``-th neighbour: first within its cell, then in all cells nearer than that.
3. Rounds: each component looks for its least edge out (the larger of distance and both core distances; of equal ones the least
   ends).  First each cell meets the nearest cell that holds another component, which bounds all components; then all pairs of
   cells whose boxes are within a bound meet.  Components tied by their edges become one.
   In more than a few dimensions all boxes overlap, so there all pairs of points meet once only, in large parts, for lists of each
   point's nearest.  A component's least edge is in these lists unless it is longer than what they leave out; the components that
   do not know theirs wait for others to join them, and once they are most of all, their points look for it among all others, but
   those of the largest, which the others come to.
4. Components below ``least`` points that point along their least edges to a larger one leave the tree there; pairs that
   point at each other become one.  What is left are the clusters that are born, and the edges between them.
5. The tree of these births and merges is a few numbers for each cluster, in one place; how long points stay in each is summed in
   Spark, and the most stable clusters are chosen from the leaves up.

Merges of equal length happen at once, so the result does not depend on the order of ties.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.operators import neighbours
from mosaiq.operators.iteration import saved
from mosaiq.operators.objects import least_linked


#: Dimensions up to which the boxes of small cells rule out most pairs.
NARROW = 3


@dataclass(frozen=True)
class Spread:
    #: Points that a cell holds by the sample, and cells at most.
    cell: int = 2_000
    most_cells: int = 1_024
    #: Rows that the cells are cut by; every row is put into a cell.
    sample: int = 20_000
    #: In more than NARROW dimensions, points that a cell holds by the sample, and the nearest that each point lists at least.
    wide: int = 32_768
    listed: int = 16
    #: Clusters that are born anywhere; their tree is held in one place, so more are an error.
    most_clusters: int = 2_000_000


def _cuts(points: np.ndarray, cells: int) -> list[tuple[int, float, int, int]]:
    """A tree of cuts (dimension, value, next below or at the value, next above); a next below 0 is cell -1 - next."""
    tree: list[list] = []
    count = 0

    def cut(part: np.ndarray, left: int) -> int:
        nonlocal count
        spread = np.ptp(part, axis=0) if len(part) else np.zeros(1)
        d = int(spread.argmax())
        if left < 2 or len(part) < 2 or not spread[d] > 0:
            count += 1
            return -count
        at = float(np.median(part[:, d]))
        if at >= part[:, d].max():
            at = float(part[part[:, d] < at, d].max())
        here = len(tree)
        tree.append([d, at, 0, 0])
        low = part[:, d] <= at
        tree[here][2] = cut(part[low], left // 2)
        tree[here][3] = cut(part[~low], left - left // 2)
        return here

    cut(points, cells)
    return [tuple(x) for x in tree]


def _placed(points: np.ndarray, tree: list[tuple[int, float, int, int]]) -> np.ndarray:
    at = np.zeros(len(points), np.int64) if tree else np.full(len(points), -1)
    while (going := np.flatnonzero(at >= 0)).size:
        node = at[going]
        dims, values, low, high = (np.array([x[i] for x in tree]) for i in range(4))
        at[going] = np.where(points[going, dims[node]] <= values[node], low[node], high[node])
    return -1 - at


def in_cells(points: DataFrame, n: int, how: Spread, cell: int | None = None) -> DataFrame:
    """``p, weight, v`` with ``cell``."""
    share = how.sample / max(n, 1)
    drawn = points.filter(F.pmod(F.xxhash64("p"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("v").limit(2 * how.sample)
    sample = np.array([r[0] for r in drawn.collect()], float)
    cells = max(1, min(how.most_cells, -(-n // (cell or how.cell))))
    tree = _cuts(sample.reshape(len(sample), -1), cells) if len(sample) else []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield frame.assign(cell=_placed(np.stack(frame["v"].to_numpy()), tree))

    return saved(points.mapInPandas(run, "p long, weight long, v array<double>, cell long"))


def boxes(placed: DataFrame, size: int, columns: list[str] = []) -> DataFrame:
    """``cell``, its least and greatest values (``low``, ``high``) and the least of further columns."""
    lows, highs = ([f(F.get("v", F.lit(i))) for i in range(size)] for f in (F.min, F.max))
    return placed.groupBy("cell").agg(F.array(*lows).alias("low"), F.array(*highs).alias("high"), *[F.min(c).alias(c) for c in columns])


def _apart(low_a, high_a, low_b, high_b):
    """Distance of two boxes (or of a point, as a box without a side)."""
    gap = F.zip_with(F.zip_with(low_a, high_b, lambda x, y: x - y), F.zip_with(low_b, high_a, lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.sqrt(F.aggregate(gap, F.lit(0.0), lambda a, x: a + x * x)) * (1 - 1e-12)


def _squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """Squares of all distances by one product, and a bound of what rounding may take two of them, or of those that
    ``_lengths`` gives, apart."""
    own, other = (a * a).sum(axis=1), (b * b).sum(axis=1)
    slack = 4e-15 * (a.shape[1] + 10) * (own.max() + other.max())
    if not np.isfinite(slack):
        return np.zeros((len(a), len(b))), np.inf
    found = a @ (-2 * b.T)
    found += own[:, None]
    found += other[None, :]
    return found, slack


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of ``a`` to those of ``b`` at the same places."""
    width = max(1, 4_000_000 // max(1, a.shape[1]))
    return np.concatenate([np.sqrt(((a[s : s + width] - b[s : s + width]) ** 2).sum(axis=1)) for s in range(0, max(1, len(a)), width)])


def _kth(a: np.ndarray, b: np.ndarray, weights: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each of ``a`` the distances to the nearest of ``b`` and their weights, k points or more in sum if there are.  Only pairs
    that can be among these are measured by their differences."""
    width = max(1, 1_000_000 // len(b))
    for s in range(0, len(a), width):
        part = a[s : s + width]
        squares, slack = _squares(part, b)
        most = np.partition(squares, k, axis=1)[:, k] if len(b) > k else np.full(len(part), np.inf)
        i, j = np.nonzero(squares <= most[:, None] + slack)
        d = _lengths(part[i], b[j])
        order, starts = np.lexsort((j, d, i)), np.searchsorted(i, np.arange(len(part) + 1))
        for r in range(len(part)):
            pick = order[starts[r] : min(starts[r + 1], starts[r] + k + 1)]
            yield s + r, d[pick], weights[j[pick]]


def cores(placed: DataFrame, size: int, least: int, n_points: int) -> DataFrame:
    """``placed`` with ``core``: the distance to the ``least``-th other point, or to the last where there are fewer."""
    k = min(least, n_points - 1)

    def own(frame: pd.DataFrame) -> pd.DataFrame:
        x, w = np.stack(frame["v"].to_numpy()), frame["weight"].to_numpy()
        ds, ws, bound = [], [], np.full(len(x), np.inf)
        for i, d, each in _kth(x, x, w, k):
            enough = np.flatnonzero(np.cumsum(each) > k)  # itself counts as one
            bound[i] = d[enough[0]] if len(enough) else np.inf
            ds.append(d)
            ws.append(each)
        return frame.assign(bound=bound, d=pd.Series(ds, frame.index, object), w=pd.Series(ws, frame.index, object))

    first = saved(placed.groupBy("cell").applyInPandas(own, "p long, weight long, v array<double>, cell long, bound double, d array<double>, w array<long>"))
    box = F.broadcast(boxes(placed, size).withColumnRenamed("cell", "other"))
    asked = first.join(box, _apart(F.col("v"), F.col("v"), F.col("low"), F.col("high")) <= F.col("bound")).filter("other <> cell").select("p", F.col("other").alias("cell"), "v")

    def further(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        near = _kth(np.stack(q["v"].to_numpy()), np.stack(x["v"].to_numpy()), x["weight"].to_numpy(), k) if len(q) and len(x) else ()
        found = [(d, each) for _, d, each in near]
        ds, ws = (pd.Series([f[i] for f in found], dtype=object) for i in (0, 1))
        return pd.DataFrame({"p": q["p"].to_numpy()[: len(found)], "d": ds, "w": ws})

    more = asked.groupBy("cell").cogroup(placed.select("cell", "v", "weight").groupBy("cell")).applyInPandas(further, "p long, d array<double>, w array<long>")
    every = first.select("p", "d", "w").unionByName(more).groupBy("p").agg(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("d", "w")))).alias("near"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("d"))
    reach = F.aggregate("near", start, lambda a, x: F.when(a["n"] > k, a).otherwise(F.struct((a["n"] + x["w"]).alias("n"), x["d"].alias("d"))))["d"]
    return saved(placed.join(every.select("p", reach.alias("core")), "p"))


def _least_out(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """The least edge between different components of two cells, for each component of either."""
    found = []
    if len(a) and len(b):
        xa, xb = np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy())
        pa, pb, ca, cb, ka, kb = (f[c].to_numpy() for c in ("p", "comp", "core") for f in (a, b))
        # by number, so that the least of each component can be summed up
        _, numbers = np.unique(np.concatenate([ca, cb]), return_inverse=True)
        na, nb = numbers[: len(ca)], numbers[len(ca) :]
        width = max(1, 1_000_000 // len(xb))
        for s in range(0, len(xa), width):
            e = slice(s, s + width)
            squares, slack = _squares(xa[e], xb)
            np.maximum(squares, np.maximum(ka[e, None], kb[None, :]) ** 2, out=squares)
            apart = na[e, None] != nb[None, :]
            squares[~apart] = np.inf
            least = np.full(numbers.max() + 1, np.inf)
            np.minimum.at(least, na[e], squares.min(axis=1))
            np.minimum.at(least, nb, squares.min(axis=0))
            # what can be the least edge of either end's component, or as long as that, is measured by its differences
            i, j = np.nonzero(apart & (squares <= np.maximum(least[na[e], None], least[None, nb]) + slack))
            w = np.maximum(_lengths(xa[e][i], xb[j]), np.maximum(ka[e][i], kb[j]))
            u, v = pa[e][i], pb[j]
            for mine, other in ((ca[e][i], cb[j]), (cb[j], ca[e][i])):
                every = pd.DataFrame({"comp": mine, "w": w, "lo": np.minimum(u, v), "hi": np.maximum(u, v), "other": other})[np.isfinite(w)]
                found.append(every.sort_values(["w", "lo", "hi"], kind="stable").drop_duplicates("comp"))
    if not found:
        return pd.DataFrame({c: np.zeros(0, t) for c, t in (("comp", np.int64), ("w", float), ("lo", np.int64), ("hi", np.int64), ("other", np.int64))})
    every = pd.concat(found).sort_values(["w", "lo", "hi"], kind="stable")
    return every.drop_duplicates("comp")


EDGE = "comp long, w double, lo long, hi long, other long"


def spanning_edges(points: DataFrame, size: int, rounds: int = 60) -> DataFrame:
    """``lo, hi, w``: a least spanning tree of ``p, v, cell, core`` over the larger of distance and both core distances."""
    info = saved(boxes(points, size, ["core"]))
    a, b = (info.select(*[F.col(c).alias(f"{c}_{s}") for c in ("cell", "low", "high", "core")]) for s in "ab")
    # one row for each two cells, of which there are a bounded number
    reach = F.when(F.col("cell_a") == F.col("cell_b"), 0.0).otherwise(_apart(F.col("low_a"), F.col("high_a"), F.col("low_b"), F.col("high_b")))
    pairs = saved(a.join(F.broadcast(b), F.col("cell_a") <= F.col("cell_b")).select("cell_a", "cell_b", F.greatest(reach, "core_a", "core_b").alias("apart")))
    tied = saved(points.select("p", F.col("p").alias("comp")))
    edges = None

    def meet(state: DataFrame, which: DataFrame) -> DataFrame:
        side = lambda s: state.join(which.select(F.col(f"cell_{s}").alias("cell"), "cell_a", "cell_b"), "cell").select(*[F.col(c).alias(c) for c in ("cell_a", "cell_b", "p", "v", "core", "comp")])
        found = side("a").groupBy("cell_a", "cell_b").cogroup(side("b").groupBy("cell_a", "cell_b")).applyInPandas(_least_out, EDGE)
        return found.groupBy("comp").agg(F.min(F.struct("w", "lo", "hi", "other")).alias("e")).select("comp", "e.*")

    for _ in range(rounds):
        state = saved(points.join(tied, "p"))
        held = state.groupBy("cell").agg(F.min("comp").alias("least"), F.max("comp").alias("most"))
        if held.agg(F.min("least") == F.max("most")).first()[0] in (True, None):
            return edges if edges is not None else points.sparkSession.createDataFrame([], "lo long, hi long, w double")
        sides = [held.select(F.col("cell").alias(f"cell_{s}"), F.col("least").alias(f"least_{s}"), F.col("most").alias(f"most_{s}")) for s in "ab"]
        apart = saved(pairs.join(sides[0], "cell_a").join(sides[1], "cell_b").filter("least_a <> least_b or most_a <> most_b or least_a <> most_a").select("cell_a", "cell_b", "apart"))
        ends = apart.select(F.col("cell_a").alias("cell"), "cell_a", "cell_b", "apart").unionByName(apart.select(F.col("cell_b").alias("cell"), "cell_a", "cell_b", "apart"))
        first = saved(ends.groupBy("cell").agg(F.min(F.struct("apart", "cell_a", "cell_b")).alias("e")).select("e.cell_a", "e.cell_b").distinct())
        best = saved(meet(state, first))
        bounds = state.join(best.select("comp", "w"), "comp", "left").groupBy("cell").agg(F.max(F.coalesce("w", F.lit(float("inf")))).alias("w"))
        sides = [bounds.select(F.col("cell").alias(f"cell_{s}"), F.col("w").alias(f"w_{s}")) for s in "ab"]
        rest = apart.join(first, ["cell_a", "cell_b"], "left_anti").join(sides[0], "cell_a").join(sides[1], "cell_b").filter("apart <= greatest(w_a, w_b)").select("cell_a", "cell_b")
        rest = saved(rest)
        if not rest.isEmpty():
            best = saved(best.unionByName(meet(state, rest)).groupBy("comp").agg(F.min(F.struct("w", "lo", "hi", "other")).alias("e")).select("comp", "e.*"))
        new = best.select("lo", "hi", "w").distinct()
        edges = saved(new if edges is None else edges.unionByName(new))
        roots = least_linked(best.select(F.lit(0).alias("image"), F.col("comp").alias("u"), F.col("other").alias("v")))
        tied = saved(tied.join(roots.select(F.col("node").alias("comp"), "least"), "comp").select("p", F.col("least").alias("comp")))
    raise RuntimeError(f"the tree did not close within {rounds} rounds")


def lists(points: DataFrame, size: int, least: int, n_points: int, n: int, how: Spread) -> tuple[DataFrame, DataFrame]:
    """``points`` in cells with ``core`` (as ``cores``) and ``beyond``, below which no edge is that the lists leave out; and the edges
    ``lo, hi, w`` of the lists."""
    k = min(least, n_points - 1)
    near = neighbours.exact_graph(points.select(F.col("p").alias("c"), "v"), n, size, max(how.listed, k))
    weighed = near.withColumn("weight", F.lit(1).cast("long")) if n == n_points else near.join(points.select(F.col("p").alias("item"), "weight"), "item")
    each = weighed.groupBy(F.col("query").alias("p")).agg(F.array_sort(F.collect_list(F.struct("distance", "weight"))).alias("near"))
    start = F.struct(F.col("weight").alias("n"), F.lit(0.0).alias("d"))
    reach = F.aggregate("near", start, lambda a, x: F.when(a["n"] > k, a).otherwise(F.struct((a["n"] + x["weight"]).alias("n"), x["distance"].alias("d"))))["d"]
    last = F.when(F.size("near") < n - 1, F.greatest(F.element_at("near", -1)["distance"], "core")).otherwise(float("inf"))
    placed = in_cells(points, n, how, max(1, min(how.wide, neighbours.NUMBERS // size)))
    placed = placed.join(each, "p", "left").withColumn("core", F.coalesce(reach, F.lit(0.0)))
    placed = saved(placed.select("p", "weight", "v", "cell", "core", F.coalesce(last, F.lit(float("inf"))).alias("beyond")))
    known = near.select(F.least("query", "item").alias("lo"), F.greatest("query", "item").alias("hi"), "distance").distinct()
    for end in ("lo", "hi"):
        known = known.join(placed.select(F.col("p").alias(end), F.col("core").alias(f"core_{end}")), end)
    return placed, saved(known.select("lo", "hi", F.greatest("distance", "core_lo", "core_hi").alias("w")))


def _looked_for(points: DataFrame, size: int, tied: DataFrame, unsure: DataFrame, how: Spread) -> DataFrame:
    """The least edge out of each component ``comp`` of ``unsure`` that is shorter than its ``bound``, if there is one: its points that can
    have such an edge meet the cells within the bound."""
    who = tied.join(unsure, "comp").filter("beyond < bound").select("p", "comp", "bound")
    open_ = points.select("p", "v", "cell", "core").join(who, "p")
    # a few meet each cell once
    open_ = saved(open_.withColumn("block", F.lit(0) if who.count() <= how.wide else F.col("cell").cast("int")).drop("cell"))
    blocks = boxes(open_.withColumnRenamed("block", "cell").withColumn("bound", -F.col("bound")), size, ["bound"])
    blocks = blocks.select(F.col("cell").alias("block"), F.col("low").alias("low_b"), F.col("high").alias("high_b"), (-F.col("bound")).alias("bound"))
    near = boxes(points, size, ["core"]).join(F.broadcast(blocks), F.greatest(_apart(F.col("low"), F.col("high"), F.col("low_b"), F.col("high_b")), "core") <= F.col("bound"))
    near = saved(near.select("block", "cell"))
    on = ["block", "cell"]
    asked = open_.join(F.broadcast(near), "block").select(*on, "p", "v", "core", "comp").groupBy(*on)
    there = points.select("p", "v", "cell", "core").join(tied.select("p", "comp"), "p").join(F.broadcast(near), "cell").select(*on, "p", "v", "core", "comp").groupBy(*on)
    found = asked.cogroup(there).applyInPandas(_least_out, EDGE).join(unsure, "comp").filter("w < bound")
    return saved(found.groupBy("comp").agg(F.min(F.struct("w", "lo", "hi", "other")).alias("e")).select("comp", "e.*"))


def spanning_of_lists(points: DataFrame, known: DataFrame, size: int, how: Spread, rounds: int = 200) -> DataFrame:
    """As ``spanning_edges``, of ``p, v, cell, core, beyond`` and the edges of their lists.  Of equally long edges those known come first."""
    tied = points.select("p", "beyond", F.col("p").alias("comp"))
    known = known.select(F.col("lo").alias("a"), F.col("hi").alias("b"), "w", "lo", "hi")
    edges = points.sparkSession.createDataFrame([], "lo long, hi long, w double")
    for _ in range(rounds):
        both = known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b"), "w", "lo", "hi"))
        best = both.groupBy(F.col("a").alias("comp")).agg(F.min(F.struct("w", "lo", "hi", F.col("b").alias("other"))).alias("e")).select("comp", "e.*")
        comps = tied.groupBy("comp").agg(F.min("beyond").alias("beyond"), F.count(F.lit(1)).alias("n"))
        state = saved(comps.join(best, "comp", "left").withColumn("sure", F.coalesce(F.col("w") <= F.col("beyond"), F.lit(False))))
        count, sure, largest = state.agg(F.count(F.lit(1)), F.count_if("sure"), F.max_by("comp", F.struct("n", "comp"))).first()
        if count <= 1:
            return edges
        step = state.filter("sure").select("comp", "w", "lo", "hi", "other")
        if 4 * sure < count:
            unsure = state.filter(~F.col("sure") & (F.col("comp") != largest))
            found = _looked_for(points, size, tied, unsure.select("comp", F.coalesce("w", F.lit(float("inf"))).alias("bound")), how)
            same = unsure.select("comp", "w", "lo", "hi", "other").filter("w is not null").join(found, "comp", "left_anti")
            step = step.unionByName(found).unionByName(same)
        step = saved(step)
        if step.isEmpty():
            break
        edges = saved(edges.unionByName(step.select("lo", "hi", "w").distinct()))
        roots = least_linked(step.select(F.lit(0).alias("image"), F.col("comp").alias("u"), F.col("other").alias("v")))
        roots = saved(roots.select("node", "least"))
        tied = saved(tied.join(roots.withColumnRenamed("node", "comp"), "comp", "left").select("p", "beyond", F.coalesce("least", "comp").alias("comp")))
        for end in "ab":
            known = known.join(roots.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("least", end)).drop("least")
        ends = [f("a", "b").alias(c) for f, c in ((F.least, "a"), (F.greatest, "b"))]
        known = known.filter("a <> b").select(*ends, "w", "lo", "hi").groupBy("a", "b").agg(F.min(F.struct("w", "lo", "hi")).alias("e"))
        known = saved(known.select("a", "b", "e.*"))
    raise RuntimeError(f"the tree did not close within {rounds} rounds")


def births(points: DataFrame, edges: DataFrame, least: int, rounds: int = 10_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is born and what leaves: ``leaving`` (``p, weight, w, anchor``: at which length a point stops being a cluster of its own
    kin and becomes part of the cluster that ``anchor`` is in), ``born`` (``c, w``) and the edges between those born."""
    large = F.col("size") >= least
    comps = saved(points.select(F.col("p").alias("c"), F.col("weight").alias("size"), F.when(F.col("weight") >= least, F.col("core")).alias("born")))
    where = saved(points.select("p", "weight", F.col("p").alias("c")))
    tree = saved(edges.select(F.col("lo").alias("a"), F.col("hi").alias("b"), "w", "lo", "hi"))
    gone = None
    for _ in range(rounds):
        small = comps.filter(~large)
        both = tree.unionByName(tree.select(F.col("b").alias("a"), F.col("a").alias("b"), "w", "lo", "hi"))
        if small.isEmpty() or tree.isEmpty():
            break
        step = both.join(small.select(F.col("c").alias("a")), "a", "left_semi").groupBy("a").agg(F.min(F.struct("w", "lo", "hi", "b")).alias("e")).select(F.col("a").alias("c"), "e.w", F.col("e.b").alias("to"))
        step = saved(step)
        back = step.select(F.col("c").alias("to"), F.col("to").alias("c"), F.lit(True).alias("mutual"))
        step = step.join(back, ["c", "to"], "left")
        # a pair that points at each other stands for what points at it: the least of both is its end
        head = F.when(F.col("mutual"), F.least("c", "to")).otherwise(F.col("to"))
        jump = saved(step.select("c", "w", head.alias("to"), F.coalesce("mutual", F.lit(False)).alias("mutual")))
        while True:
            ends = jump.select(F.col("c").alias("to"), F.col("to").alias("next"))
            moved = saved(jump.join(ends, "to", "left").select("c", "w", F.coalesce("next", "to").alias("next"), "mutual", (F.coalesce("next", "to") != F.col("to")).alias("moved")))
            more = not moved.filter("moved").isEmpty()
            jump = moved.select("c", "w", F.col("next").alias("to"), "mutual")
            if not more:
                break
        whole = comps.select(F.col("c").alias("to"), large.alias("large"))
        jump = saved(jump.join(whole, "to"))
        leave = jump.filter("large").select("c", F.col("w").alias("at"), F.col("to").alias("anchor"))
        merge = jump.filter("mutual and not large").select("c", "to", "w")
        if gone is not None:
            gone = gone.unionByName(where.join(leave, "c").select("p", "weight", F.col("at").alias("w"), "anchor"))
        else:
            gone = where.join(leave, "c").select("p", "weight", F.col("at").alias("w"), "anchor")
        gone = saved(gone)
        made = comps.join(merge, "c").groupBy("to").agg(F.sum("size").alias("size"), F.max("w").alias("w"))
        made = saved(made.select(F.col("to").alias("c"), "size", F.when(large, F.col("w")).alias("born")))
        touched = jump.filter("large or mutual").select("c")
        comps = saved(comps.join(touched, "c", "left_anti").unionByName(made))
        here = where.join(leave, "c", "left_anti").join(merge.select("c", "to"), "c", "left").select("p", "weight", F.coalesce("to", "c").alias("c"))
        where = saved(here)
        new = leave.select("c", F.col("anchor").alias("to")).unionByName(merge.select("c", "to"))
        for end in "ab":
            tree = tree.join(new.withColumnRenamed("c", end), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        tree = saved(tree.filter("a <> b").select("a", "b", "w", "lo", "hi"))
    else:
        raise RuntimeError(f"small clusters are left after {rounds} rounds")
    born = comps.filter(large).select("c", F.col("born").alias("w"))
    inside = where.join(born, "c").select("p", "weight", "w", F.col("c").alias("anchor"))
    return saved(inside if gone is None else gone.unionByName(inside)), born, tree.select("a", "b", "w")


class Condensed:
    """The tree of clusters that are born and merge; leaves come first, a parent after its children."""

    def __init__(self, ids: np.ndarray, born: np.ndarray, edges: np.ndarray) -> None:
        """``edges``: positions of both ends and the length of each."""
        self.ids = ids
        level, parent, home, top = born.tolist(), [-1] * len(ids), list(range(len(ids))), list(range(len(ids)))

        def find(x: int) -> int:
            while home[x] != x:
                home[x] = home[home[x]]
                x = home[x]
            return x

        for a, b, w in sorted(map(tuple, edges.tolist()), key=lambda e: e[2]):
            x, y = find(int(a)), find(int(b))
            nodes = [top[x], top[y]]
            # what came to be at this very length is no cluster of its own: both are one
            same = [n for n in nodes if level[n] >= w]
            if not same:
                level.append(w)
                parent.append(-1)
                same = [len(level) - 1]
            for n in nodes:
                if n != same[0]:
                    parent[n] = same[0]
            home[x] = y
            top[y] = same[0]
        self.level, self.parent = np.array(level), np.array(parent)
        order = np.argsort(self.level, kind="stable")
        self.order = order.tolist()
        self.up = [np.where(self.parent < 0, np.arange(len(level)), self.parent)]
        while len(level) > 1 and (self.up[-1][self.up[-1]] != self.up[-1]).any():
            self.up.append(self.up[-1][self.up[-1]])

    def at(self, anchor: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The cluster that holds each anchor once all merges of up to ``w`` have happened."""
        node = np.searchsorted(self.ids, anchor)
        for up in reversed(self.up):
            node = np.where(self.level[up[node]] <= w, up[node], node)
        return node

    def chosen(self, size: np.ndarray, rate: np.ndarray, first: np.ndarray) -> np.ndarray:
        """A label for each node, -1 for none: of the sums of points that leave at each node, of their densities, and the
        least of them."""
        n = len(self.level)
        density = 1 / np.maximum(self.level, 1e-300)
        # a node of the level of its parent is part of it
        children: list[list[int]] = [[] for _ in range(n)]
        size, rate, first = size.astype(float), rate.copy(), first.copy()
        part = np.array([self.parent[i] >= 0 and self.level[i] >= self.level[self.parent[i]] for i in range(n)], bool)
        total, worth, taken = size.copy(), np.zeros(n), np.zeros(n, bool)
        rank = sorted(range(n), key=lambda i: (self.level[i], not part[i]))
        for i in rank:
            p = self.parent[i]
            if part[i]:
                rate[p] += rate[i]
                total[p] += total[i]
                size[p] += size[i]
                first[p] = min(first[p], first[i])
                children[p] += children[i]
                for c in children[i]:
                    self.parent[c] = p
                continue
            inner = sum(total[c] for c in children[i] if not part[c])
            birth = density[p] if p >= 0 else 0.0
            stable = rate[i] - birth * (total[i] - inner) + inner * (density[i] - birth)
            below = sum(worth[c] for c in children[i])
            taken[i] = p >= 0 and (not children[i] or stable >= below)
            worth[i] = stable if taken[i] else below
            if p >= 0:
                children[p].append(i)
                total[p] += total[i]
                first[p] = min(first[p], first[i])
        label = np.full(n, -1)
        top = np.full(n, -1)
        for i in reversed(rank):
            p = self.parent[i]
            top[i] = top[p] if p >= 0 and (top[p] >= 0 or part[i]) else i if taken[i] else -1
        names = {c: k for k, c in enumerate(sorted({int(t) for t in top if t >= 0}, key=lambda c: first[c]))}
        for i in range(n):
            label[i] = names.get(int(top[i]), -1)
        return label


def spread_labels(df: DataFrame, columns: list[str], least: int, id_column: str, how: Spread = Spread()) -> DataFrame:
    """``id_column`` and ``cluster``: numbers from 0 of the clusters of at least ``least`` points that are most stable over all
    densities, in order of their least ids; -1 for noise.  Ids must be distinct and whole numbers; rows with a null are noise."""
    spark = df.sparkSession
    rows = saved(df.select(F.col(id_column).cast("long").alias("id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("v")))
    whole = rows.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    points = saved(whole.groupBy("v").agg(F.min("id").alias("p"), F.count(F.lit(1)).alias("weight")).select("p", "weight", "v"))
    n, distinct = points.agg(F.sum("weight"), F.count(F.lit(1))).first()
    if not n or n <= least:
        return rows.select(F.col("id").alias(id_column), F.lit(-1).cast("long").alias("cluster"))
    if len(columns) <= NARROW:
        reached = cores(in_cells(points, distinct, how), len(columns), least, n)
        edges = spanning_edges(reached, len(columns))
    else:
        reached, known = lists(points, len(columns), least, n, distinct, how)
        edges = spanning_of_lists(reached, known, len(columns), how)
    leaving, born, tree = births(reached, edges, least)
    if born.count() > how.most_clusters:
        raise ValueError(f"more than {how.most_clusters} clusters are born")
    started = born.orderBy("c").toPandas()
    ends = tree.toPandas()
    ids = started["c"].to_numpy(np.int64)
    edges = np.column_stack([np.searchsorted(ids, ends["a"]), np.searchsorted(ids, ends["b"]), ends["w"]]).reshape(-1, 3)
    made = Condensed(ids, started["w"].to_numpy(float), edges)
    shared = spark.sparkContext.broadcast(made)

    def settle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(node=shared.value.at(frame["anchor"].to_numpy(), frame["w"].to_numpy()))

    at = saved(leaving.mapInPandas(settle, "p long, weight long, w double, anchor long, node long"))
    sums = at.groupBy("node").agg(F.sum("weight").alias("n"), F.sum(F.col("weight") / F.greatest("w", F.lit(1e-300))).alias("rate"), F.min("p").alias("first")).toPandas()
    size, rate, first = np.zeros(len(made.level)), np.zeros(len(made.level)), np.full(len(made.level), np.iinfo(np.int64).max)
    for target, c in ((size, "n"), (rate, "rate"), (first, "first")):
        target[sums["node"]] = sums[c]
    labels = made.chosen(size, rate, first)
    named = spark.createDataFrame(pd.DataFrame({"node": np.arange(len(labels)), "cluster": labels}))
    found = at.join(named, "node").select("p", "cluster")
    same = whole.join(points.select("p", "v"), "v").select("id", "p")
    found = same.join(found, "p", "left").select("id", "cluster")
    return rows.select("id").join(found, "id", "left").select(F.col("id").alias(id_column), F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"))
