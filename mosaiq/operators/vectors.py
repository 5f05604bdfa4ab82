"""Feature vectors: fuzzy graphs over neighbours, principal components, k-means."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.operators.iteration import saved


def smooth_distances(neighbours: DataFrame, steps: int = 64, tolerance: float = 1e-5) -> DataFrame:
    """Local scale of each query: ``rho`` the nearest positive distance, ``sigma`` so that the memberships
    exp(-(d - rho) / sigma) sum to log2 of the number of neighbours.  The bisection runs in the JVM."""
    each = neighbours.groupBy("query").agg(F.array_sort(F.collect_list("distance")).alias("d"))
    each = each.withColumn("rho", F.coalesce(F.array_min(F.filter("d", lambda x: x > 0)), F.lit(0.0))).withColumn("target", F.log2(F.size("d")))
    total = lambda s: F.aggregate("d", F.lit(0.0), lambda a, x: a + F.when(x > F.col("rho"), F.exp(-(x - F.col("rho")) / s)).otherwise(1.0))
    start = F.struct(F.lit(0.0).alias("low"), F.lit(1e300).alias("high"), F.lit(1.0).alias("mid"))

    def step(state, _):
        sums = total(state["mid"])
        done = F.abs(sums - F.col("target")) < tolerance
        low, high = F.when(done | (sums > F.col("target")), state["low"]).otherwise(state["mid"]), F.when(~done & (sums > F.col("target")), state["mid"]).otherwise(state["high"])
        mid = F.when(done, state["mid"]).when(high > 1e299, state["mid"] * 2).otherwise((low + high) / 2)
        return F.struct(low.alias("low"), high.alias("high"), mid.alias("mid"))

    return each.select("query", "rho", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)["mid"].alias("sigma"))


def fuzzy_union(memberships: DataFrame) -> DataFrame:
    """Symmetric weights a + b - a * b of ``query``, ``item``, ``weight``."""
    both = memberships.select("query", "item", F.col("weight").alias("a"), F.lit(0.0).alias("b")).unionByName(memberships.select(F.col("item").alias("query"), F.col("query").alias("item"), F.lit(0.0).alias("a"), F.col("weight").alias("b")))
    return both.groupBy("query", "item").agg(F.max("a").alias("a"), F.max("b").alias("b")).select("query", "item", (F.col("a") + F.col("b") - F.col("a") * F.col("b")).alias("weight"))


def covariance(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """``i``, ``j``, ``cov`` (sample) for i <= j.  Each task sums its rows' products first."""

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, p = 0, 0.0, 0.0
        for frame in frames:
            if len(frame):
                x = np.stack(frame[vector].to_numpy()).astype(np.float64)
                n, s, p = n + len(x), s + x.sum(axis=0), p + x.T @ x
        if n:
            i, j = np.triu_indices(len(s))
            yield pd.DataFrame({"i": i, "j": j, "n": n, "si": s[i], "sj": s[j], "p": p[i, j]})

    sums = df.select(vector).mapInPandas(partial, "i long, j long, n long, si double, sj double, p double").groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "p")])
    return sums.select("i", "j", ((F.col("p") - F.col("si") * F.col("sj") / F.col("n")) / (F.col("n") - 1)).alias("cov"))


def principal_components(df: DataFrame, k: int, vector: str = "embedding") -> tuple[np.ndarray, np.ndarray]:
    """Variances and directions (columns; the entry of largest size is positive) from the covariance matrix, whose
    size is that of a vector."""
    rows = covariance(df, vector).collect()
    size = 1 + max(r["j"] for r in rows)
    c = np.zeros((size, size))
    for r in rows:
        c[r["i"], r["j"]] = c[r["j"], r["i"]] = r["cov"]
    values, directions = np.linalg.eigh(c)
    order = np.argsort(-values)[:k]
    directions = directions[:, order]
    return values[order], directions * np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(k)])


def project(df: DataFrame, directions: np.ndarray, vector: str = "embedding") -> DataFrame:
    """``pc1`` ... of every row, as expressions."""
    dot = lambda w: F.aggregate(F.zip_with(vector, F.array(*map(F.lit, w)), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return df.select("*", *[dot([float(x) for x in directions[:, i]]).alias(f"pc{i + 1}") for i in range(directions.shape[1])])


def assign(df: DataFrame, centres: list[list[float]], vector: str = "embedding") -> DataFrame:
    """``cluster`` of the nearest centre (the first of those that tie) and its ``distance``."""
    each = [F.struct(F.sqrt(F.aggregate(F.zip_with(vector, F.array(*map(F.lit, c)), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)).alias("distance"), F.lit(i).cast("long").alias("cluster")) for i, c in enumerate(centres)]
    return df.withColumn("_m", F.array_min(F.array(*each))).select(*df.columns, "_m.cluster", "_m.distance")


#: Rows of a task that the driver follows from round to round.
OPEN = 1000


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The first of the nearest centres; which of nearly equal ones, differences tell, not the rounding of squares."""
    squares = (centres**2).sum(1)
    score = squares[None] - 2 * x @ centres.T
    near = score.argmin(axis=1)
    best = score[np.arange(len(x)), near]
    tied = np.flatnonzero((score <= (best + 1e-12 * (squares.max() + np.abs(best)))[:, None]).sum(axis=1) > 1)
    near[tied] = ((x[tied][:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    return near


def _sums(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the rows nearest to each centre."""
    mine = (_nearest(x, centres) == np.arange(len(centres))[:, None]).astype(np.float64)
    return mine @ x, mine.sum(axis=1)


def k_means(df: DataFrame, k: int, rounds: int | None = None, vector: str = "embedding", id_column: str = "vec_id") -> list[list[float]]:
    """Centres that have settled; each task sums its rows for each centre.  They start from the 64 k rows of least hash, of
    which each next one is drawn by its squared distance to those before it.

    Each round lessens the sum of squared distances until the centres stand still, so it ends; how many rounds it takes grows with
    the rows.  More than ``rounds``, if given, are an error.  One job serves many rounds: a task returns its ``OPEN`` rows that are
    the least nearer to their centre than to another as they are, and only sums of the others, which stay with their centres while
    none has moved by half of what the least of them is nearer."""
    start = np.array([r[0] for r in df.select(vector).orderBy(F.xxhash64(id_column)).limit(64 * k).collect()], np.float64)
    chance, picked = np.random.default_rng(0), [0]
    while len(picked) < min(k, len(start)):
        far = ((start[:, None] - start[picked][None]) ** 2).sum(axis=2).min(axis=1)
        picked.append(int(chance.choice(len(start), p=far / far.sum())) if far.sum() > 0 else len(picked))
    centres = start[picked]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(centres), np.zeros(len(centres))
        kept, slack, least = np.zeros((0, centres.shape[1])), np.zeros(0), np.inf
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                near = _nearest(x, centres)
                far = np.sqrt(np.maximum(((x * x).sum(1)[:, None] + (centres**2).sum(1)[None]) - 2 * x @ centres.T, 0))
                own = far[np.arange(len(x)), near]
                far[np.arange(len(x)), near] = np.inf
                gap = far.min(axis=1) - own
                kept, slack = np.concatenate([kept, x]), np.concatenate([slack, gap])
                if len(kept) > OPEN:
                    order = np.argpartition(slack, OPEN)
                    least = min(least, slack[order[OPEN]])
                    add, n = _sums(kept[order[OPEN:]], centres)
                    sums, counts = sums + add, counts + n
                    kept, slack = kept[order[:OPEN]], slack[order[:OPEN]]
        made = {"c": np.arange(len(centres)), "n": counts, "s": pa.array(list(sums), pa.list_(pa.float64()))}
        yield pa.RecordBatch.from_pydict(made | {"least": np.full(len(centres), least)})
        if len(kept):
            yield pa.RecordBatch.from_pydict({"c": np.full(len(kept), -1), "n": np.ones(len(kept)), "s": pa.array(list(kept), pa.list_(pa.float64())), "least": np.full(len(kept), np.inf)})

    rows = saved(df.select(vector).repartition(df.sparkSession.sparkContext.defaultParallelism))  # a file may be one task
    turns = itertools.count() if rounds is None else iter(range(rounds))
    while True:
        got = rows.mapInArrow(partial, "c long, n double, s array<double>, least double").toArrow()  # k sums of each task and OPEN rows
        c, n, least = (got.column(name).to_numpy() for name in ("c", "n", "least"))
        s = got.column("s").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)
        x, mine = s[c < 0], (c[c >= 0] == np.arange(len(centres))[:, None]).astype(np.float64)
        first, fixed, sure, least = centres, mine @ s[c >= 0], mine @ n[c >= 0], least.min()
        # rounding may count against what is sure
        while centres is first or 2 * np.linalg.norm(centres - first, axis=1).max() < least - 1e-6 * np.abs(centres).max():
            if next(turns, None) is None:
                raise RuntimeError(f"the centres did not settle within {rounds} rounds")
            sums, counts = _sums(x, centres)
            sums, counts = sums + fixed, counts + sure
            moved = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
            settled, centres = np.allclose(moved, centres), moved
            if settled:
                return centres.tolist()


def whitened_k_means(df: DataFrame, k: int, vector: str = "embedding", id_column: str = "vec_id") -> list[list[float]]:
    """Centres found with each component divided by its standard deviation, given in the components' own sizes and ordered
    by their norms."""
    sizes = df.agg(F.max(F.size(vector)).alias("n")).first()["n"] or 0
    spread = [x or 1.0 for x in df.agg(*[F.stddev_pop(F.get(vector, F.lit(i))).alias(str(i)) for i in range(sizes)]).first()]
    scaled = df.select(id_column, F.zip_with(vector, F.array(*map(F.lit, spread)), lambda x, s: x / s).alias(vector))
    centres = np.array(k_means(scaled, k, vector=vector, id_column=id_column)) * np.array(spread)
    return centres[np.argsort(np.linalg.norm(centres, axis=1), kind="stable")].tolist()
