"""Clusters by density, and unmixing of channels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.operators import vectors
from mosaiq.operators.reshape import hashed_sample


def core_distances(points: np.ndarray, k: int) -> np.ndarray:
    """Distance of each point to its k-th neighbour (or its last one), a block of points at a time."""
    out = np.zeros(len(points))
    k = min(k, len(points) - 1)
    width = max(1, 4_000_000 // max(1, points.size))
    for a in range(0, len(points), width):
        d = ((points[a : a + width, None, :] - points[None]) ** 2).sum(axis=2)
        out[a : a + width] = np.sqrt(np.partition(d, k, axis=1)[:, k])
    return out


def spanning_tree(points: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Edges (one end, other end, length) of a least spanning tree over the larger of distance and both core distances,
    by growing from the first point: one row of distances at a time."""
    n = len(points)
    best, origin, outside = np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool)
    edges, now = np.zeros((n - 1, 3)), 0
    for step in range(n - 1):
        outside[now] = False
        reach = np.maximum(np.sqrt(((points - points[now]) ** 2).sum(axis=1)), np.maximum(core, core[now]))
        nearer = outside & (reach < best)
        best[nearer], origin[nearer] = reach[nearer], now
        now = int(np.where(outside, best, np.inf).argmin())
        edges[step] = origin[now], now, best[now]
    return edges[np.argsort(edges[:, 2], kind="stable")]


def density_labels(points: np.ndarray, least: int) -> np.ndarray:
    """Labels from 0 of clusters of at least so many points that are most stable over all densities; -1 for noise."""
    n = len(points)
    if n <= least:
        return np.full(n, -1)
    edges = spanning_tree(points, core_distances(points, least))
    # merges of the single-linkage tree: node n + i joins two nodes at a distance
    parent, left, right, size = np.arange(2 * n - 1), np.zeros(n - 1, int), np.zeros(n - 1, int), np.ones(2 * n - 1, int)

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, (a, b, _) in enumerate(edges):
        x, y = top(int(a)), top(int(b))
        left[i], right[i], size[n + i] = x, y, size[x] + size[y]
        parent[x] = parent[y] = n + i
    density = 1 / np.maximum(edges[:, 2], 1e-300)
    # from the root down: a cluster lives until both sides of a split are large enough
    birth, stable, children, members = [0.0], [0.0], [[]], [[]]

    def leaves(node: int) -> list[int]:
        out, stack = [], [node]
        while stack:
            x = stack.pop()
            if x < n:
                out.append(x)
            else:
                stack += [left[x - n], right[x - n]]
        return out

    stack = [(2 * n - 2, 0)]
    while stack:
        node, cluster = stack.pop()
        x, y, at = int(left[node - n]), int(right[node - n]), density[node - n]
        large = [c for c in (x, y) if size[c] >= least]
        if len(large) == 2:
            stable[cluster] += (at - birth[cluster]) * size[node]
            for c in large:
                children[cluster].append(len(birth))
                stack += [(c, len(birth))] if c >= n else []
                birth.append(at)
                stable.append(0.0)
                children.append([])
                members.append(leaves(c))
        else:
            for c in (x, y):
                if c in large:
                    stack += [(c, cluster)] if c >= n else []
                else:
                    stable[cluster] += (at - birth[cluster]) * size[c]
    # from the leaves up: a cluster stands if it is as stable as the best of what it splits into; the root never does
    chosen, worth = set(), list(stable)
    for c in range(len(birth) - 1, 0, -1):
        below = sum(worth[d] for d in children[c])
        if not children[c] or stable[c] >= below:
            chosen.add(c)
            gone = list(children[c])
            while gone:
                d = gone.pop()
                chosen.discard(d)
                gone += children[d]
        else:
            worth[c] = below
    labels = np.full(n, -1)
    for number, c in enumerate(sorted(chosen, key=lambda c: min(members[c]))):
        labels[members[c]] = number
    return labels


def density_clusters(df: DataFrame, columns: list[str], least: int, keys: list[str] | None = None, most_rows: int = 50_000, outlier: int = 0) -> DataFrame:
    """The rows with ``cluster``: ``outlier`` for noise, and numbers above it; each group of ``keys`` by itself.

    A group comes to one task, as every point's neighbours decide; one of more than ``most_rows`` is an error, not a sample.
    """
    keys = keys or []
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if not sizes.filter(F.col("n") > most_rows).isEmpty():
        raise ValueError(f"a group has more than {most_rows} rows")
    names = df.columns

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return part.assign(cluster=density_labels(part[columns].to_numpy(float), least) + 1 + outlier)[[*names, "cluster"]]

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", cluster long"
    return (df.groupBy(*keys) if keys else df.groupBy(F.lit("all"))).applyInPandas(run, schema)


def unmixed(pixels: DataFrame, channels: int, vector: str = "embedding", id_column: str = "vec_id", percent: int = 10) -> DataFrame:
    """``cluster`` of every pixel and its ``strength`` there: centres of the background and each channel's colour from a
    stated share of the pixels, by the hash of their ids, then the nearest centre of every pixel and the pixel's norm."""
    centres = vectors.whitened_k_means(hashed_sample(pixels, id_column, percent), channels + 1, vector, id_column)
    norm = F.sqrt(F.aggregate(F.transform(vector, lambda x: x.cast("double") * x), F.lit(0.0), lambda a, x: a + x))
    return vectors.assign(pixels, centres, vector).withColumn("strength", norm).drop("distance")
