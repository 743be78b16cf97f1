"""Density clustering of vectors per group, without a reference library."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.session import ship


def hdbscan(x: np.ndarray, min_cluster: int, min_samples: int = 2) -> np.ndarray:
    """Labels from 0, -1 for noise: mutual reachability, minimum spanning tree, condensed tree, excess of mass.

    Memory is linear in the rows: distances are taken row by row.
    """
    n = len(x)
    if n < max(min_cluster, 2):
        return np.full(n, -1)
    sq = (x**2).sum(1)
    row = lambda i: np.sqrt(np.maximum(sq + sq[i] - 2 * (x @ x[i]), 0))
    core = np.array([np.partition(row(i), min(min_samples - 1, n - 1))[min(min_samples - 1, n - 1)] for i in range(n)])
    best, link, done = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool)
    at, edges = 0, []
    for _ in range(n - 1):
        done[at] = True
        reach = np.maximum(np.maximum(row(at), core), core[at])
        better = ~done & (reach < best)
        best[better], link[better] = reach[better], at
        nxt = int(np.argmin(np.where(done, np.inf, best)))
        edges.append((best[nxt], link[nxt], nxt))
        at = nxt
    edges.sort(key=lambda e: e[0])
    parent, size, kids = list(range(2 * n - 1)), [1] * n + [0] * (n - 1), {}
    height = np.zeros(2 * n - 1)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for k, (d, a, b) in enumerate(edges):
        ra, rb, new = find(a), find(b), n + k
        parent[ra] = parent[rb] = new
        size[new], kids[new], height[new] = size[ra] + size[rb], (ra, rb), d
    def leaves(i: int) -> list[int]:
        out, todo = [], [i]
        while todo:
            j = todo.pop()
            if j < n:
                out.append(j)
            else:
                todo += kids[j]
        return out

    clusters: list[dict] = [{"birth": 0.0, "mass": 0.0, "kids": [], "node": 2 * n - 2}]
    todo = [(2 * n - 2, 0)]
    while todo:
        node, c = todo.pop()
        birth = clusters[c]["birth"]
        while node >= n:
            lam = 1 / max(height[node], 1e-12)
            a, b = kids[node]
            big = [k for k in (a, b) if size[k] >= min_cluster]
            if len(big) == 2:
                clusters[c]["mass"] += (lam - birth) * size[node]
                for k in big:
                    clusters.append({"birth": lam, "mass": 0.0, "kids": [], "node": k})
                    clusters[c]["kids"].append(len(clusters) - 1)
                    todo.append((k, len(clusters) - 1))
                break
            small = [k for k in (a, b) if size[k] < min_cluster]
            clusters[c]["mass"] += (lam - birth) * sum(size[k] for k in small)
            if not big:
                break
            node = big[0]
    keep, value = [False] * len(clusters), [0.0] * len(clusters)
    for c in reversed(range(len(clusters))):
        below = sum(value[k] for k in clusters[c]["kids"])
        own = clusters[c]["mass"]
        keep[c] = c > 0 and own >= below
        value[c] = own if keep[c] else below
    label, out, stack = 0, np.full(n, -1), [0]
    while stack:
        c = stack.pop()
        if keep[c]:
            out[leaves(clusters[c]["node"])] = label
            label += 1
        else:
            stack += clusters[c]["kids"]
    return out


def clusters(chunks: DataFrame, group: str = "repository_id", id_col: str = "vec_id", vec_col: str = "embedding", dim: int = 128) -> DataFrame:
    """``(group, id, label)``: density clusters of each group's vectors, -1 for noise; groups under 5 are all noise.

    Labels are numbers within their group without further meaning. A group is
    one task of linear memory and quadratic time; for one group that holds most
    of a large table use the similarity clusters, which cut groups into blocks.
    """
    ship(chunks.sparkSession)
    fit = chunks.where((F.size(vec_col) == dim) & F.exists(vec_col, lambda v: v != 0)).select(group, F.col(id_col).alias("id"), F.col(vec_col).alias("v"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-10)
        labels = hdbscan(x, max(3, len(x) // 20)) if len(x) >= 5 else np.full(len(x), -1)
        return pd.DataFrame({group: pdf[group], "id": pdf["id"], "label": labels})

    kind = chunks.select(group).schema[0].dataType.simpleString()
    return fit.groupBy(group).applyInPandas(run, f"{group} {kind}, id long, label int")
