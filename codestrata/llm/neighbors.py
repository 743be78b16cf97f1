"""Problem 3: the most similar vectors of every vector.

Method: balanced posting lists. Centroids are fitted on a bounded sample and
oversized ones split; every vector is put into the list of its nearest centroid
and, near a boundary, into further lists. A walk on an in-memory graph of the
centroids finds the nearest ones, and the ratio of their distance to that of
the nearest one selects the lists. Stored and asking vectors are the same, so
two vectors that share a list are compared there, exactly and in double
precision: a query's vector does not travel to lists besides those that store
it.

Lists are of bounded size at every size of the collection: one that holds more
than ``MOST_ROWS`` is split by centroids fitted on a bounded sample of its own
rows, level by level. What even that leaves large is compared in blocks. Exact
copies are searched once and put back afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codestrata.llm.vectors import copies, matrix, usable
from codestrata.scratch import Scratch
from codestrata.session import ship

#: Vectors that centroids are fitted on, at most, of all and of a list that is split; all vectors are indexed.
SAMPLE, SPLIT_SAMPLE = 20_000, 4_096
#: Vectors a list has on average, and the most centroids of one level (they travel to every task that routes).
LIST_SIZE, MOST_LISTS = 64, 4_096
#: A vector is in the lists up to this ratio of its nearest centroid's distance, at most so many.
RATIO, LISTS = 1.2, 8
#: A list of more rows is split; levels of splitting at most; rows of a block where a list stays large.
MOST_ROWS, LEVELS, BLOCK = 4_096, 4, 4_096
#: Neighbours of a centroid in the graph, and the width of the walk.
DEGREE, BEAM = 24, 32


def fit_centroids(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centroids of balanced lists: spherical k-means, oversized ones split."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    c = x[rng.permutation(len(x))[:k]].copy()
    most = max(2, int(np.ceil(2.0 * len(x) / k)))
    for turn in range(rounds):
        near = np.concatenate([np.argmax(part @ c.T, axis=1) for part in np.array_split(x, max(1, len(x) // 4096))])
        order = np.argsort(near, kind="stable")
        cuts = np.searchsorted(near[order], np.arange(len(c) + 1))
        out = []
        for i in range(len(c)):
            own = x[order[cuts[i] : cuts[i + 1]]]
            if not len(own):
                continue
            if len(own) > most and turn < rounds - 1 and len(out) < 2 * k:
                axis = own - own.mean(axis=0)
                side = axis @ axis[np.argmax((axis**2).sum(axis=1))]
                cut = np.median(side)
                halves = [own[side > cut], own[side <= cut]]
                out += [h.mean(axis=0) for h in halves if len(h)]
            else:
                out.append(own.mean(axis=0))
        c = np.stack(out)
        norm = np.linalg.norm(c, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, c / np.maximum(norm, 1e-12), x[: len(c)][0])
    return c[:MOST_LISTS]


class CentroidGraph:
    """Centroids, each linked to its most similar ones, walked best-first."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.c = centroids.astype(np.float32)
        n = len(self.c)
        d = min(DEGREE, n - 1)
        if d > 0:
            sim = self.c @ self.c.T
            np.fill_diagonal(sim, -2)
            self.links = np.argpartition(-sim, d - 1, axis=1)[:, :d].astype(np.int32)
        else:
            self.links = np.zeros((n, 0), np.int32)
        self.doors = np.linspace(0, n - 1, min(n, int(4 * np.sqrt(n)))).astype(np.int32)

    def nearest(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k most similar centroids found for each row: ids and similarities (-2 where none)."""
        x = x.astype(np.float32)
        n, beam = len(x), max(BEAM, k)
        rows = np.arange(n)[:, None]
        seen = np.zeros((n, len(self.c)), bool)
        seen[:, self.doors] = True
        near = x @ self.c[self.doors].T
        ids = np.full((n, beam), -1, np.int32)
        sims = np.full((n, beam), -2.0, np.float32)
        first = np.argsort(-near, axis=1)[:, :beam]
        ids[:, : first.shape[1]], sims[:, : first.shape[1]] = self.doors[first], near[rows, first]
        todo = sims > -2.0
        while True:
            open_at = np.where(todo, sims, -2.0)
            best = np.argpartition(-open_at, 3, axis=1)[:, :4]
            live = open_at[rows, best] > -2.0
            at = np.flatnonzero(live.any(axis=1))
            if not len(at) or not self.links.shape[1]:
                break
            r, j = np.nonzero(live)
            todo[r, best[r, j]] = False
            r, new = np.repeat(r, self.links.shape[1]), self.links[ids[r, best[r, j]]].ravel()
            pair = np.unique((r.astype(np.int64) * len(self.c) + new)[~seen[r, new]])  # a centroid offered twice in one step counts once
            if not len(pair):
                continue
            r, new = pair // len(self.c), (pair % len(self.c)).astype(np.int32)
            seen[r, new] = True
            s = np.einsum("pd,pd->p", x[r], self.c[new])
            better = s > sims[r, -1]  # rows of the beam stay sorted, the last is the worst
            r, new, s = r[better], new[better], s[better]
            if not len(r):
                continue
            nth = np.arange(len(r)) - np.searchsorted(r, r, side="left")
            wide = int(nth.max()) + 1
            own = np.unique(r)
            where = np.searchsorted(own, r)
            more_ids, more = np.full((len(own), wide), -1, np.int32), np.full((len(own), wide), -2.0, np.float32)
            more_ids[where, nth], more[where, nth] = new, s
            all_ids, all_sims = np.concatenate([ids[own], more_ids], 1), np.concatenate([sims[own], more], 1)
            all_todo = np.concatenate([todo[own], more > -2.0], 1)
            top = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            pick = np.arange(len(own))[:, None]
            ids[own], sims[own], todo[own] = all_ids[pick, top], all_sims[pick, top], all_todo[pick, top]
        return ids[:, :k], sims[:, :k]

    def lists_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs chosen by the ratio of their distances."""
        ids, sims = self.nearest(x, LISTS)
        dist = np.sqrt(np.maximum(0.0, 2 - 2 * sims.astype(np.float64)))
        use = (ids >= 0) & (sims > -1.5) & (dist <= RATIO * dist[:, :1] + 1e-6)
        use[:, 0] = True
        r, j = np.nonzero(use)
        return r, ids[r, j]


def _lists_wanted(n: int, sample: int) -> int:
    return int(np.clip(n // LIST_SIZE, 1, min(MOST_LISTS // 2, max(1, sample // 4))))


def _router(centroids: np.ndarray, dim: int):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = CentroidGraph(centroids)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                r, lists = graph.lists_of(matrix(part.column(1), dim))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(r)), pa.array(lists.astype(np.int64) + MOST_LISTS)], names=["id", "list"])

    return route


def _fitter(dim: int):
    """The centroids of one oversized list, from a bounded sample of it."""

    def fit(table: pa.Table) -> pa.Table:
        x = matrix(table.column("vec"), dim)
        c = fit_centroids(x, _lists_wanted(table.column("n")[0].as_py(), len(x)))
        return pa.table({"list": table.column("list").slice(0, 1), "centroids": pa.array([c.astype(np.float32).tobytes()], pa.binary())})

    return fit


def _splitter(dim: int):
    """The lists one level down of a block of rows of an oversized list."""

    def split(rows: pa.Table, fitted: pa.Table) -> pa.Table:
        if not rows.num_rows or not fitted.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "list": pa.array([], pa.int64())})
        graph = CentroidGraph(np.frombuffer(fitted.column("centroids")[0].as_py(), np.float32).reshape(-1, dim))
        x, ids, parent = matrix(rows.column("vec"), dim), rows.column("id").to_numpy(), rows.column("list")[0].as_py()
        out = [(r + at, lists) for at in range(0, len(x), 1024) for r, lists in [graph.lists_of(x[at : at + 1024])]]
        r, lists = (np.concatenate([o[i] for o in out]) for i in range(2))
        return pa.table({"id": pa.array(ids[r]), "list": pa.array(lists.astype(np.int64) + parent * MOST_LISTS)})

    return split


def _compare(dim: int, k: int, least: float):
    """Each row's ``k`` most similar others in a block of a list, or between two blocks; ``grp``, where it is set, keeps rows of one group apart."""
    schema = pa.schema([("id", pa.int64()), ("other", pa.int64()), ("cos", pa.float64())])

    def compare(table: pa.Table) -> pa.Table:
        s, a = table.column("s")[0].as_py(), table.column("a")[0].as_py()
        own, ids, grp = table.column("own").to_numpy(), table.column("id").to_numpy(), table.column("grp").to_numpy()
        x = matrix(table.column("vec"), dim)
        order = np.argsort(ids, kind="stable")  # equal cosines: the smaller id first
        own, ids, grp, x = own[order], ids[order], grp[order], x[order]
        out = []
        for i, j in {(s, a), (a, s)}:
            query, data = np.flatnonzero(own == i), np.flatnonzero(own == j)
            for at in range(0, len(query), 1024):
                q = query[at : at + 1024]
                cos = np.round(x[q] @ x[data].T, 6)
                cos[(ids[q][:, None] == ids[data][None, :]) | (grp[q][:, None] == grp[data][None, :])] = -2
                keep = min(k, len(data))
                floor = -np.partition(-cos, keep - 1, axis=1)[:, keep - 1] if 0 < keep < len(data) else np.full(len(q), -2.0)
                r, c = np.nonzero((cos >= floor[:, None]) & (cos >= least))
                top = np.lexsort((c, -cos[r, c], r))
                r, c = r[top], c[top]
                nth = np.arange(len(r)) - np.searchsorted(r, r, side="left")
                r, c = r[nth < k], c[nth < k]
                out.append((ids[q][r], ids[data][c], cos[r, c]))
        cols = [np.concatenate([o[i] for o in out]) if out else np.zeros(0) for i in range(3)]
        return pa.Table.from_arrays([pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.int64)), pa.array(cols[2].astype(np.float64))], schema=schema)

    return compare


def posting_lists(vectors: DataFrame, dim: int, scratch: Scratch) -> DataFrame:
    """``(id, list)``: the lists of each row of ``vectors (id, vec)``, none of them larger than ``MOST_ROWS`` where splitting can help."""
    n = vectors.count()
    if not n:
        return scratch.save(vectors.select("id", F.lit(0).cast("long").alias("list")))
    seed = matrix(vectors.orderBy(F.xxhash64("id")).limit(SAMPLE).select("vec").toArrow().column("vec"), dim)
    centroids = fit_centroids(seed, _lists_wanted(n, len(seed)))
    placed = scratch.save(vectors.select("id", "vec").mapInArrow(_router(centroids, dim), "id long, list long"))
    for _ in range(LEVELS):
        sizes = placed.groupBy("list").agg(F.count("*").alias("n"))
        large = scratch.save(sizes.where(F.col("n") > MOST_ROWS))
        if large.isEmpty():
            break
        rows = scratch.save(placed.join(large, "list").join(vectors.select("id", "vec"), "id").select("list", "id", "vec", "n"))
        nth = F.row_number().over(W.partitionBy("list").orderBy(F.xxhash64("id", "list")))
        fitted = rows.withColumn("nth", nth).where(F.col("nth") <= SPLIT_SAMPLE).groupBy("list").applyInArrow(_fitter(dim), "list long, centroids binary")
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        ask = rows.select("list", "id", "vec", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block")).groupBy("list", "block")
        answer = fitted.join(large, "list").select("list", "centroids", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block")).groupBy("list", "block")
        finer = ask.cogroup(answer).applyInArrow(_splitter(dim), "id long, list long")
        placed = scratch.save(placed.join(large.select("list"), "list", "left_anti").select("id", "list").unionByName(finer), placed, rows)
    return placed


def search(vectors: DataFrame, dim: int, k: int, least: float, scratch: Scratch, group: DataFrame | None = None, placed: DataFrame | None = None) -> DataFrame:
    """``(id, other, cos)``: for each ``id`` up to ``k`` other ids of highest cosine, at least ``least``.

    ``vectors`` has unique ``id`` and distinct ``vec``; every row is indexed
    and every row is a query. Cosines are rounded to 6 digits, equal ones go
    to the smaller id. With ``group (id, grp)`` only others of another group
    count; groups are not negative. ``placed`` are lists made before.
    """
    placed = placed if placed is not None else posting_lists(vectors, dim, scratch)
    blocks = placed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = vectors.select("id", "vec")
    rows = rows.join(group, "id") if group is not None else rows.withColumn("grp", -1 - F.monotonically_increasing_id())
    own, at = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.col("with")
    cells = (
        placed.join(blocks, "list")
        .select("id", "list", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
        .select("id", "list", "own", F.least("own", at).alias("s"), F.greatest("own", at).alias("a"))
        .join(rows, "id")
    )
    found = cells.groupBy("list", "s", "a").applyInArrow(_compare(dim, k, least), "id long, other long, cos double")
    best = found.groupBy("id", "other").agg(F.max("cos").alias("cos"))
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("cos"), "other"))
    return best.withColumn("nth", rank).where(F.col("nth") <= k).drop("nth")


def most_similar(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = 128, k: int = 5, least: float = 0.85) -> DataFrame:
    """``(id, neighbor_id, cos)``: the ``k`` most similar other vectors of each vector.

    Cosine in double precision, rounded to 6 digits, at least ``least``; equal
    ones by smaller id. Vectors that cannot take part (see ``vectors.usable``)
    neither ask nor answer; an empty table gives no rows. Only the two named
    columns are read.
    """
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark, "neighbors")
    vectors = scratch.save(usable(df, id_col, vec_col, dim))
    distinct, members = copies(vectors, scratch)
    between = search(distinct, dim, k + 1, least, scratch)
    with_self = between.unionByName(distinct.select("id", F.col("id").alias("other"), F.lit(1.0).alias("cos")))
    nth_copy = F.row_number().over(W.partitionBy("first").orderBy("id"))  # the limit works below the shuffle, so a much copied vector sends few rows a task
    asked = members.withColumn("nth", nth_copy).where(F.col("nth") <= k + 1).select(F.col("first").alias("other"), F.col("id").alias("neighbor_id"))
    offered = with_self.join(asked, "other").select("id", "neighbor_id", "cos")
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("cos"), "neighbor_id"))
    lists = (
        offered.withColumn("nth", rank)
        .where(F.col("nth") <= k + 1)
        .groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("nth", "neighbor_id", "cos"))).alias("near"))
    )
    return (
        members.join(lists.withColumnRenamed("id", "first"), "first")
        .select("id", F.explode(F.slice(F.filter("near", lambda x: x["neighbor_id"] != F.col("id")), 1, k)).alias("x"))
        .select("id", F.col("x.neighbor_id").alias("neighbor_id"), F.col("x.cos").alias("cos"))
    )
