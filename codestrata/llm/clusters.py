"""Problem 6: grouping records into similarity clusters.

Method: an approximate nearest-neighbour graph is built by neighbour descent
(random-projection leaves to start from, then neighbours of neighbours), the
edges of at least the wanted similarity are clustered by modularity-based local
moving until no vertex gains, and communities are described by their highest
internal weighted degree.

For groups defined by a similarity bound the communities are tested against the
definition: posting lists are searched for the most similar vector of another
community of every vector. What reaches the bound is an edge that the graph
lacks, so moving goes on with it; communities that are still reached from
outside when no vertex gains any more, or that hold a pair below the bound, are
no groups.

Nothing is gathered per group: leaves, pools and groups are cut into blocks of
bounded size, and exact copies of a vector are clustered once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codestrata.llm.neighbors import posting_lists, search
from codestrata.llm.vectors import copies, matrix, usable
from codestrata.scratch import Scratch
from codestrata.session import ship

#: Vectors that the projection trees are fitted on, at most; all vectors pass through them.
SAMPLE = 20_000
#: Trees, and the rows a leaf should hold. Where the sample is too small for such leaves, random planes split them on.
TREES, LEAF = 4, 64
#: Neighbours kept for each vector; reverse neighbours that join a pool; descent rounds at most.
K, BACK, ROUNDS = 10, 6, 4
#: Descent ends when no more than this share of the entries that reach the bound are new.
CALM = 0.05
#: Rows of a block where groups are compared exactly.
BLOCK = 1_024
#: Weight of the expected edges in modularity. The definition knows no upper size of a group, so it is low.
RESOLUTION = 0.05


class ProjectionTree:
    """Random hyperplanes through a sample; a row's leaf is found by walking down."""

    def __init__(self, x: np.ndarray, leaf: int, rng: np.random.Generator) -> None:
        self.normals: list[np.ndarray] = []
        self.cuts: list[float] = []
        self.kids: list[list[int]] = []
        self.leaves = 0
        self.middles: list[np.ndarray] = []
        self._grow(x, leaf, rng)
        self.normals_ = np.stack(self.normals) if self.normals else np.zeros((0, x.shape[1]), np.float32)
        self.middles_ = np.stack(self.middles).astype(np.float32)
        self.cuts_, self.kids_ = np.array(self.cuts, np.float32), np.array(self.kids, np.int64).reshape(-1, 2)

    def _grow(self, x: np.ndarray, leaf: int, rng: np.random.Generator) -> int:
        """Index of the node, or -1 - leaf number."""
        if len(x) > leaf:
            a, b = x[rng.choice(len(x), 2, replace=False)]
            side = x @ (a - b)
            cut = float(np.median(side))
            right = side > cut
            if 0 < right.sum() < len(x):
                at = len(self.normals)
                self.normals.append((a - b).astype(np.float32))
                self.cuts.append(cut)
                self.kids.append([0, 0])
                self.kids[at] = [self._grow(x[~right], leaf, rng), self._grow(x[right], leaf, rng)]
                return at
        self.leaves += 1
        self.middles.append(x.mean(axis=0) if len(x) else np.zeros(x.shape[1]))
        return -self.leaves

    def leaf_of(self, x: np.ndarray, planes: int = 0) -> np.ndarray:
        """The leaf of each row; ``planes`` random planes through the middle split every leaf of the sample on."""
        at = np.zeros(len(x), np.int64) if len(self.kids_) else np.full(len(x), -1)
        while (at >= 0).any():
            live = np.flatnonzero(at >= 0)
            node = at[live]
            right = np.einsum("nd,nd->n", x[live], self.normals_[node]) > self.cuts_[node]
            at[live] = self.kids_[node, right.astype(int)]
        leaf = -1 - at
        if planes:
            side = np.random.default_rng(17).normal(size=(planes, x.shape[1])).astype(np.float32)
            code = ((x - self.middles_[leaf]) @ side.T > 0) @ (1 << np.arange(planes, dtype=np.int64))
            leaf = (leaf << planes) + code
        return leaf


_EDGES = pa.schema([("id", pa.int64()), ("other", pa.int64()), ("cos", pa.float64())])


def _edges(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    cols = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in range(3)]
    return pa.Table.from_arrays([pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.int64)), pa.array(cols[2].astype(np.float64))], schema=_EDGES)


def _halves(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Unit vectors kept as half floats."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(-1, dim).astype(np.float32)


def _leaf_lists(dim: int, k: int):
    """The k most similar rows inside one block of a leaf."""

    def lists(table: pa.Table) -> pa.Table:
        ids, x = table.column("id").to_numpy(), _halves(table.column("unit"), dim)
        if len(ids) < 2:
            return _edges([])
        cos = x @ x.T
        np.fill_diagonal(cos, -2)
        top = np.argpartition(-cos, min(k, len(ids) - 1) - 1, axis=1)[:, : min(k, len(ids) - 1)]
        r = np.repeat(np.arange(len(ids)), top.shape[1])
        return _edges([(ids[r], ids[top.ravel()], cos[r, top.ravel()])])

    return lists


def _pool_pairs(dim: int):
    """Pairs inside each pool of which one is new, where they beat an end's worst entry.

    Rows come sorted by pool, so a pool may go on in the next batch.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def close(t: pa.Table) -> Iterator[pa.RecordBatch]:
            pool = t.column("pool").to_numpy()
            ids, floor, new = t.column("id").to_numpy(), t.column("floor").to_numpy(), t.column("new").to_numpy(zero_copy_only=False)
            x = _halves(t.column("unit"), dim)
            cuts = np.flatnonzero(np.concatenate([[True], pool[1:] != pool[:-1], [True]]))
            out = []
            for a, b in zip(cuts, cuts[1:]):
                if b - a < 2:
                    continue
                cos = x[a:b] @ x[a:b].T
                np.fill_diagonal(cos, -2)
                r, c = np.nonzero((cos > floor[a:b, None] + 1e-6) & (new[a:b, None] | new[None, a:b]))
                out.append((ids[a:b][r], ids[a:b][c], cos[r, c]))
            yield from _edges(out).to_batches()

        for batch in batches:
            t = pa.Table.from_batches([batch])
            if held is not None:
                t = pa.concat_tables([held, t])
            pool = t.column("pool").to_numpy()
            cut = int(np.searchsorted(pool, pool[-1], side="left")) if len(pool) else 0
            if cut:
                yield from close(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None and held.num_rows:
            yield from close(held)

    return pairs


def neighbour_descent(vectors: DataFrame, dim: int, least: float, scratch: Scratch) -> DataFrame:
    """``(id, other, cos)``: about the ``K`` most similar others of each row.

    ``vectors`` has unique ``id`` and distinct ``vec``. Vectors travel as half
    floats, so cosines are exact to some 0.0005 only. A pool without a new
    entry is not visited again.
    """
    seed = matrix(vectors.orderBy(F.xxhash64("id")).limit(SAMPLE).select("vec").toArrow().column("vec"), dim).astype(np.float32)
    n = vectors.count()
    rng = np.random.default_rng(11)
    leaf = max(8, int(LEAF * len(seed) / max(n, 1)))
    planes = max(0, int(np.log2(max(1.0, leaf * n / max(len(seed), 1) / LEAF))))
    trees = [ProjectionTree(seed, leaf, rng) for _ in range(TREES)]

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), dim).astype(np.float32)
            packed = pa.array([v.tobytes() for v in x.astype(np.float16)], pa.binary())
            where = np.stack([tree.leaf_of(x, planes) * TREES + i for i, tree in enumerate(trees)], axis=1)
            leaves = pa.FixedSizeListArray.from_arrays(pa.array(where.ravel(), pa.int64()), TREES).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), packed, leaves], names=["id", "unit", "leaves"])

    units = scratch.save(vectors.select("id", "vec").mapInArrow(plant, "id long, unit binary, leaves array<long>"))
    leaves = units.select("id", "unit", F.explode("leaves").alias("leaf"))
    sizes = units.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    cells = leaves.join(sizes.where("blocks > 1"), "leaf", "left").withColumn("block", F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))))
    first = cells.groupBy("leaf", "block").applyInArrow(_leaf_lists(dim, K), "id long, other long, cos double")

    def best(rows: DataFrame) -> DataFrame:
        """rows: id, other, cos, old. An entry is new if it was not there before."""
        once = rows.groupBy("id", "other").agg(F.max("cos").alias("cos"), F.max("old").alias("old"))
        rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("cos"), "other"))
        return once.withColumn("nth", rank).where(F.col("nth") <= K).select("id", "other", "cos", (~F.col("old")).alias("new"))

    graph = scratch.save(best(first.withColumn("old", F.lit(False))))
    for _ in range(ROUNDS):
        floors = graph.groupBy("id").agg(F.when(F.count("*") >= K, F.min("cos")).otherwise(F.lit(-1.5)).alias("floor"))
        there = graph.select(F.col("id").alias("pool"), F.col("other").alias("id"), "new")
        shuffled = F.row_number().over(W.partitionBy("pool").orderBy(F.desc("new"), F.xxhash64("id", "pool")))
        back = graph.select(F.col("other").alias("pool"), "id", "new").withColumn("nth", shuffled).where(F.col("nth") <= BACK).drop("nth")
        member = scratch.save(there.unionByName(back).groupBy("pool", "id").agg(F.max("new").alias("new")))
        pool = member.join(member.where("new").select("pool").distinct(), "pool", "left_semi")
        rows = pool.join(units.select("id", "unit").join(floors, "id", "left").fillna(-1.5, ["floor"]), "id")
        found = rows.select("pool", "id", "unit", "floor", "new").repartition("pool").sortWithinPartitions("pool").mapInArrow(_pool_pairs(dim), "id long, other long, cos double")
        fresh = found.groupBy("id", "other").agg(F.max("cos").alias("cos")).withColumn("old", F.lit(False))
        graph = scratch.save(best(graph.select("id", "other", "cos", F.lit(True).alias("old")).unionByName(fresh)), graph, member)
        new, every = graph.where(F.col("cos") >= least).agg(F.count_if("new"), F.count("*")).first()
        if new <= CALM * every:
            break
    return graph.select("id", "other", "cos")


def communities(edges: DataFrame, scratch: Scratch, rounds: int = 3, resolution: float = 1.0, start: DataFrame | None = None) -> DataFrame:
    """``(id, community)`` by modularity-based local moving over undirected ``(a, b, w)``.

    In a round every vertex moves to the neighbouring community of the highest
    modularity gain, if that bears a smaller number than its own; numbers only
    fall, so moves in parallel cannot swap for ever. After ``rounds`` rounds,
    or fewer where nothing moves, communities become the vertices of the next
    level; the end is a level without a move. ``start`` gives communities to
    begin with, ``resolution`` weighs the edges expected by chance.
    """
    both = edges.select("a", "b", "w").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    level = scratch.save(both)
    total = level.agg(F.sum("w")).first()[0]
    member = scratch.save(level.select(F.col("a").alias("id")).distinct().select("id", F.col("id").alias("community")))
    if not total:
        return member
    fold = start
    while True:
        if fold is not None:
            member = scratch.save(member.join(fold.select(F.col("id").alias("community"), F.col("community").alias("c")), "community", "left").select("id", F.coalesce("c", "community").alias("community")), member)
            of_a, of_b = (fold.select(F.col("id").alias(x), F.col("community").alias(f"c{x}")) for x in "ab")
            ends = [F.coalesce(f"c{x}", x).alias(x) for x in "ab"]
            level = scratch.save(level.join(of_a, "a", "left").join(of_b, "b", "left").select(*ends, "w").groupBy("a", "b").agg(F.sum("w").alias("w")), level)
        own = scratch.save(level.groupBy("a").agg(F.sum("w").alias("deg")).select("a", F.col("a").alias("c"), "deg"))
        few = own.count() // 50  # the next level goes on where only so many moved
        any_moved = False
        for _ in range(rounds):
            mass = own.groupBy("c").agg(F.sum("deg").alias("mass"))
            seen_from = own.join(mass, "c").select(F.col("a").alias("b"), "c", "mass")
            towards = level.where("a <> b").join(seen_from, "b").groupBy("a", "c").agg(F.sum("w").alias("into"), F.max("mass").alias("mass"))
            offers = towards.join(own.select("a", F.col("c").alias("now"), "deg"), "a").select(
                "a",
                "c",
                (F.col("into") - resolution * F.col("deg") * (F.col("mass") - F.when(F.col("c") == F.col("now"), F.col("deg")).otherwise(0.0)) / F.lit(total)).alias("gain"),
            )
            best = offers.groupBy("a").agg(F.max(F.struct(F.round("gain", 9).alias("gain"), (-F.col("c")).alias("neg"))).alias("x"))
            moves = (F.col("x.gain") > 0) & (-F.col("x.neg") < F.col("c"))
            new = scratch.save(own.join(best, "a", "left").select("a", F.when(moves, -F.col("x.neg")).otherwise(F.col("c")).alias("c"), "deg", F.coalesce(moves, F.lit(False)).alias("moved")), own)
            own = new.drop("moved")
            own._scratch_path = new._scratch_path
            moved = new.where("moved").count()
            any_moved = any_moved or moved > 0
            if moved <= few:
                break
        fold = own.select(F.col("a").alias("id"), F.col("c").alias("community"))
        if not any_moved:
            return member


def _block_check(dim: int, least: float):
    """Whether a block holds a pair below the bound."""

    def check(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        x = matrix(table.column("vec"), dim)
        a, b = x[side == 0], x[side == 1]
        low = bool(len(a) and len(b) and np.round(a @ b.T, 6).min() < least)
        return pa.table({"grp": table.column("grp").slice(0, 1), "broken": pa.array([low])})

    return check


def _unit_rows(dim: int):
    """Each vector at length one."""

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = matrix(batch.column(2), dim).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(u) + 1, dim), pa.int32()), pa.array(u))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["grp", "id", "u"])

    return units


def _near_middle(dim: int, cap: float):
    """Whether a row lies so far from its group's middle that it must be compared."""

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, mid = (batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) for i in (2, 3))
            dot = np.einsum("nd,nd->n", u, mid) / np.maximum(np.linalg.norm(mid, axis=1), 1e-12)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 4)), pa.array(dot < cap)], names=["grp", "id", "n", "far"])

    return far


def mutual_groups(grouped: DataFrame, dim: int, least: float, scratch: Scratch) -> DataFrame:
    """``(grp)``: the groups any two of whose vectors reach ``least``; rows are (grp, id, vec).

    Rows so near their group's middle that any two of them must reach the bound
    are not compared with each other; only the others meet all rows, in blocks.
    """
    units = scratch.save(grouped.select("grp", "id", "vec").mapInArrow(_unit_rows(dim), "grp long, id long, u array<double>"))
    middle = units.groupBy("grp").agg(vector_to_array(Summarizer.mean(array_to_vector("u"))).alias("mid"), F.count("*").alias("n"))
    cap = float(np.sqrt((1 + least) / 2)) + 1e-6
    placed = scratch.save(units.join(middle, "grp").select("grp", "id", "u", "mid", "n").mapInArrow(_near_middle(dim, cap), "grp long, id long, n long, far boolean"))
    rows = placed.join(placed.where("far").select("grp").distinct(), "grp", "left_semi").join(units.select("id", F.col("u").alias("vec")), "id")
    rows = rows.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    all_blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    asked = rows.where("far").select("grp", "vec", F.lit(0).alias("side"), F.col("own").alias("i"), all_blocks.alias("j"))
    answering = rows.select("grp", "vec", F.lit(1).alias("side"), all_blocks.alias("i"), F.col("own").alias("j"))
    checked = asked.unionByName(answering).groupBy("grp", "i", "j").applyInArrow(_block_check(dim, least), "grp long, broken boolean")
    return placed.select("grp").distinct().join(checked.where("broken").select("grp").distinct(), "grp", "left_anti")


def bounded_groups(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = 128, least: float = 0.70, smallest: int = 4, resolution: float = RESOLUTION) -> DataFrame:
    """``(id, first_id)`` of every vector in a group of mutual similarity.

    A group has at least ``smallest`` vectors, any two of cosine ``least`` or
    more, and reaches no vector outside. Vectors that cannot take part (see
    ``vectors.usable``) are in no group; copies of one vector are members of
    their own; an empty table gives no rows. Only the two named columns are
    read. Whether a vector outside reaches a group is looked up in posting
    lists, whose recall ``neighbors`` states; all else is exact.
    """
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark, "clusters")
    vectors = scratch.save(usable(df, id_col, vec_col, dim))
    distinct, copied = copies(vectors, scratch)
    graph = neighbour_descent(distinct, dim, least, scratch)
    # half floats: an edge within their error of the bound is left to the exact search below
    edges = scratch.save(
        graph.where(F.col("cos") >= least + 5e-4).groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).agg(F.max("cos").alias("w"))
    )
    placed, fold = posting_lists(distinct, dim, scratch), None
    while True:
        found = communities(edges, scratch, resolution=resolution, start=fold)
        member = scratch.save(distinct.select("id").join(found, "id", "left").select("id", F.coalesce("community", "id").alias("grp")))
        near = scratch.save(search(distinct, dim, 1, least, scratch, member, placed))
        reached = near.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), F.col("cos").alias("w")).distinct()
        more = scratch.save(reached.join(edges, ["a", "b"], "left_anti"))
        if more.isEmpty():
            break
        edges = scratch.save(edges.unionByName(more), edges)
        fold = member.select("id", F.col("grp").alias("community"))
    open_groups = near.select("id").unionByName(near.select(F.col("other").alias("id"))).distinct().join(member, "id").select("grp").distinct()
    sizes = copied.join(member.select(F.col("id").alias("first"), "grp"), "first").groupBy("grp").agg(F.count("*").alias("size"), F.min("id").alias("first_id"))
    whole = scratch.save(sizes.where(F.col("size") >= smallest).join(open_groups, "grp", "left_anti"))
    rows = member.join(whole.select("grp"), "grp", "left_semi").join(distinct, "id").select("grp", "id", "vec")
    sound = mutual_groups(rows, dim, least, scratch)
    kept = member.join(whole.join(sound, "grp", "left_semi").select("grp", "first_id"), "grp").select(F.col("id").alias("first"), "first_id")
    return copied.join(kept, "first").select("id", "first_id")


def described_communities(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", file_col: str = "file_path", dim: int = 128, least: float = 0.70, smallest: int = 4, top: int = 5) -> DataFrame:
    """One row per group of ``bounded_groups``; ``community`` is its smallest id.

    ``(community, size, file_count, cohesion, top_ids, top_files)``: cohesion is
    the mean cosine of any two members; ``top_ids`` are the members of the
    highest summed cosine with the others (ties: smaller id) and ``top_files``
    their files. Both follow from the sum of a group's unit vectors.
    """
    scratch = Scratch(df.sparkSession, "communities")
    groups = bounded_groups(df, id_col, vec_col, dim, least, smallest).withColumnRenamed("first_id", "community")
    unit = F.expr("aggregate(vec, 0D, (s, x) -> s + CAST(x AS DOUBLE) * x, s -> sqrt(s))")
    placed = usable(df, id_col, vec_col, dim).join(groups, "id").withColumn("len", unit)
    files = df.select(F.col(id_col).cast("long").alias("id"), F.col(file_col).alias("file")).groupBy("id").agg(F.min("file").alias("file"))
    members = scratch.save(placed.select("community", "id", F.expr("transform(vec, x -> CAST(x AS DOUBLE) / len)").alias("u")).join(files, "id", "left"))
    sums = members.groupBy("community").agg(
        vector_to_array(Summarizer.sum(array_to_vector("u"))).alias("total"), F.count("*").alias("size"), F.countDistinct("file").alias("file_count")
    )
    square = F.expr("aggregate(total, 0D, (s, x) -> s + x * x)")
    sizes = scratch.save(sums.withColumn("cohesion", F.round((square - F.col("size")) / (F.col("size") * (F.col("size") - 1)), 6)))
    strength = F.expr("aggregate(zip_with(u, total, (a, b) -> a * b), 0D, (s, x) -> s + x)") - 1
    rank = F.row_number().over(W.partitionBy("community").orderBy(F.desc(F.round("strength", 6)), "id"))
    leaders = (
        members.join(sizes.select("community", "total"), "community")
        .select("community", "id", "file", strength.alias("strength"))
        .withColumn("nth", rank)
        .where(F.col("nth") <= top)
        .groupBy("community")
        .agg(F.sort_array(F.collect_list(F.struct("nth", "id", "file"))).alias("x"))
        .select("community", F.col("x.id").alias("top_ids"), F.array_distinct(F.filter("x.file", lambda f: f.isNotNull())).alias("top_files"))
    )
    return sizes.drop("total").join(leaders, "community").select("community", "size", "file_count", "cohesion", "top_ids", "top_files")
