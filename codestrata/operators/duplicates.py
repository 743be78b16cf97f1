"""Groups of similar chunks inside a repository, and what they would save."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.operators.graph import components
from codestrata.session import ship

BLOCK = 2_048


def similar_pairs(chunks: DataFrame, threshold: float, dim: int, group: str = "repository_id", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(grp, a, b, similarity, copy)`` with a < b inside each group, block against block.

    Equal vectors are compared once and linked to their first copy (``copy``
    is true), so copies do not multiply into pairs.
    """
    ship(chunks.sparkSession)
    fit = chunks.where((F.size(vec_col) == dim) & F.exists(vec_col, lambda v: v != 0)).select(F.col(group).cast("string").alias("grp"), F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    first = fit.groupBy("grp", "v").agg(F.min("id").alias("id"))
    copies = fit.join(first.withColumnRenamed("id", "first"), ["grp", "v"]).where("id <> first").select("grp", F.col("first").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"), F.lit(True).alias("copy"))
    sizes = first.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = first.join(sizes, "grp").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    left = own.select("grp", "id", "v", F.lit(0).alias("side"), F.col("own").alias("i"), F.explode(F.sequence(F.col("own"), F.col("blocks") - 1)).alias("j"))
    right = own.select("grp", "id", "v", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"), F.col("own").alias("j"))

    def compare(t: pa.Table) -> pa.Table:
        side, ids = t.column("side").to_numpy(), t.column("id").to_numpy()
        x = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        p, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        s = np.round(x[p] @ x[q].T, 6)
        same = t.column("i")[0].as_py() == t.column("j")[0].as_py()
        keep = (s >= threshold) & (ids[p][:, None] != ids[q][None, :])
        if same:
            keep &= ids[p][:, None] < ids[q][None, :]
        r, c = np.nonzero(keep)
        a, b = ids[p][r], ids[q][c]
        return pa.table({"grp": pa.array([t.column("grp")[0].as_py()] * len(r), pa.string()), "a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b)), "similarity": pa.array(s[r, c])})

    found = left.unionByName(right).groupBy("grp", "i", "j").applyInArrow(compare, "grp string, a long, b long, similarity double")
    return found.withColumn("copy", F.lit(False)).unionByName(copies)


def greedy_groups(pairs: DataFrame) -> DataFrame:
    """``(grp, seed, id, similarity)``: the first unused chunk takes all unused ones similar to it, in order of id.

    Greedy over first copies inside each connected component, which decides
    alone about its rows; copies then go where their first copy is.
    """
    ship(pairs.sparkSession)
    flag = F.col("copy") if "copy" in pairs.columns else F.lit(False)
    rows = pairs.select("grp", "a", "b", "similarity", flag.alias("copy"))
    copies = rows.where("copy").select("grp", F.col("a").alias("id"), F.col("b").alias("other"))
    copied = copies.select("grp", "id").distinct()
    links = rows.where("NOT copy").drop("copy").unionByName(copied.select("grp", F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity")))
    comp = components(links.select("a", "b")).withColumnRenamed("id", "a")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[tuple[int, float]]] = {}
        for a, b, s in zip(pdf["a"], pdf["b"], pdf["similarity"]):
            near.setdefault(a, []).append((b, s))
        used: set[int] = set()
        out = []
        for a in sorted(near):
            if a in used:
                continue
            got = [(b, s) for b, s in sorted(near[a]) if b not in used]  # a itself is among them where it has copies
            if got:
                used |= {a, *(b for b, _ in got)}
                out += [(pdf["grp"].iloc[0], a, a, 1.0), *((pdf["grp"].iloc[0], a, b, s) for b, s in got if b != a)]
        return pd.DataFrame(out, columns=["grp", "seed", "id", "similarity"])

    firsts = links.join(comp, "a").groupBy("group_id").applyInPandas(run, "grp string, seed long, id long, similarity double")
    everyone = copies.unionByName(copied.withColumn("other", F.col("id")))
    return firsts.join(everyone, ["grp", "id"], "left").select("grp", "seed", F.coalesce("other", "id").alias("id"), "similarity")


def savings(groups: DataFrame, chunks: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """``(seed, chunks, similarity, lines)``: group size, mean similarity, and the lines of all but the seed."""
    spans = chunks.select(F.col(id_col).alias("id"), (F.col("line_end") - F.col("line_start")).alias("span")).distinct()
    joined = groups.join(spans, "id", "left")
    return joined.groupBy("seed").agg(
        F.count("*").alias("chunks"),
        F.round(F.avg(F.when(F.col("id") != F.col("seed"), F.col("similarity"))), 4).alias("similarity"),
        F.coalesce(F.sum(F.when(F.col("id") != F.col("seed"), F.col("span"))), F.lit(0)).cast("long").alias("lines"),
    )
