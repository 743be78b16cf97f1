"""Vector search and vector statistics by built-in expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer

from codestrata.functions import paths, vectors
from codestrata.session import ship


def top_k(chunks: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vec_col: str = "embedding", **equal: str) -> DataFrame:
    """The k chunks most similar to a query vector, after equality filters; a top-k, never a sort."""
    for c, v in equal.items():
        chunks = chunks.where(F.col(c) == v)
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = chunks.where(vectors.usable(F.col(vec_col), len(query))).withColumn("score", F.round(vectors.cosine(F.col(vec_col), q), 6))
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def context_first(chunks: DataFrame, query: list[float], context_file: str | Column, limit: int = 5, of_file: int = 2) -> DataFrame:
    """Up to ``of_file`` hits of the context file, then other files' hits up to the limit, in order."""
    own = top_k(chunks.where(F.col("file_path") == context_file), query, of_file).withColumn("branch", F.lit(0))
    rest = top_k(chunks.where(F.col("file_path") != context_file), query, limit).withColumn("branch", F.lit(1))
    return own.unionByName(rest).orderBy("branch", F.desc("score"), "vec_id").limit(limit)


QUERY_BLOCK, DATA_BLOCK = 1_024, 16_384


def nearest(queries: DataFrame, data: DataFrame, k: int, dim: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, near, similarity, nth)``: exact k nearest others of a stated query set, block against block.

    Each block pair is one task of bounded size and sends k rows a query.
    """
    ship(data.sparkSession)
    pick = lambda df: df.where(vectors.usable(F.col(vec_col), dim)).select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    q, d = pick(queries), pick(data)
    qn, dn = max(1, -(-q.count() // QUERY_BLOCK)), max(1, -(-d.count() // DATA_BLOCK))
    h = F.xxhash64("id")
    q = q.select("id", "v", F.lit(1).alias("ask"), F.pmod(h, F.lit(qn)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(dn - 1))).alias("db"))
    d = d.select("id", "v", F.lit(0).alias("ask"), F.explode(F.sequence(F.lit(0), F.lit(qn - 1))).alias("qb"), F.pmod(h, F.lit(dn)).cast("int").alias("db"))

    def block(t: pa.Table) -> pa.Table:
        ask, ids = t.column("ask").to_numpy(), t.column("id").to_numpy()
        x = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        a, b = np.flatnonzero(ask == 1), np.flatnonzero(ask == 0)
        b = b[np.argsort(ids[b])]
        sim = np.round(x[a] @ x[b].T, 6)
        sim[ids[a][:, None] == ids[b][None, :]] = -2
        top = np.argsort(-sim, axis=1, kind="stable")[:, :k]
        r = np.repeat(np.arange(len(a)), top.shape[1])
        c = top.ravel()
        return pa.table({"id": pa.array(ids[a][r], pa.int64()), "near": pa.array(ids[b][c], pa.int64()), "similarity": pa.array(sim[r, c], pa.float64())})

    found = q.unionByName(d).groupBy("qb", "db").applyInArrow(block, "id long, near long, similarity double").where("similarity > -2")
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("similarity"), "near"))
    return found.withColumn("nth", rank).where(F.col("nth") <= k).select(F.col("id").alias("vec_id"), "near", "similarity", "nth")


def mean_vectors(chunks: DataFrame, *by: str, vec_col: str = "embedding", dim: int = 128) -> DataFrame:
    """The element-wise mean vector and the count per group, aggregated map-side."""
    fit = chunks.where(vectors.usable(F.col(vec_col), dim))
    v = array_to_vector(F.col(vec_col).cast("array<double>"))
    return fit.groupBy(*by).agg(vector_to_array(Summarizer.mean(v)).alias("mean"), F.count("*").alias("n"))


def cohesion(chunks: DataFrame, group: str, vec_col: str = "embedding", dim: int = 128) -> DataFrame:
    """Mean pairwise cosine of each group in one pass: (|sum u|^2 - n) / (n (n - 1)); 1 for a single vector."""
    fit = chunks.where(vectors.usable(F.col(vec_col), dim)).withColumn("u", vectors.unit(F.col(vec_col)))
    agg = fit.groupBy(group).agg(vector_to_array(Summarizer.sum(array_to_vector("u"))).alias("s"), F.count("*").alias("n"))
    pairs = (vectors.dot(F.col("s"), F.col("s")) - F.col("n")) / (F.col("n") * (F.col("n") - 1))
    return agg.select(group, "n", F.round(F.when(F.col("n") > 1, pairs).otherwise(1.0), 6).alias("cohesion"))


def style_consistency(chunks: DataFrame, dim: int = 128) -> DataFrame:
    """``(file_path, folder, similarity, best_folder, best_similarity, off_style, move)``: each file's mean against the means of folders.

    The files are a query set that meets the folders block by block. Cosines
    have 3 digits; a file is off style below 0.6, and should move where another
    folder is better by more than 0.1. Of equally similar folders always the same one counts.
    """
    c = chunks.withColumn("folder", paths.directory(F.col("file_path"), "root"))
    files, folders = mean_vectors(c, "file_path", "folder", dim=dim), mean_vectors(c, "folder", dim=dim)
    own = files.join(folders.select("folder", F.col("mean").alias("fm")), "folder")
    own = own.select("file_path", "folder", F.round(vectors.cosine(F.col("mean"), F.col("fm")), 3).alias("similarity"))
    ids = folders.select("folder", F.pmod(F.xxhash64("folder"), F.lit(1 << 62)).alias("at"))
    key = F.xxhash64("file_path", "folder")
    negative = F.when(key < 0, key).otherwise(-1 - key)  # never a folder's number
    near = nearest(files.select(negative.alias("vec_id"), "mean"), folders.join(ids, "folder").select(F.col("at").alias("vec_id"), "mean"), 1, dim, vec_col="mean")
    best = near.join(ids.select(F.col("at").alias("near"), F.col("folder").alias("best_folder")), "near").select("vec_id", "best_folder", F.round("similarity", 3).alias("best_similarity"))
    return own.withColumn("vec_id", negative).join(best, "vec_id").select("file_path", "folder", "similarity", "best_folder", "best_similarity", (F.col("similarity") < 0.6).alias("off_style"), (F.col("best_similarity") > F.round(F.col("similarity") + 0.1, 3)).alias("move"))
