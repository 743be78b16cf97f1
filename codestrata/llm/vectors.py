"""Vectors as rows: which take part, exact copies, and Arrow access."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.scratch import Scratch


def usable(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """``(id, vec)``: one row per id whose vector takes part.

    Null ids, null vectors, vectors of another length, with null, NaN or
    infinite parts, or all zero take no part. Repeated rows count once; of
    differing vectors under one id the smallest counts.
    """
    v = F.col("vec")
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))) & F.exists(v, lambda x: x != 0)
    return (
        df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("vec"))
        .where(F.col("id").isNotNull() & (F.size("vec") == dim))
        .where(fine)
        .groupBy("id")
        .agg(F.min("vec").alias("vec"))
    )


def copies(vectors: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(``(id, vec)`` of each distinct vector under its smallest id, ``(id, first)`` of every id).

    Vectors are told apart by 128 bits of hash, so only narrow rows are joined;
    the smallest id is found before the shuffle, task by task.
    """
    keyed = scratch.save(vectors.select("id", F.xxhash64("vec").alias("h"), F.xxhash64(F.lit(1), "vec").alias("g")))
    members = scratch.save(keyed.join(keyed.groupBy("h", "g").agg(F.min("id").alias("first")), ["h", "g"]).select("id", "first"))
    distinct = scratch.save(vectors.join(members.where("id = first").select("id"), "id", "left_semi").select("id", "vec"))
    return distinct, members


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """A list<float> column as an (n, dim) array of unit rows in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    m = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True) if len(m) else m
