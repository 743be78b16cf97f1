"""Problem 4: consolidating pairwise matches into groups.

Method: Hash-to-Min. Every vertex keeps a cluster set; each round it sends the
set to the set's smallest member and that member to all others, until nothing
changes. Cluster sets are kept as rows ``(v, u)`` and never as arrays, so no
group is ever gathered in one task; minima are pre-aggregated map-side and the
join back is an equi-join that adaptive execution may split where one vertex
holds much of the data. Before the first round each input partition is
contracted by itself with union-find, which turns dense local links to stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.scratch import Scratch
from codestrata.session import ship

#: Links of one partition contracted at a time; bounds a task's memory only.
CONTRACT_ROWS = 1_000_000


def _contract_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stars (vertex, smallest vertex reached) of one block of links."""
    ids, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    far = label != np.arange(len(ids))
    return ids[far], ids[label[far]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            v, u = _contract_links(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(u, pa.int64())], names=["v", "u"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        n += batch.num_rows
        if n >= CONTRACT_ROWS:
            yield from flush()
            held, n = [], 0
    yield from flush()


def _state(df: DataFrame) -> tuple:
    """A fingerprint of a set of rows: its size and the sum of its row hashes."""
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def link_groups(links: DataFrame, a: str | Column = "a", b: str | Column = "b") -> DataFrame:
    """``(id, group_id)`` for every id that occurs in a link to another id.

    ``group_id`` is the smallest id reached directly or through others. Links
    with a null end or of an id with itself are no links; repeated links and
    either direction count once; an empty input gives an empty result. Only
    the two named columns are read, so other columns of any name may stand
    beside them.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    spark = links.sparkSession
    ship(spark)
    scratch = Scratch(spark, "link-groups")
    pairs = links.select(col(a).cast("long").alias("a"), col(b).cast("long").alias("b")).where("a <> b")
    stars = pairs.mapInArrow(_contract, "v long, u long")
    v, u = F.col("v"), F.col("u")
    ends = [(v, u), (u, v), (v, v), (u, u)]
    sets = scratch.save(
        stars.select(F.explode(F.array(*(F.struct(x.alias("v"), y.alias("u")) for x, y in ends))).alias("r")).select("r.v", "r.u").distinct()
    )
    before = _state(sets)
    while True:
        low = sets.groupBy("v").agg(F.min("u").alias("m"))
        sent = sets.join(low, "v").select(
            F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("r")
        )
        sets = scratch.save(sent.select("r.v", "r.u").distinct(), sets)
        now = _state(sets)
        if now == before:
            break
        before = now
    return sets.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("group_id"))
