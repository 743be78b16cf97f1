"""Problem 9: mixing sources to target weights.

Method: time-varying curriculum. Each source has a weight schedule over
training time; its integral is the demand for the source's tokens up to a
time. A use of a text starts where the cumulative demand reaches the
cumulative tokens before it, so inverting the demand gives its training
position, and the uses are range-sorted by position.

Cumulative sums are taken by one range sort with sums per partition, so a
source that holds a third of all texts is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codestrata.llm.tokens import VOCABULARY, token_sizes
from codestrata.scratch import Scratch
from codestrata.session import ship

#: How far the default schedules lean: sources of long texts grow by this share towards the end.
LEAN = 0.5
#: Points at which schedules are integrated.
GRID = 257


def default_schedules(shares: dict[str, float], lengths: dict[str, float], lean: float = LEAN) -> dict[str, list[tuple[float, float]]]:
    """Linear schedules of the target shares as integrals: short texts early, long texts late."""
    known = {s: lengths.get(s) or 0.0 for s in shares}
    mean = sum(shares[s] * known[s] for s in shares) / max(sum(shares.values()), 1e-12)
    spread = max((abs(known[s] - mean) for s in shares), default=0.0) or 1.0
    tilt = {s: lean * (known[s] - mean) / spread for s in shares}
    return {s: [(0.0, shares[s] * (1 - tilt[s])), (1.0, shares[s] * (1 + tilt[s]))] for s in shares}


def integral(knots: list[tuple[float, float]], grid: np.ndarray) -> np.ndarray:
    """The integral of a piecewise linear schedule from 0 to each point of the grid."""
    t, w = zip(*sorted(knots))
    v = np.maximum(np.interp(grid, t, w), 0.0)
    return np.concatenate([[0.0], np.cumsum((v[1:] + v[:-1]) / 2 * np.diff(grid))])


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the tokens before each row among the rows of its source in this partition; rows come sorted by source."""
    total: dict[str, int] = {}
    for batch in batches:
        source, n = batch.column(1).to_pylist(), batch.column(2).to_numpy()
        before = np.zeros(len(n), np.int64)
        for i, (s, k) in enumerate(zip(source, n.tolist())):
            before[i] = total.get(s, 0)
            total[s] = before[i] + k
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(before)], names=["id", "source", "tokens", "pid", "before"])


def _positions(tables: dict[str, tuple[float, np.ndarray]], grid: np.ndarray):
    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source = np.array(batch.column(1).to_pylist(), object)
            start = batch.column(4).to_numpy().astype(np.float64)
            at = np.zeros(len(start))
            for s in set(source.tolist()):
                used, cumulative = tables[s]
                own = source == s
                at[own] = np.interp(start[own] / used, cumulative, grid)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(at)], names=["id", "source", "tokens", "use_no", "position"])

    return positions


def demand(totals: dict[str, int], targets: dict[str, tuple[float, int]], budget: int | None = None) -> dict[str, float]:
    """Tokens to take from each source: its share of the budget, at most ``max_repeats`` times what it has.

    The default budget is the size of all sources together. Sources that are
    too small give all they may; the others keep their ratio to each other.
    """
    budget = sum(totals.get(s, 0) for s in targets) if budget is None else budget
    return {s: min(share * budget, float(max(0, most) * totals.get(s, 0))) for s, (share, most) in targets.items()}


def mix(sizes: DataFrame, targets: DataFrame, scratch: Scratch, schedules: dict[str, list[tuple[float, float]]] | None = None, budget: int | None = None) -> DataFrame:
    """``(place, id, source, use_no, tokens, position)``: one row per use of a text, in training order.

    ``sizes`` has (id, source, tokens) with unique ids, ``targets`` (source,
    target_share, max_repeats). Texts of no tokens, of a null source or of a
    source without a target are not used; of repeated targets the largest share
    counts; null shares and repeats are 0. The text that crosses a source's
    demand is used if more than half of it is within, so shares are met to half
    a text.
    """
    spark = sizes.sparkSession
    ship(spark)
    empty = spark.createDataFrame([], "place long, id long, source string, use_no int, tokens long, position double")
    wanted: dict[str, tuple[float, int]] = {}
    for r in targets.select("source", "target_share", "max_repeats").distinct().collect():  # one row a source
        if r[0] is not None:
            wanted[r[0]] = max(wanted.get(r[0], (0.0, 0)), (float(r[1] or 0), int(r[2] or 0)))
    live = sizes.where("tokens > 0").join(F.broadcast(spark.createDataFrame([(s,) for s in wanted], "source string")), "source")
    facts = {r["source"]: (r["n"], r["t"]) for r in live.groupBy("source").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).collect()}
    if not facts:
        return empty
    totals = {s: t for s, (_, t) in facts.items()}
    take = {s: d for s, d in demand(totals, wanted, budget).items() if d > 0}
    if not take:
        return empty
    shares = {s: wanted[s][0] for s in take}
    plans = schedules or default_schedules(shares, {s: facts[s][1] / facts[s][0] for s in take})
    grid = np.linspace(0.0, 1.0, GRID)
    tables = {}
    for s in take:
        c = integral(plans.get(s, [(0.0, 1.0), (1.0, 1.0)]), grid)
        tables[s] = (take[s] + 1e-9, c / c[-1] if c[-1] > 0 else grid)
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = (
        live.where(F.col("source").isin(sorted(take)))
        .select("id", "source", "tokens", F.xxhash64("id").alias("h"))
        .repartitionByRange(n, "source", "h", "id")
        .sortWithinPartitions("source", "h", "id")
        .select("id", "source", "tokens", F.spark_partition_id().alias("pid"))
    )
    run = scratch.save(ranged.mapInArrow(_running, "id long, source string, tokens long, pid int, before long"))
    sums = run.groupBy("source", "pid").agg(F.sum("tokens").alias("many"))
    offset = F.coalesce(F.sum("many").over(W.partitionBy("source").orderBy("pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = run.join(F.broadcast(sums.select("source", "pid", offset.alias("offset"))), ["source", "pid"])  # sources times partitions
    facts_df = F.broadcast(spark.createDataFrame([(s, float(take[s]), int(totals[s])) for s in take], "source string, take double, total long"))
    uses = placed.join(facts_df, "source").select("id", "source", "tokens", (F.col("before") + F.col("offset")).alias("start"), "take", "total")
    times = F.floor((F.col("take") - F.col("start") - F.col("tokens") / 2) / F.col("total")).cast("int") + 1
    each = uses.withColumn("times", times).where("times > 0").select("id", "source", "tokens", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("use_no"), "start", "total")
    begun = each.select("id", "source", "tokens", "use_no", (F.col("start") + (F.col("use_no") - 1) * F.col("total")).alias("start"))
    at = begun.mapInArrow(_positions(tables, grid), "id long, source string, tokens long, use_no int, position double")
    sorted_uses = scratch.save(
        at.repartitionByRange(n, "position", "source", "id", "use_no").sortWithinPartitions("position", "source", "id", "use_no").withColumn("pid", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
    )
    counts = sorted_uses.groupBy("pid").agg(F.count("*").alias("many"), F.min("row").alias("first"))
    before = F.coalesce(F.sum("many").over(W.orderBy("pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    offsets = F.broadcast(counts.select("pid", before.alias("before"), "first"))
    return sorted_uses.join(offsets, "pid").select((F.col("before") + F.col("row") - F.col("first") + 1).alias("place"), "id", "source", "use_no", "tokens", "position")


def mixed_documents(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every use of every document in training order; see ``mix``."""
    scratch = Scratch(documents.sparkSession, "mixing")
    return mix(scratch.save(token_sizes(documents, "doc_id", "text", ("source",), vocabulary)), targets, scratch)


def shares_reached(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, target_share, tokens, share)``, absent sources with share 0."""
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    all_tokens = F.sum("tokens").over(W.partitionBy(F.lit(0)))  # one row a source
    want = targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"))
    return (
        want.join(got, "source", "left")
        .select("source", "target_share", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.round(F.coalesce(F.col("tokens") / all_tokens, F.lit(0.0)), 6).alias("share"))
    )
