"""Problem 8: filling fixed-capacity containers with items.

Method: shallow combinations of lengths that fill a window below the capacity
are enumerated, their repeat counts are solved by non-negative least squares
against the histogram of lengths, rounded down, and the residual is packed
greedily, largest first into the fullest container that still has room. All
of that happens on the histogram, whose size is bounded by the capacity. The
items then take the places of their length by rank, which is counted in the
partitions they lie in, so a length that a third of all items share is no
bottleneck.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codestrata.llm.tokens import VOCABULARY, token_sizes
from codestrata.scratch import Scratch
from codestrata.session import ship

#: Lengths are binned to so many steps of the capacity for the least squares only.
STEPS = 256
#: Items of one combination at most, and the window it must fill, in steps.
DEPTH, WINDOW = 3, 1


@lru_cache(maxsize=4)
def combinations(steps: int, depth: int, window: int) -> np.ndarray:
    """All ascending combinations of at most ``depth`` steps whose sum lies in the window, as counts per step."""
    out: list[tuple[int, ...]] = []

    def grow(prefix: tuple[int, ...], least: int, left: int) -> None:
        if prefix and left < window:
            out.append(prefix)
        if len(prefix) < depth:
            for s in range(least, left + 1):
                grow((*prefix, s), s, left - s)

    grow((), 1, steps)
    a = np.zeros((steps + 1, len(out)))
    for j, combo in enumerate(out):
        for s in combo:
            a[s, j] += 1
    return a


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """min |a x - b| over x >= 0 by the active-set method of Lawson and Hanson."""
    x = np.zeros(a.shape[1])
    active: list[int] = []
    g = a.T @ b
    tol = 1e-9 * max(1.0, np.abs(g).max(initial=0))
    for _ in range(rounds):
        w = g - a.T @ (a[:, active] @ x[active]) if active else g.copy()
        w[active] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= tol:
            break
        active.append(j)
        while True:
            z = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[active] = z
                break
            now = x[active]
            bad = z <= 0
            ratio = np.min(now[bad] / np.maximum(now[bad] - z[bad], 1e-300))
            now = now + ratio * (z - now)
            x[:] = 0
            x[active] = np.maximum(now, 0)
            active = [k for k in active if x[k] > 1e-12]
            if not active:
                break
    return x


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths, how many containers of them) that hold every item of the histogram once: by combinations, or greedily alone where that takes fewer containers."""
    return min((_plan(histogram, capacity, DEPTH), _plan(histogram, capacity, 0)), key=lambda p: sum(many for _, many in p))


def _plan(histogram: dict[int, int], capacity: int, depth: int) -> list[tuple[list[int], int]]:
    """A plan from combinations of at most ``depth`` lengths and the greedy residual."""
    left = {n: c for n, c in histogram.items() if c > 0}
    filled: list[tuple[list[int], int]] = []
    if capacity in left:
        filled.append(([capacity], left.pop(capacity)))
    steps = min(STEPS, capacity)
    bins: dict[int, list[int]] = {}
    for n in sorted(left):
        bins.setdefault(-(-n * steps // capacity), []).append(n)
    need = np.zeros(steps + 1)
    for s, ns in bins.items():
        need[s] = sum(left[n] for n in ns)
    a = combinations(steps, depth, WINDOW)
    use = a[:, (a[need == 0] == 0).all(axis=0)]
    if use.shape[1] and need.any():
        weight = 1 / np.sqrt(np.maximum(need, 1))  # counts of rare lengths matter as much as those of common ones
        counts = np.floor(nnls(use * weight[:, None], need * weight) + 1e-6).astype(int)
        for j in np.argsort(-counts):
            combo = [s for s in range(steps, 0, -1) for _ in range(int(use[s, j]))]
            todo = int(counts[j])
            while todo > 0:
                lengths: list[int] = []
                for s in combo:  # the longest items of a step that are left
                    own = [n for n in reversed(bins[s]) if left.get(n, 0) > lengths.count(n)]
                    if not own:
                        break
                    lengths.append(own[0])
                if len(lengths) < len(combo):
                    break
                many = min(todo, *(left[n] // lengths.count(n) for n in lengths))
                for n in lengths:
                    left[n] -= many
                filled.append((lengths, many))
                todo -= many
    # the residual: best fit, largest first, on groups of equal containers
    room: dict[int, list[tuple[list[int], int]]] = {}
    spaces: list[int] = []

    def put(lengths: list[int], many: int) -> None:
        space = capacity - sum(lengths)
        if space not in room:
            room[space] = []
            insort(spaces, space)
        room[space].append((lengths, many))

    for lengths, many in filled:
        put(lengths, many)
    for n in sorted(left, reverse=True):
        todo = left[n]
        while todo > 0:
            k = bisect_left(spaces, n)
            if k == len(spaces):
                each = capacity // n
                if todo >= each:
                    put([n] * each, todo // each)
                    todo %= each
                if todo:
                    put([n] * todo, 1)
                break
            space = spaces[k]
            lengths, many = room[space].pop()
            if not room[space]:
                del room[space]
                spaces.pop(k)
            each = min(space // n, max(1, todo // many))
            now = min(many, todo // each)
            if now < many:
                put(lengths, many - now)
            put(lengths + [n] * each, now)
            todo -= now * each
    return [x for group in room.values() for x in group]


def _ranker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each item's number among those of its profile and length in this partition."""
    seen: dict[int, int] = {}
    for batch in batches:
        n = batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(3).to_numpy()
        order = np.argsort(n, kind="stable")
        values, first, counts = np.unique(n[order], return_index=True, return_counts=True)
        rank = np.empty(len(n), np.int64)
        rank[order] = np.arange(len(n)) - np.repeat(first, counts)
        base = np.array([seen.get(v, 0) for v in values.tolist()], np.int64)
        rank += base[np.searchsorted(values, n)]
        for v, c in zip(values.tolist(), counts.tolist()):
            seen[v] = seen.get(v, 0) + c
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(rank)], names=["at", "id", "piece", "size", "pid", "nth"])


def _placer(plans: list[list[tuple[list[int], int]]], names: list[str]):
    """Puts items (at, id, piece, size, rank) into the plan of their profile."""
    tables: dict[int, tuple] = {}  # profile and size -> (first rank, first container, place) of each run of places
    for at, one in enumerate(plans):
        slots: dict[int, list[tuple[int, int, int]]] = {}
        taken: dict[int, int] = {}
        container = 0
        for lengths, many in one:
            for place, n in enumerate(lengths, 1):
                slots.setdefault(n, []).append((taken.get(n, 0), container, place))
                taken[n] = taken.get(n, 0) + many
            container += many
        tables |= {at << 32 | n: tuple(np.array(c, np.int64) for c in zip(*rows)) for n, rows in slots.items()}
    labels = pa.array(names, pa.string())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rank = batch.column(0).to_numpy(), batch.column(4).to_numpy()
            key = at.astype(np.int64) << 32 | batch.column(3).to_numpy()
            where, spot = np.zeros(len(key), np.int64), np.zeros(len(key), np.int32)
            order = np.argsort(key, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if len(key) else []:
                first, start, place_of = tables[int(key[own[0]])]
                k = np.searchsorted(first, rank[own], side="right") - 1
                where[own] = start[k] + rank[own] - first[k]
                spot[own] = place_of[k]
            yield pa.RecordBatch.from_arrays([labels.take(pa.array(at)), pa.array(where), pa.array(spot), batch.column(1), batch.column(2), batch.column(3)], names=["profile", "container", "place", "id", "piece", "tokens"])

    return place


def pack(sizes: DataFrame, profiles: DataFrame, scratch: Scratch) -> DataFrame:
    """``(profile, container, place, id, piece, tokens)`` for ``(id, tokens)`` and ``(profile, capacity_tokens)``.

    Items of no tokens take no place; an item above the capacity is cut into
    full pieces and a rest, numbered from 1; profiles of null or no capacity
    pack nothing; repeated profiles count once. Containers are numbered from 0
    in each profile, places from 1. All profiles are filled in one pass over
    the items.
    """
    spark = sizes.sparkSession
    ship(spark)
    kept = sorted({(r[0], r[1]) for r in profiles.select("profile", "capacity_tokens").collect() if r[0] is not None and r[1] and r[1] > 0})
    if not kept:
        return spark.createDataFrame([], "profile string, container long, place int, id long, piece int, tokens int")
    n, capacity = F.col("tokens"), F.col("p.capacity")
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("at"), F.lit(int(c)).alias("capacity")) for i, (_, c) in enumerate(kept))))
    last = F.ceil(n / capacity).cast("int")
    pieces = sizes.where("tokens > 0").select("id", "tokens", each.alias("p")).select("id", "tokens", "p", last.alias("last"), F.explode(F.sequence(F.lit(1), last)).alias("piece"))
    size = F.when(F.col("piece") < F.col("last"), capacity).otherwise(n - (F.col("last") - 1) * capacity).cast("int")
    items = pieces.select(F.col("p.at").alias("at"), "id", "piece", size.alias("size"), F.spark_partition_id().alias("pid"))
    ranked = scratch.save(items.mapInArrow(_ranker, "at int, id long, piece int, size int, pid int, nth long"))
    local = ranked.groupBy("at", "size", "pid").agg(F.count("*").alias("many"))
    before = F.sum("many").over(W.partitionBy("at", "size").orderBy("pid").rowsBetween(W.unboundedPreceding, -1))
    offsets = local.select("at", "size", "pid", F.coalesce(before, F.lit(0)).alias("before"))
    histograms: list[dict[int, int]] = [{} for _ in kept]
    for r in local.groupBy("at", "size").agg(F.sum("many").alias("many")).collect():  # at most as many rows as the capacities add up to
        histograms[r["at"]][r["size"]] = r["many"]
    plans = [plan(h, int(c)) for h, (_, c) in zip(histograms, kept)]
    placed = ranked.join(offsets, ["at", "size", "pid"]).select("at", "id", "piece", "size", (F.col("nth") + F.col("before")).alias("rank"))
    return placed.mapInArrow(_placer(plans, [p for p, _ in kept]), "profile string, container long, place int, id long, piece int, tokens int")


def packed_documents(documents: DataFrame, profiles: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Every text's container and place for each profile; see ``pack``."""
    scratch = Scratch(documents.sparkSession, "packing")
    return pack(scratch.save(token_sizes(documents, id_col, text_col, vocabulary=vocabulary)), profiles, scratch)


def fill_report(packed: DataFrame, profiles: DataFrame) -> DataFrame:
    """``(profile, containers, tokens, fill)``: how full the containers are."""
    per = packed.groupBy("profile").agg((F.max("container") + 1).alias("containers"), F.sum("tokens").alias("tokens"))
    caps = profiles.groupBy("profile").agg(F.max("capacity_tokens").alias("capacity"))
    return per.join(caps, "profile").select("profile", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("fill"))
