"""Problem 7: rebuilding conversations from message rows.

Method: parent pointers are resolved by iterative pointer-jumping joins; rows
whose parent is missing are orphans, rows that never reach a root lie on or
hang from a cycle; every root-to-leaf path comes out as an ordered
conversation. Where rows have no parent pointer, the message before it in its
thread is the parent; predecessors are found by one range sort over all rows,
so a thread that holds a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.scratch import Scratch
from codestrata.session import ship

#: The roles of a clean conversation, in their order at equal times.
ROLES = ["system", "user", "assistant"]


def clean_role(role: str = "role"):
    """system, user or assistant; null for anything else.

    Letter case, outer white space and an enum class name in front do not
    matter.
    """
    got = F.regexp_extract(F.lower(F.col(role)), r"^\s*(?:[a-z_]\w*\.)?(system|user|assistant)\s*$", 1)
    return F.when(got != "", got)


def _lag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    thread = before = None
    rank, first = 0, True
    for pdf in batches:
        prev = pdf["id"].shift(1)
        same = pdf["thread"].eq(pdf["thread"].shift(1))
        if len(pdf):
            same.iloc[0] = not first and pdf["thread"].iloc[0] == thread
            prev.iloc[0] = before
        out = pdf.assign(parent=prev.where(same, None), head=False, rank=range(rank, rank + len(pdf)))
        if first and len(pdf):
            out.loc[out.index[0], "head"] = True
            first = False
        if len(pdf):
            thread, before = pdf["thread"].iloc[-1], pdf["id"].iloc[-1]
        rank += len(pdf)
        yield out[["id", "thread", "pid", "head", "rank", "parent"]]


def previous_in_thread(rows: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """``(id, parent)`` with the row before each row of its ``thread``.

    ``rows`` has unique string ids ``id`` and ``thread``. One range sort; only
    the last row of each partition visits the driver.
    """
    n = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = (
        rows.select("id", "thread", *order)
        .repartitionByRange(n, "thread", *order, "id")
        .withColumn("pid", F.spark_partition_id())
        .sortWithinPartitions("thread", *order, "id")
        .select("id", "thread", "pid")
    )
    sorted_rows = scratch.save(ranged.mapInPandas(_lag, "id string, thread string, pid int, head boolean, rank long, parent string"))
    ends = sorted_rows.groupBy("pid").agg(F.max(F.struct("rank", "thread", "id")).alias("e")).orderBy("pid").collect()
    carried = [(int(b["pid"]), a["e"]["thread"], a["e"]["id"]) for a, b in zip(ends, ends[1:])]
    spark = rows.sparkSession
    tails = F.broadcast(spark.createDataFrame(carried, "pid int, tail_thread string, tail_id string"))  # one row a partition at most
    return sorted_rows.join(tails, "pid", "left").select(
        "id", F.coalesce("parent", F.when(F.col("head") & (F.col("thread") == F.col("tail_thread")), F.col("tail_id"))).alias("parent")
    )


def resolve_parents(nodes: DataFrame, scratch: Scratch, sums: tuple[str, ...] = ()) -> DataFrame:
    """``(id, parent, root, hops, status, *sums)`` for unique ``id``.

    ``hops`` counts the steps up to the root; each column of ``sums`` comes out
    added up over the row and all rows above it. ``status`` is ``ok``,
    ``orphan`` (its topmost row names a parent that does not exist) or
    ``cycle`` (root, hops and sums are null). A row that is its own parent is a
    cycle. Rounds grow with the logarithm of the longest path.
    """
    known = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    start = nodes.join(known, "parent", "left")
    top = F.col("parent").isNull() | F.col("known").isNull()
    state = scratch.save(
        start.select(
            "id",
            "parent",
            F.when(~top, F.col("parent")).alias("ptr"),
            F.when(top, F.col("id")).alias("root"),
            F.when(top, F.lit(0)).otherwise(F.lit(1)).cast("long").alias("hops"),
            (F.col("parent").isNotNull() & F.col("known").isNull()).alias("lost"),
            *(F.col(s).cast("long").alias(s) for s in sums),
        )
    )
    left = state.where("ptr IS NOT NULL").count()
    while left:
        t = state.select(
            F.col("id").alias("ptr"),
            F.col("ptr").alias("t_ptr"),
            F.col("root").alias("t_root"),
            F.col("hops").alias("t_hops"),
            F.col("lost").alias("t_lost"),
            *(F.col(s).alias(f"t_{s}") for s in sums),
        )
        jumped = state.where("ptr IS NOT NULL").join(t, "ptr").select(
            "id",
            "parent",
            F.col("t_ptr").alias("ptr"),
            F.col("t_root").alias("root"),
            (F.col("hops") + F.col("t_hops")).alias("hops"),
            F.col("t_lost").alias("lost"),
            *((F.col(s) + F.col(f"t_{s}")).alias(s) for s in sums),
        )
        state = scratch.save(state.where("ptr IS NULL").unionByName(jumped), state)
        now = state.where("ptr IS NOT NULL").count()
        if now == left:  # every row of a tree gets nearer each round: the rest is cycles
            break
        left = now
    cyclic = F.col("ptr").isNotNull()
    return state.select(
        "id",
        "parent",
        "root",
        F.when(~cyclic, F.col("hops")).alias("hops"),
        F.when(cyclic, "cycle").when(F.col("lost"), "orphan").otherwise("ok").alias("status"),
        *(F.when(~cyclic, F.col(s)).alias(s) for s in sums),
    )


def root_to_leaf_paths(resolved: DataFrame, scratch: Scratch) -> DataFrame:
    """``(leaf, id, turn_no)``: each path of the trees, numbered from its root.

    Trees without a fork have one path, which is all their rows; only rows of
    forked trees are expanded, by doubling jumps.
    """
    ok = resolved.where("status <> 'cycle'").select("id", "parent", "root", "hops")
    kids = ok.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("kids"))
    kids = kids.withColumnRenamed("parent", "id")
    forked = ok.join(kids.where("kids > 1"), "id", "left_semi").select("root").distinct()
    leaves = ok.join(kids, "id", "left_anti").select("root", F.col("id").alias("leaf"))
    plain = ok.join(forked, "root", "left_anti")
    paths = plain.join(leaves.join(forked, "root", "left_anti"), "root").select("leaf", "id", (F.col("hops") + 1).alias("turn_no"))
    tree = scratch.save(ok.join(forked, "root", "left_semi"))
    deepest = tree.agg(F.max("hops")).first()[0]
    if deepest is None:
        return paths
    ups = [scratch.save(tree.where("hops > 0").select("id", F.col("parent").alias("up")))]
    while 2 ** len(ups) <= deepest:
        a, b = ups[-1], ups[-1].select(F.col("id").alias("up"), F.col("up").alias("up2"))
        ups.append(scratch.save(a.join(b, "up").select("id", F.col("up2").alias("up"))))
    walk = leaves.join(forked, "root", "left_semi").select("leaf", F.col("leaf").alias("id"))
    for up in reversed(ups):
        walk = scratch.save(walk.unionByName(walk.join(up, "id").select("leaf", F.col("up").alias("id"))))
    return paths.unionByName(walk.join(tree, "id").select("leaf", "id", (F.col("hops") + 1).alias("turn_no")))


def kept_messages(messages: DataFrame, threads: DataFrame) -> DataFrame:
    """``(thread_id, turn_no, message_id)`` of the threads fit for training.

    A message id counts once, in its latest delivery (by ``updated_at``; at
    equal times the greatest row). A thread is kept if it is listed in
    ``threads``; every role is clean; no user or assistant content is null or
    blank; every message has an id and a time; and, system messages aside, it
    is one or more pairs of a user message and a reply. Rows with a null
    thread belong to no thread. Empty tables give no rows.
    """
    spark = messages.sparkSession
    ship(spark)
    scratch = Scratch(spark, "conversations")
    fields = ["message_id", "thread_id", "role", "content", "created_at", "updated_at"]
    rows = messages.select(*fields).where("thread_id IS NOT NULL")
    said = (
        rows.select(
            "message_id",
            "thread_id",
            "created_at",
            "updated_at",
            clean_role().alias("role"),
            F.coalesce(~F.col("content").rlike(r"(?U)^[\s\x{200B}\x{FEFF}]*$"), F.lit(False)).alias("filled"),
        )
        .withColumn("fit", F.col("role").isNotNull() & ((F.col("role") == "system") | F.col("filled")) & F.col("created_at").isNotNull() & F.col("message_id").isNotNull())
        .groupBy("message_id", F.when(F.col("message_id").isNull(), F.col("thread_id")).alias("of"))
        .agg(F.max(F.struct("updated_at", "thread_id", "created_at", "role", "fit")).alias("r"))
        .select("message_id", "r.thread_id", "r.created_at", "r.role", "r.fit")
    )
    said = scratch.save(said)
    talk = F.when(F.col("role") != "system", 1).otherwise(0)
    kept = (
        said.groupBy("thread_id")
        .agg(F.min("fit").alias("fit"), F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).alias("asked"), F.sum(F.when(F.col("role") == "assistant", 1).otherwise(0)).alias("told"))
        .where("fit AND asked > 0 AND asked = told")
        .join(threads.select("thread_id").distinct(), "thread_id", "left_semi")
        .select("thread_id")
    )
    good = scratch.save(
        said.join(kept, "thread_id", "left_semi").select(
            F.col("message_id").alias("id"),
            F.col("thread_id").alias("thread"),
            "created_at",
            F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")).alias("rank_of_role"),
            "role",
            talk.alias("talk"),
        )
    )
    parents = previous_in_thread(good, ["created_at", "rank_of_role"], scratch)
    resolved = resolve_parents(good.select("id", "talk").join(parents, "id"), scratch, ("talk",))
    turns = scratch.save(
        root_to_leaf_paths(resolved, scratch).join(resolved.select("id", F.col("talk").alias("nth")), "id").join(good.select("id", "thread", "role"), "id")
    )
    paired = turns.groupBy("thread").agg(
        F.min((F.col("role") == "system") | ((F.col("nth") % 2 == 1) == (F.col("role") == "user"))).alias("paired")
    )
    return turns.join(paired.where("paired"), "thread", "left_semi").select(
        F.col("thread").alias("thread_id"), F.col("turn_no").cast("int").alias("turn_no"), F.col("id").alias("message_id")
    )
