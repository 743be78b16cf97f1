import random
from datetime import datetime, timedelta

import pytest

from codestrata.llm import conversations, link_groups
from codestrata.scratch import Scratch


def brute_groups(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


def test_groups_equal_union_find(spark):
    rnd = random.Random(5)
    links = [(rnd.randint(0, 400), rnd.randint(0, 400)) for _ in range(250)]
    links += [(1000 + i, 1001 + i) for i in range(70)]  # a long chain
    links += [(2000, 2001 + i) for i in range(150)]  # a hub
    links += [(None, 5), (7, None), (9, 9), (3, 4), (4, 3), (3, 4)]
    df = spark.createDataFrame([(a, b, "clash", i) for i, (a, b) in enumerate(links)], "x long, y long, id string, group_id int").repartition(5)
    got = {r.id: r.group_id for r in link_groups.link_groups(df, "x", "y").collect()}
    assert got == brute_groups(links)


def test_no_links_no_groups(spark):
    df = spark.createDataFrame([], "a long, b long")
    assert link_groups.link_groups(df).count() == 0
    assert link_groups.link_groups(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 0


def resolve(spark, rows):
    df = spark.createDataFrame(rows, "id string, parent string, weight int")
    s = Scratch(spark, "t")
    return conversations.resolve_parents(df, s, ("weight",)), s


def test_parents_orphans_and_cycles(spark):
    rows = [("a", None, 1), ("b", "a", 1), ("c", "b", 1), ("d", "b", 1), ("o", "gone", 1), ("p", "o", 1), ("x", "y", 1), ("y", "x", 1), ("z", "y", 1), ("s", "s", 1)]
    rows += [(f"n{i}", f"n{i - 1}" if i else None, 1) for i in range(40)]
    got, s = resolve(spark, rows)
    by = {r.id: r for r in got.collect()}
    assert (by["c"].root, by["c"].hops, by["c"].weight, by["c"].status) == ("a", 2, 3, "ok")
    assert by["p"].status == by["o"].status == "orphan" and by["p"].root == "o"
    assert {k for k, r in by.items() if r.status == "cycle"} == {"x", "y", "z", "s"} and by["z"].root is None
    assert by["n39"].hops == 39
    paths = {}
    for r in conversations.root_to_leaf_paths(got, s).collect():
        paths.setdefault(r.leaf, []).append((r.turn_no, r.id))
    assert [i for _, i in sorted(paths["c"])] == ["a", "b", "c"] and [i for _, i in sorted(paths["d"])] == ["a", "b", "d"]
    assert len(paths["n39"]) == 40 and "b" not in paths


T0 = datetime(2024, 1, 1)


def chat(spark, rows, threads=("t1", "t2", "t3", "t4", "t5", "t6", "t7")):
    m = spark.createDataFrame(
        [(i, t, r, c, T0 + timedelta(seconds=s), T0 + timedelta(seconds=u), 1) for i, t, r, c, s, u in rows],
        "message_id string, thread_id string, role string, content string, created_at timestamp, updated_at timestamp, turn_no int",
    )
    th = spark.createDataFrame([(t, "x") for t in threads] + [("t1", "x"), (None, "x")], "thread_id string, role string")
    return [tuple(r) for r in conversations.kept_messages(m, th).orderBy("thread_id", "turn_no").collect()]


def test_kept_threads(spark):
    rows = [
        ("m2", "t1", " MessageRole.ASSISTANT", "yes", 5, 5), ("m1", "t1", "User", "q", 5, 5), ("m0", "t1", "system", None, 5, 5), ("m1", "t1", "user", "q", 5, 9),
        ("a1", "t2", "user", "q", 1, 1), ("a2", "t2", "user", "q", 2, 2), ("a3", "t2", "assistant", "r", 3, 3),
        ("b1", "t3", "user", "  \n", 1, 1), ("b2", "t3", "assistant", "r", 2, 2),
        ("c1", "t4", "user", "q", 1, 1), ("c2", "t4", "tool", "r", 2, 2), ("c3", "t4", "assistant", "r", 3, 3),
        ("d1", "t5", "assistant", "q", 1, 1), ("d2", "t5", "user", "r", 2, 2),
        ("e1", "lost", "user", "q", 1, 1), ("e2", "lost", "assistant", "r", 2, 2),
        ("f1", "t6", "system", "s", 1, 1), ("g1", None, "user", "q", 1, 1), (None, "t7", "user", "q", 1, 1), ("h1", "t7", "assistant", "r", 2, 2),
    ]
    assert chat(spark, rows) == [("t1", 1, "m0"), ("t1", 2, "m1"), ("t1", 3, "m2")]
    assert chat(spark, []) == []


def test_one_thread_with_most_rows(spark):
    rows = [(f"k{i:05d}", "t1", "user" if i % 2 == 0 else "assistant", "x", i, i) for i in range(600)] + [("z1", "t2", "user", "q", 1, 1), ("z2", "t2", "assistant", "r", 2, 2)]
    got = chat(spark, rows)
    assert [g[2] for g in got[:600]] == [f"k{i:05d}" for i in range(600)] and [g[1] for g in got[:600]] == list(range(1, 601)) and len(got) == 602
