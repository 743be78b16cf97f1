import os
import random
from collections import Counter

import numpy as np
import pytest

from codestrata.llm import mixing, packing, tokens
from codestrata.scratch import Scratch


def check_packed(rows, sizes, cap):
    fill, seen, places = Counter(), Counter(), set()
    for r in rows:
        fill[r.container] += r.tokens
        seen[r.id] += r.tokens
        assert (r.container, r.place) not in places
        places.add((r.container, r.place))
        assert sizes[r.id] > cap or r.piece == 1
    assert seen == {i: n for i, n in sizes.items() if n} and max(fill.values(), default=0) <= cap
    return len(fill)


@pytest.mark.parametrize("cap", [1, 7, 256, 1000])
def test_packing_keeps_every_item_and_wastes_little(spark, cap):
    rnd = random.Random(cap)
    sizes = {i: int(rnd.lognormvariate(4, 1)) for i in range(2000)} | {5000: 0, 5001: cap, 5002: 3 * cap, 5003: 3 * cap + 1} | {6000 + i: 5 for i in range(700)}
    df = spark.createDataFrame(list(sizes.items()), "id long, tokens long").repartition(4)
    prof = spark.createDataFrame([("p", cap), ("p", cap), ("none", 0), (None, 5), ("null", None)], "profile string, capacity_tokens int")
    rows = packing.pack(df, prof, Scratch(spark, "t")).collect()
    n = check_packed(rows, sizes, cap)
    assert {r.profile for r in rows} == {"p"}
    assert n <= -(-sum(sizes.values()) // cap) * (1.02 if cap >= 256 else 1.4) + 2


def test_nothing_to_pack(spark):
    prof = spark.createDataFrame([("p", 9)], "profile string, capacity_tokens int")
    assert packing.pack(spark.createDataFrame([], "id long, tokens long"), prof, Scratch(spark, "t")).count() == 0
    assert packing.pack(spark.createDataFrame([(1, 3)], "id long, tokens long"), prof.limit(0), Scratch(spark, "t")).count() == 0


def test_least_squares_is_non_negative_and_solves():
    rng = np.random.default_rng(1)
    a = rng.uniform(size=(20, 50))
    x = np.maximum(rng.normal(size=50), 0)
    got = packing.nnls(a, a @ x)
    assert (got >= 0).all() and np.abs(a @ got - a @ x).max() < 1e-6


def test_mix_meets_shares_within_half_a_text(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice("aab"), rnd.randint(1, 50)) for i in range(1200)] + [(5000 + i, "c", 10) for i in range(5)] + [(6000, None, 9), (6001, "z", 9), (6002, "a", 0)]
    df = spark.createDataFrame(rows, "id long, source string, tokens long").repartition(4)
    t = spark.createDataFrame([("a", 0.3, 1), ("b", 0.5, 4), ("c", 0.1, 2), ("gone", 0.1, 3), (None, 0.5, 1), ("a", 0.3, 1)], "source string, target_share double, max_repeats int")
    got = mixing.mix(df, t, Scratch(spark, "t")).collect()
    total = sum(n for _, s, n in rows if s in ("a", "b", "c"))
    used, times = Counter(), Counter()
    for r in got:
        used[r.source] += r.tokens
        times[r.id] += 1
    assert abs(used["a"] - 0.3 * total) <= 50 and abs(used["b"] - 0.5 * total) <= 50 and used["c"] == 100
    assert all(times[i] <= {"a": 1, "b": 4, "c": 2}.get(s, 0) for i, s, _ in rows)
    assert sorted(r.place for r in got) == list(range(1, len(got) + 1))
    got.sort(key=lambda r: r.place)
    assert all(a.position <= b.position for a, b in zip(got, got[1:])) and 0 <= got[0].position and got[-1].position <= 1
    half = Counter(r.source for r in got[: len(got) // 2])
    assert all(half[s] > 0 for s in "abc")
    shares = {r.source: r.share for r in mixing.shares_reached(mixing.mix(df, t, Scratch(spark, "t")), t).collect()}
    assert shares["gone"] == 0 and abs(sum(shares.values()) - 1) < 1e-5


def test_schedules_are_followed(spark):
    df = spark.createDataFrame([(i, "early" if i % 2 else "late", 10) for i in range(400)], "id long, source string, tokens long")
    t = spark.createDataFrame([("early", 0.5, 1), ("late", 0.5, 1)], "source string, target_share double, max_repeats int")
    plan = {"early": [(0.0, 1.0), (1.0, 0.0)], "late": [(0.0, 0.0), (1.0, 1.0)]}
    got = sorted(mixing.mix(df, t, Scratch(spark, "t"), plan).collect(), key=lambda r: r.place)
    first = Counter(r.source for r in got[:100])
    assert first["early"] > 3 * first["late"]


def test_nothing_to_mix(spark):
    df = spark.createDataFrame([], "id long, source string, tokens long")
    t = spark.createDataFrame([("a", 0.3, 1)], "source string, target_share double, max_repeats int")
    assert mixing.mix(df, t, Scratch(spark, "t")).count() == 0
    some = spark.createDataFrame([(1, "a", 5)], "id long, source string, tokens long")
    assert mixing.mix(some, t.limit(0), Scratch(spark, "t")).count() == 0
    assert mixing.mix(some, spark.createDataFrame([("a", None, None)], t.schema), Scratch(spark, "t")).count() == 0


@pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary here")
def test_token_sizes(spark):
    df = spark.createDataFrame([(1, "hello world", "a"), (1, "hello world", "a"), (2, None, "a"), (3, "", None), (None, "x", "a"), (4, "<|endoftext|>", "a"), (5, "word " * 40_000, "a")], "doc_id long, text string, source string")
    got = {r.id: r.tokens for r in tokens.token_sizes(df, "doc_id", "text", ("source",)).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1 and 40_000 <= got[5] <= 40_002 and None not in got
