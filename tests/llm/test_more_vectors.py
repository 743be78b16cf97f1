import numpy as np
from test_vectors import DIM, brute, data, frame

from codestrata.llm import clusters, neighbors
from codestrata.scratch import Scratch


def test_oversized_lists_are_split_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "MOST_ROWS", 150)
    rng = np.random.default_rng(5)
    hot = rng.normal(size=DIM)
    x = np.concatenate([data(6, groups=20, size=20)[1], (hot + rng.normal(scale=0.3, size=(700, DIM))).astype(np.float32)])  # a third and more of all rows lie together
    ids = rng.permutation(5 * len(x))[: len(x)]
    want = brute(ids, x, 5, 0.85)
    df = frame(spark, ids, x)
    got = {(r.id, r.neighbor_id) for r in neighbors.most_similar(df, dim=DIM).collect()}
    assert len(got & want) >= 0.95 * len(want)  # every level of splitting costs a little
    vectors = df.selectExpr("vec_id AS id", "embedding AS vec")
    placed = neighbors.posting_lists(vectors, DIM, Scratch(spark, "t"))
    assert placed.select("id").distinct().count() == len(x)
    assert placed.where(f"list >= {neighbors.MOST_LISTS**2}").count() > 0  # lists of the second level


def test_lists_left_large_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK", 16)
    ids, x = data(8)
    got = {(r.id, r.neighbor_id) for r in neighbors.most_similar(frame(spark, ids, x), dim=DIM).collect()}
    want = brute(ids, x, 5, 0.85)
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)


def test_search_outside_of_groups(spark):
    ids, x = np.arange(4), np.eye(DIM)[[0, 0, 0, 0]] + 0.1 * np.eye(DIM)[[1, 2, 3, 4]]
    vectors = frame(spark, ids, x).selectExpr("vec_id AS id", "embedding AS vec")
    group = spark.createDataFrame([(0, 7), (1, 7), (2, 8), (3, 8)], "id long, grp long")
    got = {(r.id, r.other) for r in neighbors.search(vectors, DIM, 5, 0.5, Scratch(spark, "t"), group).collect()}
    assert got == {(0, 2), (0, 3), (1, 2), (1, 3), (2, 0), (2, 1), (3, 0), (3, 1)}


def test_a_pair_across_two_groups_makes_neither_a_group(spark):
    rng = np.random.default_rng(2)
    a, b = np.eye(DIM)[0], np.eye(DIM)[1]
    near = lambda c, n: c + rng.normal(scale=0.01, size=(n, DIM))
    bridge = np.stack([a + 0.42 * b, b + 0.42 * a])  # at 0.7 or more to each other and to their own, not to the other group
    x = np.concatenate([near(a, 12), near(b, 12), bridge, near(np.eye(DIM)[2], 6)]).astype(np.float32)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert u[24] @ u[25] >= 0.7 and u[0] @ u[25] < 0.7
    got = {(r.id, r.first_id) for r in clusters.bounded_groups(frame(spark, np.arange(len(x)), x), dim=DIM).collect()}
    assert got == {(i, 26) for i in range(26, 32)}


def test_communities_end_and_keep_a_start(spark):
    path = spark.createDataFrame([(i, i + 1, 1.0) for i in range(30)], "a long, b long, w double")
    got = {r.id: r.community for r in clusters.communities(path, Scratch(spark, "t")).collect()}
    assert set(got) == set(range(31)) and 1 < len(set(got.values())) < 31
    start = spark.createDataFrame([(i, 0) for i in range(31)], "id long, community long")
    assert {r.community for r in clusters.communities(path, Scratch(spark, "t"), start=start).collect()} == {0}
    assert clusters.communities(path.limit(0), Scratch(spark, "t")).count() == 0


def test_random_planes_split_leaves_on():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, DIM)).astype(np.float32)
    tree = clusters.ProjectionTree(x[:200], 25, rng)
    plain, fine = tree.leaf_of(x), tree.leaf_of(x, 3)
    assert (fine >> 3 == plain).all() and len(np.unique(fine)) > 4 * len(np.unique(plain))
