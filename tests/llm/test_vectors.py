import numpy as np
import pytest

from codestrata.llm import clusters, neighbors

DIM = 16


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), None if v is None else [float(a) for a in v], "f", "clash") for i, v in zip(ids, x)], "vec_id long, embedding array<float>, file_path string, cos string")


def data(seed=1, groups=12, size=18, noise=40):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        c = rng.normal(size=DIM)
        out += list(c + rng.normal(scale=0.18 * np.linalg.norm(c) / np.sqrt(DIM), size=(rng.integers(4, size), DIM)))
    out += list(rng.normal(size=(noise, DIM)))
    x = np.array(out, np.float32) * rng.uniform(0.5, 3, (len(out), 1)).astype(np.float32)
    return rng.permutation(10 * len(x))[: len(x)], x


def brute(ids, x, k, least):
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    out = set()
    for i in range(len(ids)):
        other = sorted((-s[i, j], ids[j]) for j in range(len(ids)) if j != i and s[i, j] >= least)
        out |= {(int(ids[i]), int(j)) for _, j in other[:k]}
    return out


def test_neighbours_with_copies_ties_and_bad_vectors(spark):
    ids, x = data()
    x = np.concatenate([x, np.repeat(x[:1], 9, axis=0), 2 * x[1:2]])
    ids = np.concatenate([ids, np.arange(90_000, 90_010)])
    want = brute(ids, x, 5, 0.85)
    bad = [(70_000, None), (70_001, [0.0] * DIM), (70_002, [1.0] * (DIM - 1)), (70_003, [float("nan")] * DIM), (70_004, [None] + [1.0] * (DIM - 1))]
    df = frame(spark, ids, x).union(frame(spark, ids[:20], x[:20]))
    extra = spark.createDataFrame([(i, v, "f", "c") for i, v in bad] + [(None, [1.0] * DIM, "f", "c")], "vec_id long, embedding array<float>, file_path string, cos string")
    got = {(r.id, r.neighbor_id) for r in neighbors.most_similar(df.union(extra), dim=DIM).collect()}
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)


def test_neighbours_of_nothing_and_of_one(spark):
    none = frame(spark, [], [])
    assert neighbors.most_similar(none, dim=DIM).count() == 0
    assert neighbors.most_similar(frame(spark, [1], [np.ones(DIM)]), dim=DIM).count() == 0
    assert {tuple(r)[:2] for r in neighbors.most_similar(frame(spark, [1, 2], [np.ones(DIM), np.ones(DIM)]), dim=DIM).collect()} == {(1, 2), (2, 1)}


def test_centroids_are_balanced_and_the_graph_finds_the_nearest():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, DIM)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = neighbors.fit_centroids(x, 60)
    g = neighbors.CentroidGraph(c)
    got, _ = g.nearest(x[:300], 1)
    assert (got[:, 0] == np.argmax(x[:300] @ c.T, axis=1)).mean() > 0.97
    sizes = np.bincount(np.argmax(x @ c.T, axis=1), minlength=len(c))
    assert sizes.max() < 8 * len(x) / len(c)


def brute_groups(ids, x, least=0.70, smallest=4):
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = np.round(u @ u.T, 6) >= least
    sets = {}
    for i in range(len(ids)):
        sets.setdefault(near[i].tobytes(), []).append(i)
    return {(int(ids[i]), int(min(ids[j] for j in m))) for k, m in sets.items() if len(m) == np.frombuffer(k, bool).sum() >= smallest for i in m}


@pytest.mark.parametrize("seed", [1, 2])
def test_bounded_groups_equal_brute_force(spark, seed):
    ids, x = data(seed)
    x = np.concatenate([x, np.repeat(x[:1], 5, axis=0)])
    ids = np.concatenate([ids, np.arange(90_000, 90_005)])
    want = brute_groups(ids, x)
    df = frame(spark, ids, x).union(frame(spark, ids[:9], x[:9])).union(frame(spark, [70_000, 70_001], [None, np.zeros(DIM)]))
    got = {(r.id, r.first_id) for r in clusters.bounded_groups(df, dim=DIM).collect()}
    assert got == want and len({g for _, g in want}) > 3


def test_groups_of_nothing(spark):
    assert clusters.bounded_groups(frame(spark, [], []), dim=DIM).count() == 0
    assert clusters.bounded_groups(frame(spark, [1, 2, 3, 4], [np.ones(DIM)] * 4), dim=DIM).count() == 4


def test_descriptions_name_the_leading_members(spark):
    ids, x = data(4)
    got = clusters.described_communities(frame(spark, ids, x), dim=DIM).collect()
    assert got and all(1 <= len(r.top_ids) <= 5 and 0.7 <= r.cohesion <= 1 and r.size >= 2 and r.file_count == 1 for r in got)


def test_communities_split_two_cliques_joined_by_one_edge(spark):
    from codestrata.scratch import Scratch

    clique = lambda a: [(i, j, 1.0) for i in range(a, a + 6) for j in range(i + 1, a + 6)]
    e = spark.createDataFrame(clique(0) + clique(10) + [(5, 10, 1.0)], "a long, b long, w double")
    got = {r.id: r.community for r in clusters.communities(e, Scratch(spark, "t"), rounds=6).collect()}
    assert len({got[i] for i in range(6)}) == 1 and len({got[i] for i in range(10, 16)}) == 1 and got[0] != got[10]
