import numpy as np
from test_vectors import DIM, brute_groups, data, frame

from codestrata.llm import clusters


def test_descriptions_are_of_the_whole_groups(spark):
    ids, x = data(7, groups=6, size=60)
    x = np.concatenate([x, np.repeat(x[:1], 5, axis=0)])
    ids = np.concatenate([ids, np.arange(90_000, 90_005)])
    u = dict(zip(map(int, ids), x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)))
    groups = {}
    for i, first in brute_groups(ids, x):
        groups.setdefault(first, []).append(i)
    got = {r.community: r for r in clusters.described_communities(frame(spark, ids, x), dim=DIM).collect()}
    assert set(got) == set(groups) and max(map(len, groups.values())) > 30
    for first, members in groups.items():
        m = np.array([u[i] for i in sorted(members)])
        s = m @ m.T
        n = len(m)
        assert got[first].size == n and abs(got[first].cohesion - (s.sum() - n) / (n * (n - 1))) < 2e-6
        degree = dict(zip(sorted(members), np.round(s.sum(axis=1) - 1, 6)))
        assert [degree[i] for i in got[first].top_ids] == sorted(degree.values(), reverse=True)[:5]
