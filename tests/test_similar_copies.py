import numpy as np

from codestrata.operators import duplicates

DIM = 8


def greedy(x, least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s, used, out = np.round(u @ u.T, 6), set(), set()
    for a in range(len(x)):
        got = [b for b in range(len(x)) if b != a and b not in used and s[a, b] >= least]
        if a not in used and got:
            used |= {a, *got}
            out |= {(a, a, 1.0), *((a, b, float(s[a, b])) for b in got)}
    return out


def test_copies_of_a_chunk_that_is_no_seed_join_its_group(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6, DIM)).astype(np.float32)
    near = (x[:4] + 0.12 * rng.normal(size=(4, DIM))).astype(np.float32)
    x = np.concatenate([x, near, np.repeat(near[:2], 7, axis=0), np.repeat(x[5:6], 3, axis=0), near[:1]])
    df = spark.createDataFrame([(i, "r", [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, repository_id string, embedding array<float>")
    got = {(r.seed, r.id, round(r.similarity, 5)) for r in duplicates.greedy_groups(duplicates.similar_pairs(df, 0.9, DIM)).collect()}
    want = {(a, b, round(s, 5)) for a, b, s in greedy(x.astype(np.float64), 0.9)}
    assert got == want and {i for s, i, _ in want if s == 0} >= {0, 6, *range(10, 17), 27}
