from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from codestrata.functions import render
from codestrata.operators import duplicates, health
from codestrata.streaming import keyed


def test_similar_pairs_and_greedy_groups(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "BLOCK", 16)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(8, 12))
    x = np.concatenate([base[i % 8] + rng.normal(scale=0.05, size=12) for i in range(80)]).reshape(80, 12).astype(np.float32)
    x[70] = x[0]
    rows = [("a" if i < 60 else "b", i, x[i].tolist()) for i in range(80)] + [("a", 900, None), ("a", 901, [0.0] * 12)]
    df = spark.createDataFrame(rows, "repository_id string, vec_id long, embedding array<float>")
    df = df.withColumn("repository_id", F.when(F.col("vec_id") == 70, "a").otherwise(F.col("repository_id")))
    got = {(r.grp, r.a, r.b) for r in duplicates.similar_pairs(df, 0.9, 12).collect()}
    u = x.astype(float) / np.linalg.norm(x, axis=1, keepdims=True)
    grp = ["a" if i < 60 or i == 70 else "b" for i in range(80)]
    full = {(grp[i], i, j) for i in range(80) for j in range(i + 1, 80) if grp[i] == grp[j] and round(float(u[i] @ u[j]), 6) >= 0.9}
    assert {p for p in full if 70 not in p} <= got <= full and ("a", 0, 70) in got
    groups = duplicates.greedy_groups(duplicates.similar_pairs(df, 0.9, 12))
    by = {r.id: r.seed for r in groups.collect()}
    assert all(by[s] == s for s in by.values()) and len(by) >= 78
    lines = spark.createDataFrame([(i, 1, 11) for i in range(80)], "vec_id long, line_start int, line_end int")
    assert all(r.lines == 10 * (r.chunks - 1) for r in duplicates.savings(groups, lines).collect())


def test_health_and_suggestions(spark):
    c = spark.createDataFrame([("x", 0.9, 10, 5, "healthy"), ("y", 0.3, 10, 6, "scattered")], "name string, cohesion double, chunk_count int, file_count int, status string")
    assert health.cluster_health(c, 0, 20, 0, 10).first().score == int(35 * 0.6 + 30 + 25 + 10)
    hot = health.spread_files(spark.createDataFrame([("f", 1), ("f", 2), ("f", -1), ("g", 1)], "file_path string, label int"))
    assert [(r.file_path, r.clusters) for r in hot.collect()] == [("f", 2)]
    out = spark.createDataFrame([("a/x.py", "b/y.py", 0.6), ("a/z.py", None, 0.9)], "file_path string, nearest_file string, nearest_similarity double")
    dup = spark.createDataFrame([(7, 3), (8, 2)], "seed long, chunks long")
    got = [(r.kind, r.target, r.place) for r in health.suggestions(hot, out, c, dup).collect()]
    assert got == [("split_file", "f", None), ("create_module", "y", None), ("move_file", "a/x.py", "b"), ("extract_utility", "7", None)]
    sim = spark.createDataFrame([("a/x.py", "b/1.py", 0.8), ("a/x.py", "a/2.py", 0.5)], "file_path string, other_path string, similarity double")
    assert health.placement(sim, sim).first().advice == "consider moving"


def test_rendering(spark):
    tree = spark.createDataFrame([("a", "a", "directory"), ("a/b.py", "b.py", "file")], "path string, name string, type string")
    assert [r.line for r in render.tree_lines(tree).orderBy("path").collect()] == ["a/", "  b.py"]
    hits = spark.createDataFrame([(2, "b.py", 5, "two"), (1, "a.py", 1, "one")], "rank int, file_path string, line_start int, content string")
    assert render.numbered_context(hits).first().prompt == "[1] a.py:1\none\n\n[2] b.py:5\ntwo"
    row = spark.range(1).select(render.commit_line(F.lit("first\nsecond"), F.lit("0123456789")).alias("c"), render.relative_time(F.lit(datetime(2024, 1, 1)), F.lit(datetime(2024, 1, 1, 2))).alias("t")).first()
    assert row.c == "0123456 first" and row.t == "2h ago"


def stream(spark, tmp_path, name, df, make, mode):
    src = str(tmp_path / f"{name}-src")
    df.coalesce(1).write.parquet(src)
    out = make(spark.readStream.schema(df.schema).parquet(src))
    q = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
    q.awaitTermination(180)
    return spark.table(name).collect()


def test_keyed_streams(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    df = spark.createDataFrame([("k", t0, '{"a": 1}'), ("k", t0 + timedelta(seconds=5), '{"b": 2}'), ("l", t0, "plain"), ("l", t0 + timedelta(hours=3), None)], "key string, ts timestamp, payload string")
    got = {r.key: r.payload for r in stream(spark, tmp_path, "ttl", df, keyed.last_known, "update")}
    assert got["k"] == '{"a": 1, "b": 2}'
    hits = spark.createDataFrame([("k", t0 + timedelta(seconds=s), i) for i, s in enumerate((0, 10, 20, 59, 60, 61))], "key string, ts timestamp, id long")
    allowed = {r.id: r.allowed for r in stream(spark, tmp_path, "rate", hits, lambda d: keyed.rate_limited(d, 2), "append")}
    assert allowed == {0: True, 1: True, 2: False, 3: False, 4: True, 5: True}


def test_previous_rows_of_a_key_over_many_partitions(spark):
    from codestrata.operators.ordered import with_previous

    rows = [("hot", i, None if i % 3 else f"v{i}") for i in range(300)] + [("b", 1, "x"), ("c", 1, None), ("c", 2, "y"), (None, 1, "n"), (None, 2, "m")]
    df = spark.createDataFrame(rows, "k string, t int, v string").repartition(5)
    got = {(r.k, r.t): r.prev_v for r in with_previous(df, "k", ["t"], ["v"]).collect()}
    full = {(r.k, r.t): r.prev_v for r in with_previous(df, "k", ["t"], ["v"], filled=True).collect()}
    value = {("k", k, t): v for k, t, v in rows}
    for k, t, _ in rows:
        assert got[k, t] == value.get(("k", k, t - 1))
        last = [v for k2, t2, v in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]) if t2 < t and v is not None]
        assert full[k, t] == (last[-1] if last else None)
    assert len(got) == len(rows)
