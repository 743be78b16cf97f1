import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from codestrata.operators import chunker, churn, findings, graph, hdbscan, search
from codestrata.sources import files, reports, sinks
from codestrata.streaming import state


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_churn_windows_in_one_pass(spark):
    now = datetime(2024, 6, 1)
    data = [("a.py", "x", now - timedelta(days=d), 5, 1) for d in (1, 40, 80, 100)] + [("b.py", "y", now - timedelta(days=2), 1, 0)]
    df = spark.createDataFrame(data, "file_path string, author string, ts timestamp, lines_added int, lines_removed int")
    got = {r.file_path: r for r in churn.file_churn(df, now).collect()}
    assert (got["a.py"].changes, got["a.py"].changes_short, got["a.py"].lines_added) == (3, 1, 15) and got["b.py"].authors == 1
    hot = churn.hot_spots(churn.file_churn(df, now), None, 2).collect()
    assert [r.file_path for r in hot] == ["a.py"] and "coverage unknown" in hot[0].risk_factors


def test_reachability_partitions_the_nodes_with_cycles(spark):
    rnd = random.Random(3)
    nodes = list(range(60))
    edges = [(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(70)] + [(1, 2), (2, 1)]
    seen, todo = {0, 1}, [0, 1]
    while todo:
        a = todo.pop()
        for x, y in edges:
            if x == a and y not in seen:
                seen.add(y)
                todo.append(y)
    e = spark.createDataFrame(edges, "caller_id long, callee_id long")
    n, s = spark.createDataFrame([(i,) for i in nodes], "id long"), spark.createDataFrame([(0,), (1,)], "id long")
    assert {r[0] for r in graph.reachable(s, e).collect()} == seen
    assert {r[0] for r in graph.unreachable(n, s, e).collect()} == set(nodes) - seen


def test_calls_resolve_by_name_and_line(spark):
    text = "def a():\n    b()\n\ndef b():\n    pass\n\ndef test_c():\n    a()\n"
    s = graph.extract_python(spark.createDataFrame([("x.py", text), ("bad.py", "def ("), ("n.py", None)], "file_path string, content string")).cache()
    f = s.where("kind = 'function'").select(F.concat_ws(":", "file_path", "name").alias("id"), "file_path", "name", "line_start", "line_end", "is_entry")
    calls = graph.resolve_calls(s.where("kind = 'call'").select("file_path", F.col("line_start").alias("line"), "name"), f)
    assert rows(calls) == [("x.py:a", "x.py:b"), ("x.py:test_c", "x.py:a")]
    assert rows(graph.unreachable(f.select("id"), f.where("is_entry").select("id"), calls)) == []


def test_diverse_sample_takes_half_by_score_then_new_folders(spark):
    data = [(1, 100.0, "a/x.py"), (2, 90.0, "a/y.py"), (3, 80.0, "a/z.py"), (4, 70.0, "b/x.py"), (5, 60.0, "c/x.py"), (6, 50.0, "d/x.py"), (7, 40.0, "b/y.py")]
    df = spark.createDataFrame(data, "id long, score double, file_path string")
    got = [r.id for r in findings.diverse_sample(df, 6).orderBy("pick").collect()]
    assert got == [1, 2, 3, 4, 5, 6]
    assert findings.diverse_sample(df, 0).count() == 0 and findings.diverse_sample(df, 50).count() == 7


def test_budget_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([("r", "main.py", 50), ("r", "x/big.py", 80), ("r", "x/small.py", 30), ("r", "y.py", 10)], "repository_id string, path string, tokens long")
    got = [(r.path, r.used) for r in findings.within_budget(df, 100).orderBy("used").collect()]
    assert got == [("main.py", 50), ("x/small.py", 80)] + [("y.py", 90)]


def test_merge_is_against_seeds_and_needs_a_shared_file(spark):
    data = [(1, 1, ["a"], "the same text here"), (2, 2, ["a", "b"], "the same text here!"), (3, 3, ["c"], "the same text here"), (4, 4, ["b"], "quite another thing"), (5, 5, None, "x")]
    df = spark.createDataFrame(data, "id long, ord long, files array<string>, text string")
    assert rows(findings.merge_issues(df)) == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 5)]


def test_hdbscan_finds_separate_blobs():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.05, (40, 4)) for c in (0, 3, 6)] + [rng.uniform(-20, 20, (5, 4))])
    labels = hdbscan.hdbscan(x, 10)
    groups = [set(labels[i * 40 : i * 40 + 40]) - {-1} for i in range(3)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3
    assert (hdbscan.hdbscan(x[:2], 3) == -1).all()


def test_nearest_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None), (998, [0.0] * 8)], "vec_id long, embedding array<double>")
    got = {(r.vec_id, r.near) for r in search.nearest(df.where("vec_id < 30"), df, 3, 8).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -2)
    assert got == {(i, int(j)) for i in range(30) for j in np.argsort(-s[i], kind="stable")[:3]}


def test_cohesion_equals_mean_pairwise_cosine(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20, 8))
    df = spark.createDataFrame([("g", v.tolist()) for v in x] + [("one", x[0].tolist())], "g string, embedding array<double>")
    got = {r.g: r.cohesion for r in search.cohesion(df, "g", dim=8).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    assert abs(got["g"] - (s.sum() - 20) / 380) < 1e-5 and got["one"] == 1.0


def test_chunks_of_files():
    py = "class A:\n    def f(self):\n        return 1\n\n    def g(self):\n        pass\n\ndef h():\n    def inner():\n        pass\n    return inner\n"
    got = [(t, n, p, a, b) for t, n, p, a, b, _ in chunker.chunks("x/a.py", py)]
    assert got == [("method", "f", "A", 2, 3), ("method", "g", "A", 5, 6), ("function", "h", None, 8, 11), ("function", "inner", None, 9, 10)]
    long = "\n\n".join("word " * 100 for _ in range(100))
    parts = list(chunker.chunks("notes.md", long))
    assert len(parts) > 5 and all(len(p[5]) <= chunker.MOST for p in parts)
    assert [c[1] for c in chunker.chunks("a.ts", "export function f(a) {\n  return 1;\n}\nconst g = (x) => {\n  y();\n};\n")] == ["f", "g"]


def test_tree_files_and_reports(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1\n" * 20)
    (tmp_path / "node_modules/b.js").write_text("y" * 100)
    (tmp_path / "src/bad.py").write_bytes("é".encode("latin-1") * 60)
    tree = files.read_tree(spark, str(tmp_path))
    assert rows(files.files_for_embedding(tree).select("path")) == [("src/a.py",), ("src/bad.py",)]
    assert files.files_for_cache(tree).where("path = 'src/bad.py'").first().content == "é" * 60
    assert {r.path: r.type for r in files.full_tree(tree).collect()}["src"] == "directory"
    (tmp_path / "cov.xml").write_text('<coverage><classes><class filename="a.py" line-rate="0.5"/><class filename="b.py" line-rate="x"/><class filename="c.py" line-rate="1.7"/></classes></coverage>')
    assert rows(reports.read_coverage(spark, str(tmp_path / "cov.xml"))) == [("a.py", 0.5), ("c.py", 1.0)]
    (tmp_path / "log.txt").write_text("c" * 40 + "\nAnn\n2024-01-02T03:04:05Z\n\n3\t1\tx.py\n")
    assert reports.read_git_logs(spark, str(tmp_path / "log.txt")).count() == 1
    (tmp_path / "l.csv").write_text('10,3,50,2,12,"f@1-12@a.py","a.py","f","f( a )",1,12\nbad,row\n')
    assert rows(reports.read_lizard(spark, str(tmp_path / "l.csv"))) == [("a.py", "f", 10, 3, 2, 1)]
    answers = spark.createDataFrame([("m", '{"a": 1}'), ("m", "x ```json\n{\"a\": 2}\n```"), ("m", '{"a": [3'), ("m", None)], "model string, content string")
    got = reports.parse_model_answers(answers).select(F.expr("cast(variant_get(parsed, '$.a') as string)").alias("a"))
    assert [r.a for r in got.collect()] == ["1", "2", "[3]", None]


def test_writes(spark, tmp_path):
    old = spark.createDataFrame([("r", "c", "a.py", 1), ("r", "d", "b.py", 2)], "repository_id string, commit_sha string, file_path string, v int")
    path = str(tmp_path / "t")
    sinks.replace_partitions(old, path, "repository_id", "commit_sha")
    sinks.replace_partitions(old.where("commit_sha = 'c'").withColumn("v", F.lit(9)), path, "repository_id", "commit_sha")
    assert {(r.commit_sha, r.v) for r in spark.read.parquet(path).collect()} == {("c", 9), ("d", 2)}
    new = spark.createDataFrame([("b.py", 3), ("c.py", 4), ("c.py", 5)], "file_path string, v int")
    base = old.select("file_path", "v")
    assert rows(sinks.new_only(base, new, "file_path")) == [("c.py", 5)]
    assert rows(sinks.upload_counts(base, new, "file_path")) == [(2, 1)]
    assert set(map(tuple, sinks.upsert(base, spark.createDataFrame([("b.py", 7), ("z", None)], "file_path string, v int"), "file_path").collect())) == {("a.py", 1), ("b.py", 7), ("z", None)}
    assert rows(sinks.merge_changed_files(base, new.where("v = 3"), "file_path")) == [("a.py", 1), ("b.py", 3)]
    assert rows(sinks.orphans(base, new, "file_path")) == [("a.py", 1)]


def test_streams_equal_their_batch_twins(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    data = [(i, t0 + timedelta(hours=3 * i), i % 3, "view" if i % 2 else "click") for i in range(40)]
    df = spark.createDataFrame(data, "event_id long, ts timestamp, user_id int, event_type string")
    src = str(tmp_path / "events")
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    for name, make in (("w", lambda d: state.windowed_counts(d, "ts", "event_type")), ("l", lambda d: state.last_values(d, "user_id", "ts", "event_id")), ("s", lambda d: state.sessions(d, "user_id", "ts", "8 hours"))):
        q = make(stream).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
        assert rows(spark.table(name)) == rows(make(df))


def test_transitions(spark):
    df = spark.createDataFrame([("a", 1, 1, "pending"), ("a", 2, 2, "running"), ("a", 3, 3, "pending"), ("b", 1, 1, "running")], "k string, ts int, id int, status string")
    got = {(r.k, r.id): r.valid for r in state.checked_transitions(df, "k", "ts", "id", "status", state.TRANSITIONS).collect()}
    assert got == {("a", 1): True, ("a", 2): True, ("a", 3): False, ("b", 1): False}
