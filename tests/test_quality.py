import json

from codestrata.functions import paths, text
from codestrata.operators import findings, quality
from codestrata.sources import reports
from pyspark.sql import functions as F


def kinds(found):
    return [(k, w, n) for k, w, n, _ in found]


def test_python_names_and_numbers():
    code = "data = 5\nMAX = 99\ndef f(tmp):\n  tmp = 3\n  for i, k in y:\n    a = 7\n  return [value for value in z if 404]\nb = 1.5\n"
    assert kinds(quality.python_findings(code)) == [("generic", "data", 1), ("magic", "5", 1), ("magic", "3", 4), ("magic", "7", 6), ("single", "b", 8)]
    assert list(quality.python_findings("")) == []


def test_script_names_and_numbers():
    code = "const data = 17;\nfunction f(tmp) { let tmp = 3; for (let i = 0; i < 99; i++) {} }\nconst MAX = 500000;\nlet q = 7\n// let tmp = 99\nconst note = 'let res = 5';\nconst go = (val, ...obj) => { const val = 1; };\n"
    assert kinds(quality.script_findings(code)) == [("generic", "data", 1), ("magic", "17", 1), ("magic", "3", 2), ("magic", "99", 2), ("single", "q", 4), ("magic", "7", 4)]


def test_patterns_never_count(spark):
    df = spark.createDataFrame([(1, "result = 3\nif value == 3\n", "go", "c"), (2, "result = 30\n", "PYTHON", "c"), (3, None, "python", "c"), (4, "x = (", "python", "c"), (5, "const tmp = 9", "TypeScript", "c")], "chunk_id long, content string, language string, id string")
    found = quality.code_findings(df)
    assert {(r.id, r.what) for r in found.collect() if r.kind == "generic"} == {(1, "result"), (2, "result"), (5, "tmp")}
    assert {(r.id, r.generic, r.magic) for r in quality.counted(found).collect()} == {(1, 0, 0), (2, 1, 1), (5, 1, 1)}


def test_priorities(spark):
    want = {"a/App.tsx": 1, "main.go": 1, "Dockerfile": 2, "x/go.mod": 2, "settings.toml": 2, "x/settings.toml": 3, "src/x.py": 3, "db/Migrations/1.py": 3, "app/views/a.py": 4, "a.py": 5, "x/.json": 5, "x/.env.example": 2}
    df = spark.createDataFrame([(p,) for p in want], "path string")
    assert {r[0]: r[1] for r in df.select("path", paths.priority(F.col("path"))).collect()} == want
    keep = spark.createDataFrame([(p,) for p in ("a.py", "b.md", "Dockerfile.dev", "go.mod", "a.png", "x/.json")], "path string")
    assert [r[0] for r in keep.where(paths.is_included(F.col("path"))).collect()] == ["a.py", "b.md", "Dockerfile.dev", "go.mod"]


def test_budget_keeps_its_reserve_and_retries_as_excerpt(spark):
    df = spark.createDataFrame([("r", "main.py", 80, 1), ("r", "a.py", 15, 1), ("r", "b.py", 10, 1), ("r", "c.py", 9, 1), ("s", "a.py", 5_000, 1), ("s", "b.py", None, 1)], "repository_id string, path string, tokens long, used int")
    got = {(r.repository_id, r.path): (r.tokens, r.truncated) for r in findings.within_budget(df, 110, excerpt=60).collect()}
    assert got == {("r", "main.py"): (80, False), ("r", "a.py"): (15, False), ("s", "a.py"): (60, True)}


def test_excerpts(spark):
    body = "".join(f"line {i:03d}\n" for i in range(100))
    df = spark.createDataFrame([(1, body), (2, "short"), (3, None), (4, "x" * 600)], "id int, t string")
    got = {r[0]: r[1] for r in df.select("id", text.excerpt(F.col("t"), 500, 100)).collect()}
    assert got[2] == "short" and got[3] is None and got[4] == "x" * 50 + "\n\n... [TRUNCATED: 500 characters omitted] ...\n\n" + "x" * 50
    assert got[1].startswith("line 000\n") and "line 004\n\n... [TRUNCATED: 800 characters omitted] ...\n\nline 095\n" in got[1]


def test_architecture_and_issue_rules(spark):
    f = spark.createDataFrame([("a", p, n) for p, n in [("src/a.py", 10), ("src/test_a.py", 10), ("README.md", 5), ("src/b.py", 10), ("lib/c.py", 400)]] + [("b", f"{i}.go", 900) for i in range(12)], "repository_id string, path string, lines int")
    assert {r[0]: r[1] for r in quality.architecture_scores(f).collect()} == {"a": 95.0, "b": 60.0}
    m = spark.createDataFrame([("a", 2, 0, 11, 20, 6, 31, 1, 1000), ("b", 0, 3, 0, 0, 0, 0, 0, 50)], "repository_id string, complex long, long_files long, generic long, magic long, nodoc long, todo long, comments long, lines long")
    got = {(r.repository_id, r.kind, r.severity) for r in quality.issues_of(m).collect()}
    assert got == {("a", "complexity", "low"), ("a", "naming", "low"), ("a", "documentation", "low"), ("a", "debt", "medium"), ("a", "comments", "low"), ("b", "long files", "medium")}


def test_complexity_of_two_tools(spark):
    rows = [("radon", 3, None, 5), ("radon", 25, "D", 9), ("radon", 50, "X", 1), ("lizard", 11, "C", 20)]
    f = spark.createDataFrame(rows, "source string, complexity int, rank string, nloc int")
    r = quality.merged_complexity(quality.complexity_partials(f)).first()
    assert (r.functions, round(r.avg, 6), r.most, r.high, r.nloc, r.complexity_source) == (4, 22.25, 50, 3, 35, "lizard+radon") and (r.rank_a, r.rank_c, r.rank_d, r.rank_f) == (1, 1, 1, 0)
    assert quality.merged_complexity(quality.complexity_partials(f.limit(0))).first().avg == 0.0


def test_metrics_json(spark, tmp_path):
    docs = {
        "cc": {"a.py": [{"type": "function", "name": "f", "complexity": 7, "rank": "B", "lineno": 1, "endline": 9}], "bad.py": {"error": "syntax"}},
        "hal": {"a.py": {"total": {"volume": 10.006, "difficulty": 2.0, "effort": 20.0, "bugs": 0.01}}, "b.py": {"total": {"volume": 1.0, "difficulty": 1.0, "effort": 1.0, "bugs": 0.0}}, "c.py": {"error": "x"}},
        "mi": {"a.py": {"mi": 70.5, "rank": "A"}, "b.py": 15.0, "c.py": {"mi": None}},
        "raw": {"a.py": {"loc": 10, "lloc": 8, "sloc": 7, "comments": 1, "multi": 0, "blank": 2}, "b.py": {"error": "x"}},
    }
    for k, d in docs.items():
        (tmp_path / f"{k}.json").write_text(json.dumps(d))
    read = lambda k: reports.read_metrics_json(spark, f"file://{tmp_path}/{k}.json", k)
    assert [tuple(r) for r in read("cc").collect()] == [("a.py", "f", "function", 7, "B", 1, 9)]
    assert tuple(quality.halstead_totals(read("hal")).first()) == (11.01, 1.5, 10.5, 0.01)
    assert tuple(quality.maintainability_totals(read("mi")).first()) == (3, 28.5, 2, 1, 1, 1)
    assert tuple(quality.raw_totals(read("raw")).first()) == (10, 8, 7, 1, 0, 2)


def test_merged_fields(spark):
    i = spark.createDataFrame(
        [(1, 10, "t" * 300, "s", ["a", "b"], ["x", None, ""], "m1", "low"), (2, 20, "u", "s", ["b", "c"], ["y", "x"], "m2", "low"), (3, 5, "v", None, [], None, None, "medium")],
        "id long, ord long, title string, summary string, files array<string>, evidence array<string>, source string, confidence string",
    )
    seeds = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "id long, seed long")
    got = {r.seed: r for r in findings.merged_fields(i, seeds).collect()}
    assert (got[1].files, got[1].evidence, got[1].sources, got[1].confidence, len(got[1].title), got[1].merged) == (["a", "b", "c"], ["x", "y"], ["m1", "m2"], "high", 200, 2)
    assert (got[3].files, got[3].evidence, got[3].sources, got[3].confidence) == ([], [], [], "medium")


def test_references(spark):
    from codestrata.operators import refs

    sha = "0f" * 20
    asked = spark.createDataFrame([("r", sha), ("r", " refs/heads/main"), ("r", "gone"), ("r", None), ("r", ""), ("s", "main"), ("r", sha)], "repository_id string, ref string")
    branches = spark.createDataFrame([("r", "main", "1" * 40), ("r", "gone", None)], "repository_id string, branch string, commit_sha string")
    latest = spark.createDataFrame([("r", "2" * 40)], "repository_id string, commit_sha string")
    got = {(r.repository_id, r.ref): (r.commit_sha, r.source) for r in refs.resolved(asked, branches, latest).collect()}
    assert got == {("r", sha): (sha, "hash"), ("r", " refs/heads/main"): ("1" * 40, "branch"), ("r", "gone"): ("2" * 40, "latest"), ("r", None): ("2" * 40, "latest"), ("r", ""): ("2" * 40, "latest"), ("s", "main"): (None, "none")}


def test_style_names_the_best_folder(spark):
    from codestrata.operators import search

    unit = lambda i, *more: [float(k == i) + 0.2 * more.count(k) for k in range(4)]
    rows = [("a/1.py", unit(0)), ("a/2.py", unit(0, 1)), ("a/lost.py", unit(2)), ("b/1.py", unit(2, 3)), ("b/2.py", unit(2)), ("top.py", unit(3)), ("a/none.py", None)]
    got = {r.file_path: r for r in search.style_consistency(spark.createDataFrame(rows, "file_path string, embedding array<float>"), 4).collect()}
    assert got["a/lost.py"].best_folder == "b" and got["a/lost.py"].move and got["a/lost.py"].off_style
    assert got["a/1.py"].best_folder == "a" and not got["a/1.py"].move and got["top.py"].best_folder == "root" and "a/none.py" not in got
