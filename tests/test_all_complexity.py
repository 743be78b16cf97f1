from codestrata.plans import catalog


def test_every_language_gets_a_complexity(spark, tmp_path):
    js = "if (a) { while (b) { c() } }"
    rows = [(1, "a.js", "JavaScript", js), (2, "a.ts", None, js), (3, "a.rs", "rust", "if a { b() }"), (4, "a.py", "python", "if a:\n    b()\n"), (5, "a.yml", "yaml", "x: 1"), (6, "a.go", "go", None)]
    spark.createDataFrame(rows, "chunk_id long, file_path string, language string, content string").write.parquet(f"{tmp_path}/code_chunks.parquet")
    got = {r.chunk_id: r.cc for r in catalog.queries()["m9_chunk_complexity"](spark, str(tmp_path)).collect()}
    assert got == {1: 3, 2: 3, 3: 2, 4: 2, 5: 1}
