from codestrata.operators import graph

METHOD = '''    def save(self):
        """Text
at the margin."""
        self.check()
'''


def got(text, first=1):
    return {(kind[0], name, a, b) for kind, _, name, a, b, _ in graph.python_symbols("x.py", text, first)}


def test_indented_cut_and_broken_pieces_give_their_symbols():
    assert got(METHOD) == {("f", "save", 1, 4), ("c", "check", 4, 4)}
    assert got(METHOD, 40) == {("f", "save", 40, 43), ("c", "check", 43, 43)}
    assert got("def f():\n    try:\n        a()\n        b(1,") == {("f", "f", 1, 4), ("c", "a", 3, 3)}
    assert got("def f(\n    x,\n):\n") == {("f", "f", 1, 3)}
    assert got("def f():\n    '''Cut docstr") == {("f", "f", 1, 1)}
    assert got("def f():\n    a.import(1)\n    b()\ndef g():\n    c()\n") == {("f", "f", 1, 3), ("c", "b", 3, 3), ("f", "g", 4, 5), ("c", "c", 5, 5)}
    assert got("def (") == set()


def test_a_function_called_only_from_a_method_is_called(spark):
    rows = [("x.py", METHOD, 40), ("x.py", "    def other(self):\n        pass\n\n\n", 60), ("y.py", "def check():\n    pass\n", 1)]
    s = graph.extract_python(spark.createDataFrame(rows, "file_path string, content string, line_start int")).cache()
    f = s.where("kind = 'function'").selectExpr("concat_ws(':', file_path, name) AS id", "file_path", "name", "line_start", "line_end")
    calls = graph.resolve_calls(s.where("kind = 'call'").selectExpr("file_path", "line_start AS line", "name"), f)
    assert [tuple(r) for r in calls.collect()] == [("x.py:save", "y.py:check")]


def test_chunks_of_null_language_are_read_by_their_path(spark, tmp_path):
    from codestrata.plans import catalog

    rows = [("a.py", None, "def one(): pass", 1), ("b.py", "Python", "def two(): pass", 1), ("c.go", None, "def three(): pass", 1)]
    spark.createDataFrame(rows, "file_path string, language string, content string, line_start int").write.parquet(f"{tmp_path}/code_chunks.parquet")
    assert {r.name for r in catalog.g1_python_symbols(spark, str(tmp_path)).collect()} == {"one", "two"}
