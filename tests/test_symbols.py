import pytest

from codestrata.functions import entries
from codestrata.operators import graph, scripts


def got(symbols):
    out = {}
    for kind, _, name, a, b, entry in symbols:
        out.setdefault(kind, set()).add((name, a, b, entry) if kind == "function" else (name, a))
    return out


def test_python_entries_and_marks():
    text = '''
@router.get("/x")
async def read(dep=Depends(session)):
    return helper()

class A:
    table = build()
    def open(self): pass
    def _hidden(self): pass

def quiet(): pass

start(quiet)
if __name__ == "__main__":
    main_loop()
    asyncio.run(serve())
'''
    s = got(graph.python_symbols("src/x.py", text))
    assert {(n, e) for n, _, _, e in s["function"]} == {("read", True), ("open", True), ("_hidden", False), ("quiet", False)}
    assert {n for n, _ in s["mark"]} == {"session", "build", "start", "quiet", "main_loop", "serve"}
    assert {n for n, _ in s["call"]} >= {"helper", "Depends", "build", "start", "main_loop", "run", "serve"}


def test_script_functions_calls_and_marks():
    text = """import x from 'y';
function load(a: string): Promise<void> {
  const s = "function quoted() {}";
  if (a) { save(s); }
}
export const send = async (row) => {
  return rows.map(shape);
};
const one = x => x + 1;
class Store {
  async open(path) {
    return new Reader(path);
  }
}
function Card() { return <Row id={1} />; }
export default memo(Card);
init();
// function gone() {}
"""
    s = got(scripts.script_symbols("src/a.tsx", text))
    assert s["function"] == {("load", 2, 5, False), ("send", 6, 8, True), ("one", 9, 9, False), ("open", 11, 13, False), ("Card", 15, 15, True)}
    assert {n for n, _ in s["call"]} == {"save", "map", "Reader", "Row", "memo", "init"}
    assert {n for n, _ in s["mark"]} >= {"shape", "Reader", "init", "Card"} and "save" not in {n for n, _ in s["mark"]}
    assert list(scripts.script_symbols("a.js", "")) == [] and got(scripts.script_symbols("a.js", "function cut() {\n  a(", 10))["function"] == {("cut", 10, 11, False)}


@pytest.mark.parametrize("path, name, marks, method, want", [("a.py", "main", [], False, True), ("tests/test_a.py", "x", [], False, True), ("a.py", "x", ["app.get"], False, True), ("api/v1/a.py", "x", ["limit"], False, True), ("api/v1/a.py", "_x", ["limit"], False, False), ("a.py", "x", ["limit"], False, False), ("a.py", "on_start", [], False, True), ("a.py", "x", [], True, True)])
def test_entry_rules(path, name, marks, method, want):
    assert entries.python_entry(path, name, marks, method) is want


def test_dead_functions_and_first_of_a_name(spark):
    f = spark.createDataFrame([("a:f", "services/a.py", "f", 1, 50), ("a:g", "services/a.py", "g", 3, 4), ("b:g", "b.py", "g", 1, 2), ("b:h", "b.py", "h", 5, 6)], "id string, file_path string, name string, line_start int, line_end int")
    marks = spark.createDataFrame([("b.py", "g"), ("c.py", "g"), ("c.py", "none")], "file_path string, name string")
    assert {r.id for r in graph.mark_entries(marks, f).collect()} == {"b:g"}
    assert {r.id for r in graph.mark_entries(marks.where("file_path = 'c.py'"), f).collect()} == {"b:g"}
    calls = spark.createDataFrame([("b:g", "b:h")], "caller_id string, callee_id string")
    dead = {r.id: (r.line_count, r.confidence, r.impact_score) for r in graph.dead_functions(f, spark.createDataFrame([("b:g",)], "id string"), calls).collect()}
    assert dead == {"a:f": (50, 1.0, 85.0), "a:g": (2, 1.0, 46.6)}


def test_links_over_names_reach_what_calls_reach(spark):
    f = spark.createDataFrame([(f"{p}:{n}", p, n, a, a + 4) for p in ("a.py", "b.py") for n, a in (("f", 1), ("g", 10), ("h", 20), ("i", 30))], "id string, file_path string, name string, line_start int, line_end int")
    calls = spark.createDataFrame([("a.py", 2, "g"), ("b.py", 11, "h"), ("a.py", 50, "i"), ("a.py", 3, "none")], "file_path string, line int, name string")
    start = f.where("id = 'a.py:f'").select("id")
    by_call = {r.id for r in graph.reachable(start, graph.resolve_calls(calls, f)).collect()}
    by_name = {r.id for r in graph.reachable(start, graph.call_links(calls, f)).collect() if not r.id.startswith("name:")}
    assert by_call == by_name == {"a.py:f", "a.py:g", "b.py:g", "a.py:h", "b.py:h"}
