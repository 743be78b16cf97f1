import pytest

from codestrata.llm import documented

DOC = "// Adds all the given numbers to the total.\n"
#: Texts whose one definition once took longer than it may and so was taken for none, or made the next wait for nothing.
SLOW = {
    "throws": ("java", DOC + "void f() throws A," + " " * 20_000 + "B {\n}\n", ["f"]),
    "casts": ("typescript", DOC + "x = " + "<a>b:c" * 4_000 + "\n\n" + DOC + "function f() {}\n", ["f"]),
    "comments": ("javascript", DOC + "function f(a) {" + "/* " * 20_000 + "}\n", ["f"]),
    "parameters": ("javascript", DOC + "function f(a = [" + "(1), " * 20_000 + "]) {\n}\n", ["f"]),
    "brackets": ("go", DOC + "func f(a int) {" + "g() " * 30_000 + "}\n", ["f"]),
}


@pytest.mark.parametrize("case", SLOW)
def test_a_slow_definition_is_found_all_the_same(case, monkeypatch):
    monkeypatch.setattr(documented, "PATIENCE", 0.2)
    lang, text, want = SLOW[case]
    got = list(documented.pairs_of(text, lang))
    assert [n for n, _, _ in got] == want and all(c in text and c.endswith("}") for _, c, _ in got)


def test_a_slow_definition_is_told_from_none(monkeypatch, caplog):
    import regex

    monkeypatch.setattr(documented, "PATIENCE", 0.05)
    slow = regex.compile(r"(?P<name>(?:a|a)*(?:a|aa)*b|a*)")
    late = []
    assert documented._match(slow, "a" * 22, 0, late) is None and late == [0]
    assert documented._match(slow, "c" * 22, 1, late)["name"] == "" and documented._match(regex.compile("b"), "a", 0, late) is None and late == [0]
    assert documented._definition(slow, "a" * 22, 0)["name"] == "a" * 22 and "more than 0.05 seconds" in caplog.text


def test_rows_of_slow_definitions_are_whole(spark):
    _, text, _ = SLOW["throws"]
    df = spark.createDataFrame([(1, "A.java", None, text.replace(" " * 20_000, " " * 100_000)), (2, "b.js", None, DOC + "function g(a) { return a /* a; }\n")], "chunk_id long, file_path string, language string, content string")
    got = {r.id: (r.function_name, r.code) for r in documented.documented_functions(df).collect()}
    assert {i: n for i, (n, _) in got.items()} == {1: "f", 2: "g"}
    assert got[1][1].endswith(" B {\n}") and got[2][1].endswith("{ return a /* a; }")
