import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codestrata.functions import paths, scoring, text, vectors
from codestrata.sources import reports


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()[0]


@pytest.mark.parametrize(
    "path, score",
    [("app/services/x.py", 100), ("lib/api/x.py", 40), ("x.py", 50), ("tests/a/test_x.py", 20), ("src/Routes/x.ts", 90)],
)
def test_location_is_the_first_known_segment(spark, path, score):
    assert one(spark, paths.location_score(F.lit(path))) == score


def test_paths(spark):
    assert one(spark, paths.tidy(F.lit(" ./a\\b//c.py"))) == "a/b/c.py"
    assert one(spark, paths.directory(F.lit("x.py"), "root")) == "root"
    assert one(spark, paths.language(F.lit("A/B.PY"))) == "python"
    assert one(spark, paths.is_skipped(F.lit("a/node_modules/x.js"))) and one(spark, paths.is_skipped(F.lit(".github/x.py")))
    assert not one(spark, paths.is_skipped(F.lit("a/.env.py")))
    assert one(spark, paths.module_path(F.lit("app/web/index.ts"))) == "app.web"
    assert one(spark, paths.test_base(F.lit("tests/test_user.py"))) == "user"
    assert one(spark, paths.same_layer(F.lit("a/services/x.py"), F.lit("b/service/y.py")))
    assert not one(spark, paths.same_layer(F.lit(""), F.lit("b/y.py")))


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 10_000), st.one_of(st.none(), st.integers(0, 3650)), st.one_of(st.none(), st.floats(0, 100)))
def test_dead_code_impact_follows_the_formula(spark, lines, days, cc):
    score = scoring.dead_code_impact(F.lit(lines), F.lit("services/x.py"), F.lit(days).cast("double"), F.lit(cc).cast("double"))
    want = 0.4 * min(100, 2 * lines) + 30 + 0.2 * (50 if days is None else max(0, 100 - days)) + 0.1 * (50 if cc is None else cc)
    assert one(spark, score) == pytest.approx(min(100, want))


def test_health_score_of_nothing_is_full(spark):
    z = F.lit(0)
    assert one(spark, scoring.health_score(z, z, z, z, z, z)) == 100
    assert one(spark, scoring.health_score(F.lit(10), F.lit(10), F.lit(9), F.lit(9), F.lit(5), F.lit(5))) == 10


def test_clamp_keeps_null(spark):
    assert one(spark, scoring.clamp(F.lit(None).cast("double"))) is None


def test_text(spark):
    assert one(spark, text.cyclomatic_complexity(F.lit("if a and b:\n  for x in y: pass"), F.lit("Python"))) == 4
    assert one(spark, text.line_count(F.lit("a\nb\n"))) == 2 and one(spark, text.line_count(F.lit("a\nb"))) == 2 and one(spark, text.line_count(F.lit(""))) == 0
    assert one(spark, text.imports(F.lit("import os\nfrom a.b import c"), F.lit("python"))) == ["a.b", "os"]
    assert one(spark, text.imports_file(F.array(F.lit("app.services.x")), F.lit("services/x.py")))
    assert one(spark, text.magic_numbers(F.lit("42 200 15 999 37"))) == 3


def test_cosine_of_a_zero_vector_is_null(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, vectors.cosine(v(1, 0), v(1, 1))) == pytest.approx(0.70710678)
    assert one(spark, vectors.cosine(v(0, 0), v(1, 1))) is None


@pytest.mark.parametrize("name, path, want", [("__init__", "a.py", True), ("render", "a.py", True), ("foo", "x/utils/a.py", True), ("HttpAdapter", "a.py", True), ("", "a.py", False), ("work", "x/utils/a.py", False)])
def test_boilerplate(spark, name, path, want):
    assert one(spark, scoring.is_boilerplate(F.lit(name), F.lit(path))) is want


@pytest.mark.parametrize(
    "raw, want",
    [('{"a": 1}', '{"a": 1}'), ('x ```json\n[1, 2,]\n``` y', "[1, 2]"), ('text {"a": [1, {"b": 2', '{"a": [1, {"b": 2}]}'), ("none", None), (None, None), ('{"a": "x, "b', None)],
)
def test_json_repair(raw, want):
    got = reports.repair_json(raw)
    assert got == want or want is None


def test_git_log_parsing():
    log = "a" * 40 + "\nAnn\n2024-01-02T03:04:05+02:00\n\n3\t1\tx.py\n-\t-\ty.bin\n" + "b" * 40 + "\nBob\n2024-01-03T00:00:00Z\n\n0\t2\tz/a b.py\n"
    rows = list(reports.parse_git_log(log))
    assert [(r[1], r[3], r[4], r[5]) for r in rows] == [("Ann", "x.py", 3, 1), ("Bob", "z/a b.py", 0, 2)]
    assert str(rows[0][2]) == "2024-01-02 01:04:05"
