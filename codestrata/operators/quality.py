"""Quality of code: names and numbers by syntax, file heuristics, architecture, issue rules, complexity of several tools."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions import paths, scoring, text
from codestrata.operators.graph import parse_python
from codestrata.operators.scripts import blanked
from codestrata.session import ship

# Names that say nothing, single letters that are no names, numbers that need none.
GENERIC_NAMES = ["data", "info", "temp", "tmp", "result", "res", "val", "value", "obj", "item", "ret", "response"]
SINGLE_LETTERS = ["a", "b", "c", "d", "e", "f", "g", "h", "k", "l", "m", "n", "o", "p", "q", "r", "s", "t", "u", "v", "w", "z"]
PLAIN_NUMBERS = [10, 60, 24, 365, 100, 1000, 200, 201, 204, 400, 401, 403, 404, 500]
#: Confidence of a finding by syntax, of a single letter or number, and of one by pattern; the least that counts.
BY_SYNTAX, BY_SHAPE, BY_PATTERN = 0.85, 0.7, 0.6
LEAST_NAME, LEAST_NUMBER = 0.7, 0.6

Finding = tuple[str, str, int, float]


def _plain(number: float) -> bool:
    return abs(number) <= 2 or number in PLAIN_NUMBERS


def python_findings(code: str) -> Iterator[Finding]:
    """(kind, what, line, confidence) of a Python text; kinds are generic, single and magic."""
    tree, lines = parse_python(code)
    if tree is None:
        return
    spared: set[str] = set()  # parameters and names of loops and comprehensions met so far
    line = lambda node: lines[min(node.lineno, len(lines)) - 1]

    def walk(node: ast.AST, looped: bool) -> Iterator[Finding]:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            spared.update(a.arg for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs])
            for child in node.body:
                yield from walk(child, looped)
            return
        if isinstance(node, (ast.For, ast.AsyncFor)):
            spared.update(t.id for t in (node.target.elts if isinstance(node.target, ast.Tuple) else [node.target]) if isinstance(t, ast.Name))
            for child in node.body:
                yield from walk(child, True)
            return
        if isinstance(node, (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)):
            spared.update(g.target.id for g in node.generators if isinstance(g.target, ast.Name))
        target = node.targets[0] if isinstance(node, ast.Assign) else node.target if isinstance(node, ast.AnnAssign) and node.value else None
        if isinstance(target, ast.Name) and target.id not in spared:
            if target.id.lower() in GENERIC_NAMES:
                yield "generic", target.id, line(target), BY_SYNTAX
            elif target.id in SINGLE_LETTERS and not looped:
                yield "single", target.id, line(target), BY_SHAPE
        constant = isinstance(target, ast.Name) and target.id.isupper()
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool) and not _plain(node.value):
            yield "magic", str(node.value), line(node), BY_SHAPE
        for child in ast.iter_child_nodes(node):
            if not (constant and isinstance(child, ast.Constant)):
                yield from walk(child, looped)

    try:
        yield from walk(tree, False)
    except RecursionError:
        return


_JS_TOKEN = re.compile(
    r"\bfor\s*\(\s*(?:(?:const|let|var)\s+)?(?P<loop>[A-Za-z_$][\w$]*)|\bfunction\b\s*\*?\s*[\w$]*\s*\((?P<params>[^()]*)\)|\((?P<arrow>[^()]*)\)\s*(?::[^=\n{]*)?=>|(?P<one>[A-Za-z_$][\w$]*)\s*=>|"
    r"\b(?:const|let|var)\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?::[^=;\n]+)?(?=[=;,\n])(?:=\s*-?(?P<sole>\d[\w.]*)\s*(?=[;,\n]))?|(?<![\w$.])(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)(?![\w$.])"
)


def script_findings(code: str) -> Iterator[Finding]:
    """As ``python_findings`` for JavaScript and TypeScript, read token by token: strings and comments are skipped."""
    code = blanked(code)
    spared: set[str] = set()
    at = count = 0
    for m in _JS_TOKEN.finditer(code):
        count += code.count("\n", at, m.start())
        at = m.start()
        if m["loop"]:
            spared.add(m["loop"])
        elif m["params"] is not None or m["arrow"] is not None or m["one"]:
            spared.update(re.findall(r"(?:^|,)\s*(?:\.\.\.)?([A-Za-z_$][\w$]*)", m["params"] or m["arrow"] or m["one"] or ""))
        elif m["name"]:
            if m["name"].lower() in GENERIC_NAMES and m["name"] not in spared:
                yield "generic", m["name"], count + 1, BY_SYNTAX
            elif m["name"] in SINGLE_LETTERS and m["name"] not in spared:
                yield "single", m["name"], count + 1, BY_SHAPE
            if m["sole"] and not m["name"].isupper() and re.fullmatch(r"\d+(?:\.\d+)?", m["sole"]) and not _plain(float(m["sole"])):
                yield "magic", m["sole"], count + 1, BY_SHAPE
        elif m["number"] and not _plain(float(m["number"])):
            yield "magic", m["number"], count + 1, BY_SHAPE


_ASSIGNED = re.compile(r"\b(" + "|".join(GENERIC_NAMES) + r")\s*=\s*[^=]", re.I)
_NO_NAMES = re.compile(r"^\s*(?:#|//|/\*|(?:async\s+)?def\s+\w+\s*\(|(?:export\s+)?(?:async\s+)?function\s|for\s+\w+\s+in\s|for\s*\()")


def pattern_findings(code: str) -> Iterator[Finding]:
    """Generic names of any other language, line by line and of low confidence; each name once a line."""
    for n, line in enumerate(code.split("\n"), 1):
        if not _NO_NAMES.match(line):
            for name in dict.fromkeys(m[1].lower() for m in _ASSIGNED.finditer(line)):
                yield "generic", name, n, BY_PATTERN


def code_findings(files: DataFrame, id_col: str = "chunk_id", text_col: str = "content", language: Column | None = None) -> DataFrame:
    """``(id, kind, what, line, confidence)`` of names and numbers in code; null texts give none, broken Python is read as far as it parses."""
    ship(files.sparkSession)
    names, types = ["id", "kind", "what", "line", "confidence"], [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.float64()]
    readers = {"python": python_findings, "javascript": script_findings, "typescript": script_findings}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *f) for i, t, lang in zip(*(c.to_pylist() for c in batch.columns)) if t for f in readers.get(lang, pattern_findings)(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    lang = F.lower(language if language is not None else F.col("language")).alias("lang")
    return files.select(F.col(id_col).cast("long").alias("id"), F.col(text_col), lang).mapInArrow(find, "id long, kind string, what string, line int, confidence double")


def counted(findings: DataFrame) -> DataFrame:
    """``(id, generic, magic)``: the findings sure enough to count."""
    kind, sure = F.col("kind"), F.col("confidence")
    return findings.groupBy("id").agg(F.count_if((kind == "generic") & (sure >= LEAST_NAME)).alias("generic"), F.count_if((kind == "magic") & (sure >= LEAST_NUMBER)).alias("magic"))


def heuristics(content: Column, language: Column) -> list[Column]:
    """lines, todo, comments, nodoc, notypes of one text."""
    python = F.lower(language) == "python"
    return [
        text.line_count(content).alias("lines"),
        text.todo_lines(content).alias("todo"),
        text.comment_lines(content).alias("comments"),
        F.when(python & text.lacks_docstring(content), 1).otherwise(0).alias("nodoc"),
        F.when(python, text.missing_hints(content)).otherwise(0).alias("notypes"),
    ]


def architecture_scores(files: DataFrame, group: str = "repository_id") -> DataFrame:
    """``(group, architecture)`` of ``(group, path, lines)``: one language, tests, a readme and folders add, a full root and long files cost."""
    low, name = F.lower("path"), paths.file_name(F.col("path"))
    root = ~F.col("path").contains("/")
    top = paths.segments(F.col("path"))[0]
    share = lambda langs: F.count_if(paths.language(F.col("path")).isin(langs)) / F.count("*")
    stats = files.groupBy(group).agg(
        (F.greatest(share(["python"]), share(["javascript", "typescript"])) > 0.7).alias("one"),
        F.max(F.lower(name).contains("test") | low.contains("__tests__")).alias("tests"),
        F.max(root & F.lower(name).startswith("readme")).alias("readme"),
        F.max(~root & top.isin("src", "lib", "app", "pkg", "internal")).alias("folders"),
        (F.count_if(root & ~name.startswith(".") & ~name.isin("README.md", "LICENSE", "package.json", "pyproject.toml", "Makefile", "Dockerfile")) > 10).alias("full"),
        (F.count_if(F.col("lines") > 300) > 0.3 * F.count("*")).alias("long"),
    )
    add = lambda c, n: F.when(F.col(c), n).otherwise(0)
    return stats.select(group, scoring.clamp(70.0 + add("one", 10) + add("tests", 5) + add("readme", 5) + add("folders", 5) - add("full", 5) - add("long", 5), 40.0, 100.0).alias("architecture"))


def issues_of(metrics: DataFrame, group: str = "repository_id") -> DataFrame:
    """``(group, kind, severity, n, confidence)``: the rules that the counts of a repository break.

    ``metrics`` has (group, complex, long_files, generic, magic, nodoc, todo, comments, lines).
    """
    c = F.col
    rule = lambda hit, kind, severity, n, sure: F.when(hit, F.struct(F.lit(kind).alias("kind"), severity.alias("severity"), n.cast("long").alias("n"), F.lit(sure).alias("confidence")))
    low = F.lit("low")
    rules = F.array(
        rule(c("complex") > 0, "complexity", F.when(c("complex") < 3, "low").when(c("complex") < 10, "medium").otherwise("high"), c("complex"), 0.9),
        rule(c("long_files") > 0, "long files", F.when(c("long_files") < 3, "low").otherwise("medium"), c("long_files"), 0.95),
        rule(c("generic") > 10, "naming", low, c("generic"), 0.7),
        rule(c("magic") > 20, "magic numbers", low, c("magic"), 0.6),
        rule(c("nodoc") > 5, "documentation", low, c("nodoc"), 0.75),
        rule(c("todo") > 10, "debt", F.when(c("todo") > 30, "medium").otherwise("low"), c("todo"), 0.95),
        rule((c("lines") > 100) & (c("comments") / c("lines") < 0.05), "comments", low, c("comments"), 0.6),
    )
    return metrics.select(group, F.inline(F.filter(rules, lambda r: r.isNotNull())))


# ------------------------------------------------------------ complexity of one or several tools


def complexity_partials(functions: DataFrame, *by: str) -> DataFrame:
    """Partial totals of ``(source, complexity, rank, nloc)``, one row a source and key: what ``merged_complexity`` adds up.

    A missing rank is A; ranks outside A to F count in no grade.
    """
    rank = F.coalesce("rank", F.lit("A"))
    return functions.groupBy("source", *by).agg(
        F.count("complexity").alias("functions"),
        F.avg("complexity").alias("avg"),
        F.max("complexity").alias("most"),
        F.count_if(F.col("complexity") > 10).alias("high"),
        F.sum("nloc").alias("nloc"),
        *(F.count_if(rank == r).alias(f"rank_{r.lower()}") for r in "ABCDEF"),
    )


def merged_complexity(partials: DataFrame, *by: str) -> DataFrame:
    """The totals over all sources: averages weighted by functions, the rest added, and the sources named; no functions give zeros."""
    n = F.sum("functions")
    ranks = [f"rank_{r}" for r in "abcdef"]
    return partials.groupBy(*by).agg(
        n.alias("functions"),
        F.when(n > 0, F.sum(F.coalesce("avg", F.lit(0.0)) * F.col("functions")) / n).otherwise(0.0).alias("avg"),
        F.coalesce(F.max("most"), F.lit(0)).alias("most"),
        F.sum("high").alias("high"),
        F.sum("nloc").alias("nloc"),
        *(F.sum(r).alias(r) for r in ranks),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("functions") > 0, F.col("source")))), "+").alias("complexity_source"),
    )


def halstead_totals(rows: DataFrame) -> DataFrame:
    """One row of ``(volume, difficulty, effort, bugs)``: sums, and means of difficulty and effort, to 2 digits."""
    zero = F.lit(0.0)
    return rows.agg(*(F.round(F.coalesce(f(c), zero), 2).alias(c) for c, f in (("volume", F.sum), ("difficulty", F.avg), ("effort", F.avg), ("bugs", F.sum))))


def maintainability_totals(rows: DataFrame) -> DataFrame:
    """One row of ``(files, avg, low, grade_a, grade_b, grade_c)`` of ``(mi, rank)``; a null index counts 0, a missing rank follows from the index."""
    mi = F.coalesce("mi", F.lit(0.0))
    grade = F.coalesce("rank", F.when(mi > 20, "A").when(mi > 10, "B").otherwise("C"))
    return rows.agg(F.count("*").alias("files"), F.round(F.coalesce(F.avg(mi), F.lit(0.0)), 2).alias("avg"), F.count_if(mi < 65).alias("low"), *(F.count_if(grade == g).alias(f"grade_{g.lower()}") for g in "ABC"))


def raw_totals(rows: DataFrame) -> DataFrame:
    """One row of line counts by kind."""
    return rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("loc", "lloc", "sloc", "comments", "multi", "blank")))
