"""Graphs of calls and links: reachability, components, calls of Python sources."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codestrata.functions import entries, scoring
from codestrata.operators.scripts import script_symbols
from codestrata.scratch import Scratch
from codestrata.session import ship


def reachable(sources: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id)`` of all nodes that ``sources (id)`` reach over ``edges (caller_id, callee_id)``.

    A frontier is joined until nothing new is found; cycles end. Each round's
    frontier is written to the shared folder, so a lost executor costs one
    round; frontiers stay tables of their own and are read as one.
    """
    scratch = Scratch(sources.sparkSession, "reachable")
    fronts = [scratch.save(sources.select("id").distinct())]
    steps = scratch.save(edges.select(F.col("caller_id").alias("id"), F.col("callee_id").alias("to")).distinct())
    while True:
        seen = reduce(DataFrame.unionByName, fronts)
        fresh = scratch.save(fronts[-1].join(steps, "id").select(F.col("to").alias("id")).distinct().join(seen, "id", "left_anti"))
        if fresh.isEmpty():
            return seen
        fronts.append(fresh)


def unreachable(nodes: DataFrame, sources: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(reachable(sources, edges), "id", "left_anti")


def components(links: DataFrame) -> DataFrame:
    """``(id, group_id)``: the smallest id each id of ``links (a, b)`` is linked with, by label propagation with pointer jumps."""
    scratch = Scratch(links.sparkSession, "components")
    both = scratch.save(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a IS NOT NULL AND b IS NOT NULL").distinct())
    label = scratch.save(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("l")))
    while True:
        near = both.join(label.select(F.col("id").alias("b"), "l"), "b").groupBy(F.col("a").alias("id")).agg(F.min("l").alias("m"))
        lower = label.join(near, "id", "left").select("id", F.least("l", F.coalesce("m", "l")).alias("l"), F.col("l").alias("was"))
        jump = lower.join(label.select(F.col("id").alias("l"), F.col("l").alias("j")), "l", "left").select("id", F.least("l", F.coalesce("j", "l")).alias("l"), "was")
        new = scratch.save(jump, label)
        if new.where("l <> was").isEmpty():
            return new.select("id", F.col("l").alias("group_id"))
        label = new.select("id", "l")


def _calling(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """``(caller_id, called)``: the name that a function calls; a call's caller is the first function around its line."""
    c, f = calls.select("file_path", "line", F.col("name").alias("called")), functions.select("file_path", F.col("id").alias("caller_id"), "line_start", "line_end")
    known = c.join(functions.select(F.col("name").alias("called")).distinct(), "called", "left_semi")
    inside = known.join(f, "file_path").where(F.col("line").between(F.col("line_start"), F.col("line_end")))
    return inside.groupBy("file_path", "line", "called").agg(F.min_by("caller_id", F.struct("line_start", "caller_id")).alias("caller_id")).select("caller_id", "called").distinct()


def resolve_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """``(caller_id, callee_id)``: a call goes to every function of its name; its caller is the first function around its line.

    ``calls`` has (file_path, line, name); ``functions`` (id, file_path, name, line_start, line_end).
    """
    return _calling(calls, functions).join(functions.select(F.col("name").alias("called"), F.col("id").alias("callee_id")), "called").select("caller_id", "callee_id").distinct()


def call_links(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """As ``resolve_calls`` over a node for each name, ``name:x``: reaches the same functions, and a name that many call and many bear costs their sum, not their product."""
    node = lambda c: F.concat(F.lit("name:"), F.col(c))
    up = _calling(calls, functions).select("caller_id", node("called").alias("callee_id"))
    return up.unionByName(functions.select(node("name").alias("caller_id"), F.col("id").alias("callee_id")).distinct())


def mark_entries(marks: DataFrame, functions: DataFrame) -> DataFrame:
    """``(id)`` of the functions that ``marks (file_path, name)`` make entry points.

    A mark goes to the function of its name in its file; where there is none,
    to the first one of that name anywhere, by file and line.
    """
    m = marks.select("file_path", "name").distinct()
    here = m.join(functions.select("file_path", "name", "id"), ["file_path", "name"])
    first = functions.groupBy("name").agg(F.min_by("id", F.struct("file_path", "line_start", "id")).alias("id"))
    there = m.join(here.select("file_path", "name").distinct(), ["file_path", "name"], "left_anti").join(first, "name")
    return here.select("id").unionByName(there.select("id")).distinct()


def dead_functions(functions: DataFrame, sources: DataFrame, calls: DataFrame) -> DataFrame:
    """Functions that no entry point reaches, with their size and impact; sure, for reachability is exact on the given calls."""
    lost = functions.join(reachable(sources, calls), "id", "left_anti")
    lines = F.col("line_end") - F.col("line_start") + 1
    none = F.lit(None).cast("double")
    impact = F.round(scoring.dead_code_impact(lines, F.col("file_path"), none, none), 3)
    return lost.select("id", "file_path", F.col("name").alias("function_name"), "line_start", "line_end", lines.alias("line_count"), F.lit(1.0).alias("confidence"), impact.alias("impact_score"))


def _indent(line: str) -> str:
    return line[: len(line) - len(line.lstrip())]


def parse_python(text: str) -> tuple[ast.Module | None, list[int]]:
    """(tree, the text's line of each line of the tree).

    An indented piece is put into a block. Where a text is cut off or broken,
    open blocks are closed and lines that cannot be read are left out.
    """
    code = lambda x: bool(x.strip()) and not x.lstrip().startswith("#")
    rows = list(enumerate(text.split("\n"), 1))
    if next((x for _, x in rows if code(x)), "")[:1] in (" ", "\t"):
        rows.insert(0, (1, "if 1:"))
    for _ in range(3 * len(rows) + 9):
        try:
            return ast.parse("\n".join(x for _, x in rows)), [n for n, _ in rows]
        except SyntaxError as e:
            at, said = min(max(e.lineno or 1, 1), len(rows)) - 1, e.msg or ""
        except (ValueError, RecursionError):
            break
        no, line = rows[at]
        header = re.search(r"expected an indented block after .* on line (\d+)", said)
        if header:
            last = not any(code(x) for _, x in rows[at + 1 :]) and (at == int(header[1]) - 1 or line.rstrip().endswith(":"))
            rows.insert(len(rows) if last else at, (no, _indent(rows[int(header[1]) - 1][1]) + " pass"))
        elif "expected 'except' or 'finally'" in said:
            ends = [(_indent(x), x.strip()[:3]) for _, x in rows[: at + 1]]
            open_try = [i for i in range(at) if ends[i][1] == "try" and not any(d == ends[i][0] and w in ("exc", "fin") for d, w in ends[i + 1 :])]
            i = open_try[-1] if open_try else at
            rows[i] = (rows[i][0], _indent(rows[i][1]) + "if 1:" if open_try else "")
        elif "unexpected indent" in said:
            before = next((x for _, x in reversed(rows[:at]) if code(x)), "")
            rows.insert(at, (no, _indent(before) + "if 1:"))
        elif "unterminated triple-quoted" in said:
            rows = rows[:at]
        else:
            rows[at] = (no, "" if line.strip() in ("", "pass") or "unindent" in said else _indent(line) + "pass")
    return None, []


def python_symbols(path: str, text: str, first: int = 1) -> Iterator[tuple]:
    """(kind, path, name, line_start, line_end, is_entry) of functions, and of calls with kind 'call'; ``first`` is the file's line where the text begins."""
    tree, lines = parse_python(text)
    if tree is None:
        return
    line = lambda n: lines[min(n, len(lines)) - 1] + first - 1
    rows: list[tuple] = []

    def dotted(node: ast.AST) -> str:
        node = node.func if isinstance(node, ast.Call) else node
        return f"{dotted(node.value)}.{node.attr}" if isinstance(node, ast.Attribute) else getattr(node, "id", "")

    def mark(node: ast.AST) -> None:
        name = node.func if isinstance(node, ast.Call) else node
        if isinstance(name, ast.Name):
            rows.append(("mark", path, name.id, line(node.lineno), line(node.lineno), True))

    def walk(node: ast.AST, outside: bool, owner: str) -> None:
        """``outside``: not inside a function; ``owner``: what directly holds the node."""
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            entry = entries.python_entry(path, node.name, [d for d in map(dotted, node.decorator_list) if d], owner == "class" and not node.name.startswith("_"))
            rows.append(("function", path, node.name, line(node.lineno), line(node.end_lineno or node.lineno), entry))
            outside, owner = False, "function"
        elif isinstance(node, ast.ClassDef):
            owner = "class"
        elif isinstance(node, ast.If) and "__name__" in (said := ast.dump(node.test)) and "__main__" in said:
            for c in ast.walk(node):
                if isinstance(c, ast.Call):
                    mark(c)
                    if isinstance(c.func, ast.Attribute) and c.func.attr == "run":
                        for a in c.args:
                            mark(a)
        elif isinstance(node, ast.Call):
            name = node.func.attr if isinstance(node.func, ast.Attribute) else getattr(node.func, "id", None)
            if name:
                rows.append(("call", path, name, line(node.lineno), line(node.lineno), False))
            if outside:
                mark(node)
            for a in [*node.args, *(k.value for k in node.keywords)]:  # functions passed on, as to Depends()
                if isinstance(a, ast.Name):
                    mark(a)
        for child in ast.iter_child_nodes(node):
            walk(child, outside, owner)

    try:
        walk(tree, True, "module")
    except RecursionError:
        pass
    yield from rows


def _extractor(readers: dict):
    names = ["kind", "file_path", "name", "line_start", "line_end", "is_entry"]
    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_()]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for p, t, n, k in zip(*(c.to_pylist() for c in batch.columns)) if t and p and k in readers for r in readers[k](p, t, n or 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return extract


def extract_symbols(files: DataFrame, language: Column | None = None) -> DataFrame:
    """``(kind, file_path, name, line_start, line_end, is_entry)`` of ``(file_path, content)`` in Python, JavaScript and TypeScript; of Python alone without ``language``.

    Kinds are function, call, and mark: a name called or passed on where that
    makes a function an entry point. With a column ``line_start``, the file's
    line where the content begins, lines are those of the file; else those of
    the content. Null paths and texts and other languages give nothing.
    """
    ship(files.sparkSession)
    first = F.col("line_start") if "line_start" in files.columns else F.lit(1)
    lang = F.lower(language) if language is not None else F.lit("python")
    readers = {"python": python_symbols, "javascript": script_symbols, "typescript": script_symbols}
    rows = files.select("file_path", "content", first.cast("int").alias("first"), lang.alias("lang"))
    return rows.mapInArrow(_extractor(readers), "kind string, file_path string, name string, line_start int, line_end int, is_entry boolean")


def extract_python(files: DataFrame) -> DataFrame:
    """``extract_symbols`` of Python files."""
    return extract_symbols(files)
