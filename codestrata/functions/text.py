"""Column expressions on source text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decision points that add to cyclomatic complexity, by language.
DECISIONS = {
    "python": [r"\bif\b", r"\belif\b", r"\bfor\b", r"\bwhile\b", r"\band\b", r"\bor\b", r"\bexcept\b", r"\bwith\b", r"\bassert\b", r"\bcase\b"],
    "javascript": [r"\bif\b", r"\belse\s+if\b", r"\bfor\b", r"\bwhile\b", r"\bcase\b", r"\bcatch\b", r"\b\?\b", r"&&", r"\|\|", r"\?\?"],
    "java": [r"\bif\b", r"\belse\s+if\b", r"\bfor\b", r"\bwhile\b", r"\bcase\b", r"\bcatch\b", r"\b\?\b", r"&&", r"\|\|"],
    "go": [r"\bif\b", r"\belse\s+if\b", r"\bfor\b", r"\bcase\b", r"\bselect\b", r"&&", r"\|\|"],
    "": [r"\bif\b", r"\bfor\b", r"\bwhile\b", r"\bcase\b", r"\bcatch\b", r"&&", r"\|\|"],
}
# Fixed value: numbers that want a name.
MAGIC = r"\b(?!0|1|2|100|1000)\d{2,}\b"


def _decisions(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.regexp_count(text, F.lit("(?i)" + p)) for p in patterns])


def cyclomatic_complexity(text: Column, language: Column) -> Column:
    """1 plus the decision points that the language's patterns find."""
    low = F.lower(language)
    n = (
        F.when(low == "python", _decisions(text, DECISIONS["python"]))
        .when(low.isin("javascript", "typescript"), _decisions(text, DECISIONS["javascript"]))
        .when(low == "java", _decisions(text, DECISIONS["java"]))
        .when(low == "go", _decisions(text, DECISIONS["go"]))
        .otherwise(_decisions(text, DECISIONS[""]))
    )
    return (1 + F.coalesce(n, F.lit(0))).cast("int")


def line_count(text: Column) -> Column:
    """Lines as a reader of the file would count them."""
    return F.when(F.length(text) == 0, 0).otherwise(F.regexp_count(text, F.lit("\n")) + F.when(text.endswith("\n"), 0).otherwise(1)).cast("int")


def todo_lines(text: Column) -> Column:
    return F.size(F.filter(F.split(F.upper(text), "\n"), lambda x: x.contains("TODO") | x.contains("FIXME")))


def comment_lines(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x).rlike(r"^(?:#|//|/\*|\*)")))


def lacks_docstring(text: Column) -> Column:
    """Whether a Python text defines something and holds no docstring at all."""
    return (text.contains("def ") | text.contains("class ")) & ~text.contains('\"\"\"') & ~text.contains("'''")


def missing_hints(text: Column) -> Column:
    """Definitions without a return type less those with one; the difference may be negative."""
    return F.regexp_count(text, F.lit(r"def \w+\([^)]*\):")) - F.regexp_count(text, F.lit(r"def \w+\([^)]*\)\s*->"))


def excerpt(text: Column, most: int = 50_000, size: int = 4_000) -> Column:
    """A text of more than ``most`` characters as its beginning and end, cut at line breaks where one is near."""
    half = size // 2
    head, tail = F.substring(text, 1, half), F.right(text, F.lit(half))
    last = F.lit(half) - F.length(F.substring_index(head, "\n", -1))  # characters up to and with the last line break
    begin = F.when(head.contains("\n") & (last - 1 > half // 2), F.substring(head, F.lit(1), last - 1)).otherwise(head)
    at = F.instr(tail, "\n") - 1
    end = F.when((at > 0) & (at < half // 2), F.substring(tail, at + 2, F.lit(half))).otherwise(tail)
    cut = F.concat(begin, F.lit("\n\n... [TRUNCATED: "), (F.length(text) - size).cast("string"), F.lit(" characters omitted] ...\n\n"), end)
    return F.when(F.length(text) > most, cut).otherwise(text)


def magic_numbers(text: Column) -> Column:
    return F.regexp_count(text, F.lit(MAGIC))


def imports(text: Column, language: Column) -> Column:
    """The distinct modules that a text imports, sorted."""
    low = F.lower(language)
    py = F.array_union(F.regexp_extract_all(text, F.lit(r"(?m)^\s*from\s+([\w.]+)\s+import"), 1), F.regexp_extract_all(text, F.lit(r"(?m)^\s*import\s+([\w.]+)"), 1))
    js = F.array_union(
        F.regexp_extract_all(text, F.lit(r"import\s+.*?\s+from\s+['\"]([^'\"]+)['\"]"), 1), F.regexp_extract_all(text, F.lit(r"require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)"), 1)
    )
    none = F.array().cast("array<string>")
    return F.sort_array(F.when(low == "python", py).when(low.isin("javascript", "typescript", "js", "ts"), js).otherwise(none))


def imports_file(imported: Column, path: Column) -> Column:
    """Whether one of the imported modules names the file."""
    from codestrata.functions import paths

    module, base = paths.module_path(path), paths.stem(path)
    hit = lambda i: (
        ((module != "") & ((i == module) | i.endswith(F.concat(F.lit("."), module)) | module.endswith(F.concat(F.lit("."), i))))
        | ((base != "") & ((i == base) | i.endswith(F.concat(F.lit("/"), base)) | i.endswith(F.concat(F.lit("."), base))))
    )
    return F.coalesce(F.exists(imported, hit), F.lit(False))


def embedding_text(path: Column, name: Column, kind: Column, doc: Column, content: Column) -> Column:
    line = lambda label, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{label}: "), c))
    return F.concat_ws("\n", line("File", path), line("Name", name), line("Type", kind), line("Description", doc), content)
