"""Files cut into chunks by a line state machine."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from codestrata.session import ship

MOST, OVERLAP = 8_000, 200
_PY = re.compile(r"^(\s*)(?:async\s+)?(def|class)\s+(\w+)")
_JS = re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\s*\*?\s*(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>|class\s+(\w+))")
NAMES = ["file_path", "chunk_type", "name", "parent_name", "line_start", "line_end", "content"]


def sections(text: str, stem: str) -> Iterator[tuple]:
    """A text as one module, or as parts at blank lines with some overlap."""
    if len(text) <= MOST:
        yield "module", stem, None, 1, text.count("\n") + 1, text
        return
    at, part = 0, 1
    while at < len(text):
        end = min(len(text), at + MOST)
        if end < len(text):
            cut = text.rfind("\n\n", at + MOST // 2, end)
            end = cut if cut > 0 else end
        yield "module", f"{stem}_part{part}", None, text.count("\n", 0, at) + 1, text.count("\n", 0, end) + 1, text[at:end]
        if end >= len(text):
            return
        at, part = max(end - OVERLAP, at + 1), part + 1


def chunks(path: str, text: str) -> Iterator[tuple]:
    """(type, name, parent, first line, last line, content) of the functions and methods of a file, else its sections."""
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    lines = text.split("\n")
    ending = path.rsplit(".", 1)[-1].lower()
    found: list[tuple[int, int, str, str, str | None]] = []
    if ending in ("py", "pyi"):
        holders: list[tuple[int, str]] = []
        opened: list[tuple[int, int, str, str | None]] = []
        for i, line in enumerate(lines):
            m = _PY.match(line)
            if line.strip() and not line.lstrip().startswith("#"):
                indent = len(line) - len(line.lstrip())
                while opened and indent <= opened[-1][0] and not line.lstrip().startswith((")", "]", "}")):
                    _, start, name, parent = opened.pop()
                    found.append((start, i - 1, "method" if parent else "function", name, parent))
                while holders and indent <= holders[-1][0]:
                    holders.pop()
            if m:
                indent = len(m[1])
                if m[2] == "class":
                    holders.append((indent, m[3]))
                else:
                    opened.append((indent, i, m[3], holders[-1][1] if holders else None))
        while opened:
            _, start, name, parent = opened.pop()
            found.append((start, len(lines) - 1, "method" if parent else "function", name, parent))
    elif ending in ("js", "jsx", "ts", "tsx", "mjs", "cjs"):
        depth, start = 0, None
        for i, line in enumerate(lines):
            m = _JS.match(line) if depth == 0 else None
            if m and not m[3]:
                start = (i, m[1] or m[2])
            depth = max(0, depth + line.count("{") - line.count("}"))
            if start and depth == 0 and ("}" in line or i > start[0] or line.rstrip().endswith(";")):
                found.append((start[0], i, "function", start[1], None))
                start = None
    if not found:
        yield from sections(text, stem)
    for a, b, kind, name, parent in sorted(found):
        while b > a and not lines[b].strip():
            b -= 1
        yield kind, name, parent, a + 1, b + 1, "\n".join(lines[a : b + 1])


def chunk_files(files: DataFrame) -> DataFrame:
    """One row per chunk of ``(file_path, content)``; null texts have none."""
    ship(files.sparkSession)
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *c) for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if p and t for c in chunks(p, t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=NAMES)

    return files.select("file_path", "content").mapInArrow(run, "file_path string, chunk_type string, name string, parent_name string, line_start int, line_end int, content string")
