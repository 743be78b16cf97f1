"""Functions and calls of JavaScript and TypeScript, read token by token."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

from codestrata.functions import entries

_SKIP = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.S)
_FUNCTION = re.compile(
    r"(?P<export>\bexport\s+(?:default\s+)?)?(?:\basync\s+)?(?:\bfunction\b\s*\*?\s*(?P<plain>[A-Za-z_$][\w$]*)\s*(?:<[^<>()]*>)?\s*\(|\b(?:const|let|var)\s+(?P<bound>[A-Za-z_$][\w$]*)\s*(?::[^=;\n]+)?=\s*"
    r"(?:async\s+)?(?:function\b\s*\*?\s*[\w$]*\s*\(|(?:<[^<>()]*>\s*)?\([^()]*\)\s*(?::[^=;{}\n]+)?=>|[A-Za-z_$][\w$]*\s*=>)|"
    r"^[ \t]*(?:(?:static|async|get|set|public|private|protected|override)\s+)*\*?(?P<method>[A-Za-z_$][\w$]*)\s*(?:<[^<>()]*>)?\([^()]*\)\s*(?::[^={};\n]+)?(?=\{))",
    re.M,
)
_KEYWORDS = {"if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "new", "super", "constructor", "import", "require", "with", "do", "else", "delete", "void", "in", "of", "async"}
_CALL = re.compile(r"(?:\b(?P<new>new)\s+)?(?<![\w$])(?:[\w$]+\??\.)*(?P<name>[A-Za-z_$][\w$]*)\s*(?:<[^<>()]*>)?\(|<(?P<tag>[A-Z][\w$]*)(?=[\s/>])")
_ARGUMENT = re.compile(r"[(,]\s*([A-Za-z_$][\w$]*)\s*(?=[,)])")
_EXPORTS = re.compile(r"\bexport\s*\{([^{}]*)\}|\bmodule\.exports\s*=\s*\{([^{}]*)\}|\b(?:export\s+default|module\.exports\s*=)\s+(?:[\w$.]+\()?\s*([A-Za-z_$][\w$]*)\s*\)?\s*(?:;|$)|\bexports\.([A-Za-z_$][\w$]*)\s*=", re.M)


def blanked(code: str) -> str:
    """The code with strings and comments as spaces, so that offsets and lines stay."""
    return _SKIP.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), code)


def _braces(code: str) -> tuple[dict[int, int], list[int]]:
    """(where each open brace closes, offsets at which the depth is zero again): one pass with a stack."""
    ends: dict[int, int] = {}
    stack: list[int] = []
    for m in re.finditer(r"[{}]", code):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            ends[stack.pop()] = m.start()
    tops, done = [], -1
    for a in sorted(ends):
        if a > done:
            tops.append(a)
            done = ends[a]
    return ends, tops


def script_symbols(path: str, text: str, first: int = 1) -> Iterator[tuple]:
    """(kind, path, name, line_start, line_end, is_entry): functions, calls, and marks of what is called or passed outside of functions; ``first`` is the file's line where the text begins."""
    code = blanked(text)
    breaks = [m.start() for m in re.finditer("\n", code)]
    line = lambda at: bisect_right(breaks, at - 1) + first
    ends, tops = _braces(code)
    exported = {w.split(" as ")[0].split(":")[0].strip() for m in _EXPORTS.finditer(code) for g in m.groups() if g for w in g.split(",")}
    defined: set[int] = set()
    for m in _FUNCTION.finditer(code):
        name = m["plain"] or m["bound"] or m["method"]
        if not name or name in _KEYWORDS:
            continue
        defined.add(m.start("plain") if m["plain"] else m.start("bound") if m["bound"] else m.start("method"))
        brace = code.find("{", m.end())
        stop = code.find("\n", m.end())
        bare = m["bound"] and not code[m.end() :].lstrip().startswith("{") and code[: m.end()].endswith("=>")  # an arrow without a block
        end = (stop if stop >= 0 else len(code)) if bare or brace < 0 else ends.get(brace, len(code))
        yield "function", path, name, line(m.start() + len(m[0]) - len(m[0].lstrip())), line(end), entries.script_entry(path, name, bool(m["export"]) or name in exported)

    def outside(at: int) -> bool:
        k = bisect_right(tops, at) - 1
        return k < 0 or at > ends[tops[k]]

    for m in _CALL.finditer(code):
        name, at = m["name"] or m["tag"], m.start("name") if m["name"] else m.start("tag")
        if name in _KEYWORDS or at in defined:
            continue
        yield "call", path, name, line(at), line(at), False
        if m["new"] or outside(at):
            yield "mark", path, name, line(at), line(at), True
    for m in _ARGUMENT.finditer(code):
        yield "mark", path, m[1], line(m.start(1)), line(m.start(1)), True
