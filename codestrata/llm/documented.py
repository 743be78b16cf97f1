"""Problem 2: functions paired with their documentation.

Method: recursive patterns of the ``regex`` library capture the signature
behind a comment, a stack finds the end of a body in braces. Strings and
comments are tokens of both, so brackets and definitions inside them count for
nothing. A quick scan finds the comments and strings of a text and the places
where a definition may stand; the recursive patterns run only there. Their runs
give nothing back where that could not help, lest long texts take for ever; what
takes long all the same is logged and matched to its end. Pairs whose
documentation is trivial are dropped.
"""

from __future__ import annotations

import logging
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.session import ship, spread

_log = logging.getLogger(__name__)

# File endings of each language, and other names of a language.
ENDINGS = {
    "py": "python", "pyi": "python", "go": "go", "java": "java", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "tsx": "typescript", "rb": "ruby", "rs": "rust",
}
ALIASES = {"js": "javascript", "ts": "typescript", "py": "python", "golang": "go", "rb": "ruby", "rs": "rust"}
LANGUAGES = ("python", "go", "java", "javascript", "typescript", "ruby", "rust")

# Tokens: one alternation per family; group "c" is a comment, anything else a string.
_QUOTED = r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\''
_SLASHED = r"(?P<c>//[^\n]*|/\*(?s:.*?)\*/)"
_TOKENS = {
    "python": r'(?P<c>\#[^\n]*)|"""(?s:(?:[^\\]|\\.)*?)(?:"""|\Z)|\'\'\'(?s:(?:[^\\]|\\.)*?)(?:\'\'\'|\Z)|' + _QUOTED,
    "ruby": r"(?P<c>\#[^\n]*|^=begin\b(?s:.*?)^=end[^\n]*)|" + r"<<[~-]?(['\"]?)([A-Z_]\w*)\2[^\n]*\n(?s:.*?)^[ \t]*\3$|" + _QUOTED,
    "go": _SLASHED + r'|`[^`]*(?:`|\Z)|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)+\'',
    "java": _SLASHED + r'|"""(?s:(?:[^\\]|\\.)*?)(?:"""|\Z)|' + _QUOTED,
    "javascript": _SLASHED + r"|`(?s:(?:[^`\\]|\\.)*)(?:`|\Z)|" + _QUOTED,
    "rust": _SLASHED + r'|\br(\#*)"(?s:.*?)"\2|"(?s:(?:[^"\\]|\\.)*)(?:"|\Z)|\'(?:[^\'\\\n]|\\.[^\'\n]*)\'',
}
_TOKENS["typescript"] = _TOKENS["javascript"]
TOKENS = {k: re.compile(v, re.M) for k, v in _TOKENS.items()}

# Recursive pieces: brackets balance around strings and comments.
_STRING = r"""(?:"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\.)*+`)"""
_LIFE = r"""(?:"(?:[^"\\]|\\.)*+"|'(?:[^'\\\n]|\\[^\n])'|'\w++(?!'))"""
_NOTE = r"(?://[^\n]*+|/\*(?s:.*?)\*/)"


def _balanced(string: str, note: str) -> str:
    inner = r"(?:[^()\[\]{}\"'`/#]++|" + string + "|" + note + r"|(?&round)|(?&square)|(?&curly)|[/#])*+"
    return rf"(?(DEFINE)(?P<round>\({inner}\))(?P<square>\[{inner}\])(?P<curly>\{{{inner}\}}))"


_C = _balanced(_STRING, _NOTE)
_R = _balanced(_LIFE, _NOTE)
_P = _balanced(r"""(?:[rRbBuUfF]{0,2}(?:\"\"\"(?s:.*?)\"\"\"|'''(?s:.*?)'''|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'))""", r"(?:\#[^\n]*+)")
_GAP = r"[ \t]*+\n[ \t]*+"
_AT = r"(?:@[\w.]++(?:[ \t]*+(?&round))?(?:[ \t]*+//[^\n]*+)?\s*+)*+"
# The same for bodies, where a recursive pattern grows slower with every bracket: a stack over these marks; a quote that no string begins with closes nothing.
_BRACE = re.compile(r"\s*+\{")
_CLOSING = {"(": ")", "[": "]", "{": "}"}
_MARKS = {k: re.compile(f"{_LIFE if k == 'rust' else _STRING}|{_NOTE}|" + r"[()\[\]{}\"'`]") for k in ("go", "java", "javascript", "typescript", "rust")}
_WORD = r"(?!(?:if|for|while|switch|catch|return|throw|new|else|do|try|with|await|yield|typeof|delete|super|synchronized|assert|case|match|loop|function|import)\b)"

_SIGNATURES = {
    "go": r"(?P<sig>func[ \t]+(?:(?&round)[ \t]*)?(?P<name>[^\W\d]\w*)[ \t]*(?&square)?(?&round)[^\n{}]*+(?:(?&curly)[^\n{}]*+)??)(?=[ \t]*\{|[ \t]*(?://[^\n]*)?$)",
    "java": _AT
    + r"(?P<sig>(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)\s+)*+(?:<[^<>]*+(?:<[^<>]*+>[^<>]*+)*+>\s*+)?"
    + _WORD
    + r"(?:[\w.$]++(?:\s*+<(?>[^(){};=]*>))?(?:\s*+\[\s*+\])*+\s++)?"
    + _WORD
    + r"(?P<name>[A-Za-z_$][\w$]*+)\s*+(?&round)(?:\s*+throws(?:\s++[\w.,$]++)++)?)(?=\s*+[{;])",
    "rust": r"(?:\#!?(?&square)\s*+|//[^\n]*+\n\s*+)*+"
    + r"(?P<sig>(?:pub(?:\s*+(?&round))?\s++)?(?:(?:default|const|async|unsafe|extern(?:\s++\"[^\"]*+\")?)\s++)*+fn\s++(?P<name>[^\W\d]\w*+)\s*+(?:<(?:[^<>()]|->|(?&round)|<(?:[^<>]|<[^<>]*>)*>)*>)?\s*+(?&round)[^{};]*+)(?=[{;])",
}
_ARROW = r"(?:[^;{}=]++|=(?!>))*+"  # up to an arrow
_TYPED = r"(?:\s*+:" + _ARROW + r"(?:(?&curly)" + _ARROW + r")?)?"
_JS = (
    _AT
    + r"(?P<sig>(?:export\s++)?(?:default\s++)?(?:declare\s++)?(?:(?:public|private|protected|static|readonly|abstract|override|async|get|set)\s+(?=[\w$#*\[]))*+"
    + r"(?:(?:async\s++)?function\s*+\*?\s*+(?P<name>[\w$]++)\s*+(?:<(?>[^()]*>))?\s*+(?&round)(?:\s*+:[^;{}=]*+(?:(?&curly)[^;{}=]*+)?)?(?=\s*+[{;])"
    + r"|(?:(?:const|let|var)\s++)?(?P<name>[\w$]++)\s*+(?::[^=;]*+)?=\s*+(?:async\s*+)?(?:function\b\s*+\*?\s*+[\w$]*+\s*+(?&round)(?=\s*+[:{])|(?:(?:(?&round)|[\w$]++)"
    + _TYPED
    + r"|<[^()]*?>\s*+(?:(?&round)"
    + _TYPED
    + r"|[\w$]++))\s*+=>)"
    + r"|"
    + _WORD
    + r"\*?\s*+(?P<name>[\w$#]++)\s*+\??(?:<(?>[^()]*>))?\s*+(?&round)(?:\s*+:[^;{}=]*+(?:(?&curly)[^;{}=]*+)?)?(?=\s*+\{)))"
)
_SIGNATURES["javascript"] = _SIGNATURES["typescript"] = _JS

PAIRS = {k: regex.compile((_R if k == "rust" else _C) + _GAP + v, regex.M) for k, v in _SIGNATURES.items()}
PAIRS["ruby"] = regex.compile(
    _P + _GAP + r"(?P<sig>(?:(?:private|public|protected|module_function|memoize)\s+)?def[ \t]+(?:(?:self|[A-Z]\w*)\.)?(?P<name>[^\W\d]\w*[?!=]?|[+\-*/%<>=!~\[\]|&^]+)[ \t]*(?&round)?[^\n]*)"
    r"(?P<body>\n(?:(?P<in>[ \t]*+)(?!end\b)[^\n]*+\n)*?(?P=in)?[ \t]*end\b)?",
    regex.M,
)
_DOC = r"""(?P<doc>[rRuU]?(?:\"\"\"(?s:(?:[^\\]|\\.)*?)\"\"\"|'''(?s:(?:[^\\]|\\.)*?)'''|"(?:[^"\\\n]|\\.)+"|'(?:[^'\\\n]|\\.)+'))(?=[ \t]*(?:\#[^\n]*|;[^\n]*)?(?:\n|\Z))"""
PAIRS["python"] = regex.compile(
    _P + r"(?P<in>[ \t]*)(?P<sig>(?:async[ \t]+)?def[ \t]+(?P<name>[^\W\d]\w*)[ \t]*(?&square)?(?&round)(?:\s*+->\s*+(?:[^:\n\[\"'(]++|(?&square)|(?&round)|\"[^\"\n]*\"|'[^'\n]*')++)?[ \t]*:)"
    r"(?:[ \t]*+(?:\#[^\n]*+)?\n)*+[ \t]*+" + _DOC + r"(?P<body>(?:[^\n]*+(?:\n(?:[ \t]*+\n)*+(?P=in)[ \t]++(?=\S))?)*+)?",
    regex.M,
)
_PY_DEF = re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]", re.M)
# A line that may begin a definition after its annotations, per language: cheap, to spare the recursive patterns.
_MAYBE = {
    "go": re.compile(r"\s*func\b"),
    "ruby": re.compile(r"\s*(?:\w+\s+)?def\b"),
    "rust": re.compile(r"\s*(?:#!?\[|//|(?:pub\b|default\b|const\b|async\b|unsafe\b|extern\b|fn\b))"),
    "java": re.compile(r"\s*(?:@|[A-Za-z_$<][\w$<>\[\],.?& \t]*+\s*+\()"),
    "javascript": re.compile(r"\s*(?:@|[\w$#*<].*[(=])"),
}
_MAYBE["typescript"] = _MAYBE["javascript"]

# ---------------------------------------------------------------- trivial documentation

# Tags, directives and notes that are no description.
_TAG = re.compile(r"^\s*(?:[@\\][A-Za-z][\w-]*|:[a-z]+(?:\s+[^:\n]*)?:)(?=\W|$)")
_SECTION = re.compile(
    r"^\s*(?:args|arguments|parameters|params|keyword args|keyword arguments|other parameters|attributes|returns?|yields?|raises|throws|except(?:ion)?s|warns|examples?|usage|notes?|see also|references|errors|panics|safety|todos?)\s*:?\s*$",
    re.I,
)
_HEADED = re.compile(r"^\s*\#+\s*(?:arguments|parameters|returns?|examples?|panics|errors|safety)\s*$", re.I)
_TODO = re.compile(r"(?:^|(?<=[\s(\[]))(?:@?todo|fixme|xxx|hack|tbd|wip)\b(?:\s*\([^)]*\))?\s*[:\-]?.*$", re.I)
_TODO_LOUD = re.compile(r"(?:^|(?<=[\s(\[.;,]))(?:TODO|FIXME|XXX|HACK|TBD)\b.*$")
_DIRECTIVE = re.compile(
    r"^\s*(?:eslint\b|eslint-|tslint:|jshint\b|jslint\b|prettier-|biome-|@ts-|ts-|noqa\b|type:\s*ignore|mypy:|pylint:|pyright:|ruff:|flake8:|isort:|fmt:|yapf:|black:|pragma\b|nosec\b|nolint\b|go:\w|\+build\b|line\s+\d|export\s+\w+$|"
    r"rubocop:|frozen_string_literal:|encoding:|coding:|-\*-|typed:\s*\w+$|nosonar\b|noinspection\b|checkstyle\b|spotless:|@formatter:|istanbul\b|c8\b|v8\b|coverage:|webpack\w*:|sourcemappingurl=|clippy::|rustfmt::|cspell:|spell-?checker:|language=|codeql\b|lgtm\b|sonar-?\w*:|shellcheck\b|nosemgrep\b|swiftlint:|"
    r"#?region\b|#?endregion\b|vim:|emacs:|@flow\b|@jsx\b|@generated\b|generated by\b|do not edit\b|kics-|checkov:|deno-lint-|oxlint-|stylelint-|standard\b\s*$|snyk\b|skipcq\b|yardoc\b|steep:|sorbet\b|brakeman:|reek:|simplecov\b|:nocov:|:nodoc:|#\[|#!\[|@\w+\s*(?:\([^)]*\))?\s*$)",
    re.I,
)
_CODE = re.compile(
    r"(?:[;{}]|\)\s*:|=>|->)\s*$|^\s*[}\])]+[;,)]*\s*$|^\s*(?:#|//)|^\s*[\w$.\[\]\"'@*&<>, ]{1,80}?\s*(?:[-+*/|&:]?=|:=|<<)(?!=)\s*\S|\w\(\S*?\)[;,.]?\s*$|^\s*[\w$.]+\([^)]*\)?\s*(?:do\b.*|\{.*|[;.,)]*)$|"
    r"^\s*(?:if|elif|else|for|while|with|try|except|finally|return|raise|throw|assert|import|from|def|fn|func|function|const|let|var|class|async|await|yield|switch|case|match|catch|defer|go|unless|end|begin|rescue|ensure|new|delete|package|use|pub|public|private|protected|static)\b.*[(){}\[\]=;:<>|\"].*$|"
    r"^\s*(?:return|break|continue|pass|end|else|try|begin|raise|import|use)\s*[\w.]*\s*[;:]?\s*$|^\s*[\w.]+\.(?:each|map|select|forEach|iter)\b|\|\w+\|\s*$"
)
_WORDS = re.compile(r"[^\W\d_](?:[\w]|['’](?=\w)|-(?=[^\W\d_]))*")
_DENSE = re.compile(r"[぀-ヿ㐀-鿿가-힯฀-๿]")
_LATER = re.compile(
    r"\b(?:document(?:ation|ed)?|docs?|docstring|description|descriptions|comment|comments|summary)\b.*\b(?:to be|later|pending|missing|here|goes|needed|required|follows?|soon|tbd|tba|written|added|not yet|coming|yet|someday|placeholder|owns|fill|wanted)\b|"
    r"\b(?:add|write|insert|fill|put|provide|needs?|missing|lacks?|no|without|describe|document|update|complete|supply|give)\b.*\b(?:documentation|docs?|docstring|description|comment|summary|explanation)\b|"
    r"\b(?:not (?:yet )?documented|undocumented|yet to be (?:documented|described|written)|to be (?:documented|described|written|filled|done|completed|added)|auto-?generated (?:\w+ )?stub|generated stub|placeholder|describe (?:this|me|the (?:function|method))|document (?:this|me|it)|lorem ipsum|coming soon|work in progress|goes here|fill (?:this|me) in)\b",
    re.I,
)
_ARTICLES = {"a", "an", "the"}
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_]+|\d+")


def description(doc: str) -> str:
    """What a documentation says, without marks, tags, notes, directives and code."""
    kept: list[str] = []
    tagged = fenced = False
    lines = doc.split("\n")
    for i, line in enumerate(lines):
        text = line.strip()
        if text.startswith("```") or text.startswith("~~~"):
            fenced = not fenced
            continue
        if fenced:
            continue
        if not text:
            if tagged and not any(_SECTION.match(x) for x in lines[:i]):
                tagged = False
            continue
        if re.fullmatch(r"[-=~*_#.+]{2,}", text):
            if kept and _SECTION.match(kept[-1] if i and lines[i - 1].strip() == kept[-1].strip() else ""):
                tagged = True
            continue
        if _DIRECTIVE.match(text):
            continue
        if _TAG.match(text) or _SECTION.match(text) or _HEADED.match(text):
            tagged = True
            continue
        if tagged:
            continue
        if text.startswith(">>>") or _CODE.search(text):
            continue
        kept.append(text)
    said = "\n".join(kept)
    said = "\n".join(_TODO_LOUD.sub("", re.sub(r"^\s*(?:@?todo|fixme|xxx|hack|tbd)\b.*$", "", x, flags=re.I)) for x in said.split("\n"))
    said = re.sub(r"\{@\w+[^{}]*\}|</?\w+[^<>]*>", " ", said)
    return re.sub(r"\s+", " ", said).strip()


def is_trivial(doc: str, name: str) -> bool:
    """Fewer than five words, only the name's words and articles, or a promise to document later."""
    said = description(doc)
    words = _WORDS.findall(said)
    dense = len(_DENSE.findall(said))
    if len(words) + dense // 2 < 5:
        return True
    parts = {p.lower() for p in _PARTS.findall(name)}
    if all(w.lower() in parts or w.lower() in _ARTICLES for w in words):
        return True
    if len(words) <= 14 and _LATER.search(said):
        rest = [w for w in words if w.lower() not in parts]
        return len(rest) <= 14
    return False


def _bare(comment: str) -> str:
    """A comment without its marks."""
    if comment.startswith("/*"):
        body = re.sub(r"^/\*+!?|\*+/$", "", comment)
        return re.sub(r"^[ \t]*\*(?!\*)[ \t]?", "", body, flags=re.M)
    if comment.startswith("=begin"):
        return re.sub(r"^=(?:begin|end)[^\n]*", "", comment, flags=re.M)
    return re.sub(r"^[ \t]*(?://[/!]?|#(?!\[))[ \t]?", "", comment, flags=re.M)


def _docstring(literal: str) -> str:
    return re.sub(r"^[rRuU]?(\"\"\"|'''|\"|')|(\"\"\"|'''|\"|')$", "", literal)


#: Seconds after which a definition is called slow.
PATIENCE = 30.0


def _match(pattern: regex.Pattern, text: str, at: int, late: list[int] | None = None) -> regex.Match | None:
    """The definition at a place, if it is found within ``PATIENCE``; a place that takes longer is added to ``late``."""
    try:
        return pattern.match(text, at, timeout=PATIENCE)
    except TimeoutError:
        if late is not None:
            late.append(at)
        return None


def _definition(pattern: regex.Pattern, text: str, at: int) -> regex.Match | None:
    """The definition at a place, or none where there is none: a slow one is logged and matched to its end."""
    late: list[int] = []
    m = _match(pattern, text, at, late)
    if late:
        _log.warning("a definition at character %d of a text of %d takes more than %s seconds", at, len(text), PATIENCE)
        m = pattern.match(text, at)
    return m


def _without_open_notes(text: str) -> str:
    """The text with ``/+`` for each ``/*`` that nothing closes, which begins no comment: else each is sought an end in all the rest."""
    last = max(text.rfind("*/"), 0)
    return text[:last] + text[last:].replace("/*", "/+")


def _body_end(marks: re.Pattern, text: str, at: int) -> int:
    """Where the balanced body ends that begins at a place; the place itself if there is none."""
    if not _BRACE.match(text, at):
        return at
    open_: list[str] = []
    for m in marks.finditer(text, at):
        mark = m[0]
        if mark in _CLOSING:
            open_.append(_CLOSING[mark])
        elif mark in ")]}":
            if open_.pop() != mark:
                return at
            if not open_:
                return m.end()
        elif len(mark) == 1:
            return at
    return at


def pairs_of(text: str, language: str, bodies: bool = True) -> Iterator[tuple[str, str, str]]:
    """(name, code, documentation) of each documented definition; trivial ones too. Without ``bodies`` code may be the signature alone."""
    shape = text if language in ("python", "ruby") else _without_open_notes(text)
    tokens = list(TOKENS[language].finditer(shape))
    if language == "python":
        starts = [t.start() for t in tokens]
        for d in _PY_DEF.finditer(text):
            at = bisect_right(starts, d.start()) - 1
            if at >= 0 and tokens[at].end() > d.start() and tokens[at].start() < d.start():
                continue
            m = _definition(PAIRS["python"], text, d.start())
            if m:
                yield m["name"], (m["sig"] + (m["body"] or "")), _docstring(m["doc"])
        return
    at = 0
    maybe, pattern = _MAYBE[language], PAIRS[language]
    while at < len(tokens):
        t = tokens[at]
        at += 1
        if t["c"] is None:
            continue
        line = text.rfind("\n", 0, t.start()) + 1
        if text[line : t.start()].strip():
            continue
        start, end = t.start(), t.end()
        if not t["c"].startswith(("/*", "=begin")):  # following whole-line comments belong to it
            while at < len(tokens) and tokens[at]["c"] is not None and not tokens[at]["c"].startswith(("/*", "=begin")):
                gap = text[end : tokens[at].start()]
                if gap.count("\n") != 1 or gap.strip():
                    break
                end = tokens[at].end()
                at += 1
        if text[end : end + 1] != "\n" and text[end:].split("\n", 1)[0].strip():
            continue
        if not maybe.match(shape, end):
            continue
        m = _definition(pattern, shape, end)
        if m and language == "ruby":
            yield m["name"], m["sig"] + (m["body"] or ""), _bare(text[start:end])
        elif m:
            stop = _body_end(_MARKS[language], shape, m.end("sig")) if bodies else m.end("sig")
            yield m["name"].lstrip("#"), text[m.start("sig") : stop], _bare(text[start:end])


def language_of(language: str | None, path: str | None, text: str) -> str | None:
    """The language by its name, else by the file's ending, else by the shape of the text."""
    got = ALIASES.get(language.strip().lower(), language.strip().lower()) if language else None
    if got in LANGUAGES:
        return got
    end = path.rsplit(".", 1)[-1].strip().lower() if path and "." in path else ""
    if end in ENDINGS:  # a label of no known language, such as a dialect's, does not speak against the path
        return ENDINGS[end]
    if got or end:
        return None
    for guess, shape in (("python", r"^\s*(?:async )?def \w+\([^)]*\).*:\s*$"), ("go", r"^func "), ("rust", r"^\s*(?:pub )?fn \w+"), ("java", r"^\s*(?:public|private|protected) "), ("ruby", r"^\s*def \w+"), ("typescript", r"\bfunction\b|=>")):
        if re.search(shape, text, re.M):
            return guess
    return None


def _extract(bodies: bool):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for i, path, language, text in zip(*(batch.column(c).to_pylist() for c in range(4))):
                lang = language_of(language, path, text)
                if lang is None:
                    continue
                for name, code, doc in pairs_of(text.replace("\r\n", "\n"), lang, bodies):
                    if not is_trivial(doc, name):
                        out[0].append(i)
                        out[1].append(name)
                        if bodies:
                            out[2].append(code)
                            out[3].append(doc)
            empty = [] if bodies else [None] * len(out[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2] or empty, pa.string()), pa.array(out[3] or empty, pa.string())],
                names=["id", "function_name", "code", "documentation"],
            )

    return extract


def documented_functions(df: DataFrame, id_col: str = "chunk_id", text_col: str = "content", path_col: str = "file_path", language_col: str = "language", bodies: bool = True) -> DataFrame:
    """``(id, function_name, code, documentation)``: one row per documented function.

    Rows with a null id or text, or of no known programming language, give
    none; a null or unknown language is read from the path. Repeated rows count once, and
    so do equal pairs of one id. Empty and very long texts are read whole.
    Without ``bodies`` the last two columns are null. Only the named columns
    are read.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(path_col).alias("path"), F.col(language_col).alias("language"), F.col(text_col).alias("text"))
    rows = spread(rows.where(F.col("id").isNotNull() & (F.length("text") > 0)))
    found = rows.mapInArrow(_extract(bodies), "id long, function_name string, code string, documentation string")
    return found.distinct()
