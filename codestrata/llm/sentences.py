"""Problem 10: sentence boundaries across languages and scripts.

Method: characters are tagged as boundary or inside by a linear-chain model
with Viterbi decoding. A text falls into blocks (paragraphs, headings, list
items); inside a block only places after closing punctuation, and spaces in
scripts that end sentences without a mark, can be boundaries. Each place has
features of its mark and neighbours, of the words beside it (how often blocks
begin with them, how often their dot ends a block) and, where there are no
marks, of the characters that end and begin blocks. They may depend on the tag
of the place before: whether a quotation leads the sentence, how much has been
said since. The chain's weights are trained for all scripts on texts whose
block edges were stripped, so that the edge is known to be a boundary without
its layout, and on places whose marks leave no doubt; what is in doubt stays
hidden and is summed over. Weights start from prior log-odds of the cases. The
word and character statistics come from all documents.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codestrata.session import ship, spread

#: Learnt entries of one kind and script that travel to the tasks, the most frequent ones; each seen at least MIN_COUNT times.
MOST_ENTRIES, MIN_COUNT = 50_000, 2
#: Texts that the chain's weights are trained on, about so many at most.
SAMPLE = 4_000

# Abbreviations after which a sentence goes on.
GOES_ON = set(
    """dr mr mrs ms prof st sr sra srta sres hr hrn fr frl mme mlle mm messrs rev gen col capt lt sgt gov sen rep hon
    fig figs sec secs sect secc abschn kap nr nrn no nos num núm núms pág págs pag vol vols ver vers ed eds art arts cf vgl ca approx aprox env circa
    ee e.g i.e eg ie vs viz p pp l z.b d.h u.a s.o s.u p.ej p.ex c.-à-d bzw max min ex ej inkl exkl zzgl ggf evtl sog
    стр рис табл гл разд пункт п пп см ср напр прим т.е т.к т.н г ул им проф акад д-р тыс млн млрд руб
    पृ डॉ श्री सं क्र ص د م ج أ v ch chap eq eqs ref refs tab abb bd jh hrsg dept univ mt ft jan feb mar apr jun jul aug sep sept oct nov dec""".split()
)
# Abbreviations that may also end a sentence.
MAY_END = set("etc inc ltd co corp llc plc al usw usf jr sr.jr p.m a.m pm am uu ee.uu u.s u.k e.u u.n т.д т.п др т.д إلخ الخ ff bros approx.in sec min hrs hr ea est ave blvd s.o u.a o.ä u.ä dgl".split())
_UNITS = {"sec", "min", "hr", "hrs", "max", "approx"}
_MEASURES = {"ms", "s", "с", "мс", "h", "m", "g", "l", "t", "kg", "km", "cm", "mm", "mb", "gb", "kb", "tb", "px", "hz", "khz", "mhz", "ghz", "v", "w", "kw"}
_ARTICLES = {"der", "die", "das", "dem", "den", "des", "am", "vom", "zum", "im", "beim", "zur", "ein", "eine", "einem", "einen", "einer", "jeder", "jedem", "jeden", "diesem", "dieser"}

_ENDERS = "。．｡！？!?.…।॥؟۔‼⁇⁈⁉܀።፧"
_CLOSERS = "\"'”’»›」』）)]}】〉》〕｣＂“‘"
_OPENERS = "\"'“‘«‹「『（([{【〈《〔｢„‚¿¡＂"
_BRACKETS = re.compile("[\"＂(){}\\[\\]（）「」『』【】〈〉《》〔〕｢｣«»‹›“”„‚‘’]")
_PAIR = {"(": ")", "[": "]", "{": "}", "（": "）", "「": "」", "『": "』", "【": "】", "〈": "〉", "《": "》", "〔": "〕", "｢": "｣", "«": "»", "‹": "›", "“": "”", "„": "“”", "‚": "‘’", "‘": "’"}
_QUOTES = set("\"“„«‹「『｢＂‘‚")
_LINE = re.compile(r"[^\r\n  \x0b\x0c\x85]*(?:\r\n|[\r\n  \x0b\x0c\x85]|$)")
_HEADING = re.compile(r"^\s*#{1,6}(?:\s|$)")
_BULLET = re.compile(r"^\s*(?:[-*+•‣◦▪–·●○]\s+|(\d{1,3})(?:[.)]|、|．)\s+|([a-zA-Z])\)\s+|\((\d{1,3}|[a-z])\)\s+)(?=\S)")
_OPAQUE = re.compile(r"`[^`\n]*(?:\n[^`\n]*)?`|(?:https?|ftp|file|ssh|git)://[^\s<>\"“”«»（）「」。，]+|www\.[^\s<>]+|[\w.+-]+@[\w-]+\.[\w.-]+")
_EMOJI = re.compile(r"(?:[\U0001F000-\U0001FAFF☀-➿⬀-⯿←-⇿⌀-⏿‼⁉〰〽️‍\U000E0020-\U000E007F]+)")
_MARKLESS = re.compile(r"[฀-๿຀-໿က-႟ក-៿ༀ-࿿]")
_MARKED_LETTER = re.compile(r"[^\W\d_]")
_DENSE = re.compile(r"[぀-ヿ㐀-鿿가-힯豈-﫿]")
_LETTER = r"[^\W\d_][̀-ͯऀ-ःऺ-ॏؐ-ًؚ-ٟ]*"
#: The word before a dot, with dots inside, and the abbreviated word before it.
_LAST = re.compile(rf"(?:(?<![\w.])(?P<v>(?:{_LETTER}){{1,4}}\.)\s)?(?<![\w.])(?P<w>(?:{_LETTER})+(?:\.-?(?:{_LETTER})+|-[^\W\d_]+)*)$")


def blocks(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, heading?) of each paragraph, heading and list item, without outer white space."""
    out: list[tuple[int, int, bool]] = []
    start = end = -1
    number = None

    def close(heading: bool = False) -> None:
        nonlocal start
        if start >= 0:
            out.append((start, end, heading))
        start = -1

    fresh, inside = True, False
    for m in _LINE.finditer(text):
        line = m[0]
        bare = line.strip()
        if not bare:
            if m.end() == m.start():
                break
            close()
            fresh = True
            continue
        a = m.start() + len(line) - len(line.lstrip())
        b = m.start() + len(line.rstrip())
        if _HEADING.match(line):
            close()
            start, end = a, b
            close(True)
            fresh = True
            continue
        item = _BULLET.match(line)
        if item and item[1]:
            n = int(item[1])
            listed = number is not None and n in (1, number + 1)
            first = n == 1 and not fresh and (text[end - 1] in ".!?:;。！？：" or inside) and text[start:end].split()[-1].lower() not in _ARTICLES
            if not (fresh or listed or first):  # else a number that a line break happens to precede
                item = None
            else:
                number = n
        if item:
            close()
        elif fresh:
            number = None
        inside = bool(item) or inside and not fresh  # in a list
        if start < 0:
            start = a
        end = b
        fresh = False
    close()
    return out


def _mask(block: str) -> list[tuple[int, int]]:
    """Stretches that hold no boundary: code, addresses, and balanced quotations and brackets."""
    return [(m.start(), m.end() - (0 if m[0][0] == "`" else len(m[0]) - len(m[0].rstrip(".,;:!?)…»”'\"")))) for m in _OPAQUE.finditer(block)]


def _nests(block: str, opaque: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(open, close) of outermost quotations and brackets that close in the block; one pass with a stack for each kind."""
    skip = bytearray(len(block))
    for a, b in opaque:
        skip[a:b] = b"\1" * (b - a)
    marks = [(m.start(), m[0]) for m in _BRACKETS.finditer(block) if not skip[m.start()]]
    close_of: dict[int, int] = {}
    stacks: dict[str, list[int]] = {c: [] for c in _PAIR}
    for at, c in marks:
        for opener, stack in stacks.items():
            if stack and c in _PAIR[opener] and c != opener:
                close_of[stack.pop()] = at
        if c in stacks:
            stacks[c].append(at)
    out: list[tuple[int, int]] = []
    done = -1
    for at, c in marks:
        if at <= done or c not in stacks and c not in "\"＂":
            continue
        before = block[at - 1] if at else " "
        if c in "\"＂":
            opens = at + 1 < len(block) and not block[at + 1].isspace() and (before.isspace() or before in "([{（「“«„:：，,、—–-/" or not before.isalnum() or _DENSE.match(before))
            done_at = block.find(c, at + 1) if opens else -1
        else:
            done_at = -1 if c == "‘" and before.isalnum() else close_of.get(at, -1)
        if done_at >= 0:
            out.append((at, done_at))
            done = done_at
    return out


def _lower_only(text: str) -> bool:
    return text.islower()


class Model:
    """Statistics of words and of block edges, and the chain's weights; nothing is per document."""

    def __init__(self, starts: dict[str, int], inner: dict[str, int], lefts: dict[str, tuple[int, int]], rights: dict[str, tuple[int, int]], dots: dict[str, tuple[int, int]] | None = None, weights: dict[str, float] | None = None) -> None:
        self.starts, self.inner, self.lefts, self.rights, self.dots, self.weights = starts, inner, lefts, rights, dots or {}, weights or {}

    def opens(self, word: str) -> bool:
        """Whether a word is known to begin blocks."""
        n = self.starts.get(word, 0)
        return n >= 3 and n * 60 >= self.inner.get(word, 0)

    def edge(self, table: dict[str, tuple[int, int]], grams: list[str]) -> float:
        """Log-odds of an edge against its rate by chance; each longer context is smoothed by the shorter one."""
        p = 0.04
        for g in reversed(grams):
            at, off = table.get(g, (0, 0))
            p = (at + 5 * p) / (at + off + 5)
        return math.log(p / (1 - p) / 0.04 + 1e-6)

    def ends(self, word: str) -> float:
        """Log-odds that the dot of a word ends a block rather than stands inside one."""
        at, off = self.dots.get(word, (0, 0))
        return math.log((at + 1) / (off + 1))


def _gram(s: str) -> str:
    return re.sub(r"[A-Za-z]", "a", re.sub(r"\d", "0", s))


def left_grams(s: str) -> list[str]:
    g = _gram(s[-12:])
    return [f"{n}{g[-n:]}" for n in (9, 6, 4, 3, 2, 1) if len(g) >= n]


def right_grams(s: str) -> list[str]:
    g = _gram(s[:12])
    return [f"{n}{g[:n]}" for n in (9, 7, 5, 4, 3, 2, 1) if len(g) >= n]


def _next_token(block: str, at: int) -> tuple[int, str]:
    """(position, token) of the first word after ``at``, past white space, emoji and opening marks."""
    n = len(block)
    while at < n:
        if block[at].isspace() or block[at] in _OPENERS:
            at += 1
            continue
        m = _EMOJI.match(block, at)
        if m:
            at = m.end()
            continue
        break
    end = at
    while end < n and not block[end].isspace():
        end += 1
    return at, block[at:end]


def _kind(c: str) -> str:
    """The class of a character as a neighbour of a mark."""
    if not c:
        return "none"
    if c.isupper():
        return "upper"
    if c.islower():
        return "lower"
    if c.isdigit():
        return "digit"
    if _DENSE.match(c):
        return "dense"
    if c.isalpha():
        return "letter"
    return "open" if c in _OPENERS else "close" if c in _CLOSERS else "mark" if c in _ENDERS else "space" if c.isspace() else "sign"


def _step(x: float) -> int:
    return max(-4, min(4, round(x)))


_STOPS, _STOPS_OR_SPACE = re.compile("[" + _ENDERS + "]"), re.compile("[" + _ENDERS + "]|\\s")


def _is_markless(block: str) -> bool:
    """Whether most letters are of scripts that end sentences without a mark."""
    return bool(_MARKLESS.search(block)) and len(_MARKLESS.findall(block)) * 3 > len(_MARKED_LETTER.findall(block))


class Place:
    """A place after which a sentence may end: its position and, under each tag of the place before, prior and features."""

    __slots__ = ("at", "after", "label")

    def __init__(self, at: int, after: tuple[tuple[float, list[str]], tuple[float, list[str]]], label: int | None) -> None:
        self.at, self.after, self.label = at, after, label  # after[0]: the place before is inside, after[1]: it is a boundary


def places(block: str, model: Model, low: bool) -> list[Place]:
    """The places of a block in order."""
    opaque = _mask(block)
    nests = _nests(block, opaque)
    skip = bytearray(len(block) + 1)
    for a, b in opaque:
        skip[a:b] = b"\1" * (b - a)
    for a, b in nests:
        skip[a + 1 : b] = b"\1" * (b - a - 1)
    closes = {b: a for a, b in nests}
    markless = _is_markless(block)
    stops = _STOPS_OR_SPACE if markless else _STOPS
    ends = sorted(closes)
    out: list[Place] = []
    sign = _BULLET.match(block) or re.match(r"#{1,6}\s+", block)
    n = len(block)
    i = sign.end() if sign else 0

    def first_visible(a: int) -> int:
        while a < n and (block[a].isspace() or _EMOJI.match(block, a)):
            a += 1
        m = _BULLET.match(block, a) if a == 0 else None
        return m.end() if m else a

    while i < n:
        c = block[i]
        if markless and c.isspace():
            j = i
            while j < n and block[j].isspace():
                j += 1
            lead = re.search(r"\S+$", block[max(0, i - 8) : i])
            if not skip[i] and i and j < n and not (lead and _EMOJI.fullmatch(lead[0])):
                left, right = model.edge(model.lefts, left_grams(block[:i])), model.edge(model.rights, right_grams(block[j:]))
                back = i - (out[-1].at if out else 0)
                own = ["space", f"left{_step(left)}", f"right{_step(right)}"]
                prior = left + right
                out.append(Place(i, ((prior, [*own, "space-inside"]), (prior, [*own, "space-near" if back < 20 else "space-far"])), 0 if prior < -4 else None))
            i = j
            continue
        nest = closes.get(i)
        inner_end = nest is not None and any(x in _ENDERS for x in block[max(nest + 1, i - 2) : i].rstrip()[-1:])
        if (skip[i] or c not in _ENDERS) and not inner_end:  # on to the next place there may be
            ahead = stops.search(block, i + 1)
            k = bisect_right(ends, i)
            i = min(ahead.start() if ahead else n, ends[k] if k < len(ends) else n)
            continue
        # the cluster of marks and closers
        j = i + 1
        while j < n and (block[j] in _ENDERS and not skip[j] or block[j] in _CLOSERS and closes.get(j) is None and block[j] not in "\"'“‘" and not skip[j]):
            j += 1
        if j < n and block[j] == "\xa0" or block[j : j + 1] == " " and j + 1 < n and block[j + 1] in "।॥":
            k = j + 1
            if k < n and block[k] in "।॥!?":
                j = k + 1
        if j >= n or not block[j:].strip():
            break
        marks, glued = block[i:j], not block[j].isspace()
        pos, token = _next_token(block, j)
        nxt = token[:1]
        word = re.match(r"[^\W\d_][\w'’]*", token)
        word_low = word[0].lower() if word else ""
        low_next = low and nxt.islower()  # in texts without capitals only cased letters tell nothing
        code = bool(re.search(r"[A-Za-z][_./-][A-Za-z_]|_|\(", token.rstrip(".,;:!?")))
        wide = any(x in "。．｡！？…।॥؟۔" for x in marks)
        dense_next = bool(_DENSE.match(nxt)) if nxt else False
        opens = model.opens(word_low)
        prev = block[i - 1] if i else " "
        last = ""

        def judge(begin: int) -> tuple[str, float]:
            """(case, prior log-odds) where the sentence at hand began at ``begin``."""
            nonlocal last
            if nest is not None:  # a closed quotation or bracket that held its own end
                led = first_visible(begin) >= nest
                if any(x in _ENDERS for x in marks[1:]):
                    return "nest-mark-after", 4.0
                if block[j] in ",，、;；:：—" or block[j : j + 2] in (" —", " –"):
                    return "nest-comma", -6.0
                if block[nest] not in _QUOTES:
                    return ("bracket-led", 5.0) if led else ("bracket-lower", -4.0) if not nxt.isupper() else ("bracket", -1.0)
                if led:
                    return ("quote-led-on", -6.0) if not nxt.isupper() or low else ("quote-led", 2.0)
                if nxt.islower() and not low:
                    return ("quote-code", 2.0) if opens and code else ("quote-lower", -6.0)
                said_before = re.search(r"[:：]\s*$", block[:nest])
                if low_next:
                    return ("quote-low-colon", 3.0) if said_before else ("quote-low", -6.0)
                if said_before:
                    return "quote-colon", 4.0
                if re.search(r"[,，]\s*$", block[:nest]) or nxt.isupper() or dense_next or not nxt.isalpha():
                    return "quote-new", 4.0
                return "quote-open", 2.0
            if marks[0] == "." and not marks.startswith(".."):
                found = _LAST.search(block[max(0, begin, i - 24) : i])
                m = found["w"] if found else ""
                abbr = last = m.lower()
                pair = (found["v"] + m).lower() if found and found["v"] else abbr
                single = len(m) == 1
                if pair in GOES_ON or pair in MAY_END:
                    abbr = last = pair
                if abbr in _MEASURES and m.islower() and not glued and re.search(r"\d\s+$", block[max(0, i - len(m) - 6) : i - len(m)]):
                    return ("measure", 4.0) if not nxt.islower() else ("measure-code", 2.0) if code or opens else ("measure-on", -3.0)
                if glued and marks == ".":
                    nx = block[j : j + 12]
                    if nx[:1].isupper() and re.match(r"[^\W\d_]{2,}|[^\W\d_]['’]|[A-ZÀ-Þ]\s", nx) and not prev.isupper() and not re.search(r"(?:^|[\s(])(?:[^\W\d_]\.)+$", block[max(0, i - 4) : j]) and abbr not in GOES_ON:
                        return "glued-upper", 3.0
                    if nx[:1] in "«„“¿¡(\"" and prev.isalnum() or _EMOJI.match(block, j):
                        return "glued-open", 2.0
                    if low and prev.isalnum() and len(word_low) > 1 and opens and model.starts[word_low] * 3 >= model.inner.get(word_low, 0) and re.match(r"[^\W\d_]+['’,:]?(?:\s|$)", token) and not re.search(r"[\w-]+\.[\w-]+$|^[\w]*[_-]", block[max(0, i - 30) : i].rsplit(None, 1)[-1]):
                        return "glued-low", 1.0
                    if _DENSE.match(block[j]) and prev.isalpha() and not _DENSE.match(prev):
                        return "glued-dense", -3.0
                    return "glued", -8.0
                if single and re.match(r"[^\W\d_]\.", token):
                    return "letters", -6.0
                if single and prev.isupper():
                    if abbr in MAY_END:
                        return ("initial-may", 3.0) if nxt.isupper() else ("initial-may-on", -6.0)
                    return ("initial", -6.0) if nxt.isupper() or nxt == "" or low else ("initial-on", -3.0)
                if abbr in _UNITS:
                    on = nxt.isdigit() or nxt.islower() and not (low and opens and model.starts[word_low] * 3 >= model.inner.get(word_low, 0))
                    return ("unit-on", -6.0) if on else ("unit", 3.0)
                if abbr in MAY_END:
                    if nxt.islower():
                        return ("may-end-low", 3.0) if (low or code) and opens and not (abbr in ("p.m", "a.m") and len(block[first_visible(begin) : i].strip()) < 14) else ("may-end-on", -6.0)
                    return ("may-end", 3.0) if nxt.isupper() or not nxt.isalpha() or opens else ("may-end-letter", -5.0)
                if abbr == "no":
                    return ("no-number", -6.0) if nxt.isdigit() else ("no", 4.0)
                if abbr in GOES_ON:
                    return "goes-on", -6.0
                if single and (low or m.islower() and not nxt.isupper()):
                    return "letter-on", -6.0
                if re.search(r"(?:^|\s)\d{1,3}$", block[max(0, i - 5) : i]) and _ordinal(block[begin:i]):
                    return "ordinal", -6.0
                if nxt.islower() and not low:
                    return ("lower-code", 3.0) if code or opens else ("lower", -3.0)
                return "dot", 5.0
            if "…" in marks or marks.startswith(".."):
                said = block[first_visible(begin) : i].strip()
                spaced = prev.isspace()
                few = len(said.split()) <= 1 and len(said) <= (4 if _DENSE.search(said) else 6)
                if any(x in "。．｡!?！？।؟" for x in marks):
                    return "ellipsis-mark", 4.0
                if nxt.islower() and not low:
                    return ("ellipsis-code", 2.0) if code and not spaced and not glued else ("ellipsis-lower", -6.0)
                if low_next:
                    return ("ellipsis-low", -6.0) if spaced or len(said.split()) <= 1 or not opens else ("ellipsis-low-new", 2.0)
                if few and not nxt.isupper() and nxt.isalpha():
                    return "ellipsis-few", -4.0
                return ("ellipsis-number", -2.0) if nxt.isdigit() and spaced else ("ellipsis", 4.0)
            # ! ? and the marks of other scripts
            if block[j : j + 2] in (" »", "\xa0»") and closes.get(j + 1) is not None:
                return "mark-before-close", -8.0
            if "．" in marks and prev.isdigit() and nxt.isdigit() and glued:
                return "wide-number", -8.0
            if block[j] in ",，、;；":
                return "mark-comma", -6.0
            if not wide and glued and not (nxt.isupper() or not nxt.isalnum()) and not dense_next:
                return ("mark-glued-low", 2.0) if low and opens else ("mark-glued", -6.0)
            if nxt.islower() and not low:
                return ("mark-code", 3.0) if code or opens and not wide else ("mark-lower", -4.0)
            return "mark", 6.0

        at = out[-1].at if out else 0
        wide = wide or bool(_DENSE.match(prev))
        kind = ("wide-" if wide else "") + _kind(nxt) + ("+" if glued else "")
        begins = math.log((model.starts.get(word_low, 0) + 1) / (model.inner.get(word_low, 0) + 1))
        own = [f"next-{kind}", f"prev-{_kind(prev)}", f"first-{marks[0]}", f"opens{int(opens)}-{kind}"]
        if nxt.islower():
            own.append(f"begins{_step(begins)}-{'low' if low else kind}")
        near, prior = judge(at)
        # inside: the sentence began at an earlier place, at least the one before the last
        far, prior_far = (near, prior) if not out or nest is None and marks[0] not in ".…" else judge(out[-2].at if len(out) > 1 else 0)
        if last:
            own += [f"dot{_step(model.ends(last))}", f"word{min(5, len(last))}"]
        said = len(block[at:i].split())
        back = f"said{1 if said <= 1 else 2 if said <= 3 else 3}"
        clear = nxt.isupper() and not glued or dense_next
        # where capitals tell; where they do not, a word that hardly ever begins a block goes on after a quotation, a pause or a short form
        goes_on = nxt.islower() and not code and not wide and (begins < -1 and near not in ("dot", "mark", "quote-low-colon") if low else not opens)
        label = 1 if clear and near == far and (near in ("mark", "quote-colon") or near == "dot" and len(last) > 4) else 0 if goes_on or near == far and near in _CERTAIN else None
        out.append(Place(j, ((prior_far, [far, *own, "inside-" + back]), (prior, [near, *own, "boundary-" + back])), label))
        i = j
    return out


#: Cases whose marks leave no doubt that the sentence goes on.
_CERTAIN = {"glued", "nest-comma", "goes-on", "letters", "mark-comma", "wide-number", "no-number", "mark-before-close"}


def _ordinal(said: str) -> bool:
    """Whether a number that a dot follows is an ordinal inside a German phrase."""
    words = said.split()
    return len(words) >= 2 and words[-2].lower().strip("(„«\"") in _ARTICLES


def potentials(found: list[Place], weights: dict[str, float]) -> list[tuple[float, float]]:
    """Log-odds of a boundary at each place, where the place before is inside and where it is a boundary."""
    get = weights.get
    return [tuple(prior + sum(get(f, 0.0) for f in fs) for prior, fs in p.after) for p in found]


def decode(scored: list[tuple[float, float]]) -> list[int]:
    """The most likely boundaries, by Viterbi: indexes of the places. The block's start is a boundary."""
    inside, boundary = -math.inf, 0.0
    back: list[tuple[bool, bool]] = []
    for after_inside, after_boundary in scored:
        from_boundary = boundary > inside, boundary + after_boundary >= inside + after_inside
        inside, boundary = max(inside, boundary), max(inside + after_inside, boundary + after_boundary)
        back.append(from_boundary)
    out, tag = [], boundary > inside
    for k in range(len(scored) - 1, -1, -1):
        if tag:
            out.append(k)
        tag = back[k][1 if tag else 0]
    return out[::-1]


def sentences(text: str, model: Model) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text, in order."""
    out: list[tuple[int, int]] = []
    low = _lower_only(text)
    for a, b, heading in blocks(text):
        block = text[a:b]
        at = 0
        found = places(block, model, low or _lower_only(block) and len(block) > 60)
        cuts = [found[k].at for k in decode(potentials(found, model.weights))]
        for cut in [*cuts, len(block)]:
            piece = block[at:cut]
            if piece.strip():
                start = a + at + len(piece) - len(piece.lstrip())
                end = a + at + len(piece.rstrip())
                if not re.search(r"\w", piece) and out and at and not _EMOJI.match(piece.strip()):
                    out[-1] = (out[-1][0], end)  # stray marks end the sentence before
                elif at and cut == len(block) and _EMOJI.fullmatch(re.sub(r"\s", "", piece)):
                    out[-1] = (out[-1][0], end)
                else:
                    out.append((start, end))
            at = cut
    return out


# ---------------------------------------------------------------- learning and running

_COUNTS = "kind string, gram string, hits long"


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    c: Counter = Counter()

    def flush() -> pa.RecordBatch:
        keys = list(c)
        got = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([c[k] for k in keys], pa.int64())], names=["kind", "gram", "hits"])
        c.clear()
        return got

    for batch in batches:
        for text in batch.column(0).to_pylist():
            for a, b, heading in blocks(text):
                block = text[a:b]
                m = _BULLET.match(block)
                body = block[m.end() :] if m else block
                if heading or not body:
                    continue
                if _is_markless(body):
                    if m or len(body) >= 25:
                        for g in right_grams(body):
                            c["start", g] += 1
                        for g in left_grams(body.rstrip()):
                            c["end", g] += 1
                    for s in re.finditer(r"\s+", body):
                        if s.start() and s.end() < len(body):
                            for g in left_grams(body[max(0, s.start() - 12) : s.start()]):
                                c["left", g] += 1
                            for g in right_grams(body[s.end() : s.end() + 12]):
                                c["right", g] += 1
                else:
                    words = re.findall(r"[^\W\d_][\w'’]*", body)
                    if words and re.match(r"[^\w]*[^\W\d_]", body):
                        c["word", words[0].lower()] += 1
                        for w in words[1:]:
                            if w[:1].islower():
                                c["inner", w.lower()] += 1
                    for s in _DOTTED.finditer(body):
                        c["dot-inside" if body[s.end() :].strip() else "dot-end", s[1].lower()] += 1
            if len(c) > 400_000:
                yield flush()
    if c:
        yield flush()


_DOTTED = re.compile(rf"(?<![\w.])((?:{_LETTER})+(?:\.(?:{_LETTER})+)*)\.(?=\s|$)")


def statistics(texts: DataFrame) -> Model:
    """The model of ``texts`` (column ``text``) without weights: counts over all documents; of each kind and script the most frequent entries are kept."""
    rows = texts.mapInArrow(_learn, _COUNTS).groupBy("kind", "gram").agg(F.sum("hits").alias("hits")).where(F.col("hits") >= MIN_COUNT)
    script = F.shiftright(F.ascii(F.regexp_replace("gram", r"^[0-9a\s]+", "")), 7)
    rank = F.row_number().over(W.partitionBy("kind", script).orderBy(F.desc("hits"), "gram"))
    kept = rows.withColumn("nth", rank).where(F.col("nth") <= MOST_ENTRIES).select("kind", "gram", "hits").toArrow()
    by: dict[str, dict[str, int]] = {k: {} for k in ("word", "inner", "start", "end", "left", "right", "dot-end", "dot-inside")}
    for k, g, n in zip(*(kept.column(i).to_pylist() for i in range(3))):
        by[k][g] = n
    both = lambda x, y: {g: (by[x].get(g, 0), by[y].get(g, 0)) for g in {*by[x], *by[y]}}
    return Model(by["word"], {w: n for w, n in by["inner"].items() if w in by["word"]}, both("end", "left"), both("start", "right"), both("dot-end", "dot-inside"))


def stripped(text: str) -> Iterator[tuple[str, int]]:
    """Pairs of neighbouring blocks whose edge is stripped: (joined text, where the edge was)."""
    before = None
    for a, b, heading in blocks(text):
        block = text[a:b]
        m = _BULLET.match(block)
        body = block[m.end() :] if m else block
        if heading or not body.strip():
            before = None
            continue
        if before is not None:  # now and then the space is lost, too
            yield before + (" " if len(before) % 5 or not body[0].isupper() else "") + body, len(before)
        before = body


def _sequences(model: Model):
    """Training sequences: per place its prior, features and label (-1 hidden) under both tags of the place before."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                low = _lower_only(text)
                for joined, edge in stripped(text):
                    found = places(joined, model, low)
                    if not any(p.at == edge for p in found):
                        continue
                    rows.append([(1 if p.at == edge else -1 if p.label is None else p.label, p.after[0][0], p.after[1][0], p.after[0][1], p.after[1][1]) for p in found])
            flat = [p for r in rows for p in r]
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(r) for r in rows for _ in r], pa.int32()), pa.array([k for r in rows for k in range(len(r))], pa.int32())]
                + [pa.array([p[i] for p in flat], t) for i, t in enumerate((pa.int8(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string())))],
                names=["size", "nth", "label", "prior0", "prior1", "after0", "after1"],
            )

    return make


_SEQUENCES = "size int, nth int, label byte, prior0 double, prior1 double, after0 array<string>, after1 array<string>"


def train(table: pa.Table, ridge: float = 2.0, rounds: int = 60) -> dict[str, float]:
    """The chain's weights: gradient ascent on the likelihood of the known labels, hidden ones summed over (forward-backward)."""
    if not table.num_rows:
        return {}
    size, nth, label = (table.column(c).to_numpy().astype(np.int64) for c in ("size", "nth", "label"))
    prior = np.stack([table.column(f"prior{t}").to_numpy() for t in (0, 1)])
    names: dict[str, int] = {}
    feats = []
    for t in (0, 1):
        lists = table.column(f"after{t}").to_pylist()
        feats.append((np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([names.setdefault(f, len(names)) for x in lists for f in x], np.int64)))
    steps = [np.flatnonzero(nth == k) for k in range(int(nth.max()) + 1)]  # places of one sequence stand in a row, so place k - 1 is the row before
    w, speed = np.zeros(len(names)), np.full(len(names), 1e-8)

    def expected(score: np.ndarray, fixed: bool) -> np.ndarray:
        """P(tag before = t, boundary here) of each place, with the known labels fixed or not."""
        n = score.shape[1]
        off = np.where(fixed & (label == 1), -1e9, 0.0)
        on = np.where(fixed & (label == 0), -1e9, score)
        fwd, bwd = np.zeros((2, n)), np.zeros((2, n))
        for k, rows in enumerate(steps):
            a = np.stack([np.full(len(rows), -1e9), np.zeros(len(rows))]) if k == 0 else fwd[:, rows - 1]
            fwd[0, rows] = np.logaddexp(a[0], a[1]) + off[rows]
            fwd[1, rows] = np.logaddexp(a[0] + on[0, rows], a[1] + on[1, rows])
        for k in range(len(steps) - 1, 0, -1):
            rows = steps[k]
            for t in (0, 1):
                bwd[t, rows - 1] = np.logaddexp(off[rows] + bwd[0, rows], on[t, rows] + bwd[1, rows])
        ends = np.flatnonzero(nth == size - 1)
        z = np.repeat(np.logaddexp(fwd[0, ends], fwd[1, ends]), size[ends])
        first = nth == 0
        a = np.where(first, np.array([[-1e9], [0.0]]), np.roll(fwd, 1, axis=1))
        return np.exp(np.minimum(0.0, a + on + bwd[1] - z))

    for _ in range(rounds):
        score = np.stack([prior[t] + np.bincount(feats[t][0], w[feats[t][1]], minlength=len(size)) for t in (0, 1)])
        gap = expected(score, True) - expected(score, False)
        g = sum(np.bincount(feats[t][1], gap[t][feats[t][0]], minlength=len(w)) for t in (0, 1)) - ridge * w
        speed += g * g
        w += 0.5 * g / np.sqrt(speed)
    return dict(zip(names, w.tolist()))


def fit(texts: DataFrame) -> Model:
    """Statistics of all ``texts`` (column ``text``), and the chain's weights from a bounded sample of them."""
    model = statistics(texts)
    part = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, SAMPLE / max(texts.count(), 1)))
    model.weights = train(texts.where(part).mapInArrow(_sequences(model), _SEQUENCES).toArrow())
    return model


def _split(model: Model):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, ends = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for a, b in sentences(text, model):
                    ids.append(i)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["id", "sent_start", "sent_end"])

    return split


def sentence_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, sent_start, sent_end)``: every sentence of every text.

    Offsets count Unicode characters from 0, end exclusive, without outer white
    space; every other character belongs to just one sentence. Null, empty and
    blank texts and null ids have none; repeated rows count once; empty tables
    give no rows. Only the two named columns are read.
    """
    ship(df.sparkSession)
    rows = spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & F.col("text").rlike(r"\S")))
    model = fit(rows.select("text"))
    return rows.mapInArrow(_split(model), "id long, sent_start int, sent_end int").distinct()
