"""Problem 1: credentials embedded in source code.

Method: one scan collects candidates (literals, unquoted values, URL user
parts, header values, private-key blocks) with weak labels from pattern
matches, and, over all texts, the counts of a character Markov chain. Two more
chains are counted over the values of the labelled candidates, credentials and
others. A logistic regression on the likelihood ratios of these chains, the
surrounding identifiers and features of path and form is fitted on a bounded
sample of labelled candidates and calibrated on ones that neither it nor the
chains have seen; candidates of high calibrated score are credentials, and can
be blanked in place.

The patterns that label (token formats, classes of characters, stand-ins) are
no features: a value speaks to the model through the chains only. Stand-ins,
which are labelled as no credentials, are never blanked whatever their score.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from heapq import merge

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.scratch import Scratch
from codestrata.session import ship, spread

#: Labelled candidates that the regression is fitted on, about so many at most; all are scored.
SAMPLE = 20_000
#: Calibrated score from which a candidate is a credential.
THRESHOLD = 0.4
#: Characters before a literal in which its key is sought; a longer key is no identifier.
REACH = 1_000

# Published token formats.
TOKEN = re.compile(
    r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{40,}|glpat-[A-Za-z0-9_-]{20,}|gl[a-z]{2,4}t?-[A-Za-z0-9_-]{20,}|xox[abeprs]-[0-9A-Za-z-]{20,}|xapp-[0-9A-Za-z-]{20,}|(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{16,}|"
    r"sk-(?:proj-|ant-)?[A-Za-z0-9_-]{20,}|(?:AKIA|ASIA|AGPA|AROA|AIDA)[A-Z0-9]{16}(?![A-Za-z0-9])|AIza[A-Za-z0-9_-]{30,}|npm_[A-Za-z0-9]{30,}|hf_[A-Za-z0-9]{30,}|do[opr]_v1_[0-9a-f]{60,}|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{20,}|"
    r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}|pypi-[A-Za-z0-9_-]{40,}|dapi[0-9a-f]{32}|shp(?:at|ca|pa|ss)_[0-9a-fA-F]{32}|SK[0-9a-f]{32}(?![0-9a-f])|key-[0-9a-f]{32}|ya29\.[A-Za-z0-9_-]{30,}|EAACEdEose0cBA[0-9A-Za-z]+|lin_api_[A-Za-z0-9]{36,}|sq0[a-z]{3}-[A-Za-z0-9_-]{22,}|AccountKey=[A-Za-z0-9+/=]{40,})"
)
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PUBLIC = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*(?:PUBLIC KEY|CERTIFICATE)(?: [A-Z]+)?-----|\bssh-(?:rsa|dss|ed25519)\b|\becdsa-sha2|data:[\w/+.-]+;base64,|\bsha(?:1|224|256|384|512)[:-]")
URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://(?P<user>[^\s/:@\"'`]*):(?P<v>[^\s\"'`]+?)@(?=[\w\[{$%<-])")
QUERY = re.compile(r"[?&;](?P<k>[A-Za-z_.-]*(?:key|token|secret|passw(?:or)?d|pwd|auth|sig(?:nature)?)[A-Za-z_]*)=(?P<v>[^\s&\"'`#;]+)", re.I)
HEADER = re.compile(r"(?:(?P<k>Authorization|(?:X-)?[A-Za-z-]*(?:Key|Token|Secret|Auth))\s*[\"']?\s*[:=,]\s*[\"']?\s*)?\b(?P<s>Bearer|Basic|Token|ApiKey)\s+(?P<v>[A-Za-z0-9+/=_.~-]{8,})")
ELEMENT = re.compile(r"<(?P<k>[\w:.-]+)(?:\s[^<>]*)?>(?P<v>[^<>\s]+)</(?P=k)\s*>")
COMMAND = re.compile(
    r"(?:\bcurl\b[^\n]*?\s(?:-u|--user)\s*[= ]\s*[\"']?[^\s:\"']+:(?P<a>[^\s\"']+)|\b(?:mysql|mysqldump|mysqladmin|mariadb|sshpass)\b[^\n]*?\s-p(?P<b>[^\s\"']{4,})|"
    r"\bsshpass\s+-p\s*[\"']?(?P<c>[^\s\"']+)|\s--?(?:password|passwd|pass|token|secret|api-?key|access-?key)(?:=|\s+)[\"']?(?P<d>[^\s\"'-][^\s\"']*)|\b(?:PGPASSWORD|MYSQL_PWD|REDISCLI_AUTH)=[\"']?(?P<e>[^\s\"']+)|"
    r"\blogin\s+\S+\s+password\s+(?P<f>\S+)|\bredis-cli\b[^\n]*?\s-a\s+[\"']?(?P<g>[^\s\"']+)|\becho\s+[\"']?(?P<h>[^\s\"'|]+)[\"']?\s*\|\s*docker\s+login)"
)

_WORD_OF_KEY = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
# Words of identifiers that name a credential, and words after which it is none.
SECRET_WORDS = {"password", "passwd", "pass", "passphrase", "pwd", "pw", "secret", "secrets", "token", "credential", "credentials", "apikey", "auth", "authorization", "bearer", "dbpassword", "passcode", "pin", "accesskey", "secretkey", "privatekey", "signingkey", "authtoken", "accesstoken", "clientsecret", "smtppass", "rootpw", "hmackey", "encryptionkey", "webhooksecret", "signingsecret", "privatetoken", "jwt", "otp", "creds", "cred"}
KEY_MATES = {"api", "access", "secret", "private", "encryption", "hmac", "signing", "master", "account", "service", "shared", "deploy", "ssh", "aes", "crypto", "cipher", "session", "storage", "license", "webhook", "client", "app", "auth"}
NO_SECRET = {"public", "pub", "publishable", "min", "max", "length", "len", "ttl", "path", "file", "filename", "dir", "name", "header", "hint", "error", "title", "label", "message", "msg", "text", "placeholder", "pattern", "regex", "format", "type", "count", "limit", "expiry", "expires", "expiration", "timeout", "url", "uri", "endpoint", "id", "ids", "field", "column", "policy", "rotation", "enabled", "required", "through", "prefix", "suffix", "env", "var", "ref", "arn", "version", "algorithm", "alg", "issuer", "audience", "scope", "checksum", "hash", "digest", "sha", "integrity", "revision", "commit", "etag", "uuid", "guid", "fingerprint", "thumbprint", "icon", "logo", "pixel", "image", "table", "description", "help", "prompt", "validator", "reset", "size", "strength", "age", "days", "hours", "minutes", "seconds", "lifetime", "store", "provider", "manager", "service", "user", "username", "status", "state", "mode", "class", "request"}
_SAMPLES = re.compile(
    r"(?i)example|change[-_ ]?me|your[-_ ]|[-_ ]your|replace[-_ ]?me|replace[-_ ]?with|placeholder|dummy|redacted|insert[-_ ]|fix[-_ ]?me|goes[-_ ]here|[-_ ]here\b|x{4,}|\bxxx\b|\*{3}|\.{3}|…|•|<[^<>]*>|lorem|foobar|asdf|qwerty|"
    r"abc123|123456|my[-_ ]?(?:secret|password|token|key)|some[-_ ]?(?:secret|password|token|key)|^test[-_]?(?:secret|password|token|key|pass)?\d*$|^n/a$|"
    r"^(?:the[-_ ]?)?(?:secret|password|passwd|pass|token|key|apikey|api[-_]key|pwd|admin|root|user|test|none|null|nil|undefined|true|false|default|empty|string|required|optional|value|guest|unknown|secret[-_]?key|access[-_]?token|hunter2|letmein|welcome)\d{0,2}$"
)
#: Words that make a sample only of a value without digits.
_LOOSE = re.compile(r"(?i)to[-_ ]?do\b|sample|\bfake\b|not[-_ ]?(?:a[-_ ]?)?(?:real|set|used)|removed|masked|hidden|censored|put[-_ ]|set[-_ ]by|same[-_ ]as|see[-_ ]|enter[-_ ]|\btbd\b|abcdef")
_REFERS = re.compile(
    r"\$\{|\$\(\w|\{\{|^\$[A-Za-z_]|%\(\w+\)|^%[A-Za-z_]+%$|#\{\w|@@\w+@@|^<%|^\{[A-Za-z_][\w.-]*\}$|^\[[^\[\]]*\]$|^<[^<>]*>$|(?<![A-Za-z0-9])%[sdvq](?![A-Za-z0-9])|^\{\d*\}$|\benv(?:iron)?\b[.:\[(]|getenv|process\.env|\bENV\[|secretsmanager|\bssm:|\bvault:|vault[/ .]|keyring|\barn:aws|\b(?:op|vault|secret|sm|gcp|awssm|azkv)://|^file:|^/(?:run|etc|var|mnt|opt|usr|home|secrets)\b|"
    r"^(?:~|\.{1,2})?(?:/[a-z_.][a-z0-9_.-]*)+/?$|\bsecretKeyRef\b|valueFrom|\bresolve:|^ENC\[|^!(?:vault|secret|Ref|Sub|GetAtt|env)|^(?:config|settings|os|self|this|env|vault|secrets|process|System|ENV|Rails|app)[.:\[(]|\.(?:txt|pem|key|json|ya?ml|env|crt|cer|p12|jks)$|\bget_?(?:secret|password|token|env|parameter)\b"
)
_HASHES = re.compile(r"^\$(?:2[aby]?|5|6|argon2\w*|pbkdf2[\w-]*|scrypt)\$|^\{S?SHA\d*\}|^pbkdf2_|^sha\d+[:$-]|^md5[:$]")
_UUID = re.compile(r"^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$", re.I)
_PATTERN = re.compile(r"\[[^\]]*-[^\]]*\]|\\[dwsb]|\(\?|\{\d+,?\d*\}\$?$|\.\*")
_VALUE64 = re.compile(r"^(?:[A-Za-z0-9+/]{4}){2,}(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")

# What a line must hold, in lower case, to be looked at.
_MARKS = "pass pw secret token key auth cred login bearer basic :// -----begin jwt curl mysql mariadb redis-cli glpat ghp_ gho_ ghu_ ghs_ ghr_ xox sk_live rk_live sk_test pk_live akia asia agpa aroa aida aiza npm_ hf_ dop_v dor_v doo_v sg. eyj otp signature sig= pypi- dapi ya29. shpat shpss sq0".split()
#: Marks that stand in many words: only where the pattern matches there is the line looked at.
_WORD_PIN = re.compile(r"(?:(?<![A-Za-z])p|P)(?:in|IN)(?![a-z])")
_IF = {"pin": _WORD_PIN} | dict.fromkeys("github_pat_ gl xapp- sk rk_ pk_ shp eaacedeose0cba lin_api_".split(), TOKEN)
_SEEKER = ahocorasick.Automaton()
for _m in [*_MARKS, *_IF]:
    _SEEKER.add_word(_m, (len(_m), _IF.get(_m)))
_SEEKER.make_automaton()
#: A value long enough to be looked at without any mark.
_LONG = re.compile(r"[\"'= :]\w[\w+/-]{31,}")


def _interesting(text: str) -> Iterator[int]:
    """Where a line may hold a credential, in order; one pass of an automaton, one for long values."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    marked = (end - n + 1 for end, (n, only) in _SEEKER.iter(low) if only is None or only.match(text, end - n + 1))
    return merge(marked, (m.start() + 1 for m in _LONG.finditer(text)))


_LITERAL = re.compile(r"\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`")
_GLUE = re.compile(r"(?P<op>[ \t]*(?:\+|\\(?=\n)|<<|\.(?=[ \t\n]*[\"'])|,)?)[ \t]*(?:(?://|\#)[^\n\"']*)?(?P<nl>(?:\r?\n[ \t]*(?:(?://|\#|\*)[ \t]*)?)?)(?P<op2>[+&.]?[ \t]*)(?:[rbuf]{1,2}(?=[\"']))?(?=[\"'])", re.I)
_KEY_BEFORE = re.compile(
    r"(?:(?P<note>/\*\s*(?P<n>[\w .-]+?)\s*\*/\s*)|(?:[\"'](?P<q>[^\"'\n]{1,300})[\"']|(?P<b>[A-Za-z_$@][\w$@.-]*\??))[\"'\]\)]*\s*(?P<t>:\s*(?:&?(?:'static\s+)?[A-Za-z][\w<>\[\]|?.]*(?:\s*\|\s*\w+)*)\s*(?==))?\s*(?P<op>:=|\|\|=|\?\?=|\?=|\+=|=>|->|===?|!==?|=|:|,|\()\s*(?P<w>(?:[A-Za-z_][\w.:!]*\s*[(\[{]\s*|[(\[{]\s*|\\?\n\s*(?:(?://|\#)\s*)?|[rbuf]{1,2}(?=$))*))$",
    re.I,
)
_GOES_ON = re.compile(r"[=(\[\\+:]\s*(?:(?:#|//)[^\n\"']*)?$")
_NAMES = re.compile(r"[ \t]*(?::(?![:=])|=>|\][ \t]*=)")  # a literal that is itself a key
_UNQUOTED = re.compile(
    r"^[ \t]*(?P<c>(?:\#+|//+|;+|--|\*|<!--)?[ \t]*)(?P<pre>(?:export|readonly|declare|set|setx|local|ARG|ENV|old|tmp|temp|use|using|new|current|legacy|prod|was|the|RUN|-)[ \t]+)?(?P<k>[A-Za-z_][\w.\-]*|\"[^\"\n]+\"|'[^'\n]+')[ \t]*(?P<op>:=|=>|->|=|:|[ \t](?=\S))[ \t]*(?P<v>[^\s\"'`#][^\n]*?)[ \t]*$"
)
_ENDS = re.compile(r"\s+(?:#|//|;|-->|on |for |in |until |to ).*$")
_BLOCK = re.compile(r"^([ \t]*)(?:-[ \t]+)?([\"']?[\w.-]+[\"']?)[ \t]*:[ \t]*[|>][+-]?\d*[ \t]*(?:#[^\n]*)?$")
_NAMED = re.compile(r"^\s*-?\s*(?:name|key)\s*[:=]\s*[\"']?([\w.-]+)[\"']?\s*,?\s*$|(?:key|name)\s*=\s*[\"']([\w.-]+)[\"']\s+value\s*=\s*$", re.I)
CONFIG = {"env", "ini", "properties", "yaml", "yml", "toml", "dockerfile", "sh", "cfg", "conf", "bash", "zsh", "txt", "md", "netrc", "xml", "tf", "tfvars", "envrc", "npmrc", "pypirc"}
_DECODES = re.compile(r"(?:b64|base64|decode|unhex|fromhex|hex|atob|buffer\.from|unpack|join|concat|from_utf8|bytes|string|str|new |format|encode|strip|trim|reverse|secretstr|freeze|optional\.of|some|box|arc|to_string|of|vec|map|dict|hash|struct|login|connect|client|set|put|insert|add|with|basic|auth|sign|hmac)", re.I)


def key_words(key: str) -> list[str]:
    return [w.lower() for w in _WORD_OF_KEY.findall(key)]


def key_kind(key: str) -> tuple[int, int, int]:
    """(names a credential, names a key of some kind, names something else) of an identifier."""
    words = key_words(key)
    joined = "".join(words[-2:])
    named = bool(words) and (words[-1] in SECRET_WORDS or joined in SECRET_WORDS or any(w in SECRET_WORDS or any(w.endswith(s) for s in ("password", "secret", "token", "apikey", "passwd", "pwd")) or re.search(r"(?<!com)(?<!by)(?<!tres)(?<!sur)(?<!under)pass$|[a-z]{3}pw$", w) for w in words))
    kind = bool(words) and (words[-1] in ("key", "keys") and any(w in KEY_MATES for w in words[:-1]) or words[-1].endswith("key") and words[-1] != "key" and any(words[-1].startswith(m) for m in KEY_MATES))
    other = bool(words) and (words[-1] in NO_SECRET or any(w in ("public", "pub", "publishable", "min", "max") for w in words) or words[-2:] == ["pass", "through"])
    return int(named), int(kind), int(other)


class Candidate:
    __slots__ = ("start", "end", "key", "value", "form", "comment", "sample")

    def __init__(self, start: int, end: int, key: str, value: str, form: str, comment: bool, sample: bool = False) -> None:
        self.start, self.end, self.key, self.value, self.form, self.comment, self.sample = start, end, key, value, form, comment, sample


def _key_line(line: str) -> tuple[bool, bool]:
    """(whether a line may belong to a private key: bare, commented, quoted or with escaped line ends; whether it holds part of it)."""
    bare = [re.sub(r"^[\s#/*\"'+>|-]+|[\s\"'+\\,;)]+$", "", x) for x in re.split(r"\\[nr]", line)]
    return all(not x or re.fullmatch(r"[A-Za-z0-9+/=]{4,}", x) or re.match(r"(?:Proc-Type|DEK-Info|Comment|Version):", x) for x in bare), any(bare)


def _closing(text: str, at: int) -> int:
    """Where the bracket closes that is open at ``at``, literals left out, or -1."""
    while m := re.compile(r"[\]\"'`]").search(text, at):
        if m[0] == "]":
            return m.start()
        n = _LITERAL.match(text, m.start())
        at = n.end() if n else m.end()
    return -1


def _pem(text: str, m: re.Match) -> tuple[int, bool, str]:
    """(end of the block, whether key material stands in it, that material)."""
    stop = re.compile(r"-----END [A-Z0-9 ]*-----").search(text, m.end())
    end = stop.end() if stop else len(text)
    again = text.find("-----BEGIN", m.end(), end)
    if again >= 0:
        end = again
    if again < 0 and not stop:  # cut off: as far as lines of key material go
        end = at = m.end()
        for x in text[m.end() :].splitlines(keepends=True):
            fits, holds = _key_line(x)
            if not fits:
                break
            at += len(x)
            end = at if holds else end
        if end == m.end():
            end = len(text)
    body = text[m.end() : stop.start() if stop and stop.end() == end else end]
    body = re.sub(r"\\n|\\r", "\n", body)
    if not stop:
        kept = []
        for line in body.split("\n"):
            bare = re.sub(r"^[\s#/*\"'+>|-]+|[\s\"'+\\,;)]+$", "", line)
            if bare and not re.fullmatch(r"[A-Za-z0-9+/=]{4,}", bare) and not re.match(r"(?:Proc-Type|DEK-Info|Comment|Version):", bare):
                break
            kept.append(bare)
        body = "\n".join(kept)
    lines = [re.sub(r"[\s#/*\"'+>|\\,;()-]*$", "", re.sub(r"^[\s#*\"'>|(-]*(?://\s+)?", "", x)) for x in body.split("\n")]
    solid = "".join(x for x in lines if not re.match(r"(?:Proc-Type|DEK-Info|Comment|Version):", x))
    bad = _SAMPLES.search(re.sub(r"[A-Za-z0-9+/]{30,}", "", solid)) or _REFERS.search(solid) or re.search(r"(.)\1{7,}", solid)
    letters = re.sub(r"[^A-Za-z0-9+/]", "", solid)
    return end, not bad and len(letters) >= 24 and len(set(letters)) > 10, solid


def _key_at(text: str, line: int, at: int) -> tuple[str, str, str]:
    """(key, operator, wrapping call) that stand before a literal at ``at``; the line before helps where a value is wrapped."""
    head = text[max(line, at - REACH) : at]
    if not head.strip(" \t#/*+\\(["):
        prev = text.rfind("\n", 0, max(0, line - 1)) + 1
        head = text[max(prev, line - REACH) : at]
    m = _KEY_BEFORE.search(head)
    if not m:
        return "", "", ""
    return (m["n"] or m["q"] or m["b"] or ""), (m["op"] or "/*"), (m["w"] or "")


def candidates(text: str, path: str, truncated: bool) -> list[Candidate]:
    """Every place of ``text`` where a credential may stand, once each, in order."""
    out: list[Candidate] = []
    ext = path.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower() if path else ""
    config = ext in CONFIG or "dockerfile" in path.lower()
    solid: list[tuple[int, int]] = []  # private and public key blocks
    for m in PEM.finditer(text):
        if solid and m.start() < solid[-1][1]:
            continue
        end, real, body = _pem(text, m)
        solid.append((m.start(), end))
        if body:
            out.append(Candidate(m.start(), end, "private_key", body, "pem", False, not real))
    done = -1
    pem_starts = [s for s, _ in solid]
    taken: list[tuple[int, int]] = []

    def inside(at: int) -> bool:
        k = bisect_right(pem_starts, at) - 1
        return k >= 0 and at < solid[k][1]

    def add(start: int, end: int, key: str, value: str, form: str, comment: bool) -> None:
        if value and not inside(start) and not any(a < end and start < b for a, b in taken):
            taken.append((start, end))
            out.append(Candidate(start, end, key, value, form, comment))

    for hit in _interesting(text):
        if hit < done:
            continue
        line = text.rfind("\n", 0, hit) + 1
        stop = text.find("\n", hit)
        stop = len(text) if stop < 0 else stop
        done = stop
        if truncated and stop == len(text):
            continue
        row = text[line:stop]
        if inside(line) and inside(stop - 1):
            continue
        taken.clear()
        bare = row.lstrip()
        comment = bare.startswith(("#", "//", "*", "/*", ";", "--", "<!--"))
        for m in URL.finditer(row):
            add(line + m.start("v"), line + m.end("v"), "url", m["v"], "url", comment)
        for m in QUERY.finditer(row):
            add(line + m.start("v"), line + m.end("v"), m["k"], m["v"], "query", comment)
        for m in ELEMENT.finditer(row):
            add(line + m.start("v"), line + m.end("v"), m["k"], m["v"], "element", comment)
        for m in COMMAND.finditer(row):
            g = m.lastgroup
            add(line + m.start(g), line + m.end(g), "password", m[g], "command", comment)
        for m in HEADER.finditer(row):
            add(line + m.start("v"), line + m.end("v"), "authorization", m["v"], "basic" if m["s"] == "Basic" else "header", comment)
        at, reach = line, stop
        if _GOES_ON.search(row):  # a value wrapped to the next line
            reach = text.find("\n", stop + 1)
            reach = len(text) if reach < 0 else reach
            if truncated and reach == len(text):
                reach = stop
        while True:
            m = _LITERAL.search(text, at)
            if not m or m.start() >= reach:
                break
            g = m.lastindex
            start, end, value = m.start(g), m.end(g), m[g]
            key, op, wrap = _key_at(text, line, m.start())
            parts, tail, closing = [value], m.end(), None
            while value:
                glue = _GLUE.match(text, tail)
                if not glue:
                    break
                op1, crossed, op2 = glue["op"].strip(), bool(glue["nl"]), glue["op2"].strip()
                joins = re.search(r"(?:concat|join|\bcat)!?\s*[(\[]|\[\s*$", wrap, re.I)
                if op1 == ",":
                    if joins and closing is None:
                        closing = _closing(text, tail)
                    if not (joins and (re.search(r"concat|join|cat", wrap, re.I) or (closing >= 0 and re.match(r"\]\s*\.\s*(?:join|concat)", text[closing : closing + 16])))):
                        break
                elif not op1 and not op2 and crossed and "(" not in wrap and not config:
                    break
                elif not op1 and not op2 and not crossed and glue.end() == tail:
                    break
                n = _LITERAL.match(text, glue.end())
                if not n:
                    break
                parts.append(n[n.lastindex])
                end, tail = n.end(n.lastindex), n.end()
            value = "".join(parts)
            at = tail
            if len(value) < 4 or _NAMES.match(text, tail):
                continue
            form = "literal"
            if op == "," or op == "(":
                form = "argument"
            if op in ("==", "===", "!=", "!=="):
                form = "compare"
            before = _NAMED.search(text[line : m.start()]) or (_NAMED.match(text[text.rfind("\n", 0, max(0, line - 1)) + 1 : max(0, line - 1)]) if key.lower() == "value" else None)
            if before:
                key = before[1] or before[2]
            if wrap and "(" in wrap and not _DECODES.search(wrap):
                called = re.search(r"([A-Za-z_][\w.:!]*)\s*\(\s*$", wrap)
                if called:
                    form = "call"
            add(start, end, key, value, form, comment)
            if at >= stop:
                done = max(done, at)
        block = _BLOCK.match(row)
        if block:
            pos, pieces, first = stop + 1, [], None
            while pos < len(text):
                e = text.find("\n", pos)
                e = len(text) if e < 0 else e
                inner = text[pos:e]
                if inner.strip() and len(inner) - len(inner.lstrip()) <= len(block[1]):
                    break
                if truncated and e == len(text):
                    break
                if inner.strip():
                    first = first if first is not None else pos + len(inner) - len(inner.lstrip())
                    pieces.append((inner.strip(), pos + len(inner.rstrip())))
                pos = e + 1
            if pieces:
                add(first, pieces[-1][1], block[2].strip("\"'"), "".join(p for p, _ in pieces), "block", comment)
        if config or comment:
            m = _UNQUOTED.match(row)
            if m and (m["op"].strip() or m["pre"]) and not (m["op"] == ":" and m["v"].startswith("//")):
                value = _ENDS.sub("", m["v"])
                if comment and m["op"].strip() in ("", ":") and " " in value:
                    value = value.split(" ")[0] if m["pre"] else value
                key = m["k"].strip("\"'")
                named = _NAMED.match(text[text.rfind("\n", 0, max(0, line - 1)) + 1 : max(0, line - 1)]) if key.lower() == "value" else None
                if len(value) >= 4 and not (not config and re.search(r"[(){};]$|\w\(", value) and not TOKEN.search(value)):
                    add(line + m.start("v"), line + m.start("v") + len(value), (named[1] or named[2]) if named else key, value.rstrip(",;"), "unquoted", comment)
        for m in TOKEN.finditer(row):
            add(line + m.start(), line + m.end(), "", m[0], "token", comment)
    return out


# ---------------------------------------------------------------- features

#: Symbols of the chains: what is no printable ASCII character, then those characters.
SYMBOLS = 96
FORMS = ["literal", "unquoted", "argument", "compare", "call", "url", "query", "header", "basic", "command", "block", "token", "element", "pem"]
#: Buckets of the words of identifiers.
WORDS = 128


def symbols(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where((c >= 32) & (c < 127), c - 31, 0).astype(np.int64)


def bigrams(text: str) -> np.ndarray:
    """Counts of the Markov chain's steps in a text."""
    s = symbols(text)
    return np.bincount(s[:-1] * SYMBOLS + s[1:], minlength=SYMBOLS * SYMBOLS)


def value_symbols(value: str) -> np.ndarray:
    """The symbols of a value between a start and an end."""
    return np.concatenate([[0], symbols(value), [0]])


def log_steps(counts: np.ndarray) -> np.ndarray:
    c = counts.reshape(SYMBOLS, SYMBOLS).astype(np.float64) + 0.5
    return np.log(c / c.sum(axis=1, keepdims=True))


def decoded(value: str) -> str | None:
    """The text that a base64 value holds, if it holds one."""
    if len(value) < 12 or not _VALUE64.match(value):
        return None
    try:
        got = base64.b64decode(value, validate=True).decode("ascii")
    except (binascii.Error, ValueError, UnicodeDecodeError):
        return None
    return got if got and all(32 <= ord(c) < 127 for c in got) else None


def standin(value: str, key: str) -> bool:
    """Sample words, masks, references to where a value is kept, and other text that holds no secret."""
    v = value.strip()
    solid = bool(TOKEN.fullmatch(v)) and not re.search(r"EXAMPLE|example|X{6,}|x{4,}|0{8,}|(.)\1{5,}|your|YOUR", v)
    if solid:
        return len(set(v[4:])) < 7
    if not v or _REFERS.search(v) or _PATTERN.search(v) or _HASHES.search(v) or _UUID.match(v):
        return True
    if _SAMPLES.search(v) and not re.search(r"^(?=.*[A-Z])(?=.*[a-z])(?=.*\d).{20,}$", re.sub(_SAMPLES, "", v)):
        return True
    if _LOOSE.search(v) and not re.search(r"\d", v):
        return True
    if re.search(r"(.)\1{4,}", v) or len(set(v)) <= 3:
        return True
    if re.fullmatch(r"[-\d.:,/ T+Z]+", v) and len(v) < 12 or re.fullmatch(r"(?i)true|false|yes|no|on|off|null|none|nil", v):
        return True
    if re.search(r"\s", v) and not re.search(r"\d", v):
        return True
    if len(re.findall(r"[A-Za-z]+", v)) >= 3 and len(v.split()) >= 3:
        return True
    letters = re.sub(r"[^a-z]", "", v.lower())
    return bool(letters) and not re.search(r"\d", v) and letters == re.sub(r"[^a-z]", "", key.lower())


def secret_part(value: str, form: str) -> tuple[str, str | None]:
    """(what of a value would be secret, the text it decodes to, if any)."""
    plain = decoded(value) or (decoded(value + "=") if form == "basic" else None)
    if form == "basic" and plain and ":" in plain:
        return plain.split(":", 1)[1], plain
    m = re.match(r"(?i)^(?:bearer|basic|token|apikey)\s+(\S+)$", value)
    if m:
        plain = decoded(m[1])
        return (plain.split(":", 1)[1] if plain and ":" in plain else m[1]), plain
    return value, plain


def stands_in(c: Candidate) -> bool:
    """Whether a candidate is a sample, a mask, a reference or public."""
    if c.form == "pem":
        return c.sample
    inner, plain = secret_part(c.value, c.form)
    return standin(inner, c.key) or (plain is not None and standin(plain.split(":", 1)[-1], c.key)) or bool(PUBLIC.search(c.value))


def weak_label(c: Candidate) -> int | None:
    """1 credential, 0 none, None where no pattern tells."""
    if stands_in(c):
        return 0
    inner, _ = secret_part(c.value, c.form)
    if c.form in ("pem", "url", "query", "header", "basic", "command") or TOKEN.search(inner):
        return 1
    named, kind, other = key_kind(c.key)
    if c.form in ("compare", "call") or other or not (named or kind):
        return 0
    classes = sum(bool(re.search(p, inner)) for p in ("[A-Z]", "[a-z]", r"\d", r"[^A-Za-z0-9\s_\-./]"))
    encoded = re.fullmatch(r"(?:[0-9a-f]{2}){8,}|(?:[0-9A-F]{2}){8,}", inner) or re.fullmatch(r"[A-Za-z0-9+/_-]{16,}={0,2}", inner) and classes >= 3
    if " " in inner.strip() and not encoded:
        return None
    phrase = len(c.value) >= 10 and re.fullmatch(r"[a-z]+(?:[-_.][a-z]+)+[-_.]?\d+", inner)
    return 1 if classes >= 3 or encoded or phrase else None


class Chains:
    """Log probabilities of the steps in all texts, in credentials and in other values."""

    def __init__(self, texts: np.ndarray, secrets: np.ndarray, others: np.ndarray) -> None:
        self.texts, self.secrets, self.others = log_steps(texts), log_steps(secrets), log_steps(others)

    def ratios(self, value: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each step: credential against text, credential against other value, text alone."""
        s = value_symbols(value)
        at = (s[:-1], s[1:])
        return self.secrets[at] - self.texts[at], self.secrets[at] - self.others[at], self.texts[at]


def _peak(x: np.ndarray, width: int = 4) -> float:
    """The highest mean of so many steps in a row."""
    if len(x) <= width:
        return float(x.mean())
    sums = np.concatenate([[0.0], np.cumsum(x)])
    return float((sums[width:] - sums[:-width]).max() / width)


def features(key: str, value: str, form: str, comment: bool, path: str, chains: Chains) -> np.ndarray:
    """Markov likelihoods, identifiers, path and form of a candidate."""
    inner, _ = secret_part(value, form)
    text, other, plain = chains.ratios(inner)
    total, against = float(np.clip(text.sum() / 10, -5, 10)), float(np.clip(other.sum() / 10, -5, 5))
    markov = [text.mean(), total, plain.mean(), other.mean(), against, text[:6].mean(), other[:6].mean(), other[-4:].mean(), _peak(text), _peak(other), math.log(1 + len(value))]
    named, kind, elsewhere = key_kind(key)
    secret = float((named or kind) and not elsewhere)
    names = [secret, elsewhere, secret * markov[0], secret * total, secret * markov[3], secret * against, secret * markov[7], elsewhere * total, secret * markov[9]]
    ext = path.rsplit(".", 1)[-1].lower() if path else ""
    place = [comment, bool(re.search(r"(?:^|/)(?:tests?|spec|fixtures|examples?)/|_test\.|\.spec\.", path)), ext in CONFIG, " " in inner.strip()]
    words = np.zeros(WORDS)
    words[[zlib.crc32(w.encode()) % WORDS for w in key_words(key)[-3:]]] = 1
    return np.concatenate([[1.0], markov, names, place, [form == f for f in FORMS], words]).astype(np.float64)


FEATURES = 1 + 11 + 9 + 4 + len(FORMS) + WORDS


def logistic(x: np.ndarray, t: np.ndarray, ridge: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression by Newton steps, halved until the loss falls."""

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.sum(np.logaddexp(0, z) - t * z) + 0.5 * np.sum(ridge * w * w))

    w = start.astype(np.float64)
    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - t) + ridge * w
        h = (x * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ x + np.diag(ridge + 1e-9)
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-8 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        new = loss(w)
        if now - new < 1e-8 * max(1.0, abs(now)):
            break
        now = new
    return w


def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Weights, and the slope and offset that calibrate the held-out scores."""
    ridge = np.full(x.shape[1], 0.1)
    ridge[0], ridge[-WORDS:] = 1e-3, 1.0
    w = logistic(x[~held], y[~held], ridge, np.zeros(x.shape[1]))
    z, t = x[held] @ w, y[held]
    if len(t) <= 50 or not 0 < t.sum() < len(t):
        return w, 1.0, 0.0
    soft = np.where(t > 0, (t.sum() + 1) / (t.sum() + 2), 1 / (len(t) - t.sum() + 2))
    a, b = logistic(np.stack([z, np.ones_like(z)], axis=1), soft, np.full(2, 1e-6), np.array([1.0, 0.0]))
    return w, float(a), float(b)


_CANDIDATES = "id long, line_no int, span_start int, span_end int, key string, value string, form string, comment boolean, path string, sample boolean, label byte, counts array<long>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split(" ")[0] for x in _CANDIDATES.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.bool_(), pa.int8(), pa.list_(pa.int64())]
    total = np.zeros(SYMBOLS * SYMBOLS, np.int64)
    for batch in batches:
        rows: list[list] = [[] for _ in names]
        total += bigrams("\n".join(batch.column(2).to_pylist()))
        for i, path, text, cut in zip(*(batch.column(c).to_pylist() for c in range(4))):
            ends = None
            for c in candidates(text, path or "", bool(cut)):
                if ends is None:
                    ends = [m.start() for m in re.finditer("\n", text)]
                for col, v in zip(rows, (i, bisect_right(ends, c.start - 1) + 1, c.start, c.end, c.key[-REACH:], c.value, c.form, c.comment, path or "", stands_in(c), weak_label(c), None)):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types)], names=names)
    last = [[None]] * (len(names) - 1) + [[total.tolist()]]
    yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(last, types)], names=names)


def _count_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Steps of the values (value, form, label) of credentials and of others."""
    total = np.zeros((2, SYMBOLS * SYMBOLS), np.int64)
    for batch in batches:
        for value, form, label in zip(*(batch.column(i).to_pylist() for i in range(3))):
            s = value_symbols(secret_part(value, form)[0])
            total[label] += np.bincount(s[:-1] * SYMBOLS + s[1:], minlength=SYMBOLS * SYMBOLS)
    yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int8()), pa.array(total.tolist(), pa.list_(pa.int64()))], names=["label", "counts"])


def _summed(rows: DataFrame) -> np.ndarray:
    """The sum of ``counts``; one row a step comes to the driver."""
    out = np.zeros(SYMBOLS * SYMBOLS, np.int64)
    got = rows.select(F.posexplode("counts").alias("at", "n")).where("n > 0").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return out


def _featurer(chains: Chains):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(*c, chains).astype(np.float32) for c in zip(*(batch.column(i).to_pylist() for i in range(5)))]
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in x], pa.binary()), batch.column(5), batch.column(6)], names=["x", "label", "held"])

    return make


def _scorer(chains: Chains, w: np.ndarray, a: float, b: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = [a * float(features(*c, chains) @ w) + b for c in zip(*(batch.column(i).to_pylist() for i in range(4, 9)))]
            out = 1 / (1 + np.exp(-np.clip(np.array(z, np.float64), -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 2, 3, 4, 5, 6, 9)), pa.array(out)], names=["id", "line_no", "span_start", "span_end", "key", "value", "form", "sample", "score"])

    return score


def scored_candidates(df: DataFrame, id_col: str = "chunk_id", text_col: str = "content", path_col: str = "file_path", cut_col: str = "content_truncated") -> DataFrame:
    """``(id, line_no, span_start, span_end, key, value, form, sample, score)`` for every candidate; ``sample`` marks stand-ins.

    Rows with a null id or text have none; repeated rows count once; a null
    path or cut mark says nothing. On the last line of a cut text nothing is
    read. Empty tables give no rows. Only the named columns are read.
    """
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark, "credentials")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"), F.col(cut_col).alias("cut"))
    rows = spread(rows.where(F.col("id").isNotNull() & (F.length("text") > 0)))
    found = scratch.save(rows.mapInArrow(_scan, _CANDIDATES))
    real = found.where("id IS NOT NULL").drop("counts").distinct()
    # one candidate in five is held out of chains and regression
    known = found.where("label IS NOT NULL").withColumn("held", F.pmod(F.xxhash64("span_start", "id"), F.lit(5)) == 4)
    learnt = scratch.save(known.where("NOT held").select("value", "form", "label").mapInArrow(_count_values, "label byte, counts array<long>"))
    chains = Chains(_summed(found.where("counts IS NOT NULL")), _summed(learnt.where("label = 1")), _summed(learnt.where("label = 0")))
    n = known.count()
    part = F.pmod(F.xxhash64("id", "span_start"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, SAMPLE / max(n, 1)))
    seed = known.where(part).select("key", "value", "form", "comment", "path", "label", "held").mapInArrow(_featurer(chains), "x binary, label byte, held boolean").toArrow()
    w, a, b = np.zeros(FEATURES), 1.0, 0.0
    if seed.num_rows:
        x = np.frombuffer(b"".join(seed.column("x").to_pylist()), np.float32).reshape(-1, FEATURES).astype(np.float64)
        w, a, b = fit(x, np.array(seed.column("label").to_pylist(), float), np.array(seed.column("held").to_pylist(), bool))
    columns = "id long, line_no int, span_start int, span_end int, key string, value string, form string, sample boolean, score double"
    return real.drop("label").mapInArrow(_scorer(chains, w, a, b), columns)


def credentials_found(df: DataFrame, **cols: str) -> DataFrame:
    """The candidates of high score that are no stand-ins."""
    return scored_candidates(df, **cols).where((F.col("score") >= THRESHOLD) & ~F.col("sample"))


def credential_lines(df: DataFrame, **cols: str) -> DataFrame:
    """``(id, line_no)``: the lines on which a credential begins."""
    return credentials_found(df, **cols).select("id", "line_no").distinct()


def _blank(text: str, spans: list) -> str:
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["span_start"], -s["span_end"])):
        if s["span_start"] < at:
            continue
        part = text[s["span_start"] : s["span_end"]]
        if s["form"] == "pem":
            part = re.sub(r"(-----BEGIN[^-]*-----)(.*?)(-----END[^-]*-----|\Z)", lambda m: m[1] + re.sub(r"(?<!\\)[A-Za-z0-9+=](?![^\n]*:)", "*", re.sub(r"(?<=[A-Za-z0-9+=])/|/(?=[A-Za-z0-9+=])", "*", m[2])) + m[3], part, flags=re.S)
        else:
            part = re.sub(r"[^\s\"'+\\(),]", "*", part)
        out += [text[at : s["span_start"]], part]
        at = s["span_end"]
    return "".join([*out, text[at:]])


def redacted(df: DataFrame, id_col: str = "chunk_id", text_col: str = "content", **cols: str) -> DataFrame:
    """``(id, content)``: every distinct text, its credentials blanked character by character.

    Quotes, joins between pieces and line breaks stay, so the code around still
    parses and line numbers hold. Null texts stay null.
    """
    spans = (
        credentials_found(df, id_col=id_col, text_col=text_col, **cols)
        .groupBy("id")
        .agg(F.collect_set(F.struct("span_start", "span_end", "form")).alias("spans"))
    )
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("content")).distinct()

    def blank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, found = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            new = [_blank(t, s) if t is not None and s else t for t, s in zip(text, found)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string())], names=["id", "content"])

    return texts.join(spans, "id", "left").mapInArrow(blank, "id long, content string")
