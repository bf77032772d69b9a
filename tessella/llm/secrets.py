"""Secret scan by assignment-aware lexing.

Each text is cut into tokens as source or configuration is (strings with their prefixes, names, operators, brackets,
lines), and assignments are read from them as name-literal pairs: `name = "literal"`, with type annotations or
declarations around the name, `"name": literal`, `name := literal`, `object["name"] = literal`, `name => literal`,
`--name=literal`, `NAME=literal`, `#define NAME literal`, `<add key="name" value="literal"/>`, `<name>literal</name>`.
The right side may be a sum of literals and names, or a string that names are set into. Constants are propagated
through such names within their scopes, and a literal is scored by how sensitive the name is that it reaches, by its
length and by its entropy. Plain patterns for credentials of a known shape (the base) are always part of the result;
the lexer adds to them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which they sort where spans start together.
KINDS = ("assign", "access", "hex", "named", "flow")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_HINT = re.compile(r"password|passwd|secret|token|api_?key", re.IGNORECASE | re.ASCII)

#: Parts of names that make a target sensitive, and their weight.
SENSITIVE = {"password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "secret": 3, "token": 2, "apikey": 3, "api_key": 3, "credential": 2, "private_key": 3, "access_key": 3, "auth": 1, "signing": 1, "license_key": 2, "client_key": 2, "encryption": 2, "conn_str": 2, "connectionstring": 2}

#: Last parts of names that speak about a secret and do not hold it.
ABOUT = {"help", "hint", "label", "prompt", "message", "msg", "error", "placeholder", "title", "description", "text", "url", "uri", "path", "file", "field", "name", "length", "len", "type", "id", "ttl", "expiry", "policy", "regex", "pattern", "count", "size", "format", "header", "column", "input"}

#: Literals that stand for a secret without being one.
PLACEHOLDERS = {"none", "null", "true", "false", "undefined", "changeme", "example", "password", "secret", "token", "xxxxxx", "placeholder", "your_password", "todo", "redacted", "string", "bytes", "required", "optional"}

#: Words that declare a name, and words for types that may follow it.
DECLARES = {"const", "let", "var", "val", "static", "final", "public", "private", "protected", "auto", "char", "my", "local", "export", "mut", "pub", "readonly"}
TYPES = {"string", "str", "String", "int", "bool", "byte", "bytes", "char", "any", "float", "double", "object", "CharSequence"}

LEAST_LITERAL = 6
LEAST_SCORE = 4.0

_TOKEN = re.compile(
    r"""(?P<string>(?:(?<![A-Za-z0-9_])[rRbBfFuU]{1,2})?(?<!\\)(?:\"{3}(?:\\.|[^\\])*?\"{3}|"(?:\\.|[^"\\\n])*")|(?<![A-Za-z0-9_])[rRbBfFuU]{0,2}(?<!\\)(?:'{3}(?:\\.|[^\\])*?'{3}|'(?:\\.|[^'\\\n])*')|(?<!\\)`(?:\\.|[^`\\])*`)"""
    r"""|(?P<line>\n[\x20\t]*)"""
    r"""|(?P<define>(?<![^\n])[\x20\t]*(?:\#[\x20\t]*define|ENV|setenv)[\x20\t]+[A-Za-z_][A-Za-z0-9_]*(?=[\x20\t]))"""
    r"""|(?P<tag></?[A-Za-z_][A-Za-z0-9_.:-]*)"""
    r"""|(?P<other>={2,3}|![=]{1,2}|<=|>=|->|::|://)"""
    r"""|(?P<op>:=|=>|\+=|\?=|[:=])"""
    r"""|(?P<bracket>[{}()\[\];,<>])""",
    re.DOTALL,
)
_LAST_NAME = re.compile(r"[A-Za-z0-9_$.\-]+\Z")
_WORDS = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*")
_INDEX = re.compile(r"\[[\x20\t]*[0-9]*[\x20\t]*\][\x20\t]*\Z")
_TYPED = re.compile(r"""[\x20\t]*[&*?A-Za-z_\[(][^\n"'`=:;\#]*?(?:(?<=[\x20\t])=[\x20\t]|=(?=[\x20\t]*[rRbBfFuU]{0,2}["'`]))""")
_BARE = re.compile(r"""[A-Za-z0-9_$/+@!%^&*~.-]""")
_RUN = re.compile(r"""[^\s"'`,;<>(){}\[\]]*""")
_IDENTIFIER = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*(?:\.[A-Za-z_$][A-Za-z0-9_$]*)*\Z")
_SET_IN = re.compile(r"\$?\{[\x20]*([A-Za-z_$][A-Za-z0-9_.$]*)[^{}\n]*\}|\$([A-Za-z_][A-Za-z0-9_]*)")
_JOINS = re.compile(r"[\x20\t]*(?:\+|\|\||\.\.)[\x20\t]*|[\x20\t]+(?=[\"'])")
_DEF = re.compile(r"[\x20\t]*(?:async[\x20]+)?(?:def|class)\b[^\n]*:[\x20\t]*(?:\#[^\n]*)?\Z")


class Source:
    """A text, with the counts of the characters of any part of it and the end of any unbroken run.

    Neither costs more for a long part than for a short one: counts are differences of sums kept at every few hundred
    characters, and all positions of a run share its end.
    """

    def __init__(self, text: str):
        self.text, self._run, self._sums = text, (0, 0), None

    def bare(self, at: int) -> int:
        """End of the value without quotes at a position; the position itself if there is none."""
        if not _BARE.match(self.text, at):
            return at
        if not self._run[0] <= at < self._run[1]:
            self._run = at, _RUN.match(self.text, at).end()
        return self._run[1]

    def counts(self, start: int, end: int) -> Counter:
        if end - start <= 1024:
            return Counter(self.text[start:end])
        if self._sums is None:
            points, self._codes = np.unique(np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
            self._chars, d = [chr(p) for p in points.tolist()], len(points)
            self._step = max(256, 4 * d)  # the sums take no more room than the text
            block = np.arange(len(self._codes)) // self._step
            each = np.bincount(block * d + self._codes, minlength=(int(block[-1]) + 1) * d).reshape(-1, d)
            self._sums = np.concatenate((np.zeros((1, d), np.int64), np.cumsum(each, axis=0)))
        one, two = -(-start // self._step), end // self._step
        if two < one:
            found = np.bincount(self._codes[start:end], minlength=len(self._chars))
        else:
            ends = np.concatenate((self._codes[start : one * self._step], self._codes[two * self._step : end]))
            found = self._sums[two] - self._sums[one] + np.bincount(ends, minlength=len(self._chars))
        some = np.flatnonzero(found)
        return Counter(dict(zip([self._chars[i] for i in some], found[some].tolist(), strict=True)))


class Value:
    """A literal with what other constants put into it: terms are spans of the text or other values, never a copy."""

    __slots__ = ("_counts", "length", "plain", "source", "terms", "through")

    def __init__(self, terms: list, source: Source):
        self.terms, self.source, self.length = terms, source, 0
        self.through = any(isinstance(t, Value) for t in terms)
        pieces: list[str] | None = []
        for t in terms:
            self.length += t.length if isinstance(t, Value) else t[1] - t[0]
            piece = None if self.length > 64 else t.plain if isinstance(t, Value) else source.text[t[0] : t[1]]
            pieces = None if pieces is None or piece is None else [*pieces, piece]
        #: The text itself if it is short.
        self.plain = None if pieces is None else "".join(pieces)
        # Values of values are counted as they come, so that no chain of them has to be followed later.
        self._counts = self._counted() if self.through else None

    def _counted(self) -> Counter:
        out: Counter = Counter()
        for t in self.terms:
            out.update(t.counts() if isinstance(t, Value) else self.source.counts(*t))
        return out

    def counts(self) -> Counter:
        """How often each character stands in it."""
        return self._counted() if self._counts is None else self._counts

    def spans(self, seen: dict[int, Value]) -> Iterator[tuple[int, int]]:
        """Spans of the literal and of what it is made of, but for values that were seen, which are noted there."""
        todo = [] if id(self) in seen else [self]
        while todo:
            value = todo.pop()
            seen[id(value)] = value
            for t in value.terms:
                if not isinstance(t, Value):
                    yield t
                elif id(t) not in seen:
                    seen[id(t)] = t
                    todo.append(t)


def name_weight(name: str) -> int:
    """How much a target name suggests a secret; camel case, dashes and dots are read like underscores."""
    plain = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower().replace("-", "_").replace(".", "_").replace("$", "")
    weight = max((w for part, w in SENSITIVE.items() if part in plain), default=0)
    return 0 if plain.rpartition("_")[2] in ABOUT else weight


def score(name: str, literal: Value | str, quoted: bool = True) -> float:
    """Weight of the name, plus up to two points each for entropy and length; less for words and phrases, 0 for placeholders.

    A literal without quotes must hold a digit or a sign to be more than a word.
    """
    value = Value([(0, len(literal))], Source(literal)) if isinstance(literal, str) else literal
    weight, n = name_weight(name), value.length
    if not weight or n < LEAST_LITERAL or (value.plain is not None and value.plain.lower() in PLACEHOLDERS):
        return 0.0
    counts = value.counts()
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values() if c / n > 0)
    mixed = any(c.isdigit() or not c.isalnum() and c not in " _." or quoted and c.isupper() for c in counts)
    phrase = any(c.isspace() for c in counts) and "phrase" not in name.lower()
    return weight + min(2.0, entropy / 2) + min(n, 32) / 16 - (0.0 if mixed else 2.0) - (3.0 if phrase else 0.0)


def _string(text: str, start: int, end: int) -> tuple[int, int, bool]:
    """Content of a string token, and whether names may be set into it."""
    i = start
    while text[i] not in "\"'`":
        i += 1
    width = 3 if text[i : i + 3] in ('\"\"\"', "'''") and end - i >= 6 else 1
    return i + width, end - width, "f" in text[start:i].lower() or text[i] in '"`'


def _terms(source: Source, at: int) -> tuple[list, int, bool, int]:
    """Terms of the expression at a position (spans, or names as strings), its end, whether it is quoted, and where its
    last part begins.

    A call, or a name that is indexed, has no value that the text tells: no terms.
    """
    text, out, quoted, last = source.text, [], False, at
    while True:
        last = at
        m = _TOKEN.match(text, at)
        if m and m.lastgroup == "string":
            start, end, open_ = _string(text, m.start(), m.end())
            quoted, at = True, m.end()
            for s in _SET_IN.finditer(text, start, end) if open_ else ():
                if s.start() > start:
                    out.append((start, s.start()))
                out.append(s.group(1) or s.group(2))
                out.append((s.start(), s.end()))  # as it stands, should the name be unknown
                start = s.end()
            if end > start:
                out.append((start, end))
        elif m and m.lastgroup not in (None, "other"):
            break
        elif (end := source.bare(at)) > at:
            if text[end : end + 1] in ("(", "[") or text[end - 1] == ":":
                return [], end, False, last
            if _IDENTIFIER.match(text, at, end):
                out.append(text[at:end])
            out.append((at, end))
            at = end
        else:
            break
        join = _JOINS.match(text, at)
        if not join or not (out or quoted):  # an empty string is a part like any other
            break
        at = join.end()
    return out, at, quoted, last


def _declared(head: str) -> tuple[str, bool]:
    """The name that an assignment's left side ends in, and whether it declares it."""
    head = _INDEX.sub("", head.rstrip(" \t?!"))
    words = _WORDS.findall(head)
    last = _LAST_NAME.search(head)
    if not last or head[last.start() - 1 : last.start()] == "/":  # part of a path
        return "", False
    name = last.group().lstrip("-.")
    if name in TYPES and len(words) > 1 and words[-2] not in DECLARES:
        name = words[-2]
    return name, len(words) > 1 and bool(DECLARES.intersection(words[:-1]) or TYPES.intersection(words))


def lex(source: Source) -> Iterator[tuple]:
    """Events in the order of the text: ("set", name, terms, quoted, declares, adds), ("open", kind) and ("close", kind)."""
    text = source.text
    begin = line = 0  # where the statement and the line begin
    before = [(0, 0, "")] * 3  # the last tokens
    floor, deep, defs, waiting = 0, 0, [], None
    tag: dict[str, tuple] | None = None
    for m in _TOKEN.finditer(text):
        kind, i = m.lastgroup, m.start()
        if kind == "line":
            if deep == 0 and text[m.end() : m.end() + 1] not in ("\n", "#", ""):
                indent = m.end() - i - 1
                if waiting is not None and indent > waiting:
                    defs.append(waiting)
                    yield ("open", "def")
                if waiting is not None or text[line:i].strip():
                    waiting = None
                if _DEF.match(text, line, i):
                    waiting = len(text[line:i]) - len(text[line:i].lstrip())
                    if indent > waiting:
                        defs.append(waiting)
                        yield ("open", "def")
                        waiting = None
                while defs and indent <= defs[-1]:
                    defs.pop()
                    yield ("close", "def")
            begin, line = m.end(), i + 1
        elif kind == "bracket":
            c = m.group()
            if c == "{":
                yield ("open", "brace")
            elif c == "}":
                yield ("close", "brace")
            deep = max(0, deep + (c in "([") - (c in ")]"))
            if c == ">":
                tag = None
            if c not in "[]<>" or tag is not None:
                begin = m.end()
        elif kind == "tag":
            tag, begin = {}, m.end()
            if i >= floor and text[i + 1] != "/" and text[m.end() : m.end() + 1] == ">":
                end = text.find("<", m.end())
                if end > 0 and text.startswith(f"</{m.group()[1:]}", end):
                    a, z = m.end() + 1, end
                    while a < z and text[a].isspace():
                        a += 1
                    while z > a and text[z - 1].isspace():
                        z -= 1
                    if z > a:
                        yield ("set", m.group()[1:], [(a, z)], True, True, False)
        elif kind == "define":
            name = m.group().split()[-1]
            at = m.end()
            while text[at : at + 1] in (" ", "\t"):
                at += 1
            terms, _, quoted, _ = _terms(source, at)
            if terms:
                yield ("set", name, terms, quoted, False, False)
        elif kind == "op" and i >= floor:
            op, at = m.group(), m.end()
            gap = lambda a, b: not text[a:b].strip(" \t?")
            (s0, e0, k0), (s1, e1, k1), (s2, e2, k2) = before
            if k2 == "string" and gap(e2, i):
                name, declares = text[slice(*_string(text, s2, e2)[:2])], False
            elif text[s2:e2] == "]" and k1 == "string" and text[s0:e0] == "[" and gap(e2, i) and gap(e1, s2) and gap(e0, s1):
                name, declares = text[slice(*_string(text, s1, e1)[:2])], False
            else:
                name, declares = _declared(text[begin:i])
            if op == ":" and (typed := _TYPED.match(text, at)):
                at, declares = typed.end(), True
            elif op in (":", ":="):
                declares = True
            while text[at : at + 1] in (" ", "\t"):
                at += 1
            terms, end, quoted, last = _terms(source, at)
            if name:
                yield ("set", name, terms, quoted, declares, op == "+=")
                if tag is not None and terms:
                    tag[name.lower()] = (terms, text[at:end])
                    key, value = tag.get("key") or tag.get("name"), tag.get("value")
                    if key and value and name.lower() in ("key", "name", "value"):
                        yield ("set", key[1].strip("\"'"), value[0], True, True, False)
            # What the value holds is no target, but its last word may be one (a: b: c).
            floor = max(floor, end if quoted else last)
            begin = max(begin, at)
        before = [before[1], before[2], (i, m.end(), kind)]


def propagate(source: Source, events: Iterator[tuple]) -> Iterator[tuple[str, Value, bool]]:
    """(name, value, quoted) of each assignment with a value; names stand for what they were set to last in their scope."""
    known: dict[str, list[tuple[int, Value | None]]] = {}
    scopes: list[tuple[str, set[str]]] = [("file", set())]
    walls = [0]  # the function scopes of indented code, which hide names around them from assignments

    def close():
        for name in scopes[-1][1]:
            known[name].pop()
        scopes.pop()
        if walls[-1] >= len(scopes):
            walls.pop()

    for event in events:
        if event[0] == "open":
            scopes.append((event[1], set()))
            if event[1] == "def":
                walls.append(len(scopes) - 1)
            continue
        if event[0] == "close":
            floor = next((i for i in range(len(scopes) - 1, 0, -1) if scopes[i][0] == event[1]), None) if scopes[-1][0] != event[1] else len(scopes) - 1
            while floor and len(scopes) > floor:
                close()
            continue
        _, name, terms, quoted, declares, adds = event
        parts, skip = [], False
        for t in terms:
            if isinstance(t, str):
                got = (known.get(t) or [(0, None)])[-1][1]
                skip = got is not None
                parts += [got] if skip else []
            elif skip:
                skip = False
            else:
                parts.append(t)
        old = known.setdefault(name, [])
        if adds and old and old[-1][1] is not None:
            parts.insert(0, old[-1][1])
        value = Value(parts, source) if parts else None
        at = len(scopes) - 1
        if not declares and not (old and old[-1][0] >= walls[-1]):
            at = walls[-1] if walls[-1] else at
        elif not declares:
            at = old[-1][0]
        if old and old[-1][0] == at:
            old[-1] = (at, value)
        else:
            old.append((at, value))
            scopes[at][1].add(name)
        if value is not None:
            yield name, value, quoted


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points, sorted: those of the base, and those that the lexer adds."""
    found = set()
    if _HINT.search(text):
        found |= {("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_LITERAL}
    if "AKIA" in text:
        found |= {("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20}
    found |= {("hex", m.start(), m.end()) for m in _HEX.finditer(text)}
    if ":" in text or "=" in text or "define" in text or "ENV" in text or "setenv" in text or "</" in text:
        source, seen = Source(text), ({}, {})
        for name, value, quoted in propagate(source, lex(source)):
            if score(name, value, quoted or value.through) >= LEAST_SCORE:
                found |= {("flow" if value.through else "named", s, e) for s, e in value.spans(seen[value.through]) if e > s}
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        text = batch.column("text")
        for lo in range(0, max(1, len(text)), 256):
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find_secrets(t.as_py() or "")] for t in text.slice(lo, 256)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, 256), pa.array(spans, kind_type)], names=["doc_id", "spans"])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (doc_id, spans array<struct<kind, start, end>>) over whole texts.

    Null texts count as empty and have no spans. Literals and texts may have any length. Null ids and repeated rows pass through. Only the two named columns
    are read, whatever else docs has. Rows are scanned where they are read: there is no shuffle.
    """
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = text.schema["doc_id"].dataType.simpleString()
    return text.mapInArrow(_scan, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int>>")
