"""Tokens and scopes of languages with braces: what stands in strings, comments and brackets, and where blocks end.

One scan cuts a text into words, strings and signs and pairs its brackets with a stack; template literals put code into
strings, so their openings are on the same stack. Statements are then read block by block, and only their heads are
looked at: a declaration ends where its own block or statement ends, whatever its lines look like.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

Symbol = tuple[str, str, bool, int, int]

_CONSTANT = re.compile(r"[A-Z_][A-Z0-9_]*\Z")
_HOOK = re.compile(r"use[A-Z]")

_COMMENT = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)"
_QUOTED = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
_WORD = r"[^\W\d][\w$]*|\$[\w$]*|\d[\w.]*"
_SIGNS = r"=>|->|::|==|!=|<=|>=|&&|\|\|"
#: Per language: what to skip, strings, words.
_FORMS = {
    "typescript": (_COMMENT, _QUOTED, _WORD + r"|\#[\w$]+"),
    "java": (_COMMENT, r'"""[\s\S]*?"""|' + _QUOTED, _WORD),
    "csharp": (_COMMENT + r"|(?<![^\n])[\x20\t]*\#[^\n]*", r'\$*"""+[\s\S]*?"""+|(?:@\$?|\$@)"(?:""|[^"])*"|\$?' + _QUOTED, "@?(?:" + _WORD + ")"),
    "go": (_COMMENT, r"`[^`]*`|" + _QUOTED, _WORD),
    "rust": (_COMMENT, r'b?r(?P<raw>\#*)"[\s\S]*?"(?P=raw)|b?"(?:\\[\s\S]|[^"\\])*"|b?\'(?:\\[^\n]|[^\'\\\n])[^\'\s]{0,8}\'(?!\w)', _WORD),
    "bash": (
        r"(?<![^\s;&|(])\#[^\n]*|\\\n", r"<<-?[\x20\t]*(?P<q>[\"']?)(?P<tag>\w+)(?P=q)(?P<rest>[^\n]*)\n[\s\S]*?(?:(?<=\n)\t*(?P=tag)(?![^\n])|\Z)|'[^']*'|\"(?:\\[\s\S]|[^\"\\])*\"|\$\{(?:[^{}]|\{[^{}]*\})*\}|\\.",
        r"[\w./:@%+~!?*,^$-]+",
    ),
}
_TOKENS = {
    name: re.compile(rf"(?P<skip>[^\S\n]+|{skip})|(?P<line>\n)|(?P<string>{string})|(?P<word>{word})|(?P<sign>{_SIGNS}|[\s\S])", re.DOTALL)
    for name, (skip, string, word) in _FORMS.items()
}
_TEMPLATE = re.compile(r"(?:\\[\s\S]|[^`\\$]|\$(?!\{))*(?P<end>`|\$\{|\Z)")
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
_PAIRS = {")": "(", "]": "[", "}": "{"}
_STRING = "\0"  # the text of string tokens
#: Words after which a slash begins a regular expression.
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "await", "yield"}


class Code:
    """Tokens of a text: texts, starts and ends; pair[i] is the token that closes the bracket i, the last one if none does."""

    def __init__(self, text: str, language: str):
        self.source, self.language = text, language
        self.text: list[str] = []
        self.start: list[int] = []
        self.end: list[int] = []
        self.pair: dict[int, int] = {}
        self._lines = [m.start() for m in re.finditer("\n", text)]
        self._scan(_TOKENS[language], language in ("typescript", "go", "bash"))

    def line(self, offset: int) -> int:
        return bisect_right(self._lines, offset - 1) + 1

    def _put(self, text: str, start: int, end: int) -> None:
        self.text.append(text)
        self.start.append(start)
        self.end.append(end)

    def _scan(self, pattern: re.Pattern, by_lines: bool) -> None:
        text, at, open_, template = self.source, 0, [], self.language == "typescript"
        while at < len(text):
            m = pattern.match(text, at)
            kind, got, begin = m.lastgroup if m.lastgroup in ("skip", "line", "word", "sign") else "string", m.group(), at
            at = m.end()
            if kind == "skip" or kind == "line" and not (by_lines and (not open_ or self.text[open_[-1]] not in "([")):
                continue
            if template and got in ("/", "`") and kind == "sign":
                if got == "/" and self._operand():
                    self._put(got, begin, at)
                    continue
                if got == "/":
                    r = _REGEX.match(text, begin)
                    at = r.end() if r else at
                    self._put(_STRING if r else got, begin, at)
                    continue
                at = self._template(at, begin, open_)
            elif kind == "sign" and got in "([{":
                open_.append(len(self.text))
                self._put(got, begin, at)
            elif kind == "sign" and got in ")]}":
                while open_ and self.text[open_[-1]] != _PAIRS[got] and got == "}" and any(self.text[i] == "{" for i in open_[-8:]):
                    self.pair[open_.pop()] = len(self.text)  # a brace ends what was left open in it
                if open_ and self.text[open_[-1]] == _PAIRS[got]:
                    opener = open_.pop()
                    self.pair[opener] = len(self.text)
                    self._put(got, begin, at)
                    if self.end[opener] - self.start[opener] == 2:  # the "${" of a template goes on as a string
                        at = self._template(at, begin, open_)
            else:
                self._put(_STRING if kind == "string" else got, begin, at)
        for i in open_:
            self.pair[i] = len(self.text) - 1

    def _template(self, at: int, begin: int, open_: list[int]) -> int:
        m = _TEMPLATE.match(self.source, at)
        self._put(_STRING, begin, m.end())
        if m.group("end") == "${":
            open_.append(len(self.text))
            self._put("{", m.end() - 2, m.end())
        return m.end()

    def _operand(self) -> bool:
        """Whether the last token is a value, so that a slash divides it, or the sign before a closing tag."""
        last = next((t for t in reversed(self.text) if t != "\n"), "")
        return last in (_STRING, ")", "]", "}", "<") or (last[:1].isalnum() or last[:1] in "_$#") and last not in _BEFORE_REGEX

    def word(self, i: int) -> bool:
        return i < len(self.text) and (self.text[i][:1].isalpha() or self.text[i][:1] in ("_", "$", "#", "@") and len(self.text[i]) > 1 or self.text[i] == "_")


_GOES_ON = {"=", "+", "-", "*", "/", "%", "&", "|", "^", "?", ":", ",", ".", "<", "=>", "&&", "||", "!", "~", "extends", "implements", "->", "::", "==", "!=", "<=", ">="}
_CONTINUES = (_GOES_ON - {"!", "~"}) | {"(", "[", "{", ">", "instanceof", "in", "as", "satisfies"}
#: Words that declare something with a block of its own, whatever stands between.
_WITH_BLOCK = {"function", "class", "interface", "enum", "namespace", "module", "func", "struct", "fn", "impl", "trait", "mod", "union", "record"}


def _ends(code: Code, i: int, start: int, hi: int) -> bool:
    """Whether the line break i ends the statement that begins at start."""
    last = code.text[i - 1]
    after = next((code.text[j] for j in range(i + 1, min(hi, i + 50)) if code.text[j] != "\n"), "")
    if code.language == "go":
        return last not in _GOES_ON and last not in ("(", "[", "{")
    if code.language == "bash":
        return not (after == "{" and last == ")")
    return last not in _GOES_ON and after not in _CONTINUES


def _is_body(code: Code, start: int, i: int, head: set[str]) -> bool:
    """Whether the brace i is the block that ends the statement from start; head holds the words before it."""
    at = i - 1
    while at > start and code.text[at] == "\n":
        at -= 1
    last = code.text[at] if at >= start and i > start else ""
    if code.language == "bash":
        return last == ")" or code.text[start] == "function"
    if last in (":", "|", "&", "<", "=", "::", "?", "->", "=>") or last == "," and code.language != "rust":
        return False
    if code.language == "go" and last in ("interface", "struct") and code.text[start] == "func":
        return False
    return "=" not in head or bool(head & _WITH_BLOCK)


def statements(code: Code, lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
    """(first token, last token, opening brace of its block or -1) of each statement among tokens lo to hi."""
    start, i, head = -1, lo, set()
    while i < hi:
        t = code.text[i]
        if t == "\n":
            if start >= 0 and _ends(code, i, start, hi):
                yield start, i - 1, -1
                start = -1
            i += 1
            continue
        if start < 0:
            start, head = i, set()
        if t == ";":
            yield start, i, -1
            start = -1
        elif t in ("(", "["):
            i = code.pair[i]
        elif t == "{":
            close = code.pair[i]
            if _is_body(code, start, i, head):
                yield start, close, i
                start = -1
            i = close
        elif t == "=" or not (head & {"="}):  # words behind an equals sign are values
            head.add(t)
        i += 1
    if start >= 0:
        last = hi - 1
        while last > start and code.text[last] == "\n":
            last -= 1
        yield start, last, -1


def _angles(code: Code, i: int) -> int:
    """The token behind the type arguments that begin at i, or i."""
    if i >= len(code.text) or code.text[i] != "<":
        return i
    depth = 0
    for j in range(i, min(len(code.text), i + 2000)):
        depth += {"<": 1, ">": -1, ";": -10_000}.get(code.text[j], 0)
        if depth <= 0:
            return j + 1 if depth == 0 else i
    return i


def _one(code: Code, name: int, kind: str, exported: bool, first: int, last: int) -> Symbol:
    text = code.source[code.start[name] : code.end[name]]
    return text, kind, exported, code.line(code.start[first]), code.line(max(code.start[last], code.end[last] - 1))


def _decorated(code: Code, i: int, hi: int) -> int:
    """The token behind decorators, annotations and attributes."""
    while i < hi:
        t = code.text[i]
        if t == "@" or t[:1] == "@" and len(t) > 1:
            i += 1 if len(t) > 1 else 2
            while i + 1 < hi and code.text[i] == ".":
                i += 2
            i = code.pair[i] + 1 if i < hi and code.text[i] == "(" else i
        elif t == "#" and code.language == "rust":
            while i < hi and code.text[i] != "[":
                i += 1
            i = code.pair.get(i, i) + 1
        elif t == "[" and code.language == "csharp":
            i = code.pair[i] + 1
        elif t == "\n":
            i += 1
        else:
            break
    return i


_TS_MODIFIERS = {"public", "private", "protected", "static", "async", "readonly", "abstract", "override", "declare", "accessor", "get", "set", "*"}


def _typescript(code: Code, lo: int, hi: int, members: bool) -> Iterator[Symbol]:
    for first, last, body in statements(code, lo, hi):
        i = _decorated(code, first, last + 1)
        exported = code.text[i] == "export"
        while i < last and code.text[i] in ("export", "default"):
            i += 1
        begin = i
        while i < last and code.text[i] in ("async", "abstract"):
            i += 1
        word = code.text[i]
        if word == "const" and i < last and code.text[i + 1] == "enum":
            i, word = i + 1, "enum"
        if word in ("const", "let"):
            yield from _declarators(code, i + 1, begin, last, exported)
            continue
        name = i + 2 if word == "function" and i < last and code.text[i + 1] == "*" else i + 1
        if name > last or not code.word(name) or code.text[name] in ("extends", "implements"):
            continue
        if word == "function" and body >= 0:
            yield _one(code, name, "hook" if _HOOK.match(code.text[name]) else "function", exported, begin, last)
        elif word in ("class", "interface", "enum") and body >= 0:
            yield _one(code, name, {"class": "class", "interface": "type", "enum": "enum"}[word], exported, begin, last)
            if word == "class" and members:
                yield from _ts_methods(code, body + 1, last, exported)
        elif word == "type" and "=" in code.text[name : last + 1]:
            yield _one(code, name, "type", exported, begin, last)


def _ts_methods(code: Code, lo: int, hi: int, exported: bool) -> Iterator[Symbol]:
    for first, last, body in statements(code, lo, hi):
        i = begin = _decorated(code, first, last + 1)
        private = False
        while i < last and code.text[i] in _TS_MODIFIERS and code.text[i + 1] not in ("(", "<", "="):
            private |= code.text[i] in ("private", "protected")
            i += 1
        after = _angles(code, i + 1)
        if body >= 0 and code.word(i) and after < body and code.text[after] == "(":
            yield _one(code, i, "method", exported and not private and code.text[i][0] != "#", begin, last)


def _declarators(code: Code, i: int, first: int, last: int, exported: bool) -> Iterator[Symbol]:
    """Names of a const or let with their kinds; each spans the whole statement."""
    while i <= last:
        while i <= last and code.text[i] == "\n":
            i += 1
        if i > last:
            return
        name, end = i, code.pair.get(i, i)
        value, j = -1, end + 1
        while j <= last and not (code.text[j] in (",", ";") and value >= 0) and not (code.text[j] in (",", ";") and value < 0 and code.text[j - 1] != "<"):
            if code.text[j] == "=" and value < 0:
                value = j + 1
            j = _angles(code, j) if value < 0 and code.text[j] == "<" and _angles(code, j) > j else code.pair.get(j, j) + 1
        if code.word(name) or name in code.pair:
            text = code.source[code.start[name] : code.end[end]]
            kind = "hook" if _HOOK.match(text) else "constant" if _CONSTANT.match(text) else "function" if value >= 0 and _is_function(code, value, j) else "variable"
            yield text, kind, exported, code.line(code.start[first]), code.line(code.end[last] - 1)
        i = j + 1


def _is_function(code: Code, i: int, hi: int) -> bool:
    while i < hi and code.text[i] in ("async", "\n"):
        i += 1
    if i < hi and code.text[i] == "function":
        return True
    j = _angles(code, i)
    j = code.pair[j] + 1 if j < hi and code.text[j] == "(" else j + 1 if j == i and code.word(i) else hi
    # Between parameters and arrow only a type may stand.
    return j < hi and (code.text[j] == "=>" or code.text[j] == ":" and "=>" in code.text[j:hi])


_MODIFIERS = {
    "public", "private", "protected", "internal", "static", "final", "abstract", "sealed", "partial", "override", "virtual", "async", "synchronized", "native", "default", "strictfp", "transient",
    "volatile", "readonly", "extern", "unsafe", "new", "const", "required", "file", "non",
}


def _types(code: Code, lo: int, hi: int, members: bool) -> Iterator[Symbol]:
    """Types of Java and C# with their members; types within types are left to themselves."""
    for first, last, body in statements(code, lo, hi):
        i = _decorated(code, first, last + 1)
        begin, modifiers = first, set()
        while i < last and (code.text[i] in _MODIFIERS or code.text[i] in ("@", "[") or code.text[i][:1] == "@" and code.language == "java"):
            modifiers.add(code.text[i])
            i = _decorated(code, i, last) if code.text[i][:1] in ("@", "[") else i + 1
        word = code.text[i]
        if word == "namespace" and code.language == "csharp":
            yield from _types(code, *((body + 1, last) if body >= 0 else (last + 1, last + 1)), members)
            continue
        if word == "record" and i < last and code.text[i + 1] in ("class", "struct"):
            i += 1
        if word not in ("class", "interface", "enum", "struct", "record") or i >= last or not code.word(i + 1):
            continue
        kind = {"interface": "type", "enum": "enum"}.get(word, "class")
        yield _one(code, i + 1, kind, "public" in modifiers, begin, last)
        if body >= 0 and kind != "enum":
            yield from _members(code, body + 1, last)


def _members(code: Code, lo: int, hi: int) -> Iterator[Symbol]:
    java = code.language == "java"
    for first, last, body in statements(code, lo, hi):
        i, modifiers = _decorated(code, first, last + 1), set()
        while i < last and (code.text[i] in _MODIFIERS or code.text[i][:1] == "@" and java):
            modifiers.add(code.text[i])
            i = _decorated(code, i, last) if code.text[i][:1] == "@" else i + 1
        if code.text[i] in ("class", "interface", "enum", "struct", "record", "delegate", "event", "{", "}"):
            continue
        i = _angles(code, i)  # type parameters of a method
        j, words, stop = i, 0, body if body >= 0 else last + 1
        while j < stop and code.text[j] not in ("=", "=>", ";", ","):
            if code.text[j] == "(" and words:
                break
            words += code.text[j] == "(" or code.word(j) and code.text[j - 1] != "."  # a tuple is a type
            j = _angles(code, j) if code.text[j] == "<" and _angles(code, j) > j else code.pair.get(j, j) + 1
        public = "public" in modifiers
        if j < stop and code.text[j] == "(":
            name = j - 1
            if code.text[name] == ">":  # the method's own type parameters
                depth = 0
                while name > i:
                    depth += {">": 1, "<": -1}.get(code.text[name], 0)
                    name -= 1
                    if not depth:
                        break
            if code.word(name) and (java or words > 1) and "operator" not in code.text[i:j]:
                yield _one(code, name, "method", public, first, last)
        elif java and words > 1 and (body < 0 or "=" in code.text[i:body]):
            name = j - 1
            while name > i and not code.word(name):
                name -= 1
            yield _one(code, name, "constant" if "final" in modifiers else "variable", public, first, last)


def _go(code: Code, lo: int, hi: int, members: bool) -> Iterator[Symbol]:
    for first, last, _ in statements(code, lo, hi):
        word = code.text[first]
        if word == "func" and first < last:
            method = code.text[first + 1] == "("
            name = code.pair[first + 1] + 1 if method else first + 1
            if name <= last and code.word(name):
                yield _one(code, name, "method" if method else "function", code.text[name][:1].isupper(), first, last)
        elif word in ("type", "const") and first < last:
            group = code.text[first + 1] == "("
            specs = _specs(code, first + 2, code.pair[first + 1]) if group else [(first + 1, last)]
            for name, end in specs:
                if not code.word(name):
                    continue
                shown = first + 1 if not group else name
                if word == "const":
                    yield _one(code, name, "constant", code.text[name][:1].isupper(), shown, end)
                    continue
                of = code.pair[name + 1] + 1 if name < end and code.text[name + 1] == "[" and code.word(name + 2) and code.word(name + 3) else name + 1
                if of <= end and code.text[of] != "=":
                    yield _one(code, name, "class" if code.text[of] == "struct" else "type", code.text[name][:1].isupper(), shown, end)


def _specs(code: Code, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """First and last token of each line of a group in parentheses, where line breaks are no tokens."""
    i = lo
    while i < hi:
        first, line = i, code.line(code.start[i])
        while i < hi and (code.line(code.start[i]) == line or code.text[i - 1] in _GOES_ON):
            i = code.pair.get(i, i)
            line = code.line(code.start[i])
            i += 1
        yield first, i - 2 if code.text[i - 1] == ";" else i - 1


_RUST = {"fn": "function", "struct": "class", "union": "class", "trait": "type", "enum": "enum", "const": "constant", "static": "constant"}


def _rust(code: Code, lo: int, hi: int, members: bool, kind: str = "function") -> Iterator[Symbol]:
    for first, last, body in statements(code, lo, hi):
        i = begin = _decorated(code, first, last + 1)
        exported = i <= last and code.text[i] == "pub"
        if exported:
            i = code.pair[i + 1] + 1 if i < last and code.text[i + 1] == "(" else i + 1
        while i < last and (code.text[i] in ("async", "unsafe", "default", "extern", _STRING) or code.text[i] == "const" and code.text[i + 1] in ("fn", "async", "unsafe", "extern")):
            i += 1
        word = code.text[i] if i <= last else ""
        name = i + 2 if word == "static" and i < last and code.text[i + 1] == "mut" else i + 1
        if word in ("impl", "trait") and body >= 0 and members and kind == "function":
            if word == "trait":
                yield _one(code, name, "type", exported, begin, last)
            yield from (s for s in _rust(code, body + 1, last, members, "method") if s[1] == "method")
        elif word in _RUST and name <= last and code.word(name) and (word != "fn" or body >= 0):
            yield _one(code, name, kind if word == "fn" else _RUST[word], exported, begin, last)


def _unbroken(code: Code, i: int, last: int) -> bool:
    """Whether no blank stands between the tokens i to last, outside brackets."""
    while i < last:
        i = code.pair.get(i, i)
        if i < last and code.end[i] != code.start[i + 1]:
            return False
        i += 1
    return True


_OPENS, _CLOSES = {"if", "for", "while", "until", "select", "case"}, {"fi", "done", "esac"}


def _bash(code: Code, lo: int, hi: int, members: bool) -> Iterator[Symbol]:
    deep = 0
    for first, last, body in statements(code, lo, hi):
        word = code.text[first]
        deep = max(0, deep + (word in _OPENS) - (word in _CLOSES))
        if deep or word in _CLOSES:
            continue
        end = last - 1 if code.text[last] == ";" and last > first else last
        name = first + 1 if word == "function" else first
        if body >= 0 and name < body and code.word(name):
            yield _one(code, name, "function", not code.text[name].startswith("_"), first, last)
        elif first < end and code.text[first + 1] == "=" and re.fullmatch(r"[A-Za-z_]\w*\+?", word):
            if _unbroken(code, first, end):  # else it is set for one command
                text = word.rstrip("+")
                yield text, "constant" if _CONSTANT.match(text) else "variable", not text.startswith("_"), code.line(code.start[first]), code.line(code.end[end] - 1)


_READERS: dict[str, Callable] = {"typescript": _typescript, "java": _types, "csharp": _types, "go": _go, "rust": _rust, "bash": _bash}


def symbols(language: str, members: bool = True) -> Callable[[str], list[Symbol]]:
    """Declarations of a text: (name, kind, exported, first line, last line). members: methods of TypeScript classes and Rust impls too."""

    def parse(text: str) -> list[Symbol]:
        code = Code(text, language)
        return list(_READERS[language](code, 0, len(code.text), members))

    return parse
