"""Symbols of source files: a table function per language, applied file by file without a shuffle."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from tessella.sources.scopes import Symbol, symbols

_CONSTANT = re.compile(r"[A-Z_][A-Z0-9_]*\Z")


def _python(text: str, members: bool = True) -> list[Symbol]:
    """Top-level definitions and assignments, with the methods of classes; `__all__` says what is exported where it is set."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out: list[Symbol] = []
    listed = None
    for node in tree.body:
        if isinstance(node, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in node.targets):
            listed = {x.value for x in ast.walk(node.value) if isinstance(x, ast.Constant) and isinstance(x.value, str)}

    def put(name, kind, node, exported=None):
        known = name in listed if listed is not None else not name.startswith("_")
        out.append((name, kind, known if exported is None else exported, node.lineno, node.end_lineno))

    for node in tree.body:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            put(node.name, "function", node)
        elif isinstance(node, ast.ClassDef):
            put(node.name, "class", node)
            outside = listed is None or out[-1][2]
            for sub in node.body if members else ():
                if isinstance(sub, ast.FunctionDef | ast.AsyncFunctionDef):
                    put(sub.name, "method", sub, outside and not sub.name.startswith("_"))
        elif isinstance(node, ast.Assign | ast.AnnAssign):
            for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
                if isinstance(t, ast.Name) and t.id != "__all__":
                    put(t.id, "constant" if _CONSTANT.match(t.id) else "variable", node)
    return out


def _flat(*rules: tuple[str, str, int]) -> Callable[[str], list[Symbol]]:
    """Names by patterns without line ranges (all on line 1)."""
    return lambda text: [(m.group(1), kind, True, 1, 1) for kind, p, flags in rules for m in re.finditer(p, text, flags | re.MULTILINE)]


# Declaration patterns of the languages that are read by pattern alone.
_YAML = _flat(("variable", r"^([a-zA-Z_][\w-]*):", 0), ("constant", r"^  ([a-zA-Z_][\w-]*):", 0))
_OTHER = _flat(("function", r"^([a-zA-Z_][\w.-]*):", 0), ("class", r"^FROM\s+\S+\s+AS\s+(\S+)", re.IGNORECASE), ("constant", r"^([A-Z][A-Z0-9_]*)=", 0))
_SQL_FORM = re.compile(r"CREATE\s+(?:OR\s+REPLACE\s+)?(TABLE|FUNCTION|PROCEDURE|VIEW|INDEX|TRIGGER)\s+(?:IF\s+NOT\s+EXISTS\s+)?(\w+)", re.IGNORECASE)
_SQL_KINDS = {"TABLE": "class", "FUNCTION": "function", "PROCEDURE": "function", "TRIGGER": "function"}


def _sql(text: str) -> list[Symbol]:
    return [(m[2], _SQL_KINDS.get(m[1].upper(), "variable"), True, 1, 1) for m in _SQL_FORM.finditer(text)]


def _json(text: str) -> list[Symbol]:
    try:
        got = json.loads(text)
    except ValueError:
        return []
    return [(k, "variable", True, 1, 1) for k in got] if isinstance(got, dict) else []


def significant_lines(text: str) -> int:
    """Lines that are neither blank nor comments."""
    return sum(1 for x in text.split("\n") if x.strip() and not x.strip().startswith(("#", "//", "--", "/*", "*")))


def _fallback(text: str) -> list[Symbol]:
    return _OTHER(text) if significant_lines(text) >= 5 else []


def _adapters(members: bool) -> dict[str, tuple[str, str, Callable[[str], list[Symbol]]]]:
    """(language, parse method, reader) by extension; a new language is a new entry."""
    scoped = lambda language, name=None: (name or language, "scopes", symbols(language, members))
    return {
        **{e: scoped("typescript") for e in (".ts", ".mts", ".cts")}, ".tsx": scoped("typescript", "tsx"), **{e: scoped("bash") for e in (".sh", ".bash")},
        ".py": ("python", "ast", lambda text: _python(text, members)), ".rs": scoped("rust"), ".go": scoped("go"), ".java": scoped("java"), ".cs": scoped("csharp"),
        ".sql": ("sql", "pattern", _sql), ".yml": ("yaml", "pattern", _YAML), ".yaml": ("yaml", "pattern", _YAML), ".json": ("json", "ast", _json),
    }


ADAPTERS, TOP_LEVEL = _adapters(True), _adapters(False)


def parse_text(file: str, text: str, members: bool = True) -> tuple[str, str, list[Symbol]]:
    """(language, parse method, symbols) of one file."""
    dot = file.rfind(".")
    adapters = ADAPTERS if members else TOP_LEVEL
    language, method, parse = adapters.get(file[dot:].lower() if dot >= 0 else "", ("unknown", "heuristic", _fallback))
    return language, method, parse(text)


def parse_files(files: DataFrame, members: bool = True) -> DataFrame:
    """files (file, content) to (file, language, parse_method, name, kind, exported, line_start, line_end); one row a symbol.

    members: methods of Python and TypeScript classes and of Rust impls count too, not only what stands at the top.
    """
    columns = ["file", "language", "parse_method", "name", "kind", "exported", "line_start", "line_end"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for file, text in zip(pdf["file"], pdf["content"], strict=True):
                language, method, found = parse_text(file, text or "", members)
                rows += [(file, language, method, *s) for s in found]
            yield pd.DataFrame(rows, columns=columns)

    return files.select("file", "content").mapInPandas(run, "file string, language string, parse_method string, name string, kind string, exported boolean, line_start int, line_end int")
