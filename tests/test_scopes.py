"""Declarations of languages with braces: scopes, strings and comments that look like code, and broken texts."""

from __future__ import annotations

import time

import pytest

from tessella.sources.parse import parse_text
from tessella.sources.scopes import symbols


def found(file, text, **more):
    return parse_text(file, text, **more)[2]


CASES = [
    # strings, comments, templates and regular expressions hide what they hold
    ("a.ts", "const a = `x ${`y ${ {b: '}'} } {`} `;\nfunction f() {}\n", [("a", "variable", False, 1, 1), ("f", "function", False, 2, 2)]),
    ("a.ts", "const re = /['\"`{]/, half = a / 2 / b\nlet next = 1\n", [("re", "variable", False, 1, 1), ("half", "variable", False, 1, 1), ("next", "variable", False, 2, 2)]),
    ("a.ts", "/* function no() {} */ // class No {\nfunction yes() { /* } */ }\n", [("yes", "function", False, 2, 2)]),
    # statements go on over lines, and end without semicolons
    ("a.ts", "const total = first\n  + second\n  .third\nlet rest = 1\n", [("total", "variable", False, 1, 3), ("rest", "variable", False, 4, 4)]),
    ("a.ts", "export const table: Record<string, { a: number }> = {\n  x: { a: 1 },\n}\nexport type T = { a: 1 }\n", [("table", "variable", True, 1, 3), ("T", "type", True, 4, 4)]),
    ("a.tsx", "export function App() {\n  return <div a={x}>{y && <b/>}</div>\n}\nconst B = () => <a>it's {z}</a>\n", [("App", "function", True, 1, 3), ("B", "constant", False, 4, 4)]),
    ("a.ts", "class A {\n  get = 1\n  static async *items(): X { }\n  ['computed']() {}\n  set(v: T) { }\n  over(a: string): void\n  over(a: any) { }\n}\n", [("A", "class", False, 1, 8), ("items", "method", False, 3, 3), ("set", "method", False, 5, 5), ("over", "method", False, 7, 7)]),
    ("a.ts", "namespace N { export function no() {} }\ndeclare class D { f(): void }\nexport { a, b } from './x'\nexport default { c: 1 }\nfunction g() {}\n", [("g", "function", False, 5, 5)]),
    ("A.java", "class A {\n  Map<String, List<X>> get(\n    @Ann(v = {1}) int a) {\n    return new X() { void no() {} };\n  }\n  X x = new X() { int y = 1; };\n}\n", [("A", "class", False, 1, 7), ("get", "method", False, 2, 5), ("x", "variable", False, 6, 6)]),
    ("A.java", "public interface I<T> {\n  int LIMIT = 3;\n  <R> R map(F<T, R> f);\n}\n", [("I", "type", True, 1, 4), ("LIMIT", "variable", False, 2, 2), ("map", "method", False, 3, 3)]),
    ("a.cs", "namespace A;\npublic record struct P(int X);\nclass C {\n  void F<T>() where T : class { }\n  string this[int i] { get { return \"}\"; } }\n  event Action E;\n  delegate void D(int a);\n}\n", [("P", "class", True, 2, 2), ("C", "class", False, 3, 8), ("F", "method", False, 4, 4)]),
    ("a.go", "package a\nvar x = T{a: 1}\nfunc f(a int) map[string]struct{} {\n\treturn nil\n}\ntype A = B\ntype G[K comparable, V any] struct { k K }\nconst A, B = 1, 2\n", [("f", "function", False, 3, 5), ("G", "class", True, 7, 7), ("A", "constant", True, 8, 8)]),
    ("a.rs", "pub trait T { fn sig(&self); fn body(&self) { let c = '}'; } }\nimpl<'a> T for P<'a> { fn sig(&self) {} }\nstatic mut S: &str = r##\"}\"#\"##;\nextern \"C\" { fn no(); }\n", [("T", "type", True, 1, 1), ("body", "method", False, 1, 1), ("sig", "method", False, 2, 2), ("S", "constant", False, 3, 3)]),
    ("a.sh", "for i in 1 2; do\n  A=1\ndone\nB=\"x\n}\"\nf() { C=1; }; D=2\nE=1 F=2\ncase $x in\n  a) G=1 ;;\nesac\nH=${x:-{}\n", [("B", "constant", True, 4, 5), ("f", "function", True, 6, 6), ("D", "constant", True, 6, 6), ("H", "constant", True, 11, 11)]),
]


@pytest.mark.parametrize(("file", "text", "want"), CASES)
def test_declarations(file, text, want):
    assert found(file, text) == want


def test_without_members_only_the_top_counts():
    ts = "export class A {\n  m() {}\n}\n"
    assert [x[0] for x in found("a.ts", ts)] == ["A", "m"] and [x[0] for x in found("a.ts", ts, members=False)] == ["A"]
    py = "class A:\n    def m(self): pass\n"
    assert [x[0] for x in found("a.py", py)] == ["A", "m"] and [x[0] for x in found("a.py", py, members=False)] == ["A"]
    assert [x[0] for x in found("a.rs", "impl A { fn m() {} }\nfn f() {}", members=False)] == ["f"]


def test_listed_names_are_the_exported_ones():
    text = "__all__ = ['_a']\ndef _a(): pass\ndef b(): pass\n"
    assert found("x.py", text) == [("_a", "function", True, 2, 2), ("b", "function", False, 3, 3)]


@pytest.mark.parametrize("language", ["typescript", "java", "csharp", "go", "rust", "bash"])
def test_broken_and_long_texts_end_in_time(language):
    read = symbols(language)
    began = time.perf_counter()
    for text in ("", "\n", "{" * 50_000, "}" * 50_000, "([{" * 20_000, "`${" * 30_000, "class A {\n" * 20_000, "function f() {\n" * 20_000, "a < " * 40_000, "'" * 99_999, '"' * 99_999, "/" * 100_000, "fn f<" * 30_000, "const a = 1, " * 20_000, "x = y\n" * 40_000, "\\" * 99_999, "<<A\n" * 5_000, "/*" * 50_000, "é" * 100_000, "((" * 20 + ")}" * 20, "type a = " * 20_000, "${" * 30_000, "\n" * 100_000):
        read(text)
    assert time.perf_counter() - began < 40
