"""Queries for parsers, scanners of texts and providers, over sources that are built around the documents."""

from __future__ import annotations

import re
from functools import partial

from pyspark.sql import functions as F

from tessella.functions import scanners as Z
from tessella.operators import intervals as I
from tessella.operators import providers as V
from tessella.plans.base import Catalog, folder, table
from tessella.plans.q_more import _of
from tessella.sources import parse

CATALOG = Catalog()
c = F.col


def _files(spark, sf, extension, *parts):
    return table(spark, sf, "documents").select(_of("d", c("doc_id"), extension).alias("file"), _of(*parts).alias("content"))


#: Per extension: language, parse method, and the lines of a file. A line is a text, or a text with the symbols that begin
#: (name, kind, exported) and the number of open symbols that end on it; a line in a list is there doc_id % 4 times.
#: "@lang" and "@doc_id" stand for the document's own.
_PARSED = {
    ".py": ("python", "ast", [
        "__all__ = ['f_@lang', 'C@doc_id']", ("def f_@lang(", [("f_@lang", "function", True)], 0), "        x,", "):", ["    # def no(): }"], "    def inner():", "        pass", ("    return x", [], 1), "",
        ("class C@doc_id:", [("C@doc_id", "class", True)], 0), ("    async def m(self):", [("m", "method", True)], 0), ["        self.y = 'class N:'"], ("        return 1", [], 2), ("LIMIT = 3", [("LIMIT", "constant", False)], 1),
    ]),
    ".ts": ("typescript", "scopes", [
        "// class No {", ("export async function use_@lang<T = {}>(", [("use_@lang", "function", True)], 0),
        "  a: string,", "  b: { c: number },", "  d = `x ${ a + `in ${b} {` } }`,", "  e = /[/}]{/g,", "): Promise<{ ok: boolean }>", "{", ["  const s = '} \\' {' // }"], "  function inner() { return 1 / 2 / 3; }", ("}", [], 1),
        ("export abstract class K@doc_id<T> extends B", [("K@doc_id", "class", True)], 0), "{", "  field = { a: 1 };", "  arrow = () => {", ["    /* } */"], "  }",
        ("  constructor(private readonly z: string) { super(); }", [("constructor", "method", True)], 1), ("  public async run_@lang<T>(", [("run_@lang", "method", True)], 0), "    a: T,", "  ): Promise<void> {", ["    if (a) { }"], ("  }", [], 1),
        ("  private static get value(): number { return 1 }", [("value", "method", False)], 1), "  abstract nobody(): void;", ("}", [], 1),
        ("export const MAX = 1, pick = async (x) => {", [("MAX", "constant", True), ("pick", "function", True)], 0), ["  x += `${x}`"], ("}", [], 2), ("const useIt = 3", [("useIt", "hook", False)], 1),
        ("type U =", [("U", "type", False)], 0), "  | 'a'", ("  | { b: 1 };", [], 1), ("interface I@doc_id { a: string }", [("I@doc_id", "type", False)], 1), "declare function nope(): void;", ("export const enum E { A, B }", [("E", "enum", True)], 1),
    ]),
    ".java": ("java", "scopes", [
        "package p;", ('@Ann(x = "{")', [("A@doc_id", "class", True)], 0), "public final class A@doc_id<T extends B<T>> implements C {",
        ("  private static final Map<String, List<Integer>> MAP = new HashMap<>();", [("MAP", "constant", False)], 1), ("  int[] a_@lang = {1, 2}, b;", [("a_@lang", "variable", False)], 1), ("  public A@doc_id(int x) { this.x = x; }", [("A@doc_id", "method", True)], 1),
        ("  public <R> R call(", [("call", "method", True)], 0), "      String a,", "      int... b) throws X,", "      Y {", ['    String s = "}";  // }'], "    class Local { void no() {} }", ("  }", [], 1),
        ("  abstract void none();", [("none", "method", False)], 1), "  class Inner { void hid() {} }", ('  String t = """', [("t", "variable", False)], 0), "    text } block", ('    """;', [], 1), ("}", [], 1),
        ("interface I_@lang { void f(); }", [("I_@lang", "type", False), ("f", "method", False)], 2), ("enum E { X, Y; void no() {} }", [("E", "enum", False)], 1),
    ]),
    ".cs": ("csharp", "scopes", [
        "#region {", "namespace N.M {", ("  [Attr(1)]", [("A@doc_id", "class", True)], 0), "  public class A@doc_id : B, I<int> where T : new()", "  {", "    public int X { get; set; } = 5;", '    private readonly string s = @"a ""}"" ";', "    public A@doc_id() : base() { }",
        ("    public async Task<List<int>> Run_@lang<T>(", [("Run_@lang", "method", True)], 0), "        int a,", '        string b = $"{a}}}")', "        where T : class", "    {", ["      var x = new { A = '}' };"], ("    }", [], 1),
        ("    int Expr(int x) => x + 1;", [("Expr", "method", False)], 1), ("    public (int a, int b) Pair() { return (1, 2); }", [("Pair", "method", True)], 1), ("  }", [], 1), ("  internal struct S { void M() {} }", [("S", "class", False), ("M", "method", False)], 2), "}", "#endregion",
    ]),
    ".go": ("go", "scopes", [
        "package p", ("func Big@doc_id(", [("Big@doc_id", "function", True)], 0), "  a int,", "  b interface{},", ") (interface{}, error) {", ["  s := `raw { `"], "  return func() { }, nil", ("}", [], 1), ("func (t *T) small_@lang() {", [("small_@lang", "method", False)], 0), ("}", [], 1),
        "const (", ("  First = iota", [("First", "constant", True)], 1), ("  second", [("second", "constant", False)], 1), ")", ("type T struct {", [("T", "class", True)], 0), "  m map[string]struct{}", ("}", [], 1), "type (", ("  U interface { F() }", [("U", "type", True)], 1), ("  W struct {", [("W", "class", True)], 0), ["    x int // }"], ("  }", [], 1), ")",
    ]),
    ".rs": ("rust", "scopes", [
        "use a::{b, c};", "#[derive(Debug)]", ("pub struct P@doc_id { a: i32 }", [("P@doc_id", "class", True)], 1), ("pub(crate) const X: [u8; 3] = [1, 2, 3];", [("X", "constant", True)], 1), ("pub async fn run_@lang<'a, I>(x: &'a str) -> Result<(), E>", [("run_@lang", "function", True)], 0), "where", "    I: Iterator<Item = u8>,", "{",
        ['    let c = \'{\'; let r = r#"}"{"#;'], "    fn inner() {}", ("}", [], 1), "impl<T> P@doc_id {", ("    pub fn m(&self) -> i32 {", [("m", "method", True)], 0), ["        /* } */"], ("    }", [], 1), "}", ("enum E_@lang { A { x: i32 }, B }", [("E_@lang", "enum", False)], 1), "mod t { fn hidden() {} }",
    ]),
    ".sh": ("bash", "scopes", [
        "#!/bin/bash", "# no() {", ('NAME="a } b"', [("NAME", "constant", True)], 1), ("low_@lang=$(cmd {a,b})", [("low_@lang", "variable", True)], 1), "X=1 cmd run", ("function alpha {", [("alpha", "function", True)], 0), ["  local y=2"], ("}", [], 1),
        ("_beta@doc_id()", [("_beta@doc_id", "function", False)], 0), "{", "  cat <<EOF", "} not { here", "EOF", ["  Z=3 # }"], ("}", [], 1), "if true; then", "  IN=1", "fi", ("END=1", [("END", "constant", True)], 1),
    ]),
    ".json": ("json", "ast", [('{"a_@lang": 1, "b": {"c": 2}}', [("a_@lang", "variable", True), ("b", "variable", True)], 2)]),
}


def _sql(text):
    """SQL of a text with the document's own parts."""
    return "concat('" + text.replace("@lang", "', lang, '").replace("@doc_id", "', doc_id, '") + "', '')"


def _symbols(lines):
    """SQL rows (name, kind, exported, first line, last line) of a file's symbols: lines follow from those before."""
    rows, open_, fixed, repeated = [], [], 0, 0
    for entry in lines:
        if isinstance(entry, list):
            repeated += 1
            continue
        _, begins, ends = entry if isinstance(entry, tuple) else (entry, [], 0)
        fixed += 1
        at = f"CAST({fixed} + {repeated} * (doc_id % 4) AS INTEGER)"
        open_ += [(*x, at) for x in begins]
        rows += [(*open_.pop(), at) for _ in range(ends)]
    return rows


def _content(lines):
    own = {"@lang": c("lang"), "@doc_id": c("doc_id").cast("string")}
    text = lambda line: F.concat(*[own[x] if x in own else F.lit(x) for x in re.split("(@lang|@doc_id)", line + "\n")])
    return F.concat(*[F.repeat(text(x[0]), F.pmod(c("doc_id"), F.lit(4)).cast("int")) if isinstance(x, list) else text(x[0] if isinstance(x, tuple) else x) for x in lines])


def _parsed(extension):
    language, method, lines = _PARSED[extension]
    sql = " UNION ALL ".join(
        f"SELECT 'd' || doc_id || '{extension}' AS file, '{language}' AS language, '{method}' AS parse_method, {_sql(name)} AS name, '{kind}' AS kind, {str(e).lower()} AS exported, {a} AS line_start, {b} AS line_end FROM documents"
        for name, kind, e, a, b in _symbols(lines)
    )

    def query(spark, sf):
        return parse.parse_files(table(spark, sf, "documents").select(_of("d", c("doc_id"), extension).alias("file"), _content(lines).alias("content")))

    CATALOG.add(f"parsed_{language}", sql)(query)


for _extension in _PARSED:
    _parsed(_extension)


@CATALOG.add("significant_lines", r"SELECT doc_id, len(list_filter(string_split(concat(text, chr(10), '# note', chr(10), '  // x', chr(10), chr(10)), chr(10)), lambda x: NOT regexp_matches(x, '^\s*$') AND NOT regexp_matches(x, '^\s*(#|//|--|/\*|\*)'))) AS n FROM documents")
def significant_lines(spark, sf):
    n = Z.scalar(parse.significant_lines, "long")
    return table(spark, sf, "documents").select("doc_id", n(_of(c("text"), "\n# note\n  // x\n\n")).alias("n"))


@CATALOG.add("readme_parts", "SELECT 'd' || doc_id || '.md' AS file, p AS position, l AS level, CASE p WHEN 0 THEN source WHEN 1 THEN 'Use it' ELSE 'End' END AS heading, CASE p WHEN 0 THEN 'Intro ' || lang WHEN 1 THEN concat('```', chr(10), '# not a head', chr(10), '```') ELSE '' END AS content FROM documents, (SELECT unnest([0, 1, 2]) AS p, unnest([1, 2, 2]) AS l)")
def readme_parts(spark, sf):
    return Z.explode_readme(_files(spark, sf, ".md", "lost\n# ", c("source"), "\nIntro ", c("lang"), "\n\n## Use it\n```\n# not a head\n```\n## End\n")).select("file", "position", "level", "heading", "content")


@CATALOG.add("readme_section", "SELECT doc_id, concat('one', chr(10), '### Deeper', chr(10), lang) AS section FROM documents")
def readme_section(spark, sf):
    of = Z.scalar(lambda text: Z.section_of(text, "usage"), "string")
    return table(spark, sf, "documents").select("doc_id", of(_of("# Top\n## Usage\none\n### Deeper\n", c("lang"), "\n## Next\nno\n")).alias("section"))


@CATALOG.add("doc_comments", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN concat('/**', chr(10), '* Says ', lang, chr(10), '*/') END AS comment FROM documents")
def doc_comments(spark, sf):
    of = Z.scalar(lambda text: Z.doc_comment(text, 6), "string")
    text = F.when(c("doc_id") % 2 == 0, _of("/**\n * Says ", c("lang"), "\n */\n@deco\n\nfunction f() {}\n")).otherwise(_of("/** early */\n\nlet a;\n\n\nfunction f() {}\n"))
    return table(spark, sf, "documents").select("doc_id", of(text).alias("comment"))


@CATALOG.add("plain_types", "SELECT doc_id, doc_id % 3 <> 0 AS plain FROM documents")
def plain_types(spark, sf):
    of = Z.scalar(Z.is_self_descriptive, "boolean")
    return table(spark, sf, "documents").select("doc_id", of(_of("{\n  name: string;\n  readonly size?: number;\n", F.when(c("doc_id") % 3 == 0, "  x: number;\n").otherwise(""), "}")).alias("plain"))


@CATALOG.add("array_bounds", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'A and B have 3 elements each' END AS refuted FROM documents")
def array_bounds(spark, sf):
    of = Z.scalar(Z.refute_bounds, "string")
    source = _of("const A: number[] = [1, f(2, 3), [4, 5]];\nlet B = ['x', 'y'", F.when(c("doc_id") % 2 == 0, ", 'z',").otherwise(""), "];\n")
    return table(spark, sf, "documents").select("doc_id", of(F.lit("`A` has 3 elements but `B` has 2"), source).alias("refuted"))


@CATALOG.add("help_commands", "SELECT doc_id, ['run', 'show-' || lang] AS names FROM documents")
def help_commands(spark, sf):
    of = Z.scalar(Z.subcommands, "array<struct<name:string,text:string>>")
    text = _of("Usage: x\n\nOptions:\n  help  not one\n\nCommands:\n  run [file]  Runs it\n  show-", c("lang"), "|s <a>  Shows ", c("source"), "\n\nMore:\n  other  no\n")
    return table(spark, sf, "documents").select("doc_id", F.transform(of(text), lambda x: x["name"]).alias("names"))


@CATALOG.add("instructions", "SELECT doc_id, 'be ' || lang AS style, 'yes' AS naming FROM documents")
def instructions(spark, sf):
    of = Z.scalar(lambda text: Z.user_instructions(text, ["style", "naming_rules"]), "map<string,string>")
    got = of(_of("# T\n## Style\nold\n## Naming Rules!\nyes\n## Unknown\nno\n## style\nbe ", c("lang"), "\n"))
    return table(spark, sf, "documents").select("doc_id", got["style"].alias("style"), got["naming_rules"].alias("naming"))


@CATALOG.add("unticked_actions", "SELECT doc_id, ['A' || doc_id, 'C'] AS ids, ['high', ''] AS severities, ['f' || source, ''] AS files FROM documents")
def unticked_actions(spark, sf):
    got = Z.unchecked_actions(_of("- [ ] <!-- A", c("doc_id"), " --> **[high]** Mend it (`f", c("source"), "`)\n- [x] <!-- B --> done\n- [ ] <!-- C --> plain\n"))
    of = lambda n: F.transform(got, lambda x: x[n])
    return table(spark, sf, "documents").select("doc_id", of("id").alias("ids"), of("severity").alias("severities"), of("file").alias("files"))


@CATALOG.add("first_json", "SELECT doc_id, concat('{\"a\": \"', lang, ' }\", \"b\": [1, 2]}') AS found FROM documents")
def first_json(spark, sf):
    return table(spark, sf, "documents").select("doc_id", Z.extract_json(_of("Sure, here: {\"a\": \"", c("lang"), " }\", \"b\": [1, 2]} and more }")).alias("found"))


@CATALOG.add("embedded_texts", "SELECT doc_id, doc_id % 4 = 0 AS is_zero, 64 AS dim FROM documents")
def embedded_texts(spark, sf):
    """Every fourth text is empty or null: it gets a zero vector and never reaches the provider."""
    d = table(spark, sf, "documents").select("doc_id", F.when(c("doc_id") % 8 == 0, F.lit(None).cast("string")).when(c("doc_id") % 4 == 0, "").otherwise(_of("word ", c("source"))).alias("t"))
    return V.embed(d, c("t"), "v", V.HashingEmbedder, 64).select("doc_id", (~F.exists("v", lambda x: x != 0)).alias("is_zero"), F.size("v").alias("dim"))


class Shouter:
    """A provider that answers in capitals and fails on every tenth row."""

    def evaluate(self, row):
        if row["id"] % 10 == 0:
            raise ValueError("no answer")
        return [{"id": row["id"], "value": row["t"].upper()}]


@CATALOG.add("provider_answers", "SELECT doc_id AS id, CASE WHEN doc_id % 10 <> 0 THEN upper(source) END AS value, CASE WHEN doc_id % 10 = 0 THEN 'ValueError: no answer' END AS error FROM documents")
def provider_answers(spark, sf):
    return V.evaluate(table(spark, sf, "documents").select(c("doc_id").alias("id"), c("source").alias("t")), Shouter, "id long, value string", calls=4)


class Summarizer:
    def evaluate(self, row):
        return [{"id": row["id"], "body_hash": row["body_hash"], "value": "new " + row["id"]}]


@CATALOG.add("cached_summaries", "SELECT 'd' || doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'old' ELSE 'new d' || doc_id END AS value FROM documents")
def cached_summaries(spark, sf):
    """Every second body is cached, but a third of all with another hash than now."""
    d = table(spark, sf, "documents").select(_of("d", c("doc_id")).alias("id"), _of("h", c("doc_id")).alias("body_hash"), "doc_id")
    cache = d.filter("doc_id % 3 <> 1").select("id", F.when(c("doc_id") % 3 == 0, c("body_hash")).otherwise("stale").alias("body_hash"), F.lit("old").alias("value"))
    return V.summarize(d.drop("doc_id"), cache, Summarizer).select("id", "value")


@CATALOG.add("unique_without_asking", "SELECT 'd' || doc_id AS name, CASE WHEN doc_id % 5 <= 2 OR doc_id % 3 = 0 THEN 'UNIQUE' END AS auto FROM documents")
def unique_without_asking(spark, sf):
    d = table(spark, sf, "documents").select(F.lit("f").alias("file"), _of("d", c("doc_id")).alias("name"), (c("doc_id") % 5).alias("lines"), "doc_id")
    return V.auto_unique(d, d.filter("doc_id % 3 <> 0").select("file", "name")).select("name", "auto")


class _Fails:
    """A provider that does not answer for multiples of a number."""

    def __init__(self, by):
        self.by = by

    def evaluate(self, row):
        if row["id"] % self.by == 0:
            raise ValueError("no answer")
        return [{"id": row["id"], "value": f"by {self.by}"}]


def _routed(spark, sf):
    """Every fourth row's model begins with a provider that is down; all end with a fallback."""
    d = table(spark, sf, "documents").select(c("doc_id").alias("id"), F.when(c("doc_id") % 4 == 0, "x-1").otherwise("m-1").alias("model"))
    router = V.Router({"x-": ["down", "third"], "m-": ["third"]}, ["backup"])
    return V.evaluate_routed(d, router, {name: partial(_Fails, by) for name, by in (("down", 1), ("third", 3), ("backup", 15))}, "id long, value string", folder(spark, "routed"), attempts=1)


@CATALOG.add("provider_routes", """SELECT doc_id AS id, CASE WHEN doc_id % 3 <> 0 THEN 'by 3' WHEN doc_id % 15 <> 0 THEN 'by 15' END AS value, CASE WHEN doc_id % 3 <> 0 THEN 'third' ELSE 'backup' END AS provider,
CASE WHEN doc_id % 15 = 0 THEN 'ValueError: no answer' END AS error FROM documents""")
def provider_routes(spark, sf):
    return _routed(spark, sf).answers


@CATALOG.add("provider_circuits", """WITH d AS (SELECT doc_id % 4 = 0 AS x, doc_id % 3 = 0 AS t, doc_id % 15 = 0 AS b FROM documents)
SELECT CAST(0 AS INTEGER) AS pass, 'down' AS provider, count(*) AS n_calls, count(*) AS n_failed, true AS open FROM d WHERE x UNION ALL
SELECT 0, 'third', count(*), count(*) FILTER (t), false FROM d WHERE NOT x UNION ALL SELECT 1, 'third', count(*), count(*) FILTER (t), false FROM d WHERE x UNION ALL
SELECT 1, 'backup', count(*), count(*) FILTER (b), false FROM d WHERE NOT x AND t UNION ALL SELECT 2, 'backup', count(*), count(*) FILTER (b), false FROM d WHERE x AND t""")
def provider_circuits(spark, sf):
    """Calls and failures of each provider by pass, and whose circuit is open."""
    return _routed(spark, sf).circuits


@CATALOG.add("covered_days", """WITH s AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS a, CAST(CAST(l_shipdate AS DATE) + to_days(CAST(2 * l_linenumber AS INTEGER)) AS DATE) AS b FROM lineitem),
days AS (SELECT DISTINCT l_suppkey, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM s),
runs AS (SELECT l_suppkey, count(*) AS length, count(*) FILTER (first) AS n_runs FROM (SELECT l_suppkey, lag(day) OVER (PARTITION BY l_suppkey ORDER BY day) IS DISTINCT FROM CAST(day - INTERVAL 1 DAY AS DATE) AS first FROM days) GROUP BY l_suppkey)
SELECT l_suppkey, n_intervals, length, n_runs FROM runs JOIN (SELECT l_suppkey, count(*) AS n_intervals FROM s GROUP BY l_suppkey) USING (l_suppkey)""")
def covered_days(spark, sf):
    """Days on which a supplier has something on its way: a line item is two days on its way per line number."""
    day = F.unix_date(c("l_shipdate").cast("date"))
    return I.union_lengths(table(spark, sf, "lineitem").select("l_suppkey", day.alias("a"), (day + 2 * c("l_linenumber")).alias("b")), ["l_suppkey"], "a", "b")
