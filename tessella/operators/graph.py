"""Usage graph: imports, resolution, edges and what follows from them.

All joins are equi-joins on files or (file, symbol); candidate paths are exploded with their rank and the best hit is
an aggregate, so nothing is looked up row by row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import strip_code

c = F.col

UTILITY = ["file", "name", "value", "confidence", "detail"]
#: Files up to which they are broadcast, rows of a product that a task makes, and its tasks at most.
BROADCAST_ROWS, ROWS_A_TASK, TASKS = 1_000_000, 5_000_000, 4096

# Statement patterns per language and languages without imports.
IMPORT_FORMS = [  # kind, type only, pattern with (names, specifier) or (specifier)
    ("named", False, r"import\s+(?:\w+\s*,\s*)?\{([^}]*)\}\s*from\s*['\"]([^'\"]+)['\"]"),
    ("named", True, r"import\s+type\s+\{([^}]*)\}\s*from\s*['\"]([^'\"]+)['\"]"),
    ("default", False, r"import\s+(\w+)\s*(?:,\s*\{[^}]*\}\s*)?from\s*['\"]([^'\"]+)['\"]"),
    ("all", False, r"import\s+\*\s+as\s+(\w+)\s+from\s*['\"]([^'\"]+)['\"]"),
    ("named", False, r"export\s+\{([^}]*)\}\s*from\s*['\"]([^'\"]+)['\"]"),
    ("named", True, r"export\s+type\s+\{([^}]*)\}\s*from\s*['\"]([^'\"]+)['\"]"),
    ("all", False, r"export\s+(\*)\s+from\s*['\"]([^'\"]+)['\"]"),
]
REFERENCES = {
    "typescript": [("import", r"import\s+(?:[\s\S]*?\s+from\s+)?['\"]([^'\"]+)['\"]"), ("require", r"require\(\s*['\"]([^'\"]+)['\"]\s*\)")],
    "bash": [("source", r"(?m)^(?:source|\.) +[\"']?([^\"'\s]+)[\"']?")],
    "python": [("import", r"(?m)^from\s+(\S+)\s+import"), ("import", r"(?m)^import\s+(\S+)")],
    "rust": [("import", r"(?m)^(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+?)\s*;")],
    "go": [("import", r"(?m)^import\s+\"([^\"]+)\"")],
    "java": [("import", r"(?m)^import\s+(?:static\s+)?(\S+)\s*;")],
    "csharp": [("import", r"(?m)^using\s+(?:static\s+)?(\S+)\s*;")],
}
NO_IMPORT_LANGUAGES = ("sql", "yaml", "json")
CANDIDATES = [".ts", ".tsx", "/index.ts", "/index.tsx"]


def references(files: DataFrame, language: str) -> DataFrame:
    """(file, source, type): import references of files (file, content) of one language, in order of appearance."""
    parts = []
    if language == "rust":  # each statement is a tree of paths
        specs = files.select("file", F.explode(F.regexp_extract_all("content", F.lit(REFERENCES["rust"][0][1]), 1)).alias("spec"))
        return specs.lateralJoin(UseTree(c("spec").outer())).select("file", c("path").alias("source"), F.lit("import").alias("type"))
    for kind, pattern in REFERENCES[language]:
        parts.append(files.select("file", F.explode(F.regexp_extract_all("content", F.lit(pattern), 1)).alias("source"), F.lit(kind).alias("type")))
    if language == "go":  # grouped imports
        group = F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^import\s*\(([\s\S]*?)\)"), 1)).alias("block")
        parts.append(files.select("file", group).select("file", F.explode(F.regexp_extract_all("block", F.lit(r'"([^"]+)"'), 1)).alias("source"), F.lit("import").alias("type")))
    return reduce(DataFrame.unionAll, parts)


def normalize(path: Column) -> Column:
    """A slash path without '.' and '..' parts."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    up = lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/")


def import_statements(files: DataFrame) -> DataFrame:
    """(importer, specifier, symbol, kind, type_only) of TypeScript files (file, content); 'all' stands for every export."""
    out = None
    for kind, type_only, pattern in IMPORT_FORMS:
        both = F.arrays_zip(F.regexp_extract_all("content", F.lit(pattern), 1).alias("names"), F.regexp_extract_all("content", F.lit(pattern), 2).alias("spec"))
        rows = files.select(c("file").alias("importer"), F.explode(both).alias("m")).select("importer", c("m.names").alias("names"), c("m.spec").alias("specifier"))
        if kind == "named":
            rows = rows.withColumn("symbol", F.explode(F.split("names", ","))).withColumn("symbol", F.trim(F.regexp_replace(F.trim("symbol"), r"\s+as\s+[\s\S]*$", ""))).filter("symbol <> ''")
        else:
            rows = rows.withColumn("symbol", F.lit("default" if kind == "default" else "*"))
        rows = rows.select("importer", "specifier", "symbol", F.lit(kind).alias("kind"), F.lit(type_only).alias("type_only"))
        out = rows if out is None else out.unionAll(rows)
    return out


def resolve(statements: DataFrame, files: DataFrame) -> DataFrame:
    """Adds source_file: the first candidate of a relative specifier that is a known file; others are dropped."""
    folder = F.regexp_replace("importer", "/?[^/]*$", "")
    base = normalize(F.concat_ws("/", folder, F.regexp_replace("specifier", r"\.js$", "")))
    ranked = F.posexplode(F.array(*[F.concat(base, F.lit(x)) for x in CANDIDATES]))
    near = statements.filter(c("specifier").startswith(".") | c("specifier").startswith("/"))
    keys = near.select("importer", "specifier").distinct().select("importer", "specifier", ranked.alias("rank", "candidate"))
    best = keys.join(files.select(c("file").alias("candidate")), "candidate").groupBy("importer", "specifier").agg(F.min_by("candidate", "rank").alias("source_file"))
    return near.join(best, ["importer", "specifier"])


def edges(resolved: DataFrame, exports: DataFrame) -> DataFrame:
    """(symbol, source_file, importer, type_only): 'all' fans out to the exports (file, name) of its target."""
    named = resolved.filter("kind <> 'all'").select("symbol", "source_file", "importer", "type_only")
    fan = resolved.filter("kind = 'all'").select("source_file", "importer", "type_only").join(exports.select(c("file").alias("source_file"), c("name").alias("symbol")), "source_file")
    return named.unionByName(fan.select("symbol", "source_file", "importer", "type_only")).distinct()


def usage(edge: DataFrame) -> DataFrame:
    """(symbol, source_file, importers, type_importers): sorted; a runtime importer is not also a type-only one."""
    per = edge.groupBy("symbol", "source_file", "importer").agg(F.min("type_only").alias("type_only"))
    some = lambda p, n: F.array_sort(F.collect_set(F.when(p, c("importer")))).alias(n)
    return per.groupBy("symbol", "source_file").agg(some(~c("type_only"), "importers"), some(c("type_only"), "type_importers"))


def intra_file(symbols: DataFrame, sources: DataFrame, exported_only: bool = True) -> DataFrame:
    """(symbol, file, referencer): another symbol of the file whose lines name it, comments and strings aside.

    The theta join runs within a file only. symbols: (file, name, exported, line_start, line_end).
    """
    some = symbols.filter("exported") if exported_only else symbols
    with_body = some.join(sources, "file").select("file", c("name").alias("referencer"), strip_code(F.array_join(F.slice(F.split("content", "\n"), c("line_start"), F.greatest(c("line_end") - c("line_start") + 1, F.lit(0))), "\n")).alias("body"))
    words = with_body.select("file", "referencer", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"[A-Za-z_$][A-Za-z0-9_$]*"), 0))).alias("name"))
    return some.select("file", "name").join(words, ["file", "name"]).filter("name <> referencer").select(c("name").alias("symbol"), "file", "referencer").distinct()


def transitive(intra: DataFrame, used: DataFrame) -> DataFrame:
    """intra rows whose referencer is imported itself: one hop."""
    return intra.join(used.select(c("symbol").alias("referencer"), c("source_file").alias("file")), ["referencer", "file"], "left_semi")


def orphans(exports: DataFrame, edge: DataFrame) -> DataFrame:
    """Exports (file, name) that no file imports."""
    return exports.join(edge.select(c("source_file").alias("file"), c("symbol").alias("name")), ["file", "name"], "left_anti")


def _verdict(out: DataFrame) -> DataFrame:
    by = lambda p, a: F.concat(F.lit(p), F.size(a), F.when(F.size(a) > 1, " files: ").otherwise(" file: "), F.array_join(a, ", "))
    some = lambda a: F.coalesce(F.size(a) > 0, F.lit(False))
    detail = F.when(some("importers"), by("Runtime-imported by ", "importers")).when(some("type_importers"), by("Type-only imported by ", "type_importers")).when(some("via"), F.concat(F.lit("Transitively used by "), F.array_join("via", ", "))).otherwise("Exported but imported by 0 files")
    dead = ~some("importers") & ~some("type_importers") & ~some("via")
    return out.withColumns({"value": F.when(dead, "DEAD").otherwise("USED"), "confidence": F.lit(95), "detail": detail})


def utility(exports: DataFrame, used: DataFrame, hops: DataFrame) -> DataFrame:
    """(file, name, value, confidence, detail): runtime, then type-only, then transitive use, else DEAD."""
    u = used.select(c("source_file").alias("file"), c("symbol").alias("name"), "importers", "type_importers")
    t = hops.groupBy("file", c("symbol").alias("name")).agg(F.array_sort(F.collect_set("referencer")).alias("via"))
    return _verdict(exports.join(u, ["file", "name"], "left").join(t, ["file", "name"], "left")).select(*UTILITY)


def utility_of_groups(names: DataFrame, files: DataFrame, used: DataFrame, hops: DataFrame, shorten: Callable[[Column], Column] = lambda d: d) -> DataFrame:
    """`utility` where every file (file, module) of a module exports all of its names (name, module); hops: (symbol, referencer).

    The product of names and files is what comes out, but it is not shuffled: names meet their uses, a name with those files
    of its module that use it goes to the files of its module, and only the exports that no one imports are made there.
    What a row of the product costs counts: the verdict, with its detail shortened, is made once a name, and a file is
    sought by its hash before its path.
    """
    u = used.select(c("source_file").alias("file"), c("symbol").alias("name"), "importers", "type_importers")
    via = hops.groupBy(c("symbol").alias("name")).agg(F.array_sort(F.collect_set("referencer")).alias("via"))
    each = names.join(via, "name", "left")
    count = lambda rows, n: rows.groupBy("module").agg(F.count("*").alias(n))
    total = count(names, "n").join(count(files, "f"), "module").agg(F.coalesce(F.sum(c("n") * c("f")), F.lit(0)), F.coalesce(F.sum("f"), F.lit(0))).first()
    near = lambda rows: F.broadcast(rows) if total[1] <= BROADCAST_ROWS else rows
    short = lambda rows: _verdict(rows).withColumn("detail", shorten(c("detail")))
    hit = short(each.join(u, "name").join(near(files), ["module", "file"]))
    own = u.select("name", "file").join(names, "name").join(near(files), ["module", "file"])
    taken = own.groupBy("name", "module").agg(F.collect_set("file").alias("taken"))
    none = F.lit(None).cast("array<string>")
    rest = short(each.join(taken, ["name", "module"], "left").withColumns({"importers": none, "type_importers": none}))
    rest = rest.select("name", "module", "taken", F.transform("taken", lambda f: F.xxhash64(f)).alias("hashes"), "value", "confidence", "detail")
    rest = rest.repartition(min(TASKS, 1 + total[0] // ROWS_A_TASK), "name")
    found = F.array_contains("hashes", c("hash")) & F.array_contains("taken", c("file"))
    rest = rest.join(near(files.withColumn("hash", F.xxhash64("file"))), "module").filter(~F.coalesce(found, F.lit(False)))
    return hit.select(*UTILITY).unionAll(rest.select(*UTILITY))


def rust_modules(paths: DataFrame, files: DataFrame) -> DataFrame:
    """(path, file): a::b::c to the file of its longest prefix below a crate's source folder (.rs or /mod.rs)."""
    parts = F.split("path", "::")
    prefix = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("p"))))
    tries = paths.distinct().select("path", prefix.alias("x")).select("path", "x.n", F.explode(F.array(F.concat("x.p", F.lit(".rs")), F.concat("x.p", F.lit("/mod.rs")))).alias("file"))
    return tries.join(files.select("file"), "file").groupBy("path").agg(F.max_by("file", F.struct("n", "file")).alias("file"))


def rust_use_tree(spec: str) -> list[str]:
    """Paths of a nested `use` tree: a::{b, c::{d as x, e::*}} to a::b, a::c::d, a::c::e; `self` is the path before it."""
    head, brace, rest = spec.partition("{")
    if not brace:
        path = head.strip().split(" as ")[0].strip().removesuffix("::*")
        return [path] if path else []
    out, depth, start, before = [], 0, 0, head.strip()
    inner = rest[: rest.rindex("}")] if "}" in rest else rest
    for i, ch in enumerate(inner + ","):
        depth += (ch == "{") - (ch == "}")
        if ch == "," and not depth:
            out += [before.removesuffix("::") if p in ("self", "*") else before + p for p in rust_use_tree(inner[start:i])]
            start = i + 1
    return out


@F.udtf(returnType="path string")
class UseTree:
    """The paths of a `use` statement's tree, comments left out."""

    def eval(self, spec: str) -> Iterator[tuple[str]]:
        for path in rust_use_tree(re.sub(r"//[^\n]*|/\*[\s\S]*?\*/", " ", spec or "")):
            yield (path,)


def test_files(sources: DataFrame, tests: DataFrame) -> DataFrame:
    """(file, test): tests (test, imports) named after a file or importing a path part equal to its base name."""
    base = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]+$", "")
    named = tests.select("test", F.regexp_extract(F.element_at(F.split("test", "/"), -1), r"^(.+?)\.(?:test|spec)\.", 1).alias("base")).filter("base <> ''")
    imported = tests.select("test", F.explode("imports").alias("i")).select("test", F.explode(F.split("i", r"[/.]")).alias("base")).filter("base <> ''")
    return sources.select("file", base.alias("base")).join(named.unionAll(imported).distinct(), "base").select("file", "test").distinct()


def file_dependencies(refs: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file, name, version, pos): imported packages of the manifest in order of first use. refs: (file, source, pos)."""
    package = F.regexp_extract("source", r"^(@[^/]+/[^/]+|[^./@][^/]*)", 1)
    first = refs.select("file", package.alias("name"), "pos").filter("name <> ''").groupBy("file", "name").agg(F.min("pos").alias("pos"))
    return first.join(manifest, "name").select("file", "name", "version", "pos")


def crate_map(manifests: DataFrame) -> DataFrame:
    """(crate, src) of Cargo manifests (dir, content): package names with dashes as underscores, and their source folders."""
    name = F.regexp_extract("content", r"(?s)\[package\].*?name\s*=\s*\"([^\"]+)\"", 1)
    rows = manifests.select(F.regexp_replace(name, "-", "_").alias("crate"), F.when(c("dir") == "", "src").otherwise(F.concat("dir", F.lit("/src"))).alias("src"))
    return rows.filter("crate <> ''")


def resolve_other(refs: DataFrame, files: DataFrame, language: str, crates: DataFrame | None = None) -> DataFrame:
    """(file, source, target): references (file, source) of bash, python or rust to files of the tree, first candidate wins.

    Python: relative dots climb from the file's folder, other modules start at the root or below src/. Rust: `crate::`
    and names of crates lead into their source folder (the longest matching one), the rest is a path of modules.
    """
    folder = F.regexp_replace("file", "/?[^/]*$", "")
    keys = refs.select("file", "source").distinct()
    if language == "bash":
        tries = F.array(normalize(F.concat_ws("/", folder, "source")), normalize(c("source")))
    elif language == "python":
        dots = F.length(F.regexp_extract("source", r"^(\.*)", 1))
        rest = F.translate(F.regexp_replace("source", r"^\.+", ""), ".", "/")
        climbed = normalize(F.concat_ws("/", folder, F.array_join(F.array_repeat(F.lit(".."), F.greatest(dots - 1, F.lit(0))), "/"), rest))
        roots = F.when(dots > 0, F.array(climbed)).otherwise(F.array(rest, F.concat(F.lit("src/"), rest)))
        tries = F.flatten(F.transform(roots, lambda r: F.array(F.concat(r, F.lit(".py")), F.concat(r, F.lit("/__init__.py")))))
    else:
        parts = F.split(F.regexp_replace("source", r"^::", ""), "::")
        known = crates.select(c("crate"), c("src"))
        own = keys.join(known, F.element_at(parts, 1) == c("crate"), "left").groupBy("file", "source").agg(F.max_by("src", F.length("src")).alias("src"))
        keys = own
        base = F.coalesce("src", F.regexp_extract("file", r"^(.*?src)/", 1))
        tail = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
        lengths = F.reverse(F.sequence(F.lit(1), F.greatest(F.size(tail), F.lit(1))))
        path = F.transform(lengths, lambda n: F.concat_ws("/", base, F.array_join(F.slice(tail, F.lit(1), n), "/")))
        tries = F.flatten(F.transform(path, lambda p: F.array(F.concat(p, F.lit(".rs")), F.concat(p, F.lit("/mod.rs")))))
    ranked = keys.select("file", "source", F.posexplode(tries).alias("rank", "target"))
    best = ranked.join(files.select(c("file").alias("target")), "target").groupBy("file", "source").agg(F.min_by("target", "rank").alias("target"))
    return best.filter("target <> file")
