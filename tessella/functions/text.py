"""Column expressions over source code, Markdown and names. All run inside Spark's generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and limits that decide results.
PROSE_REMOVALS = [(r"(?s)```.*?```", ""), (r"`([^`\n]+)`", "$1"), (r"(?md)^\|[^\n]*\|$", ""), (r"(?md)^>\s[^\n]*$", ""), (r"<[^>]+>", ""), (r"(?md)^---+$", ""), (r"(?md)^\s*\n", "\n")]
CODE_REMOVALS = [(r"//[^\n\r\u2028\u2029]*", ""), (r"(?s)/\*.*?\*/", ""), (r"`(?:[^`\\$]|\\.|\$(?!\{))*`", '""'), (r'"(?:[^"\\]|\\.)*"', '""'), (r"'(?:[^'\\]|\\.)*'", '""')]
BRANCHES = [r"(?<!else\s)\bif\s*\(", r"\belse\s+if\s*\(", r"\bcase\s+", r"&&", r"\|\|", r"\?[^?:]", r"\bcatch\s*\("]
COMPLEXITY_STEPS = [(2, 1), (5, 2), (10, 3), (20, 4)]
STOP_WORDS = "this that with from have been will would could should does which when where they them their there about into more some such than very also just only each because being other what then still called calls like used using before after".split()
CONCEPTS = [
    ("getting-started", r"^(?:getting.?started|install|setup|quick.?start|start)"),
    ("architecture", r"^(?:architecture|design|system.?design)"),
    ("core-concepts", r"^(?:core.?concepts|concepts|glossary|terminology)"),
    ("api-reference", r"^(?:api|reference|endpoints?|routes?|commands?)"),
    ("modules", r"^(?:modules?|components?|packages?|libs?)"),
    ("development", r"^(?:development|contributing|build|deploy|dev)"),
    ("guides", r"^(?:guides?|tutorials?|how.?to|walkthrough|cookbook)"),
]
EMBED_CHARS, SIGNATURE_CHARS, SCAFFOLD_CHARS = 1500, 200, 200


def _chain(text: Column, steps) -> Column:
    return reduce(lambda t, s: F.regexp_replace(t, s[0], s[1]), steps, text)


def trim_blank(text: Column) -> Column:
    """Trim any ASCII white space, not blanks alone."""
    return F.regexp_replace(text, r"\A[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+\z", "")


def strip_non_prose(text: Column) -> Column:
    """Markdown without fences, inline ticks, tables, quotes, tags, rules and blank lines."""
    return trim_blank(_chain(text, PROSE_REMOVALS))


def strip_code(text: Column) -> Column:
    """Source without comments and with empty string literals; template literals that set expressions in stay as they are."""
    return _chain(text, CODE_REMOVALS)


def is_scaffold(text: Column) -> Column:
    """A page with the scaffolding mark and less than 200 characters of its own."""
    rest = trim_blank(_chain(text, [(r"(?s)<!--.*?-->", ""), (r"(?md)^#+\s[^\n]*", ""), (r"(?md)^\s*$", "")]))
    return text.contains("<!-- SCAFFOLDING") & (F.length(rest) < SCAFFOLD_CHARS)


def branches(body: Column) -> Column:
    """Cyclomatic complexity by counting branching constructs."""
    return reduce(lambda a, p: a + F.regexp_count(body, F.lit(p)), BRANCHES, F.lit(1))


def complexity(body: Column) -> Column:
    """Complexity on a scale of 1 to 5."""
    n = branches(body)
    out = F.when(n <= COMPLEXITY_STEPS[0][0], COMPLEXITY_STEPS[0][1])
    for most, score in COMPLEXITY_STEPS[1:]:
        out = out.when(n <= most, score)
    return out.otherwise(5)


def body(source: Column, start: Column, end: Column) -> Column:
    """Lines start to end (from 1) of a source."""
    return F.array_join(F.slice(F.split(source, "\n"), start, F.greatest(end - start + 1, F.lit(0))), "\n")


def signature(source: Column, start: Column) -> Column:
    """The first three lines at most, up to one that opens a body, on one line of 200 characters at most."""
    lines = F.transform(F.slice(F.split(source, "\n"), start, 3), F.trim)
    opens = lambda i: F.coalesce(F.element_at(lines, i).rlike(r"\{|=>"), F.lit(False))
    n = F.when((F.size(lines) >= 1) & opens(1), 1).when((F.size(lines) >= 2) & opens(2), 2).otherwise(3)
    return F.substring(F.trim(F.regexp_replace(F.array_join(F.slice(lines, 1, n), " "), r"\s+", " ")), 1, SIGNATURE_CHARS)


def hash16(*parts) -> Column:
    """First 16 hexadecimal digits of the SHA-256 of the parts, joined as they are."""
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 16)


def function_id(file, start, end) -> Column:
    return hash16(file, F.lit(":"), start, F.lit("-"), end)


def section_id(file, heading, ordinal=None) -> Column:
    """Id of a section; with an ordinal, parts that repeat a heading stay apart."""
    parts = [F.lit("doc:"), file, F.lit(":"), heading]
    return hash16(*parts) if ordinal is None else hash16(*parts, F.when(ordinal > 0, F.concat(F.lit("#"), ordinal)).otherwise(""))


def action_id(file, number) -> Column:
    return F.concat(F.lit("ACT-"), F.substring(F.sha2(file, 256), 1, 6), F.lit("-"), number)


def estimate_tokens(text) -> Column:
    """A quarter of the characters, rounded up; of null none."""
    return F.coalesce(F.ceil(F.length(text) / 4), F.lit(0)).cast("long")


def embed_code(name, sign, source) -> Column:
    """Text for a code embedding; long bodies are cut and marked."""
    cut = F.when(F.length(source) > EMBED_CHARS, F.concat(F.substring(source, 1, EMBED_CHARS), F.lit("\n// ... truncated"))).otherwise(source)
    return F.concat_ws("\n", name, sign, cut)


def embed_nlp(name, summary, concepts, profile) -> Column:
    """Text for a prose embedding: only the parts that are there."""
    filled = lambda c: F.when(F.length(c) > 0, c)
    return F.concat_ws("\n", filled(name), filled(summary), F.when(F.size(concepts) > 0, F.array_join(concepts, ", ")), filled(profile))


def keywords(text: Column) -> Column:
    """Distinct words of more than three characters, in order, without stop words."""
    words = F.split(F.lower(text), r"[\s,.:;()\[\]{}'\"`/\\|—–]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(STOP_WORDS)))


def section_score(heading: Column, content: Column, words: Column) -> Column:
    """Three points for a keyword in the heading, one for each of up to three uses in the text."""
    h, t = F.lower(heading), F.lower(content)
    uses = lambda k: ((F.length(t) - F.length(F.replace(t, k, F.lit("")))) / F.length(k)).cast("long")
    return F.aggregate(words, F.lit(0).cast("long"), lambda a, k: a + F.when(F.instr(h, k) > 0, 3).otherwise(0) + F.least(F.lit(3).cast("long"), uses(k)))


def kebab(name: Column) -> Column:
    return F.lower(_chain(name, [("([a-z0-9])([A-Z])", "$1-$2"), ("([A-Z])([A-Z][a-z])", "$1-$2")]))


def strip_order_prefix(name: Column) -> Column:
    return F.regexp_replace(name, r"^(?i)(?:\d+|[a-z])[-_.]", "")


def concept(name: Column) -> Column:
    """First matching concept of a directory or page name; null if none."""
    plain = strip_order_prefix(name)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for label, pattern in CONCEPTS:
        out = out.when(plain.rlike("(?i)" + pattern), label)
    return out


def page_type(path: Column) -> Column:
    p = F.lower(path)
    reference = reduce(lambda a, w: a | p.contains(w), ["api-reference", "cli", "types", "schema", "endpoint"], F.lit(False))
    return F.when(p.contains("module"), "module").when(reference, "reference").otherwise("conceptual")


def module_name(path: Column) -> Column:
    """Directory after the first `src`, else the one before it, else the first of three parts or more; null if none."""
    parts = F.split(path, "/")
    src = F.array_position(parts, "src")
    after, before = F.try_element_at(parts, (src + 1).cast("int")), F.try_element_at(parts, F.greatest(src - 1, F.lit(1)).cast("int"))
    return F.when(src > 0, F.when(src + 1 < F.size(parts), after).when(src > 1, before)).when(F.size(parts) >= 3, F.element_at(parts, 1))


def sub_domain(path: Column) -> Column:
    """module/file without its extension."""
    return F.concat_ws("/", module_name(path), F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+$", ""))


def file_context(path: Column) -> Column:
    """What kind of file a path is: first match."""
    p = F.lower(path)
    return F.when(p.rlike(r"\.(test|spec)\.|/__tests__/|/tests?/"), "test").when(p.rlike(r"config|\.rc\."), "config").when(p.rlike(r"\.(tsx|jsx)$|/components/"), "react-component").when(p.rlike(r"/(api|routes?|controllers?|handlers?)/"), "api-handler").when(p.rlike(r"/(utils?|helpers?|lib)/"), "utility").otherwise("general")


def strip_date_suffix(model: Column) -> Column:
    return F.regexp_replace(model, r"-\d{8}$", "")


def provider(model: Column) -> Column:
    """Text before the first slash, else a name by the model family, else 'unknown'."""
    return F.when(F.instr(model, "/") > 0, F.substring_index(model, "/", 1)).when(model.startswith("claude"), "anthropic").when(model.startswith("gemini"), "google").when(model.rlike(r"^(gpt|o\d)"), "openai").otherwise("unknown")


def short_count(n: Column) -> Column:
    """1234567 as 1.2M, 1234 as 1K, small numbers as they are."""
    return F.when(n >= 1_000_000, F.concat(F.format_string("%.1f", n / 1e6), F.lit("M"))).when(n >= 1_000, F.concat(F.round(n / 1e3).cast("long").cast("string"), F.lit("K"))).otherwise(n.cast("string"))


def minutes(n: Column) -> Column:
    """Minutes as ~Hh Mm."""
    h, m = F.floor(n / 60).cast("string"), (n % 60).cast("long").cast("string")
    return F.when(n >= 60, F.concat(F.lit("~"), h, F.lit("h "), m, F.lit("m"))).otherwise(F.concat(F.lit("~"), m, F.lit("m")))


def relink(text: Column, old: str, new: str) -> Column:
    """Markdown links below one prefix moved below another."""
    return F.regexp_replace(text, r"\]\(" + old.replace(".", r"\."), "](" + new)


def remap_path(path: Column, old: str, new: str) -> Column:
    """A path equal to a prefix, or below it, moved to another one."""
    return F.when(path == old, F.lit(new)).when(path.startswith(old + "/"), F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 30))).otherwise(path)


def quote_path(path: Column) -> Column:
    """A path for use within a quoted string of a filter: single quotes are doubled."""
    return F.replace(path, F.lit("'"), F.lit("''"))


def json_strings(text: Column) -> Column:
    """The strings of a JSON array; other elements are dropped, and anything else is empty."""
    items = F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")
    typed = F.transform(items, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
    return F.coalesce(F.filter(typed, lambda s: s.isNotNull()), F.array().cast("array<string>"))


def check_action(text: Column, action: Column) -> Column:
    """A checklist with the box of one action ticked."""
    return F.replace(text, F.concat(F.lit("- [ ] <!-- "), action, F.lit(" -->")), F.concat(F.lit("- [x] <!-- "), action, F.lit(" -->")))


def all_checked(text: Column) -> Column:
    return text.rlike(r"(?m)^- \[x\]") & ~text.rlike(r"(?m)^- \[ \]")


def safe_percent(done: Column, total: Column) -> Column:
    """Whole percent, 100 at most, 100 of nothing."""
    return F.when(total == 0, 100).otherwise(F.least(F.lit(100), F.round(100 * done / total))).cast("long")
