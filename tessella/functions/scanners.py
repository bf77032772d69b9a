"""Table functions that need to walk a text: JSON payloads, README sections, comments above symbols, checklists, help.

Built-in expressions cannot say these (balanced brackets, backward scans, sections with state), so each is an Arrow
UDF over whole batches. Checklists and re-exports are plain regular expressions and stay in generated code.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def first_json(text: str | None) -> str | None:
    """The first JSON payload of a text: a json fence, a bare fence that holds one, or the first balanced brackets."""
    if not text:
        return None
    fenced = re.search(r"```json\s*\n(.*?)\n```", text, re.S)
    if fenced:
        return fenced[1].strip()
    bare = re.search(r"```\s*\n(.*?)\n```", text, re.S)
    if bare and bare[1].strip()[:1] in ("{", "["):
        return bare[1].strip()
    decoder = json.JSONDecoder()
    opens = re.search(r"[{\[]", text)
    if not opens:
        return None
    try:
        return text[opens.start() : decoder.raw_decode(text, opens.start())[1]]
    except ValueError:
        return _balanced(text, opens.start())


def _balanced(text: str, at: int) -> str | None:
    """From an opening bracket to its match, brackets in strings aside."""
    depth, quoted, skip = 0, False, False
    for i in range(at, len(text)):
        ch = text[i]
        if skip:
            skip = False
        elif quoted:
            skip, quoted = ch == "\\", ch != '"'
        elif ch == '"':
            quoted = True
        elif ch in "{[":
            depth += 1
        elif ch in "}]":
            depth -= 1
            if not depth:
                return text[at : i + 1]
    return None


def scalar(f: Callable, returns: str):
    """An Arrow UDF of a plain function over one or more columns."""

    @F.pandas_udf(returns)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            columns = columns if isinstance(columns, tuple) else (columns,)
            yield pd.Series([f(*row) for row in zip(*columns, strict=True)], dtype=object)

    return run


def extract_json(text: Column) -> Column:
    return scalar(first_json, "string")(text)


def readme_sections(text: str | None) -> list[tuple[int, str, int, str]]:
    """(level, heading, offset, content) of sections under headings of any level, fenced lines aside."""
    out, fenced, at = [], False, 0
    for line in (text or "").splitlines(keepends=True):
        fenced ^= line.startswith("```")
        m = None if fenced else re.match(r"(#{1,6})\s+(.+?)\s*\Z", line)
        if m:
            out.append([len(m[1]), m[2], at, ""])
        elif out:
            out[-1][3] += line
        at += len(line)
    return [(a, b, o, x.strip()) for a, b, o, x in out]


def section_of(text: str | None, heading: str) -> str | None:
    """Text of the section with a heading, up to the next heading that is not below it."""
    rows = readme_sections(text)
    for i, (level, name, at, _) in enumerate(rows):
        if name.lower() == heading.lower():
            end = next((o for deeper, _, o, _ in rows[i + 1 :] if deeper <= level), len(text))
            return text[at:end].partition("\n")[2].strip()
    return None


def user_instructions(text: str | None, known: list[str]) -> dict[str, str]:
    """Recognised `## ` sections of a configuration page, by normalised heading; the last of equal ones counts."""
    parts = re.split(r"(?m)^## +(.+)$", text or "")
    names = [re.sub(r"[^a-z0-9]+", "_", h.strip().lower()).strip("_") for h in parts[1::2]]
    return {n: body.strip() for n, body in zip(names, parts[2::2], strict=True) if n in known and body.strip()}


def doc_comment(source: str | None, line: int) -> str | None:
    """The doc comment that ends right above a line (decorators and blank lines between are skipped)."""
    lines = (source or "").split("\n")
    i = min(line - 2, len(lines) - 1)
    while i >= 0 and (not lines[i].strip() or lines[i].lstrip().startswith("@")):
        i -= 1
    if i < 0 or not lines[i].rstrip().endswith("*/"):
        return None
    end = i
    while i >= 0 and "/**" not in lines[i]:
        if i < end and "*/" in lines[i]:
            return None
        i -= 1
    return "\n".join(x.strip() for x in lines[i : end + 1]) if i >= 0 else None


def is_self_descriptive(body: str | None) -> bool:
    """A type with one to five fields whose names all have more than two characters."""
    fields = re.findall(r"(?m)^\s*(?:readonly\s+)?(\w+)\??\s*:", body or "")
    return 1 <= len(fields) <= 5 and all(len(f) > 2 for f in fields)


def array_size(source: str, name: str) -> int | None:
    """Top-level elements of the array literal that a name is defined as."""
    m = re.search(rf"(?:const|let|var)\s+{re.escape(name)}\s*(?::[^=]+)?=\s*\[", source)
    if not m:
        return None
    depth, parts, filled = 1, 0, False
    for ch in source[m.end() :]:
        depth += (ch in "[({") - (ch in "])}")
        if not depth:
            return parts + filled
        if ch == "," and depth == 1:
            parts, filled = parts + filled, False
        elif not ch.isspace():
            filled = True
    return None


def refute_bounds(detail: str | None, source: str | None) -> str | None:
    """Why a finding about array bounds is unfounded: two arrays that it names have the same size; null otherwise."""
    names = re.findall(r"`(\w+)`", detail or "") + re.findall(r"(\w+)\s+(?:array\s+)?(?:has|only|contains)\s+\d+", detail or "")
    sizes = {n: s for n in dict.fromkeys(names) if (s := array_size(source or "", n)) is not None}
    if len(sizes) >= 2 and len(set(sizes.values())) == 1:
        return f"{' and '.join(sizes)} have {next(iter(sizes.values()))} elements each"
    return None


def subcommands(help_text: str | None) -> list[tuple[str, str]]:
    """(name, description) below a `Commands:` head of a help text, until the next head."""
    out, inside = [], False
    for line in (help_text or "").split("\n"):
        if re.match(r"\S.*:\s*$", line):
            inside = bool(re.match(r"(?i)(?:available |sub)?commands:", line))
        elif inside and (m := re.match(r"\s{2,}([a-z][\w-]*)(?:\|[\w-]+)?(?:\s+[\[<][^ ]+)*\s{2,}(\S.*)", line)):
            out.append((m[1], m[2].strip()))
    return out


def explode_readme(docs: DataFrame) -> DataFrame:
    """docs (file, content) to (file, position, level, heading, offset, content)."""
    sections = scalar(readme_sections, "array<struct<level:int,heading:string,offset:int,content:string>>")
    return docs.select("file", F.posexplode(sections(c("content"))).alias("position", "s")).select("file", "position", "s.*")


def unchecked_actions(text: Column) -> Column:
    """Array of (id, severity, file, description) of open boxes: `- [ ] <!-- ID --> **[severity]** text (`file`)`."""
    line = r"(?m)^- \[ \] <!-- (\S+) -->(?: \*\*\[(\w+)\]\*\*)? (.*?)(?: \(`([^`]+)`\))?$"
    part = lambda n: F.regexp_extract_all(text, F.lit(line), n)
    return F.arrays_zip(part(1).alias("id"), part(2).alias("severity"), part(4).alias("file"), part(3).alias("description"))


def re_exports(files: DataFrame) -> DataFrame:
    """(file, name, source): names that a module passes on."""
    form = F.lit(r"export\s+\{([^}]*)\}\s*from\s*['\"]([^'\"]+)['\"]")
    both = F.arrays_zip(F.regexp_extract_all("content", form, 1).alias("names"), F.regexp_extract_all("content", form, 2).alias("source"))
    rows = files.select("file", F.explode(both).alias("m")).select("file", F.explode(F.split("m.names", ",")).alias("name"), c("m.source").alias("source"))
    return rows.withColumn("name", F.trim(F.regexp_replace("name", r"(?s)^.*\sas\s+", ""))).filter("name <> ''")


def count_tokens(text: Column, vocabulary: str, pattern: str | None = None) -> Column:
    """Tokens by a byte-level BPE vocabulary file in tiktoken's format; its path is the caller's choice."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import base64

        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        split = pattern or r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        codec = tiktoken.Encoding("own", pat_str=split, mergeable_ranks=ranks, special_tokens={})
        for s in batches:
            yield pd.Series([len(x) for x in codec.encode_ordinary_batch([t or "" for t in s])])

    return run(text)
