"""The vector index as a table: cards and sections with their vectors, kept up to date by content.

Rows carry `type` ('function' or 'doc_section') and `source`; filters on these and on `file` reach the scan, and column
lists leave the vectors out wherever only cards are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions import vectors as V
from tessella.operators import incremental as I
from tessella.operators import similarity as S

c = F.col

CARD_COLUMNS = ["id", "file", "name", "signature", "summary", "doc_summary", "key_concepts", "behavioral_profile", "complexity", "called", "last_indexed"]
#: Profiles a card may have.
PROFILES = ["pure", "sideEffectful", "async", "memoized", "stateful", "utility"]


def cards(symbols: DataFrame, sources: DataFrame) -> DataFrame:
    """Cards of functions, methods and hooks: symbols (file, name, kind, line_start, line_end) with sources (file, content).

    Functions that call another one of their file list it; the lookup is an equi-join on words of the body.
    """
    some = symbols.filter(c("kind").isin("function", "method", "hook")).join(sources, "file")
    body = T.body(c("content"), c("line_start"), c("line_end"))
    out = some.select(T.function_id(c("file"), c("line_start"), c("line_end")).alias("id"), "file", "name", T.signature(c("content"), c("line_start")).alias("signature"), body.alias("body"))
    out = out.withColumns({"complexity": T.complexity(c("body")), "body_hash": T.hash16("body")})
    words = out.select("id", "file", c("name").alias("own"), F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"([A-Za-z_$][\w$]*)\s*[(<]"), 1))).alias("name"))
    calls = words.join(symbols.select("file", "name").distinct(), ["file", "name"]).filter("name <> own").groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("called"))
    return out.join(calls, "id", "left").withColumn("called", F.coalesce("called", F.array().cast("array<string>")))


def with_summaries(rows: DataFrame, summaries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cards with the summaries (id, summary, doc_summary, key_concepts, behavioral_profile) found, ids without one)."""
    both = rows.join(summaries, "id", "left")
    profile = F.when(c("behavioral_profile").isin(PROFILES), c("behavioral_profile")).otherwise("utility")
    cut = lambda x: F.substring(x, 1, 400)
    return both.withColumns({"behavioral_profile": profile, "summary": cut("summary"), "doc_summary": cut("doc_summary")}), both.filter("summary is null").select("id")


def zero(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), dim)


def rows_of_cards(df: DataFrame, dims: tuple[int, int]) -> DataFrame:
    """Index rows: vectors that are not there are zero vectors."""
    return df.withColumns({"nlp_vector": F.coalesce("nlp_vector", zero(dims[1])), "doc_vector": F.coalesce("doc_vector", zero(dims[1])), "type": F.lit("function"), "source": F.lit("")})


def rows_of_sections(sections: DataFrame, dims: tuple[int, int], source: str) -> DataFrame:
    """sections (id, file, heading, embed_text, nlp_vector) as index rows without a code vector."""
    return sections.select("id", "file", c("heading").alias("name"), c("embed_text").alias("summary"), zero(dims[0]).alias("vector"), "nlp_vector", c("nlp_vector").alias("doc_vector"), F.lit("doc_section").alias("type"), F.lit(source).alias("source"))


def upsert(index: DataFrame, rows: DataFrame) -> DataFrame:
    return I.upsert(index, rows.filter(valid_id(c("id"))), ["id"])


def upsert_sections(index: DataFrame, rows: DataFrame) -> DataFrame:
    """Replace all sections of the files that rows touch."""
    touched = rows.select("file").distinct().withColumn("type", F.lit("doc_section"))
    return index.join(touched, ["file", "type"], "left_anti").unionByName(rows, allowMissingColumns=True)


def delete_sections(index: DataFrame, ids: DataFrame) -> DataFrame:
    gone = ids.select("id").withColumn("type", F.lit("doc_section"))
    return index.join(gone, ["id", "type"], "left_anti")


def delete_file(index: DataFrame, file: str, kind: str | None = None) -> DataFrame:
    return I.delete_where(index, (c("file") == file) & (F.lit(True) if kind is None else c("type") == kind))


def valid_id(x: Column) -> Column:
    """Sixteen hexadecimal digits."""
    return x.rlike(r"^[0-9a-f]{16}$")


def functions(index: DataFrame, file: str | None = None, with_doc_vectors: bool = False) -> DataFrame:
    df = index.filter("type = 'function'")
    df = df if file is None else df.filter(c("file") == file)
    return df.select(*[x for x in CARD_COLUMNS if x in index.columns], *(["doc_vector"] if with_doc_vectors else []))


def sections(index: DataFrame, source: str | None = None) -> DataFrame:
    df = index.filter("type = 'doc_section'")
    return df if source is None else df.filter(c("source") == source)


def indexed_files(index: DataFrame) -> DataFrame:
    return index.filter("type = 'function'").select("file").distinct()


def by_name(index: DataFrame, part: str) -> DataFrame:
    """Functions whose name holds a text, whatever its case."""
    return index.filter("type = 'function'").filter(F.instr(F.lower("name"), part.lower()) > 0)


def stats(index: DataFrame) -> DataFrame:
    """One row: cards, files, sections, summaries and the last change."""
    fn = c("type") == "function"
    return index.agg(F.count_if(fn).alias("n_cards"), F.count_distinct(F.when(fn, c("file"))).alias("n_files"), F.count_if(c("type") == "doc_section").alias("n_sections"), F.count_if(fn & (F.length("summary") > 0)).alias("n_summaries"), F.max("last_indexed").alias("last_indexed"))


def dimension_drift(index: DataFrame, code: int, nlp: int) -> DataFrame:
    """One row (code_drift, nlp_drift): whether any vector has another dimension than the models give."""
    return index.agg(F.coalesce(F.bool_or(F.size("vector") != code), F.lit(False)).alias("code_drift"), F.coalesce(F.bool_or(F.size("nlp_vector") != nlp), F.lit(False)).alias("nlp_drift"))


def file_centroids(index: DataFrame) -> DataFrame:
    """(file, centroid, n) of the prose vectors of a file's functions."""
    return S.centroid(index.filter("type = 'function'"), ["file"], "nlp_vector")


def is_unembedded(v) -> Column:
    return v.isNull() | V.is_zero(v)


def table_name(mode: str) -> str:
    """Vectors of different models never share a table."""
    return f"cards_{mode}"
