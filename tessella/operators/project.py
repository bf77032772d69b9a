"""Project level: languages, frameworks and types from files and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Extension, file name and framework tables.
EXTENSIONS = {".ts": "TypeScript", ".tsx": "TypeScript", ".js": "JavaScript", ".jsx": "JavaScript", ".mjs": "JavaScript", ".cjs": "JavaScript", ".sh": "Shell", ".bash": "Shell", ".py": "Python", ".rs": "Rust", ".go": "Go", ".java": "Java", ".cs": "C#", ".sql": "SQL", ".yml": "YAML", ".yaml": "YAML", ".json": "JSON"}
FILE_NAMES = {"Dockerfile": "Docker", "Makefile": "Makefile", "Jenkinsfile": "Groovy"}
FRAMEWORKS = [  # id, language, dependencies, suppressed id, implied types
    ("nextjs", "typescript", ["next"], "react", ["Frontend", "Backend API"]),
    ("nuxt", "typescript", ["nuxt"], "vue", ["Frontend", "Backend API"]),
    ("nestjs", "typescript", ["@nestjs/core"], None, ["Backend API"]),
    ("react", "typescript", ["react"], None, ["Frontend"]),
    ("vue", "typescript", ["vue"], None, ["Frontend"]),
    ("angular", "typescript", ["@angular/core"], None, ["Frontend"]),
    ("svelte", "typescript", ["svelte"], None, ["Frontend"]),
    ("solid", "typescript", ["solid-js"], None, ["Frontend"]),
    ("express", "typescript", ["express"], None, ["Backend API"]),
    ("fastify", "typescript", ["fastify"], None, ["Backend API"]),
    ("hono", "typescript", ["hono"], None, ["Backend API"]),
    ("koa", "typescript", ["koa"], None, ["Backend API"]),
    ("hapi", "typescript", ["@hapi/hapi"], None, ["Backend API"]),
    ("prisma", "typescript", ["prisma", "@prisma/client"], None, ["ORM"]),
    ("drizzle", "typescript", ["drizzle-orm"], None, ["ORM"]),
    ("typeorm", "typescript", ["typeorm"], None, ["ORM"]),
    ("sequelize", "typescript", ["sequelize"], None, ["ORM"]),
    ("knex", "typescript", ["knex"], None, ["ORM"]),
    ("mikro-orm", "typescript", ["@mikro-orm/core"], None, ["ORM"]),
    ("commander", "typescript", ["commander"], None, ["CLI"]),
    ("yargs", "typescript", ["yargs"], None, ["CLI"]),
    ("clipanion", "typescript", ["clipanion"], None, ["CLI"]),
    ("cac", "typescript", ["cac"], None, ["CLI"]),
    ("vitest", "typescript", ["vitest"], None, []),
    ("jest", "typescript", ["jest"], None, []),
    ("passport", "typescript", ["passport"], None, []),
    ("django", "python", ["django"], None, ["Frontend", "Backend API"]),
    ("fastapi", "python", ["fastapi"], None, ["Backend API"]),
    ("flask", "python", ["flask"], None, ["Backend API"]),
    ("sqlalchemy", "python", ["sqlalchemy", "SQLAlchemy"], None, ["ORM"]),
    ("click", "python", ["click"], None, ["CLI"]),
    ("typer", "python", ["typer"], None, ["CLI"]),
    ("pytest", "python", ["pytest"], None, []),
    ("actix", "rust", ["actix-web"], None, ["Backend API"]),
    ("rocket", "rust", ["rocket"], None, ["Backend API"]),
    ("axum", "rust", ["axum"], None, ["Backend API"]),
    ("diesel", "rust", ["diesel"], None, ["ORM"]),
    ("sea-orm", "rust", ["sea-orm"], None, ["ORM"]),
    ("clap", "rust", ["clap"], None, ["CLI"]),
    ("gin", "go", ["github.com/gin-gonic/gin"], None, ["Backend API"]),
    ("echo", "go", ["github.com/labstack/echo"], None, ["Backend API"]),
    ("fiber", "go", ["github.com/gofiber/fiber"], None, ["Backend API"]),
    ("gorm", "go", ["gorm.io/gorm"], None, ["ORM"]),
    ("cobra", "go", ["github.com/spf13/cobra"], None, ["CLI"]),
    ("aspnet", "csharp", ["Microsoft.AspNetCore"], None, ["Backend API"]),
    ("ef-core", "csharp", ["Microsoft.EntityFrameworkCore"], None, ["ORM"]),
    ("spring", "java", ["org.springframework"], None, ["Backend API"]),
    ("hibernate", "java", ["org.hibernate"], None, ["ORM"]),
    ("picocli", "java", ["picocli"], None, ["CLI"]),
]

c = F.col


def classify_file(path: Column) -> Column:
    """Language by extension, else by file name; null if unknown."""
    name = F.element_at(F.split(path, "/"), -1)
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    return F.coalesce(F.try_element_at(table(EXTENSIONS), F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))), F.try_element_at(table(FILE_NAMES), name))


def language_shares(files: DataFrame, language: str) -> DataFrame:
    """(lang, n, pct): languages of 1 % of files at least, percent of those kept."""
    n = files.filter(c(language).isNotNull()).groupBy(c(language).alias("lang")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # one row a language
    kept = n.withColumn("total", total).filter(c("n") >= 0.01 * c("total")).drop("total")
    return kept.withColumn("pct", F.round(100 * c("n") / total).cast("long"))


def primary_language(files: DataFrame, language: str, position: str) -> DataFrame:
    """One row: the most frequent language, of equals the first seen."""
    n = files.filter(c(language).isNotNull()).groupBy(language).agg(F.count("*").alias("n"), F.min(position).alias("first"))
    return n.agg(F.max_by(language, F.struct("n", -c("first"))).alias("language"))


def detect_frameworks(dependencies: DataFrame) -> DataFrame:
    """Frameworks (id, language, types) of a manifest (name), without those that another one found suppresses."""
    rules = dependencies.sparkSession.createDataFrame(FRAMEWORKS, "id string, language string, deps array<string>, suppresses string, types array<string>")
    hits = rules.select("id", F.explode("deps").alias("dep")).join(dependencies.select(c("name").alias("dep")).distinct(), "dep", "left_semi")
    found = rules.join(hits.select("id").distinct(), "id", "left_semi")
    gone = found.filter("suppresses is not null").select(c("suppresses").alias("id"))
    return found.join(gone, "id", "left_anti").select("id", "language", "types")


def project_types(frameworks: DataFrame, extra: list[str] = ()) -> DataFrame:
    """One row: sorted union of implied types and extra ones."""
    return frameworks.agg(F.array_sort(F.array_distinct(F.concat(F.flatten(F.collect_list("types")), F.array(*[F.lit(x) for x in extra]).cast("array<string>")))).alias("types"))


def scan_globs(shares: DataFrame) -> DataFrame:
    """Include globs (glob) of languages with 5 % at least."""
    spark = shares.sparkSession
    ext = spark.createDataFrame(list(EXTENSIONS.items()), "ext string, lang string")
    return shares.filter(c("pct") >= 5).join(ext, "lang").select(F.concat(F.lit("src/**/*"), "ext").alias("glob"))


def merge_dependencies(prod: DataFrame, dev: DataFrame) -> DataFrame:
    """(name, version): versions of dev dependencies win."""
    both = prod.withColumn("rank", F.lit(0)).unionByName(dev.withColumn("rank", F.lit(1)))
    return both.groupBy("name").agg(F.max_by("version", "rank").alias("version"))


def active_models(configs: DataFrame) -> DataFrame:
    """(model): every model that any slot of the configurations (slots map<string, string>) names, once."""
    return configs.select(F.explode(F.map_values("slots")).alias("model")).filter("model is not null").distinct()
