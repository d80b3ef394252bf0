"""Chunks of lines for embedding, column search, and context bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def chunk(files: DataFrame, repo: str, most_lines: int = 80, most_bytes: int = 3000) -> DataFrame:
    """path, chunk_id, start_line, end_line, chunk_text: lines are taken while the chunk has at most most_lines lines and most_bytes bytes
    (a line feed counts one); a longer line is a chunk of its own; chunks of white space are left out.

    A fold over each file's lines inside one row: no shuffle."""
    parts = F.split(F.regexp_replace("content", "\r\n?", "\n"), "\n", -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    df = files.select("path", tx.language_of(F.col("path")).alias("language"), parts.alias("parts"))
    start = F.struct(F.array(F.lit(1)).alias("starts"), F.lit(0).alias("lines"), F.lit(0).alias("bytes"), F.lit(0).alias("at"))

    def step(a: Column, text: Column) -> Column:
        size, at = F.octet_length(text), a["at"] + 1
        full = (a["lines"] > 0) & ((a["lines"] >= most_lines) | (a["bytes"] + 1 + size > most_bytes))
        return F.when(full, F.struct(F.concat(a["starts"], F.array(at)).alias("starts"), F.lit(1).alias("lines"), size.alias("bytes"), at.alias("at"))).otherwise(
            F.struct(a["starts"].alias("starts"), (a["lines"] + 1).alias("lines"), (a["bytes"] + F.when(a["lines"] > 0, 1).otherwise(0) + size).alias("bytes"), at.alias("at"))
        )

    ranges = F.aggregate("parts", start, step, lambda a: F.transform(a["starts"], lambda s, k: F.struct(s.alias("start_line"), F.coalesce(F.get(a["starts"], k + 1) - 1, a["at"]).alias("end_line"))))
    body = lambda r: F.array_join(F.slice("parts", r["start_line"], F.greatest(r["end_line"] - r["start_line"] + 1, F.lit(0))), "\n")
    cut = F.transform(ranges, lambda r: F.struct(r["start_line"].alias("start_line"), r["end_line"].alias("end_line"), body(r).alias("chunk_text")))
    df = df.where(F.size("parts") > 0).select("path", "language", F.explode(cut).alias("c")).select("path", "language", "c.*")  # a chunk's row does not carry the file
    df = df.where(tx.trim_unicode(F.col("chunk_text")) != "")
    ident = F.sha1(F.array_join(F.array(F.lit(repo), F.col("path"), F.col("start_line").cast("string"), F.col("end_line").cast("string"), tx.trim_unicode(F.col("chunk_text"))), "\0").cast("binary"))
    return df.select("path", "language", ident.alias("chunk_id"), "start_line", "end_line", "chunk_text")


def stale_ids(stored: DataFrame, current: DataFrame) -> DataFrame:
    """path, chunk_id of stored chunks that no longer exist."""
    return stored.select("path", "chunk_id").join(current.select("path", "chunk_id"), ["path", "chunk_id"], "left_anti")


def search_columns(columns: DataFrame, query: str, model_pattern: str = "", most: int = 20) -> DataFrame:
    """source, model, column, description, score: the name equals the query 30, contains it 15, else 5 for each word; the description
    contains it 8, else 2 for each word."""
    low = query.strip().lower()
    words = list(dict.fromkeys(low.split()))
    name, about = F.lower("column"), F.lower(F.coalesce("description", F.lit("")))
    count = lambda c: sum((F.contains(c, F.lit(w)).cast("int") for w in words), F.lit(0))
    by_name = F.when(name == low, 30).when(F.contains(name, F.lit(low)), 15).otherwise(5 * count(name))
    by_text = F.when(F.contains(about, F.lit(low)), 8).otherwise(2 * count(about))
    own = columns
    if model_pattern:
        regex = tx.glob_to_regex(model_pattern)
        own = columns.where(F.col("model").rlike(regex) if regex else F.col("model") == model_pattern)
    return own.withColumn("score", by_name + by_text).where("score > 0").orderBy(F.desc("score"), "model", "column", "source").limit(max(1, min(most, 500)))


def model_files(columns: DataFrame, symbols: DataFrame) -> DataFrame:
    """columns with file: the first (by file) of the .sql files with symbols whose name without suffix is the model; null where there is none."""
    base = tx.path_base(F.col("file"))
    known = symbols.where(F.endswith(F.lower("file"), F.lit(".sql"))).select(F.regexp_replace(base, r"\.[^.]*$", "").alias("model"), "file").where("model <> ''")
    return columns.join(known.groupBy("model").agg(F.min("file").alias("file")), "model", "left")


def symbol_source(symbols: DataFrame, files: DataFrame, ids: list[str] | None, context: int = 0) -> DataFrame:
    """id, file, start_line, end_line, source, verified: the symbol's lines with `context` lines around. All ids (None: every symbol) in one join by file."""
    own = (symbols if ids is None else symbols.where(F.col("id").isin(*dict.fromkeys(ids)))).select("id", "name", F.col("file").alias("path"), "line", "end_line", "content_hash")
    met = own.join(files.select("path", F.split("content", "\n", -1).alias("parts")), "path")
    n = F.size("parts")
    first, last = tx.clamp(F.col("line") - context, 1, n), tx.clamp(F.col("end_line") + context, 1, n)
    cut = lambda a, z: F.array_join(F.transform(F.slice("parts", a, F.greatest(z - a + 1, F.lit(0))), lambda x: F.regexp_replace(x, "\r$", "")), "\n")
    bare = cut(tx.clamp(F.col("line"), 1, n), tx.clamp(F.col("end_line"), 1, n))
    verified = F.when(F.coalesce("content_hash", F.lit("")) != "", F.sha2(bare.cast("binary"), 256) == F.col("content_hash"))
    return met.select("id", "name", "path", first.alias("start_line"), last.alias("end_line"), cut(first, last).alias("source"), verified.alias("content_verified"))


#: What an import line looks like, by language.
IMPORT_LINES = {
    "python": r"^\s*(import |from \S+ import )",
    "javascript": r"^\s*(import |.*\brequire\s*\()",
    "typescript": r"^\s*(import |.*\brequire\s*\()",
    "tsx": r"^\s*(import |.*\brequire\s*\()",
    "go": r"^\s*import\b",
    "rust": r"^\s*use \S",
    "java": r"^\s*import \S",
    "kotlin": r"^\s*import \S",
    "csharp": r"^\s*using \S",
    "c": r"^\s*#\s*include\b",
    "cpp": r"^\s*#\s*include\b",
    "swift": r"^\s*import \S",
    "ruby": r"^\s*(require |require_relative )",
    "php": r"^\s*(use |require|include)\b",
    "elixir": r"^\s*(import |alias |use |require )\S",
    "scala": r"^\s*import \S",
    "haskell": r"^\s*import \S",
    "lua": r"^\s*(require\s*[\(\"])",
    "dart": r"^\s*import \S",
}


def import_lines(files: DataFrame) -> DataFrame:
    """path, import_lines of files that have any. In Go all lines of a block from `import (` to its `)` are import lines."""
    regex = F.try_element_at(F.create_map(*[F.lit(x) for kv in IMPORT_LINES.items() for x in kv]), tx.language_of(F.col("path")))
    lines = F.split("content", "\r?\n", -1)
    own = F.filter(lines, lambda x: F.regexp_like(x, F.col("_regex")))
    state = lambda inside, a, x: F.struct(inside.alias("inside"), F.concat(a["own"], F.array(x)).alias("own"))
    fold = F.aggregate(
        lines, F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("own")),
        lambda a, x: F.when(a["inside"], state(tx.trim_unicode(x) != ")", a, x)).when(tx.trim_unicode(x) == "import (", state(F.lit(True), a, x)).when(F.regexp_like(x, F.col("_regex")), state(F.lit(False), a, x)).otherwise(a),
        lambda a: a["own"],
    )
    taken = F.when(tx.language_of(F.col("path")) == "go", fold).otherwise(own)
    return files.withColumn("_regex", regex).where("_regex is not null").select("path", taken.alias("import_lines")).where(F.size("import_lines") > 0)


def context_bundle(symbols: DataFrame, files: DataFrame, imports: DataFrame, ids: list[str], callers: bool = False) -> DataFrame:
    """One row for each symbol: source, its file's import lines, and (if asked) the files that import its file."""
    out = symbol_source(symbols, files, ids).join(import_lines(files), "path", "left")
    out = out.withColumn("import_lines", F.coalesce("import_lines", F.array().cast("array<string>")))
    if callers:
        by = imports.where(F.col("resolved") != F.col("source_file")).groupBy(F.col("resolved").alias("path")).agg(F.array_sort(F.collect_set("source_file")).alias("callers"))
        out = out.join(by, "path", "left").withColumn("callers", F.coalesce("callers", F.array().cast("array<string>")))
    return out


def markdown(bundle: DataFrame) -> DataFrame:
    """id and the bundle as Markdown."""
    fence = F.concat(F.lit("```\n"), F.col("source"), F.lit("\n```"))
    imports = F.when(F.size("import_lines") > 0, F.concat(F.lit("\n\nImports:\n"), F.array_join(F.transform("import_lines", lambda x: F.concat(F.lit("- `"), x, F.lit("`"))), "\n"))).otherwise("")
    return bundle.select("id", F.concat(F.lit("## "), F.col("name"), F.lit("\n\n`"), F.col("path"), F.lit(":"), F.col("start_line").cast("string"), F.lit("`\n\n"), fence, imports).alias("markdown"))
