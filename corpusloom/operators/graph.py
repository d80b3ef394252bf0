"""Imports and the dependency graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.scratch import Steps
from . import trigrams

#: Identifiers that are looked for one by one.
FEW = 8

#: Import statements. Groups: clause and specifier where there are two.
_JS_FROM = r"""(?md)^\s*import\s+(.+?)\s+from\s+['"]([^'"]+)['"]"""
_JS_BARE = r"""(?md)^\s*import\s+['"]([^'"]+)['"]"""
_REQUIRE = r"""require\(\s*['"]([^'"]+)['"]\s*\)"""
_PY_FROM = r"(?md)^\s*from\s+([A-Za-z0-9_\.]+)\s+import\s+(.+)$"
_PY_IMPORT = r"(?md)^\s*import\s+(.+)$"
_INCLUDE = r"""(?md)^\s*#include\s*[<"]([^>"]+)[>"]"""
_REF = r"""(?i)ref\(\s*['"]([A-Za-z0-9_.-]+)['"]"""


def _name(c: Column) -> Column:
    """One imported name: without braces, `type` and dots in front, first field only."""
    c = tx.trim_unicode(F.regexp_replace(c, r"[{}()]", ""))
    c = F.regexp_replace(F.regexp_replace(c, r"^type\s+", ""), r"^\.{3}", "")
    return F.regexp_replace(F.regexp_extract(c, r"^(\S*)", 1), ",", "")


def _names(parts: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(parts, _name), lambda x: (x != "") & (x != "*")))


def _js_names(clause: Column) -> Column:
    """default, {a as b} -> a, * as ns -> ns."""
    star = F.regexp_extract_all(clause, F.lit(r"\*\s+as\s+(\w+)"), F.lit(1))
    braces = F.split(F.regexp_extract(clause, r"\{([^}]*)\}", 1), ",")
    braces = F.transform(braces, lambda p: F.regexp_replace(p, r"\s+as\s+.*$", ""))
    default = F.regexp_extract(clause, r"^\s*(?:type\s+)?([A-Za-z_$][\w$]*)\s*(?:,|$)", 1)
    return _names(F.concat(F.array(default), braces, star))


def _slashes(c: Column) -> Column:
    return F.replace(tx.trim_unicode(c), F.lit("."), F.lit("/"))


def _module(part: Column) -> Column:
    return _slashes(F.regexp_replace(part, r"\s+as\s+.*$", ""))


def extract_imports(files: DataFrame, strict_language: bool = False) -> DataFrame:
    """source_file, specifier, names of all import statements. Every pattern runs on every file, as parity asks; strict_language runs
    those of the file's language only. Contents are read once: all patterns' matches of a file are one list, and a match is taken apart as its kind asks."""
    lang = tx.language_of(F.col("path"))
    js, none = ("javascript", "typescript", "vue"), F.array().cast("array<string>")
    part = lambda pattern, k: F.regexp_extract("m", pattern, k)
    one = lambda specifier, names=none: F.array(F.struct(specifier.alias("specifier"), names.alias("names")))
    py_names = _names(F.transform(F.split(part(_PY_FROM, 2), ","), lambda p: F.regexp_replace(p, r"\s+as\s+.*$", "")))
    alias = lambda p: F.regexp_extract(p, r"\s+as\s+(\S+)", 1)
    named = lambda p: _names(F.array(F.when(alias(p) != "", alias(p)).otherwise(tx.path_base(_module(p)))))
    modules = F.transform(F.split(part(_PY_IMPORT, 1), ","), lambda p: F.struct(_module(p).alias("specifier"), named(p).alias("names")))
    plain = F.when(~F.contains(tx.trim_unicode(part(_PY_IMPORT, 1)), F.lit(" import ")), modules)
    kinds = [
        (_JS_FROM, js, one(part(_JS_FROM, 2), _js_names(part(_JS_FROM, 1)))), (_JS_BARE, js, one(part(_JS_BARE, 1))), (_REQUIRE, js, one(part(_REQUIRE, 1))),
        (_INCLUDE, ("c", "cpp"), one(part(_INCLUDE, 1))), (_REF, ("sql",), one(part(_REF, 1))),
        (_PY_FROM, ("python",), one(_slashes(part(_PY_FROM, 1)), py_names)), (_PY_IMPORT, ("python",), plain),
    ]
    tagged = lambda k: lambda m: F.struct(F.lit(k).alias("kind"), m.alias("m"))
    lists, taken = [], None
    for k, (pattern, languages, records) in enumerate(kinds):
        matches = F.regexp_extract_all("content", F.lit(pattern), F.lit(0))
        found = F.transform(matches, tagged(k))
        lists.append(F.when(lang.isin(*languages), found).otherwise(F.array().cast("array<struct<kind:int,m:string>>")) if strict_language else found)
        taken = F.when(F.col("kind") == k, records) if taken is None else taken.when(F.col("kind") == k, records)
    rows = files.where("content is not null").select(F.col("path").alias("source_file"), F.explode(F.concat(*lists)).alias("x")).select("source_file", "x.*")
    rows = rows.select("source_file", F.explode(taken).alias("r")).select("source_file", tx.trim_unicode(F.col("r.specifier")).alias("specifier"), "r.names")
    return rows.where("specifier <> ''")


def _resolved_dots(c: Column) -> Column:
    """A path without `.` and `..` parts."""
    fold = F.aggregate(F.split(c, "/"), F.array().cast("array<string>"), lambda a, p: F.when((p == "") | (p == "."), a).when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    return F.array_join(fold, "/")


def candidates() -> Column:
    """Paths that a specifier may mean, in order: relative to its file or from the root, with dots as slashes, as it is."""
    spec, folder = F.col("specifier"), F.regexp_replace("source_file", "[^/]*$", "")
    relative = F.startswith(spec, F.lit("./")) | F.startswith(spec, F.lit("../"))
    first = F.when(relative, _resolved_dots(F.concat(folder, spec))).when(F.startswith(spec, F.lit("/")), _resolved_dots(F.substring(spec, F.lit(2), F.length(spec))))
    dots = F.when(F.contains(spec, F.lit(".")), _resolved_dots(F.replace(spec, F.lit("."), F.lit("/"))))
    return F.array_distinct(F.filter(F.array(first, dots, _resolved_dots(spec)), lambda x: x.isNotNull() & (x != "")))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports with resolved: the first candidate that is a file; else the first file (by path) whose path goes on from a candidate with
    a suffix or `/index.` and a suffix. Both are joins by equality: a file is keyed by every beginning that it can stand for, and what a specifier means is found
    once for each folder whose files have it, and once in all if it is not relative, however many files import it."""
    spec = F.col("specifier")
    relative = F.startswith(spec, F.lit("./")) | F.startswith(spec, F.lit("../"))
    own = imports.drop("resolved").withColumn("_folder", F.when(relative, F.regexp_replace("source_file", "[^/]*$", "")).otherwise(""))
    key = ["_folder", "specifier"]
    asked = own.select(*key).distinct().select(*key, F.col("_folder").alias("source_file")).select(*key, F.posexplode(candidates()).alias("pos", "key"))
    paths = files.select("path")
    parts = F.split(tx.path_base(F.col("path")), r"\.")
    folder = F.regexp_replace("path", "[^/]*$", "")
    starts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.concat(folder, F.array_join(F.slice(parts, 1, k), ".")))
    index = F.when(F.startswith(tx.path_base(F.col("path")), F.lit("index.")), F.array(F.regexp_replace("path", "/[^/]*$", ""))).otherwise(F.array().cast("array<string>"))
    keyed = paths.where(F.size(parts) > 1).select("path", F.explode(F.concat(starts, index)).alias("key")).groupBy("key").agg(F.min("path").alias("near"))
    known = paths.select(F.col("path").alias("key")).distinct().withColumn("is_file", F.lit(True))
    met = asked.join(known, "key", "left").join(keyed, "key", "left").where("is_file or near is not null")
    best = met.groupBy(*key).agg(F.min_by("key", F.when(F.col("is_file"), F.col("pos"))).alias("exact"), F.min_by("near", F.when(F.col("near").isNotNull(), F.col("pos"))).alias("near"))
    return own.join(best.select(*key, F.coalesce("exact", "near").alias("resolved")), key, "left").select(*[c for c in imports.columns if c != "resolved"], "resolved")


def importers_of(imports: DataFrame, paths: list[str], most: int = 50) -> DataFrame:
    """path, importer_count, file, specifier, names, has_importers: as importers(), for many files in one pass; the first `most` importers of each by
    name, with how many there are."""
    most = max(1, min(most, 200))
    own = imports.where(F.col("resolved").isin(*paths)).groupBy(F.col("resolved").alias("path"), "source_file").agg(F.min(F.struct("specifier", "names")).alias("m"))
    w = W.partitionBy("path").orderBy("source_file")
    counts = own.groupBy("path").agg(F.count("*").alias("importer_count"))
    few = own.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k").join(counts, "path")
    asked = few.select("source_file").distinct()
    imported = imports.where("resolved is not null").select(F.col("resolved").alias("source_file")).join(asked, "source_file", "left_semi").distinct().withColumn("_has", F.lit(True))
    return few.join(imported, "source_file", "left").select("path", "importer_count", F.col("source_file").alias("file"), "m.specifier", "m.names", F.coalesce("_has", F.lit(False)).alias("has_importers"))


def importers(imports: DataFrame, path: str, most: int = 50) -> DataFrame:
    """Files that import a file (one record of each, the first by specifier), and whether anything imports them. The first files by name are chosen before
    their records are looked at."""
    hits = imports.where(F.col("resolved") == path)
    few = F.broadcast(hits.select("source_file").distinct().orderBy("source_file").limit(max(1, min(most, 200))))  # so many at most
    own = hits.join(few, "source_file").groupBy("source_file").agg(F.min(F.struct("specifier", "names")).alias("m"))
    imported = imports.select(F.col("resolved").alias("source_file")).join(few, "source_file", "left_semi").distinct().withColumn("_has", F.lit(True))
    met = own.join(imported, "source_file", "left").select(F.col("source_file").alias("file"), "m.specifier", "m.names", F.coalesce("_has", F.lit(False)).alias("has_importers"))
    return met.orderBy("file", "specifier")


def references(imports: DataFrame, identifiers: list[str]) -> DataFrame:
    """identifier, file, specifier, match_type of import records that name an identifier, or whose specifier has it as stem; one record
    for each file and specifier. All identifiers are answered in one pass."""
    low = {i: i.strip().lower() for i in identifiers if i.strip()}
    spec = F.col("specifier")
    stem = tx.path_stem(F.when(~F.contains(spec, F.lit("/")) & ~spec.rlike(r"\.[A-Za-z]{1,4}$"), F.replace(spec, F.lit("."), F.lit("/"))).otherwise(spec))
    held = F.transform("names", F.lower)
    lists = [F.struct(F.lit(i).alias("identifier"), F.when(F.array_contains(held, v), "named").when(stem == v, "specifier_stem").alias("match_type")) for i, v in low.items()]
    hits = imports.select("source_file", "specifier", F.explode(F.array(*lists)).alias("m")).where("m.match_type is not null")
    return hits.groupBy("m.identifier", F.col("source_file").alias("file"), "specifier").agg(F.min("m.match_type").alias("match_type"))


def _holding(files: DataFrame, identifiers: dict[str, str]) -> DataFrame:
    """path, identifier, low of the files whose content has an identifier. For a few, one expression each, outside of any lambda, so that the content is
    lower-cased once a file; many are found by one automaton."""
    if len(identifiers) > FEW:
        return trigrams.holding(files, identifiers)
    content = F.lower("content")
    hits = [F.when(F.contains(content, F.lit(low)), F.struct(F.lit(i).alias("identifier"), F.lit(low).alias("low"))) for i, low in identifiers.items()]
    if not hits:
        return files.select("path", F.lit("").alias("identifier"), F.lit("").alias("low")).where("false")
    return files.select("path", F.explode(F.array_compact(F.array(*hits))).alias("w")).select("path", "w.*")


def check_references(imports: DataFrame, files: DataFrame, symbols: DataFrame, identifiers: list[str]) -> DataFrame:
    """identifier, import_files, content_files: files that import it; files that contain it as text but do not define it."""
    by_import = references(imports, identifiers).groupBy("identifier").agg(F.countDistinct("file").alias("import_files"))
    words = F.array(*[F.lit(i) for i in identifiers])
    holds = _holding(files, {i: i.lower() for i in identifiers})
    defines = symbols.select(F.col("file").alias("path"), F.lower("name").alias("low")).distinct()
    loose = holds.join(defines, ["path", "low"], "left_anti")
    by_content = loose.groupBy("identifier").agg(F.count("*").alias("content_files"))
    asked = files.sparkSession.range(1).select(F.explode(words).alias("identifier"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return asked.join(by_import, "identifier", "left").join(by_content, "identifier", "left").select("identifier", zero("import_files"), zero("content_files"), (zero("import_files") + zero("content_files") > 0).alias("is_referenced"))


def content_references(files: DataFrame, symbols: DataFrame, identifiers: list[str], most_files: int = 20) -> DataFrame:
    """identifier, file, line, text (clamped) of the lines that contain an identifier without regard to case, in files that do not define a symbol of
    that name: those of the first `most_files` (1 to 100) such files by path for each identifier."""
    most_files = max(1, min(most_files, 100))
    holds = _holding(files, {i: i.strip().lower() for i in identifiers if i.strip()})
    defines = symbols.select(F.col("file").alias("path"), F.lower(tx.trim_unicode(F.col("name"))).alias("low")).distinct()
    loose = holds.join(defines, ["path", "low"], "left_anti")
    first = loose.withColumn("_k", F.row_number().over(W.partitionBy("identifier").orderBy("path"))).where(F.col("_k") <= most_files).drop("_k")
    lines = files.join(first, "path").select("path", "identifier", "low", F.posexplode(F.split("content", "\n", -1)).alias("at", "raw"))
    found = lines.where(F.contains(F.lower("raw"), F.col("low")))
    return found.select("identifier", F.col("path").alias("file"), (F.col("at") + 1).alias("line"), tx.clamp_line(F.col("raw")).alias("text"))


def bfs(edges: DataFrame, start: DataFrame, depth: int, direction: str = "imports") -> tuple[DataFrame, DataFrame]:
    """(nodes with level, edges met) within `depth` (1 to 3) steps of the start nodes. Each step is a join of the frontier with the edges
    and an anti-join with what was seen; edges from nodes of a level below depth are kept, also to nodes already seen. The distinct edges
    and each frontier are written, so that no step computes them again."""
    depth = max(1, min(depth, 3))
    steps = Steps(edges.sparkSession, "bfs")
    e = edges.select("source", "target").where("source <> target").distinct()
    if direction == "importers":
        e = e.select(F.col("target").alias("source"), F.col("source").alias("target"))
    elif direction == "both":
        e = e.unionByName(e.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    e = steps.save(e)
    nodes = front = steps.save(start.select(F.col(start.columns[0]).alias("node")).distinct().withColumn("level", F.lit(0)))
    for level in range(1, depth + 1):
        reached = front.join(e, front.node == e.source).select(F.col("target").alias("node")).distinct()
        front = steps.save(reached.join(nodes.select("node"), "node", "left_anti").withColumn("level", F.lit(level)))
        nodes = nodes.unionByName(front)
    met = e.join(nodes.where(F.col("level") < depth).select(F.col("node").alias("source")), "source", "left_semi")
    return nodes, met


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each node: its neighbours inside the node set, both ways, sorted; empty lists are left out."""
    own = nodes.select("node").distinct()
    inside = edges.select("source", "target").distinct().join(own.withColumnRenamed("node", "source"), "source", "left_semi").join(own.withColumnRenamed("node", "target"), "target", "left_semi")
    out = inside.groupBy(F.col("source").alias("node")).agg(F.array_sort(F.collect_list("target")).alias("imports"))
    back = inside.groupBy(F.col("target").alias("node")).agg(F.array_sort(F.collect_list("source")).alias("imported_by"))
    return out.join(back, "node", "full_outer")


def blast_radius(files: DataFrame, edges: DataFrame, symbol_name: str, symbol_file: str, depth: int = 1) -> DataFrame:
    """Files that reach the symbol's file over imports within depth: confirmed, if they name the symbol, else potential."""
    start = files.where(F.col("path") == symbol_file).select("path")
    nodes, _ = bfs(edges, start, depth, "importers")
    met = files.join(nodes.where("level > 0").select(F.col("node").alias("path"), "level"), "path")
    n = tx.word_count(F.col("content"), symbol_name)
    return met.select("path", "level", n.alias("references"), F.when(n > 0, "confirmed").otherwise("potential").alias("status"))
