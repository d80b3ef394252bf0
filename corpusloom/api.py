"""The named queries over one corpus, with checked arguments and results as plain values.

A Corpus holds DataFrames (files, symbols, imports, ...). `call` checks and converts arguments, runs the query and returns a dictionary;
what is wrong with a request comes back as {"error": ...}, never as an exception. The lists that are collected here are limited
by each query's own maximum.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import logging
import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import catalog, chunks, graph, history, merkle, search, symbols, telemetry, vectors
from .sources import ingest, scratch, tables
from .sources.versions import Snapshots

_TRUE, _FALSE = {"true", "1", "yes", "on"}, {"false", "0", "no", "off"}
#: Items of one batch at most, and rows of a list that has no limit of its own; a longer one says that it is truncated.
MOST_BATCH, MOST_ROWS = 256, 50_000


class RequestError(ValueError):
    """Something that the caller can mend."""


@dataclass(frozen=True)
class Arg:
    """kind: str, int, float, bool or list; a number is held between low and high."""

    kind: type = str
    default: Any = None
    required: bool = False
    low: float | None = None
    high: float | None = None
    choices: tuple = ()

    def read(self, name: str, value: Any) -> Any:
        if value is None:
            if self.required:
                raise RequestError(f"missing argument: {name}")
            return self.default
        try:
            if self.kind is bool:
                word = str(value).strip().lower()
                if word not in _TRUE | _FALSE:
                    raise ValueError
                value = word in _TRUE
            elif self.kind in (int, float):
                value = self.kind(float(value)) if self.kind is int else float(value)
            elif self.kind is list:
                value = [str(v) for v in value] if isinstance(value, (list, tuple)) else [str(value)]
                if len(value) > MOST_BATCH:
                    raise RequestError(f"{name} has more than {MOST_BATCH} items")
            else:
                value = str(value)
        except (TypeError, ValueError) as e:
            raise e if isinstance(e, RequestError) else RequestError(f"{name} is not a {self.kind.__name__}") from None
        if self.low is not None:
            value = max(self.low, min(self.high, value))
        if self.choices and value not in self.choices:
            raise RequestError(f"{name} is not one of {', '.join(map(str, self.choices))}")
        return value


def _text(required: bool = True) -> Arg:
    return Arg(str, "", required)


def _count(default: int, high: int) -> Arg:
    return Arg(int, default, low=1, high=high)


ARGUMENTS: dict[str, dict[str, Arg]] = {
    "index_folder": {"path": _text(), "extra_ignore_patterns": Arg(list, []), "incremental": Arg(bool, True), "follow_symlinks": Arg(bool, False), "changed_paths": Arg(list, [])},
    "index_repo": {"url": _text(), "extra_ignore_patterns": Arg(list, []), "incremental": Arg(bool, True)},
    "index_file": {"path": _text()},
    "list_repos": {},
    "resolve_repo": {"path": _text()},
    "get_file_tree": {"path_prefix": _text(False), "include_summaries": Arg(bool, False)},
    "get_file_outline": {"file_path": _text(False), "file_paths": Arg(list, [])},
    "get_symbol_source": {"symbol_id": _text(False), "symbol_ids": Arg(list, []), "verify": Arg(bool, False), "context_lines": Arg(int, 0, low=0, high=50)},
    "get_file_content": {"file_path": _text(), "start_line": Arg(int), "end_line": Arg(int)},
    "search_symbols": {"query": _text(), "kind": Arg(str, "", choices=("", *symbols.KINDS)), "file_pattern": _text(False), "language": _text(False), "max_results": _count(10, 100), "token_budget": Arg(int), "detail_level": Arg(str, "standard", choices=("compact", "standard", "full"))},
    "invalidate_cache": {},
    "search_text": {"query": _text(), "is_regex": Arg(bool, False), "file_pattern": _text(False), "max_results": _count(20, 100), "context_lines": Arg(int, 0, low=0, high=10), "retrieval_mode": Arg(str, "lexical", choices=("lexical", "semantic", "hybrid")), "lexical_weight": Arg(float), "semantic_weight": Arg(float)},
    "get_repo_outline": {},
    "find_importers": {"file_path": _text(False), "file_paths": Arg(list, []), "max_results": _count(50, 200)},
    "find_references": {"identifier": _text(False), "identifiers": Arg(list, []), "max_results": _count(50, 200)},
    "check_references": {"identifier": _text(False), "identifiers": Arg(list, []), "search_content": Arg(bool, True), "max_content_results": _count(20, 100)},
    "search_columns": {"query": _text(), "model_pattern": _text(False), "max_results": _count(20, 500)},
    "get_context_bundle": {"symbol_id": _text(False), "symbol_ids": Arg(list, []), "include_callers": Arg(bool, False), "output_format": Arg(str, "json", choices=("json", "markdown"))},
    "get_session_stats": {"now": _text(False), "trend_windows": Arg(list, [])},
    "get_dependency_graph": {"file": _text(), "direction": Arg(str, "imports", choices=("imports", "importers", "both")), "depth": _count(1, 3)},
    "get_symbol_diff": {},
    "get_class_hierarchy": {"class_name": _text()},
    "get_related_symbols": {"symbol_id": _text(), "max_results": _count(10, 50)},
    "suggest_queries": {},
    "get_blast_radius": {"symbol": _text(), "depth": _count(1, 3)},
    "wait_for_fresh": {"timeout_ms": Arg(int, 500, low=0, high=600_000)},
    "check_freshness": {"current_head": _text(False)},
}


def _ids(one: str, many: list[str], what: str) -> list[str]:
    """One name or several, not both."""
    if bool(one) == bool(many):
        raise RequestError(f"give either {what} or {what}s")
    return list(dict.fromkeys(many or [one]))


def _paths(one: str, many: list[str]) -> list[str]:
    return list(dict.fromkeys(map(tx.clean_path, _ids(one, many, "file_path"))))


def _list(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def repo_id(path: str) -> str:
    clean = path.rstrip("/") or "/"
    return f"local/{clean.rsplit('/', 1)[-1]}-{hashlib.sha1(clean.encode()).hexdigest()[:8]}"


def _roots(spark: SparkSession, path: str) -> list[str] | None:
    """The folder of a path and the root of the version control that it is in, where that is another one; None if there is no such path. Links of
    local paths are followed."""
    path = path if "://" in path else os.path.realpath(os.path.expanduser(path))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    at = hadoop(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    if fs.getFileStatus(at).isFile():
        path, at = path.rsplit("/", 1)[0] or "/", at.getParent()
    steps = 0
    while at is not None and not fs.exists(hadoop(at, ".git")):  # a folder, or the file of a worktree
        at, steps = at.getParent(), steps + 1
    own = path.rstrip("/") or "/"
    return [own] if at is None or not steps else [own, own.rsplit("/", steps)[0] or "/"]


def _resolved(spark: SparkSession, path: str, find: Callable[[str], Corpus | None]) -> dict:
    """The answer of resolve_repo: the corpus of the path's folder, else that of the version control's root."""
    asked = path.strip()
    roots = _roots(spark, asked or ".")
    if roots is None:
        return {"found": False, "indexed": False, "error": f"Path does not exist: {asked}"}
    for root in roots:
        own = find(root)
        if own is not None:
            language = tx.language_of(F.col("path")).alias("language")
            languages = {r.language: r["count"] for r in own.files.select(language).groupBy("language").count().collect()}
            return {
                "found": True, "indexed": True, "repo": own.name, "source_root": own.root, "display_name": own.root.rsplit("/", 1)[-1],
                "symbol_count": own.symbols.count() if own.symbols is not None else 0, "file_count": sum(languages.values()),
                "languages": {k: n for k, n in sorted(languages.items(), key=lambda x: x[0] or "") if k}, "indexed_at": own.indexed_at and own.indexed_at.isoformat(),
            }
    return {"found": True, "indexed": False, "repo": repo_id(roots[0]), "hint": "call index_folder to index this path"}


@dataclass
class Corpus:
    """Tables of one corpus. Only files is needed; imports are extracted and resolved from it once, when first asked for."""

    files: DataFrame
    symbols: DataFrame | None = None
    columns: DataFrame | None = None
    calls: DataFrame | None = None
    other: Corpus | None = None
    embed: Any = None
    chunk_vectors: DataFrame | None = None
    name: str = "local/corpus"
    root: str = ""
    head: str = ""
    indexed_at: dt.datetime | None = None
    stream: Any = None
    meta_fields: list[str] | None = None
    totals: Any = None  # streaming.cumulative.Cumulative: the totals of all sessions
    commits: DataFrame | None = None  # commit, parent
    kept: Snapshots | None = None  # the versions that files come from, once a folder is indexed
    _imports: DataFrame | None = field(default=None, repr=False)

    @property
    def spark(self) -> SparkSession:
        return self.files.sparkSession

    @property
    def lines(self) -> DataFrame:
        return tables.lines(self.files)

    @property
    def imports(self) -> DataFrame:
        if self._imports is None:
            self._imports = graph.resolve_imports(graph.extract_imports(self.files), self.files).persist()
        return self._imports

    def _symbols(self) -> DataFrame:
        if self.symbols is None:
            raise RequestError("the corpus has no symbols")
        return self.symbols

    def call(self, tool: str, arguments: dict[str, Any] | None = None) -> dict[str, Any]:
        began = time.monotonic()
        if tool not in ARGUMENTS:
            return {"error": f"unknown tool: {tool}"}
        try:
            given = {k: a.read(k, (arguments or {}).get(k)) for k, a in ARGUMENTS[tool].items()}
            out = getattr(self, tool)(**given)
        except (RequestError, ValueError) as e:
            return {"error": str(e)}
        except Exception:  # as the interface promises: no exception leaves it
            logging.getLogger(__name__).exception("%s failed", tool)
            return {"error": f"Internal error processing {tool}"}
        meta = {"timing_ms": round((time.monotonic() - began) * 1000, 2), "repo": self.name}
        if self.meta_fields is not None:
            meta = {k: v for k, v in meta.items() if k in self.meta_fields}
        return out | ({"_meta": meta} if meta else {})

    # ---- ingest

    def index_folder(self, path: str, extra_ignore_patterns: list[str], incremental: bool, follow_symlinks: bool, changed_paths: list[str]) -> dict:
        """Read a folder, keep what discovery takes, and tell what changed against the present files. incremental: with changed_paths only these are
        read, and nothing is replaced where nothing changed."""
        return self._ingest(path.rstrip("/") or "/", extra_ignore_patterns, incremental, follow_symlinks, changed_paths, ingest.FOLDER_FILES)

    def index_repo(self, url: str, extra_ignore_patterns: list[str], incremental: bool) -> dict:
        if "://" in url and not url.startswith(("file://", "hdfs://", "s3a://", "viewfs://")):
            raise RequestError("only stores that Spark reads can be indexed")
        return self._ingest(url.removeprefix("file://").rstrip("/"), extra_ignore_patterns, incremental, False, [], ingest.REPO_FILES)

    def _links(self, root: str, follow: bool) -> DataFrame | None:
        """Links below a local folder with their reasons; None if there is none. A store that only Spark reads has no links."""
        if not os.path.isdir(root):
            return None
        top = os.path.realpath(root)
        found = [(os.path.relpath(p, root), os.path.realpath(p)) for d, folders, names in os.walk(root) for n in (*folders, *names) if os.path.islink(p := os.path.join(d, n))]
        return ingest.link_reason(self.spark.createDataFrame(found, "path string, link_target string"), top, follow) if found else None

    def _taken(self, kept: Snapshots, version: int, root: str) -> None:
        """The files from now on: those of a written version, whatever happens to the folder."""
        self.files, self.kept, self._imports, self.root, self.name = kept.read(version), kept, None, root, repo_id(root)
        self.indexed_at = dt.datetime.now(dt.UTC)

    def _ingest(self, root: str, extra_ignore: list[str], incremental: bool, follow: bool, changed: list[str], cap: int) -> dict:
        known = incremental and self.root == root and self.kept is not None
        part = [p.strip().removeprefix(root + "/") for p in changed if p.strip()] if known else []
        if any(p.startswith("/") or ".." in p.split("/") for p in part):
            raise RequestError("a changed path is outside the folder")
        at = scratch.folder(self.spark, "ingest")
        try:
            seen = ingest.take(self.spark, root, at, extra_ignore, self._links(root, follow), part or None, cap)
        except AnalysisException:
            raise RequestError(f"Folder not found: {root}") from None
        seen.write.parquet(f"{at}/taken")
        seen = self.spark.read.schema(seen.schema).parquet(f"{at}/taken")
        new = seen.where("skip_reason is null").select("path", "content")
        named = self.spark.createDataFrame([(p,) for p in part], "path string") if part else None
        old = self.files.select("path", "content_hash" if "content_hash" in self.files.columns else ingest.content_hash(F.col("content")).alias("content_hash"))
        after = ingest.incremental(old, new, named)
        diff = ingest.counts(old, after)
        skipped = {r.skip_reason: r.n for r in catalog.skip_counts(seen).collect()}
        if known and not any(diff[k] for k in ("new", "changed", "deleted")):
            return {"success": True, "repo": self.name, "message": "No changes detected", "file_count": self.files.count(), "new": 0, "changed": 0, "deleted": 0, "skipped": skipped}
        kept = self.kept or Snapshots(self.spark, scratch.folder(self.spark, "corpus"), 64)
        about = {"head": self.head, "name": repo_id(root), "root": root}
        if part:
            touched = after.where("origin <> 'kept'").select("path", F.when(F.col("origin") == "new", "added").otherwise("modified").alias("change_type")).join(new, "path")
            gone = old.join(named, "path", "left_semi").join(new, "path", "left_anti").select("path", F.lit("deleted").alias("change_type"), F.lit(None).cast("string").alias("content"))
            version = kept.commit(touched.unionByName(gone), **about)
        else:
            version = kept.replace(new, **about)
        self._taken(kept, version, root)
        return {"success": True, "repo": self.name, "file_count": kept.entry(version)["file_count"], **{k: diff[k] for k in ("new", "changed", "deleted")}, "skipped": skipped}

    def index_file(self, path: str) -> dict:
        """One file of an indexed folder, by its path there or its full path: only its bucket of the snapshot is read and written."""
        began = time.monotonic()
        asked = path.strip()
        no = lambda why: {"success": False, "error": why}
        full = asked if asked.startswith("/") or "://" in asked or not self.root else f"{self.root}/{asked}"
        if "://" not in full:
            full = os.path.realpath(os.path.expanduser(full))
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(full or "/")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not asked or not fs.exists(at):
            return no(f"File not found: {asked}")
        if not fs.getFileStatus(at).isFile():
            return no(f"Path is not a file: {asked}")
        if not self.root or self.kept is None or not full.startswith(f"{self.root}/"):
            return no(f"No indexed folder found that contains {asked}. Run index_folder on the parent directory first.")
        own = full.removeprefix(f"{self.root}/")
        if ".." in own.split("/"):
            return no(f"File path failed security validation: {asked}")
        row = self.spark.createDataFrame([(own, int(fs.getFileStatus(at).getLen()))], "path string, size_bytes long")
        if row.where(tx.language_of(F.col("path")).isNull()).head(1):
            return no(f"Unsupported file type: {os.path.splitext(own)[1].lower() or (own if own.startswith('.') else '')}. File not recognized as a supported language.")
        try:
            now = ingest.contents(self.spark, self.root, row, scratch.folder(self.spark, "file")).first()
        except Exception as e:
            return no(f"Failed to read file: {e}")
        before = self.kept.read(paths=[own]).select("content_hash").first()
        content = now.content.encode("utf-8", "surrogatepass")
        seconds = lambda: round(time.monotonic() - began, 3)
        if before is not None and before.content_hash == hashlib.sha256(content).hexdigest():
            return {"success": True, "message": "File unchanged", "repo": self.name, "file": own, "duration_seconds": seconds()}
        net = self.spark.createDataFrame([(own, "added" if before is None else "modified", now.content)], "path string, change_type string, content string")
        self._taken(self.kept, self.kept.commit(net, head=self.head, name=self.name, root=self.root), self.root)
        return {"success": True, "repo": self.name, "file": own, "is_new": before is None, "symbol_count": 0, "indexed_at": self.indexed_at.isoformat(), "duration_seconds": seconds()}

    def list_repos(self) -> dict:
        own = [c for c in (self, self.other) if c is not None]
        return {"repos": sorted(({"repo": c.name, "file_count": c.files.count(), "indexed_at": c.indexed_at and c.indexed_at.isoformat()} for c in own), key=lambda r: r["repo"])}

    def resolve_repo(self, path: str) -> dict:
        return _resolved(self.spark, path, lambda root: self if repo_id(root) == self.name else None)

    def invalidate_cache(self) -> dict:
        if self._imports is not None:
            self._imports.unpersist()
        self._imports = None
        return {"success": True, "repo": self.name}

    # ---- catalog

    def get_file_tree(self, path_prefix: str, include_summaries: bool) -> dict:
        """The nested tree of a corpus, whose files are at most as many as its cap, and the sums of each directory."""
        root = merkle.nested(self.files, path_prefix, include_summaries).where("directory = ''").first()
        below = self.files.where(F.startswith("path", F.lit(path_prefix))).count()
        return {"path_prefix": path_prefix, "tree": json.loads(root.tree) if root else [], "file_count": below, "directories": _list(catalog.file_tree(self.files, path_prefix).orderBy("directory"))}

    def get_file_outline(self, file_path: str, file_paths: list[str]) -> dict:
        asked = _paths(file_path, file_paths)
        own = self.files.where(F.col("path").isin(*asked)).select("path", tx.language_of(F.col("path")).alias("language"))
        found = {r.path: {"file": r.path, "language": r.language, "symbols": []} for r in own.collect()}
        return {"results": [found.get(p, {"file": p, "error": f"File not found: {p}"}) for p in asked]}

    def get_file_content(self, file_path: str, start_line: int | None, end_line: int | None) -> dict:
        file_path = tx.clean_path(file_path)
        own = self.files.where(F.col("path") == file_path)
        row = catalog.content_slice(own, start_line or 1, end_line or 2**31 - 1).first()
        if row is None:
            raise RequestError(f"File not found: {file_path}")
        out = row.asDict()
        if start_line is None and end_line is None:
            out["content"] = own.first().content
        return out

    def get_repo_outline(self) -> dict:
        none = self.spark.createDataFrame([], "kind string")
        rows = _list(catalog.repo_outline(self.files, self.symbols if self.symbols is not None else none).orderBy("section", "key"))
        stale = self.indexed_at is not None and (dt.datetime.now(dt.UTC) - self.indexed_at.astimezone(dt.UTC)).days >= 7
        return {s: {r["key"]: r["n"] for r in rows if r["section"] == s} for s in ("directories", "kinds", "languages")} | ({"is_stale": True} if stale else {})

    def get_symbol_diff(self) -> dict:
        if self.other is None:
            raise RequestError("there is no other corpus to compare with")
        diff = catalog.symbol_diff(self._symbols(), self.other._symbols())
        n = {r.status: r["count"] for r in diff.groupBy("status").count().collect()}
        rows = _list(diff.where("status <> 'unchanged'").orderBy("file", "name", "kind").limit(MOST_ROWS))
        out = {s: [r for r in rows if r["status"] == s] for s in ("added", "removed", "changed")} | {"unchanged_count": n.get("unchanged", 0)}
        return out | ({"truncated": True} if sum(n.values()) - n.get("unchanged", 0) > len(rows) else {})

    # ---- search

    def search_text(self, query, is_regex, file_pattern, max_results, context_lines, retrieval_mode, lexical_weight, semantic_weight) -> dict:
        lexical = search.matching_lines(self.lines, query, is_regex, file_pattern)
        meta: dict[str, Any] = {"retrieval_mode": retrieval_mode}
        hits = lexical.orderBy("path", "line").limit(max_results)
        if retrieval_mode != "lexical":
            if self.embed is None or self.chunk_vectors is None:
                meta |= {"degraded": True, "retrieval_mode": "lexical"}
            else:
                k = max(5, max_results) if retrieval_mode == "semantic" else max(5, 3 * max_results)
                q = self.spark.createDataFrame([("q", "main", self.embed(query))], "query_id string, namespace string, embedding array<double>")
                near = vectors.top_k(self.chunk_vectors, q, k).join(self.chunk_vectors.select("id", "path", F.col("start_line").alias("line"), F.col("chunk_text")), "id").where(tx.matches_path(F.col("path"), file_pattern))
                near = near.select("path", "line", tx.clamp_line(F.get(F.filter(F.split("chunk_text", "\n"), lambda x: F.trim(x) != ""), F.lit(0))).alias("text"), "score")
                if retrieval_mode == "semantic":
                    hits = near.orderBy(F.desc("score"), "path", "line", "text").limit(max_results)
                else:
                    few = lexical.orderBy("path", "line").limit(max(250, 4 * max_results))
                    hits = search.fuse(few, near, search.hybrid_weights(lexical_weight, semantic_weight), max_results)
        if context_lines:
            hits = search.with_context(self.lines, hits, context_lines)
        rows = _list(hits)
        if retrieval_mode == "lexical" or meta.get("degraded"):
            rows.sort(key=lambda r: (r["path"], r["line"]))
        elif retrieval_mode == "semantic":
            rows.sort(key=lambda r: (-r["score"], r["path"], r["line"], r["text"]))
        by_file: dict[str, list] = {}
        for r in rows:
            by_file.setdefault(r.pop("path"), []).append(r)
        return {"result_count": len(rows), "truncated": len(rows) >= max_results, "results": [{"file": p, "matches": m} for p, m in by_file.items()], **meta}

    def search_symbols(self, query, kind, file_pattern, language, max_results, token_budget, detail_level) -> dict:
        found = symbols.search(self._symbols(), query, kind, language, file_pattern)
        level = {"compact": ("id", "name", "kind", "file", "line"), "standard": ("id", "name", "kind", "file", "line", "signature", "summary"), "full": tuple(self._symbols().columns)}[detail_level]
        out: dict[str, Any] = {"total_symbols": self._symbols().count()}
        if token_budget is None:
            rows = symbols.ranked(found, max_results)
        else:
            taken = symbols.pack_budget(found, token_budget).persist()
            first = taken.first()
            out |= {"token_budget": token_budget, "tokens_used": first.tokens_used if first else 0}
            rows = found.join(taken.select("id"), "id", "left_semi").orderBy(F.desc("score"), "file", "line", "name", "id")
        out["results"] = _list(rows.select(*level, F.round("score", 6).alias("score")))
        return out | {"result_count": len(out["results"])}

    def get_symbol_source(self, symbol_id, symbol_ids, verify, context_lines) -> dict:
        asked = _ids(symbol_id, symbol_ids, "symbol_id")
        found = {r["id"]: r for r in _list(chunks.symbol_source(self._symbols(), self.files, asked, context_lines))}
        for r in found.values():
            if not verify:
                r["content_verified"] = None
        return {"results": [found.get(i, {"id": i, "error": f"Symbol not found: {i}"}) for i in asked]}

    def get_context_bundle(self, symbol_id, symbol_ids, include_callers, output_format) -> dict:
        asked = _ids(symbol_id, symbol_ids, "symbol_id")
        bundle = chunks.context_bundle(self._symbols(), self.files, self.imports if include_callers else None, asked, include_callers)
        rows = {r["id"]: r for r in _list(bundle)}
        if missing := [i for i in asked if i not in rows]:
            raise RequestError(f"Symbol not found: {missing[0]}")
        if output_format == "markdown":
            text = {r.id: r.markdown for r in chunks.markdown(bundle).collect()}
            return {"markdown": "\n\n".join(text[i] for i in asked)}
        return {"symbols": [rows[i] for i in asked]}

    def search_columns(self, query, model_pattern, max_results) -> dict:
        if self.columns is None:
            raise RequestError("the corpus has no column metadata")
        found = chunks.search_columns(self.columns, query, model_pattern, max_results)
        if self.symbols is not None:
            found = chunks.model_files(found, self.symbols).orderBy(F.desc("score"), "model", "column", "source")
        rows = _list(found)
        many = self.columns.select("source").distinct().count() > 1
        for r in rows:
            if not many:
                r.pop("source")
        totals = self.columns.agg(F.countDistinct("source", "model").alias("m"), F.count("*").alias("c")).first()
        return {"result_count": len(rows), "results": rows, "total_models": totals.m, "total_columns": totals.c}

    # ---- relations

    def find_importers(self, file_path, file_paths, max_results) -> dict:
        asked = _paths(file_path, file_paths)
        if file_path:
            file_path = asked[0]
            rows = _list(graph.importers(self.imports, file_path, max_results))
            return {"file_path": file_path, "importer_count": self.imports.where(F.col("resolved") == file_path).select("source_file").distinct().count(), "importers": rows}
        found: dict[str, list[dict]] = {}
        for r in _list(graph.importers_of(self.imports, asked, max_results).orderBy("path", "file")):
            found.setdefault(r.pop("path"), []).append(r)
        counts = {p: own[0]["importer_count"] for p, own in found.items()}
        rows = lambda p: [{k: v for k, v in r.items() if k != "importer_count"} for r in found.get(p, [])]
        return {"results": [{"file_path": p, "importer_count": counts.get(p, 0), "importers": rows(p)} for p in asked]}

    def find_references(self, identifier, identifiers, max_results) -> dict:
        asked = _ids(identifier, identifiers, "identifier")
        found = graph.references(self.imports, asked)
        best = found.groupBy("identifier", "file").agg(F.min("match_type").alias("match_type"), F.array_sort(F.collect_list(F.struct("specifier", "match_type"))).alias("matches"))
        rank = F.row_number().over(W.partitionBy("identifier").orderBy("file"))
        first = best.withColumn("_rank", rank).where(F.col("_rank") <= max_results).drop("_rank")
        rows = _list(first.orderBy("identifier", "file"))
        per = [{"identifier": i, "references": [{k: r[k] for k in ("file", "matches" if identifier else "match_type")} for r in rows if r["identifier"] == i]} for i in asked]
        return per[0] if identifier else {"results": per}

    def check_references(self, identifier, identifiers, search_content, max_content_results) -> dict:
        asked = _ids(identifier, identifiers, "identifier")
        syms = self.symbols if self.symbols is not None else self.spark.createDataFrame([], "file string, name string")
        imported: dict[str, dict[str, list]] = {i: {} for i in asked}
        for r in graph.references(self.imports, asked).orderBy("identifier", "file", "specifier").collect():
            imported[r.identifier].setdefault(r.file, []).append({"specifier": r.specifier, "match_type": r.match_type})
        held: dict[str, dict[str, list]] = {i: {} for i in asked}
        if search_content:
            for r in graph.content_references(self.files, syms, asked, max_content_results).orderBy("identifier", "file", "line").collect():
                held[r.identifier].setdefault(r.file, []).append({"line": r.line, "text": r.text})
        rows = lambda by: [{"file": f, "matches": m} for f, m in sorted(by.items())]
        out = []
        for i in asked:
            one = {"identifier": i, "is_referenced": bool(imported[i] or held[i]), "import_count": len(imported[i]), "import_references": rows(imported[i]), "content_count": len(held[i])}
            out.append(one | ({"content_references": rows(held[i])} if search_content else {}))
        return out[0] if identifier else {"results": out}

    def _edges(self) -> DataFrame:
        return self.imports.where("resolved is not null").select(F.col("source_file").alias("source"), F.col("resolved").alias("target"))

    def get_dependency_graph(self, file, direction, depth) -> dict:
        file = tx.clean_path(file)
        start = self.files.where(F.col("path") == file).select("path")
        if not start.head(1):
            raise RequestError(f"File not found: {file}")
        nodes, met = graph.bfs(self._edges(), start, depth, direction)
        near = {r.node: {k: r[k] for k in ("imports", "imported_by") if r[k]} for r in graph.neighbours(self._edges(), nodes).collect()}
        return {"nodes": _list(nodes.orderBy("level", "node")), "edges": _list(met.orderBy("source", "target")), "neighbors": near}

    def get_class_hierarchy(self, class_name) -> dict:
        own = self._symbols().where(F.lower("kind") == "class")
        row = own.where(F.lower("name") == class_name.lower()).select("name").distinct().orderBy((F.col("name") != class_name).cast("int"), "name").first()
        if row is None:
            raise RequestError(f"Class not found: {class_name}")
        bases = symbols.class_bases(own)
        known = own.select("name").distinct().withColumn("indexed", F.lit(True))
        up = symbols.closure(bases, row.name).join(known, "name", "left").select("name", "level", F.coalesce("indexed", F.lit(False)).alias("indexed"))
        return {"class": row.name, "ancestors": _list(up.orderBy("level", "name")), "descendants": _list(symbols.closure(bases, row.name, up=False).orderBy("level", "name"))}

    def get_related_symbols(self, symbol_id, max_results) -> dict:
        if not self._symbols().where(F.col("id") == symbol_id).head(1):
            raise RequestError(f"Symbol not found: {symbol_id}")
        rows = _list(symbols.related(self._symbols(), self.imports, symbol_id, max_results).orderBy(F.desc("score"), "file", "name", "id"))
        return {"related_count": len(rows), "related": rows}

    def get_blast_radius(self, symbol, depth) -> dict:
        by = self._symbols()
        rows: list = []
        for test in (F.col("id") == symbol, F.col("name") == symbol, F.lower("name") == symbol.lower()):
            rows = by.where(test).select("id", "name", "file").orderBy("file", "id").limit(21).collect()
            if rows:
                break
        if not rows:
            raise RequestError(f"Symbol not found: {symbol}")
        if len(rows) > 1:
            return {"error": f"Ambiguous symbol: {symbol}", "candidates": [r.asDict() for r in rows[:20]]}
        found = _list(graph.blast_radius(self.files, self._edges(), rows[0].name, rows[0].file, depth).orderBy("level", "path"))
        return {"symbol": rows[0].asDict(), "confirmed": [r for r in found if r["status"] == "confirmed"], "potential": [r for r in found if r["status"] == "potential"]}

    def suggest_queries(self) -> dict:
        own = self._symbols()
        count = lambda c: {r[0]: r[1] for r in own.groupBy(F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("unknown"))).count().collect()}
        words = [r.keyword for r in symbols.keyword_histogram(own).collect()]
        return {"kinds": count("kind"), "languages": count("language"), "top_keywords": words, "most_imported": _list(symbols.most_imported(self.imports)), "example_queries": [{"query": w, "tool": "search_symbols"} for w in words[:2]]}

    # ---- telemetry and freshness

    def get_session_stats(self, now: str, trend_windows: list[str]) -> dict:
        """The session's totals, those of all sessions where they are kept, and for each asked window its points with their tools."""
        if self.calls is None:
            raise RequestError("there are no recorded calls")
        if unknown := [w for w in trend_windows if w not in telemetry.WINDOWS]:
            raise RequestError(f"unknown trend window: {unknown[0]}")
        own = telemetry.normalise_calls(self.calls)
        at = now or dt.datetime.now(dt.UTC).strftime("%Y-%m-%d %H:%M:%S")
        out = {"total": _list(telemetry.rollup(own))[0], "tools": _list(telemetry.rollup(own, "tool_name").orderBy("tool_name")), "costs": _list(telemetry.competitor_costs(own)), "windows": _list(telemetry.trends(own, at))[0]}
        if self.totals is not None:
            out["cumulative"] = _list(self.totals.snapshot())[0] | {"tools": _list(self.totals.tools().orderBy("tool_name"))}
        windows = {}
        for w in dict.fromkeys(trend_windows):  # as many points as the window has steps
            tools: dict = {}
            for r in _list(telemetry.trend_by_tool(own, w, at).orderBy("bucket", "tool_name")):
                tools.setdefault(r.pop("bucket"), []).append(r)
            windows[w] = [p | {"tools": tools.get(p["bucket"], [])} for p in _list(telemetry.trend(own, w, at).orderBy("bucket"))]
        return out | {"trend_windows": windows}

    def wait_for_fresh(self, timeout_ms: int) -> dict:
        from .streaming.changes import wait_for_fresh

        return {"fresh": True if self.stream is None else wait_for_fresh(self.stream, timeout_ms)}

    def check_freshness(self, current_head: str) -> dict:
        """Whether the corpus has been indexed at this head, and where the commits are known, how many it lacks."""
        fresh = None if not (current_head and self.head) else current_head == self.head
        out = {"fresh": fresh, "indexed_head": self.head or None, "current_head": current_head or None}
        if self.commits is not None and fresh is not None:
            try:
                out["commits_behind"] = 0 if fresh else history.distance(self.commits, self.head, current_head)
            except ValueError:  # a head that the table does not have
                out["commits_behind"] = None
        return out


@dataclass
class Workspace:
    """Several corpora by name. Every query takes `repo`: a full name, or a bare one that only one corpus has; with one corpus it may be left out.

    store (a sources.store.RepoStore) keeps what is indexed; what is deleted goes there, too. With embed, chunks of what is indexed get vectors."""

    spark: SparkSession
    corpora: dict[str, Corpus] = field(default_factory=dict)
    store: Any = None
    embed: Any = None  # from a column of texts to one of vectors

    def _query_vector(self, text: str) -> list[float]:
        return list(self.spark.range(1).select(self.embed(F.lit(text))).first()[0])

    def _find(self, repo: str) -> Corpus:
        if not repo and len(self.corpora) == 1:
            return next(iter(self.corpora.values()))
        if repo in self.corpora:
            return self.corpora[repo]
        near = [n for n in sorted(self.corpora) if n.rsplit("/", 1)[-1] == repo or n.rsplit("/", 1)[-1].rsplit("-", 1)[0] == repo]
        if len(near) > 1:
            raise RequestError(f"Ambiguous repository name: {repo}")
        if not near:
            raise RequestError(f"Repository not found: {repo}")
        return self.corpora[near[0]]

    def _of_path(self, path: str) -> Corpus | None:
        """The corpus with the longest root that contains a path."""
        own = [c for c in self.corpora.values() if c.root and (path == c.root or path.startswith(c.root + "/"))]
        return max(own, key=lambda c: len(c.root), default=None)

    def call(self, tool: str, arguments: dict[str, Any] | None = None) -> dict[str, Any]:
        given = dict(arguments or {})
        repo = str(given.pop("repo", "") or "").strip()
        try:
            if tool in ("index_folder", "index_repo"):
                return self._index(tool, given)
            if tool == "index_file":
                own = self._of_path(str(given.get("path", "")).strip()) or (self._find(repo) if repo else None)
                empty = Corpus(self.spark.createDataFrame([], "path string, size_bytes long, content string"))
                return self._index_file(own, given) if own is not None else empty.call(tool, given)
            if tool == "list_repos":
                return {"repos": [{"repo": n, "file_count": c.files.count(), "indexed_at": c.indexed_at and c.indexed_at.isoformat()} for n, c in sorted(self.corpora.items())]}
            if tool == "resolve_repo":
                return _resolved(self.spark, str(given.get("path", "")), lambda root: own if (own := self._open(root)).name == repo_id(root) else None)
            if tool == "get_symbol_diff":
                a, b = (self._find(str(given.pop(k, "") or "")) for k in ("repo_a", "repo_b"))
                return replace(a, other=b).call(tool, given)
            if tool == "invalidate_cache":
                own = self._find(repo)
                own.call(tool)
                del self.corpora[own.name]
                if self.store is not None:
                    self.store.delete(own.name)
                return {"success": True, "repo": own.name}
            return self._find(repo).call(tool, given)
        except RequestError as e:
            return {"error": str(e)}

    def _open(self, root: str) -> Corpus:
        """The corpus of a root: the one at hand, the last version of the store, or an empty one."""
        name = repo_id(root)
        if name in self.corpora:
            return self.corpora[name]
        own = Corpus(self.spark.createDataFrame([], "path string, size_bytes long, content string"), embed=self.embed and self._query_vector)
        if self.store is not None:
            own.kept = self.store.snapshots(name)
            if (entry := own.kept.entry()) is not None:
                own.files, own.root, own.name, own.head = own.kept.read(entry["version"]), root, name, entry["head"]
                own.indexed_at = dt.datetime.fromisoformat(entry["indexed_at"]).replace(tzinfo=dt.UTC)
        return own

    def _index(self, tool: str, given: dict[str, Any]) -> dict[str, Any]:
        root = str(given.get("path" if tool == "index_folder" else "url", "")).removeprefix("file://").rstrip("/")
        own = self._open(root)
        before = own.files
        out = own.call(tool, given)
        if out.get("success"):
            self.corpora[own.name] = own
            if self.embed is not None and (own.files is not before or own.chunk_vectors is None):
                self._vectors(own, before)
        return out

    def _index_file(self, own: Corpus, given: dict[str, Any]) -> dict[str, Any]:
        """One file, and its chunks' vectors."""
        before = own.files
        out = own.call("index_file", given)
        if out.get("success") and self.embed is not None and own.files is not before:
            self._vectors(own, before, [out["file"]])
        return out

    def _vectors(self, own: Corpus, before: DataFrame, paths: list[str] | None = None) -> None:
        """Bring the chunk vectors up to date: only chunks of files that differ (or of the given ones) are embedded. They are written: a lazy
        table would be computed anew, and from all earlier ones, in each search."""
        hashed = lambda df: df.select("path", "content_hash" if "content_hash" in df.columns else ingest.content_hash(F.col("content")).alias("content_hash"))
        if own.chunk_vectors is None:
            found = vectors.embed_chunks(chunks.chunk(own.files, own.name), "main", self.embed)
        else:
            touched = catalog.file_diff(hashed(before), hashed(own.files)).select("path") if paths is None else self.spark.createDataFrame([(p,) for p in paths], "path string")
            cut = chunks.chunk(own.files.join(touched, "path", "left_semi"), own.name)
            found = vectors.sync_chunks(own.chunk_vectors, cut, touched, "main", self.embed)
        own.chunk_vectors = scratch.Steps(self.spark, "vectors").save(found)
