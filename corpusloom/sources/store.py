"""Stores and sinks as Parquet tables, partitioned by what is deleted or replaced together."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import remove
from .versions import BUCKETS, Snapshots


class Table:
    """Rows in partitions that are replaced whole: written beside the old ones, then swapped by a dynamic overwrite."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path, keys
        self.schema = T.StructType.fromDDL(schema)

    def read(self) -> DataFrame:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path).select(*self.schema.names)

    def replace(self, rows: DataFrame, **key: str) -> None:
        """The partitions that rows have, with these rows only. With a key, that partition is deleted if there are no rows."""
        if key and not rows.head(1):
            self.drop(**key)
            return
        rows.select(*self.schema.names).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.keys).parquet(self.path)

    def append(self, rows: DataFrame) -> None:
        rows.select(*self.schema.names).write.mode("append").partitionBy(*self.keys).parquet(self.path)

    def drop(self, **key: str) -> bool:
        """Delete one partition; whether there was one."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *(f"{k}={key[k]}" for k in self.keys)]))
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def _slug(repo: str) -> str:
    """A folder's name for a repository; two repositories have two."""
    return repo.replace("_", "_u").replace("/", "_s")


class RepoStore:
    """Repositories, each in versions of its own (see versions): a save writes the buckets that differ, and readers may hold on to an older version."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def snapshots(self, repo: str) -> Snapshots:
        return Snapshots(self.spark, f"{self.path}/repos/{_slug(repo)}", self.buckets)

    def save(self, repo: str, files: DataFrame, git_head: str = "", indexed_at: str | None = None) -> int:
        """Make files (path, content) the repository's next version; its number."""
        return self.snapshots(repo).replace(files, head=git_head, name=repo, indexed_at=indexed_at)

    def load(self, repo: str, version: int | None = None) -> DataFrame:
        return self.snapshots(repo).read(version)

    def changes(self, repo: str, files: DataFrame) -> DataFrame:
        """path, change against the last version."""
        from ..operators.catalog import file_diff

        return file_diff(self.load(repo), files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash")))

    def save_changes(self, repo: str, net: DataFrame, git_head: str = "") -> int:
        """Apply net changes (path, change_type, content) to the last version: only the buckets of these paths are written."""
        return self.snapshots(repo).commit(net, head=git_head, name=repo)

    def list(self) -> DataFrame:
        """Each repository's last version."""
        entry = "version long, name string, indexed_at string, head string, file_count long"
        try:
            found = self.spark.read.schema(entry).json(f"{self.path}/repos/*/log/*.json")
        except AnalysisException:
            found = self.spark.createDataFrame([], entry)
        last = found.groupBy(F.col("name").alias("repo")).agg(F.max_by(F.struct("indexed_at", "head", "file_count", "version"), "version").alias("e"))
        return last.select("repo", F.col("e.indexed_at").cast("timestamp").alias("indexed_at"), F.col("e.head").alias("git_head"), "e.file_count", "e.version").orderBy("repo")

    def delete(self, repo: str) -> bool:
        return remove(self.spark, f"{self.path}/repos/{_slug(repo)}")

    def resolve(self, name: str) -> str | None:
        """owner/name as it is, or a bare name that only one repository has; more than one is an error."""
        rows = [r.repo for r in self.list().where((F.col("repo") == name) | (F.substring_index("repo", "/", -1) == name)).limit(21).collect()]
        if name in rows:
            return name
        if len(rows) > 1:
            raise ValueError(f"Ambiguous repository name: {name}")
        return rows[0] if rows else None


class CallStore:
    """Recorded calls by day: appended, pruned by whole days and then by time, read since a moment."""

    SCHEMA = "captured_at timestamp, tool_name string, duration_ms double, request_tokens long, response_tokens long, total_tokens long, input_tokens_saved long, output_tokens_saved long, day date"

    def __init__(self, spark: SparkSession, path: str):
        self.calls = Table(spark, path, self.SCHEMA, ["day"])

    def record(self, calls: DataFrame) -> None:
        self.calls.append(calls.withColumn("day", F.to_date("captured_at")))

    def since(self, moment: str) -> DataFrame:
        at = F.lit(moment).cast("timestamp")
        return self.calls.read().where((F.col("day") >= F.to_date(at)) & (F.col("captured_at") >= at)).drop("day")

    def prune(self, now: str, days: int = 30) -> int:
        """Delete what is older than so many days: whole days go, and the day on the border is written again without its older calls. How many days
        went."""
        limit = F.lit(now).cast("timestamp") - F.expr(f"interval {days} days")
        border = F.to_date(limit)
        old = [str(r.day) for r in self.calls.read().select("day").distinct().where(F.col("day") < border).collect()]  # days
        on = self.calls.read().where(F.col("day") == border)
        if on.where(F.col("captured_at") < limit).head(1):
            day = str(on.first().day)
            staged = f"{self.calls.path}-staging-{day}"
            on.where(F.col("captured_at") >= limit).write.mode("overwrite").parquet(staged)
            self.calls.replace(self.calls.spark.read.schema(self.calls.schema).parquet(staged), day=day)
        return sum(self.calls.drop(day=d) for d in old)


class SnapshotStore:
    """Rollups of calls as they stood at a moment, appended; those of a benchmark are told apart and left out of deltas."""

    SCHEMA = "captured_at timestamp, tool_name string, call_count long, total_tokens long, tokens_saved long, run_id string, day date"

    def __init__(self, spark: SparkSession, path: str):
        self.rows = Table(spark, path, self.SCHEMA, ["day"])

    def capture(self, rollup: DataFrame, at: str, run_id: str = "") -> None:
        """rollup: tool_name, call_count, total_tokens, tokens_saved."""
        when = F.lit(at).cast("timestamp")
        self.rows.append(rollup.select(when.alias("captured_at"), "tool_name", "call_count", "total_tokens", "tokens_saved", F.lit(run_id).alias("run_id"), F.to_date(when).alias("day")))

    def deltas(self) -> DataFrame:
        """Growth by tool since the snapshot before, of snapshots that no benchmark run made."""
        from ..operators.telemetry import snapshot_deltas

        own = self.rows.read().where(F.coalesce("run_id", F.lit("")) == "").drop("run_id", "day")
        return snapshot_deltas(own, ["call_count", "total_tokens", "tokens_saved"], series=["tool_name"])


_SYMBOL = "struct<id:string,name:string,kind:string,file:string,language:string,line:int,end_line:int,signature:string,summary:string,docstring:string,keywords:array<string>,byte_length:int,content_hash:string>"
_INDEX = f"""repo string, owner string, name string, display_name string, source_root string, indexed_at string, index_version int, git_head string, file_count long, symbol_count long,
 files map<string,string>, file_blob_shas map<string,string>, file_mtimes map<string,long>, languages map<string,long>, symbols array<{_SYMBOL}>"""
#: The version of an index file that names none.
INDEX_VERSION = 1


@dataclass(frozen=True)
class IndexFiles:
    """What JSON index files hold, as tables: repos (a row each), files (repo, path, content_hash, blob_sha, mtime), symbols, languages (repo, language, n)."""

    repos: DataFrame
    files: DataFrame
    symbols: DataFrame
    languages: DataFrame


def _index_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_INDEX).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def read_index(spark: SparkSession, path: str) -> IndexFiles:
    """JSON index files (one object each), of which whole repositories are taken over. A file that is not JSON, and one without a repo, is an error; a count
    that is missing is that of what the file holds; files that only the hashes of blobs or the times name are there, too."""
    rows = _index_rows(spark, path)
    named = F.when(F.trim(F.coalesce("repo", F.lit(""))) != "", F.col("repo")).otherwise(F.raise_error(F.lit("an index file has no repo")).cast("string"))
    rows = rows.withColumn("repo", named)
    none = lambda c, kind: F.coalesce(c, F.create_map().cast(kind))
    hashes, blobs, times, languages = none("files", "map<string,string>"), none("file_blob_shas", "map<string,string>"), none("file_mtimes", "map<string,bigint>"), none("languages", "map<string,bigint>")
    n_files, n_symbols = F.size(F.map_keys(hashes)).cast("long"), F.coalesce(F.size("symbols"), F.lit(0)).cast("long")
    count = lambda c, own: F.when(F.coalesce(c, F.lit(0)) > 0, F.col(c)).otherwise(own).alias(c)
    repos = rows.select(
        "repo", F.coalesce(F.nullif("display_name", F.lit("")), F.substring_index("repo", "/", -1)).alias("display_name"), "source_root", F.col("indexed_at").cast("timestamp").alias("indexed_at"),
        F.when(F.coalesce("index_version", F.lit(0)) > 0, F.col("index_version")).otherwise(INDEX_VERSION).alias("index_version"), "git_head", count("file_count", n_files), count("symbol_count", n_symbols),
    )
    paths = F.array_distinct(F.concat(F.map_keys(hashes), F.map_keys(blobs), F.map_keys(times)))
    files = rows.select("repo", F.explode(paths).alias("path"), hashes.alias("_h"), blobs.alias("_b"), times.alias("_t"))
    files = files.select("repo", "path", *[F.try_element_at(c, F.col("path")).alias(n) for c, n in (("_h", "content_hash"), ("_b", "blob_sha"), ("_t", "mtime"))])
    return IndexFiles(repos, files, rows.select("repo", F.explode("symbols").alias("s")).select("repo", "s.*"), rows.select("repo", F.explode(languages).alias("language", "n")))


def read_index_json(spark: SparkSession, path: str) -> DataFrame:
    """Symbols of JSON index files: repo and the fields of every symbol. Fields that a symbol lacks are null; a file without symbols has no rows; a file
    that is not JSON is an error."""
    return _index_rows(spark, path).select("repo", F.explode("symbols").alias("s")).select("repo", "s.*")


def report(rows: DataFrame, title: str, most: int = 1000) -> tuple[str, str]:
    """(JSON, Markdown) of a small result; more than `most` rows is an error."""
    found = [r.asDict(recursive=True) for r in rows.limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} rows")
    names = rows.columns
    lines = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    lines += ["| " + " | ".join("" if r[c] is None else str(r[c]) for c in names) + " |" for r in found]
    return json.dumps({"title": title, "rows": found}, default=str, sort_keys=True), "\n".join(lines) + "\n"


def payload_tokens(value) -> int:
    """Estimated tokens of a JSON value: a quarter of its compact bytes, rounded up; keys sorted, <, > and & escaped."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    for c in "<>&":
        text = text.replace(c, f"\\u{ord(c):04x}")
    return -(-len(text.encode()) // 4)
