"""Snapshots of files in versions: copy on write by bucket, published by one atomic rename, read at a pinned version.

Files are dealt into buckets by a hash of their path. A commit reads the buckets that its changes touch, writes these anew in a folder of its own, and writes a
manifest that names one folder of files for every bucket: the new ones, and the old ones of all others. Nothing that an earlier version names is ever
changed. The version exists from the moment its log entry gets its final name, which fails if another writer has taken the number; a writer that
dies before has only left a folder that no version names. Readers hold a version number and are not disturbed by later commits.

    <path>/log/000000000003.json   version, parent, manifest, counts, head, moment
    <path>/manifests/<commit>      bucket, file, rows: a row for each file of data
    <path>/data/<commit>/bucket=7  Parquet

A manifest has as many rows as there are buckets, whatever the number of files; only these rows reach the driver.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import remove

BUCKETS = 1024
#: Commits are tried again so often if others were faster.
ATTEMPTS = 3
SCHEMA = "path string, content string, size_bytes long, content_hash string"
_ENTRY = "version long, parent long, manifest string, buckets int, touched int, file_count long, head string, indexed_at string, name string, root string"


class Conflict(RuntimeError):
    """Other writers have published versions in between, every time."""


class Snapshots:
    """The versions of one set of files."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        """buckets counts for a new store; an existing one keeps the number that it was made with."""
        self.spark, self.path, self._buckets = spark, path.rstrip("/"), buckets

    # ---- the log

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """All versions that can be read, in order."""
        at, fs = self._fs(f"{self.path}/log")
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def entry(self, version: int | None = None) -> dict | None:
        """The log entry of a version, by default the last; None if there is none."""
        if version is None:
            known = self.versions()
            if not known:
                return None
            version = known[-1]
        at, fs = self._fs(f"{self.path}/log/{version:012d}.json")
        if not fs.exists(at):
            raise ValueError(f"there is no version {version}")
        stream = fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def history(self) -> DataFrame:
        """A row for each version."""
        try:
            return self.spark.read.schema(_ENTRY).json(f"{self.path}/log/*.json")
        except AnalysisException:
            return self.spark.createDataFrame([], _ENTRY)

    def _publish(self, entry: dict) -> bool:
        """Give the entry its final name; False if the version is taken."""
        jvm = self.spark._jvm
        final, fs = self._fs(f"{self.path}/log/{entry['version']:012d}.json")
        fs.mkdirs(final.getParent())
        own, _ = self._fs(f"{self.path}/log/_{uuid.uuid4().hex}")
        out = fs.create(own, False)
        out.write(json.dumps(entry).encode())
        out.close()
        names = jvm.org.apache.hadoop.fs
        context = names.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(own, final, self.spark.sparkContext._gateway.new_array(getattr(names, "Options$Rename"), 0))
        except Exception as e:
            fs.delete(own, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    # ---- buckets

    def _bucket(self, buckets: int, path: Column | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col("path") if path is None else path), F.lit(buckets)).cast("int")

    def manifest(self, version: int | None = None) -> dict[int, list[tuple[str, int]]]:
        """For each bucket its files (below the store's path) and their rows."""
        entry = self.entry(version)
        out: dict[int, list[tuple[str, int]]] = {}
        if entry and entry["manifest"]:
            for r in self.spark.read.parquet(f"{self.path}/{entry['manifest']}").collect():
                out.setdefault(r.bucket, []).append((r.file, r.rows))
        return out

    def _read(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/{f}" for f in files])

    def read(self, version: int | None = None, paths: list[str] | None = None) -> DataFrame:
        """path, content, size_bytes, content_hash as of a version. With paths only their buckets are read."""
        manifest, entry = self.manifest(version), self.entry(version)
        if paths is None:
            return self._read([f for own in manifest.values() for f, _ in own])
        named = self.spark.createDataFrame([(p,) for p in paths], "path string")
        wanted = [r[0] for r in named.select(self._bucket(entry["buckets"] if entry else self._buckets)).distinct().collect()]
        return self._read([f for b in wanted for f, _ in manifest.get(b, [])]).join(F.broadcast(named), "path", "left_semi")  # the caller's list

    # ---- commits

    def commit(self, net: DataFrame, head: str = "", name: str = "", root: str = "", indexed_at: str | None = None) -> int:
        """Apply net changes (path, change_type, content), at most one for each path, to the last version; the new version's number. Without changes
        the version has its parent's manifest."""
        net = net.select("path", "change_type", "content")
        if net.groupBy("path").count().where("count > 1").head(1):
            raise ValueError("a path has several changes: coalesce them first")
        for _ in range(ATTEMPTS):
            base = self.entry()
            version = self._commit(net, base, dict(head=head, name=name, root=root, indexed_at=indexed_at or time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime())))
            if version is not None:
                return version
        raise Conflict(f"{self.path}: other writers were faster {ATTEMPTS} times")

    def _commit(self, net: DataFrame, base: dict | None, about: dict) -> int | None:
        buckets = base["buckets"] if base else self._buckets
        bucket = self._bucket(buckets)
        touched = sorted(r[0] for r in net.select(bucket.alias("b")).distinct().collect())  # at most one for each bucket
        manifest = self.manifest(base["version"]) if base else {}
        commit = uuid.uuid4().hex
        if touched:
            old = self._read([f for b in touched for f, _ in manifest.get(b, [])])
            kept = old.join(net.select("path"), "path", "left_anti")
            new = net.where("change_type <> 'deleted'").select("path", "content", F.octet_length("content").cast("long").alias("size_bytes"), F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"))
            rows = kept.unionByName(new.select(*kept.columns)).withColumn("bucket", bucket)
            at = f"{self.path}/data/{commit}"
            rows.repartition("bucket").write.partitionBy("bucket").parquet(at)
            own = self._listed(at, commit)
            manifest = {b: f for b, f in manifest.items() if b not in set(touched)} | own
        entries = [(b, f, n) for b, own in sorted(manifest.items()) for f, n in own]
        where = base["manifest"] if base and not touched else ""
        if touched and entries:
            where = f"manifests/{commit}"
            self.spark.createDataFrame(entries, "bucket int, file string, rows long").coalesce(1).write.parquet(f"{self.path}/{where}")
        entry = about | dict(version=base["version"] + 1 if base else 1, parent=base["version"] if base else None, manifest=where, buckets=buckets, touched=len(touched), file_count=sum(n for *_, n in entries))
        return entry["version"] if self._publish(entry) else None

    def _listed(self, at: str, commit: str) -> dict[int, list[tuple[str, int]]]:
        """The files below a commit's folder with their rows, by bucket."""
        out: dict[int, list[tuple[str, int]]] = {}
        place, fs = self._fs(at)
        if not any(s.isDirectory() for s in fs.listStatus(place)):
            return out  # all rows of the touched buckets went
        rows = self.spark.read.parquet(at).groupBy("bucket", F.col("_metadata.file_name").alias("name")).count()
        for r in rows.collect():
            out.setdefault(r.bucket, []).append((f"data/{commit}/bucket={r.bucket}/{r.name}", r["count"]))
        return out

    def replace(self, files: DataFrame, **about: str) -> int:
        """Make files (path, content) the next version: only buckets where something differs are written."""
        from ..operators.catalog import file_diff

        now = files.select("path", "content")
        hashed = now.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"))
        diff = file_diff(self.read().select("path", "content_hash"), hashed)
        kind = F.create_map(*[F.lit(x) for x in ("new", "added", "changed", "modified", "deleted", "deleted")])
        return self.commit(diff.select("path", F.element_at(kind, F.col("change")).alias("change_type")).join(now, "path", "left").select("path", "change_type", "content"), **about)

    def changes(self, before: int, after: int) -> DataFrame:
        """path, change (new, changed, deleted) between two versions: only buckets that have other files are read."""
        from ..operators.catalog import file_diff

        a, b = self.manifest(before), self.manifest(after)
        differ = [k for k in sorted(set(a) | set(b)) if sorted(a.get(k, [])) != sorted(b.get(k, []))]
        files = lambda m: self._read([f for k in differ for f, _ in m.get(k, [])]).select("path", "content_hash")
        return file_diff(files(a), files(b))

    def vacuum(self, keep: int = 10, older_than: float = 3600.0) -> int:
        """Forget all versions but the last `keep`, and delete what no version names; of folders that no version has ever named those whose last change is so
        many seconds ago (a commit may be under way). How many files and folders went."""
        known = self.versions()
        kept, gone = known[-keep:], known[:-keep]
        manifests = {v: self.entry(v)["manifest"] for v in known}
        stay = {f for v in kept for own in self.manifest(v).values() for f, _ in own}
        drop = {f for v in gone for own in self.manifest(v).values() for f, _ in own} - stay
        n = 0
        for v in gone:
            remove(self.spark, f"{self.path}/log/{v:012d}.json")
        for m in {manifests[v] for v in gone} - {manifests[v] for v in kept} - {""}:
            remove(self.spark, f"{self.path}/{m}")
        for f in drop:
            n += remove(self.spark, f"{self.path}/{f}")
        named = {f.split("/")[1] for f in stay}
        at, fs = self._fs(f"{self.path}/data")
        for s in fs.listStatus(at) if fs.exists(at) else []:
            own = s.getPath().getName()
            if own not in named and (time.time() - s.getModificationTime() / 1000 >= older_than or any(f.split("/")[1] == own for f in drop)):
                n += remove(self.spark, f"{self.path}/data/{own}")
        return n
