"""From folders to snapshots: listing, links, and what has to be read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog
from ..operators.catalog import MOST_BYTES, SKIPPED_DIRECTORIES

SKIPPED = set(SKIPPED_DIRECTORIES)

#: Files of one corpus at most, for a folder and for a repository.
FOLDER_FILES, REPO_FILES = 2000, 10_000


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


#: Bytes of hidden files that the driver holds at once, and files that are read by name instead of by folder.
_HELD_BYTES, _MOST_NAMED = 16 << 20, 20_000


def _store_path(spark: SparkSession, root: str):
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, top, fs.makeQualified(top).toUri().getPath().rstrip("/") + "/"


def is_hidden(path: str) -> bool:
    """Whether Spark's readers leave a path out: a part of it begins with a dot or an underscore."""
    return any(p[0] in "._" for p in path.split("/") if p)


def listing(spark: SparkSession, root: str, changed_paths: list[str] | None = None) -> DataFrame:
    """path (below the root), size_bytes of all files or of the given ones that exist: nothing is opened. Spark lists; the driver adds the files that
    Spark's readers leave out, but for those in directories that are never entered."""
    clean = root.rstrip("/")
    fs, top, base = _store_path(spark, clean)
    wanted = set(changed_paths or [])
    hidden, found = [], fs.listFiles(top, True) if fs.exists(top) and fs.getFileStatus(top).isDirectory() else None
    while found is not None and found.hasNext():
        at = found.next()
        path = at.getPath().toUri().getPath().removeprefix(base)
        if is_hidden(path) and not SKIPPED & set(path.split("/")[:-1]) and (changed_paths is None or path in wanted or path.endswith(".gitignore")):
            hidden.append((path, int(at.getLen())))
    more = spark.createDataFrame(hidden, "path string, size_bytes long")
    at = [p for c in changed_paths if not is_hidden(c) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p := f"{clean}/{c}"))] if changed_paths else [clean]
    if not at:
        return more
    return _files(spark, at, clean).select("path", "size_bytes").unionByName(more)


def _files(spark: SparkSession, at: list[str], root: str) -> DataFrame:
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(at)
    bare = F.regexp_replace("path", "^[a-z0-9]+:/*(?=/)", "")
    plain = root.split(":", 1)[-1] if "://" in root else root
    below = F.substring(bare, F.length(F.lit("/" + plain.strip("/") + "/")) + 1, F.length(bare))
    return raw.select(below.alias("path"), F.col("length").alias("size_bytes"), F.decode("content", "UTF-8").alias("content"))


def contents(spark: SparkSession, root: str, wanted: DataFrame, folder: str) -> DataFrame:
    """path, content of the wanted files (path, size_bytes), written to `folder`; bytes that are not UTF-8 become replacement characters. Up to
    _MOST_NAMED files are opened by name; of more, a folder is read and the rest dropped. Files that Spark's readers leave out go through the driver, a
    few MB at a time."""
    clean, schema = root.rstrip("/"), "path string, content string"
    hidden = F.col("path").rlike(r"(^|/)[._]")
    names = [r.path for r in wanted.where(~hidden).select("path").limit(_MOST_NAMED + 1).collect()]
    if len(names) > _MOST_NAMED:
        _files(spark, [clean], clean).where(F.col("size_bytes") <= MOST_BYTES).join(wanted.select("path"), "path", "left_semi").select("path", "content").write.mode("append").parquet(folder)
    elif names:
        _files(spark, [f"{clean}/{n}" for n in names], clean).select("path", "content").write.mode("append").parquet(folder)
    jvm = spark._jvm
    fs, _, base = _store_path(spark, clean)
    held: list[tuple[str, str]] = []
    size = 0
    for r in wanted.where(hidden).select("path", "size_bytes").toLocalIterator():
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(base + r.path))
        try:
            held.append((r.path, jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()
        size += r.size_bytes
        if size > _HELD_BYTES:
            spark.createDataFrame(held, schema).write.mode("append").parquet(folder)
            held, size = [], 0
    if held or not names:
        spark.createDataFrame(held, schema).write.mode("append").parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def take(spark: SparkSession, root: str, folder: str, extra_ignore: list[str] | None = None, links: DataFrame | None = None, changed_paths: list[str] | None = None, cap: int = REPO_FILES) -> DataFrame:
    """path, size_bytes, content, skip_reason of the files below a root (or of the given ones): a null reason for those that are taken. What paths, sizes, ignore
    files in folders and links (path, skip_reason) tell is settled on the listing, so only files that may be taken are opened, and the cap
    counts what is left."""
    listed = listing(spark, root, changed_paths)
    listed.write.parquet(f"{folder}/listing")
    listed = spark.read.schema(listed.schema).parquet(f"{folder}/listing")
    seen = catalog.discover(listed, extra_ignore=extra_ignore)
    ignore = listed.where((F.col("path").rlike(r"(^|/)\.gitignore$")) & (F.col("size_bytes") <= MOST_BYTES))
    rules = catalog.ignore_rules(contents(spark, root, ignore, f"{folder}/ignore"))
    scoped = catalog.scoped_ignored(listed, rules).withColumn("_scoped", F.lit(True))
    why = F.when(F.col("skip_reason").isNull() & F.col("_scoped"), "gitignore").otherwise(F.col("skip_reason"))
    seen = seen.join(scoped, "path", "left").select("path", "size_bytes", why.alias("skip_reason"))
    if links is not None:  # a link, or a file below one: found by equality with one of the path's own folders
        own = links.where("skip_reason is not null").groupBy(F.col("path").alias("_at")).agg(F.min("skip_reason").alias("_why"))
        parts = F.split("path", "/")
        above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
        hit = seen.select("path", F.explode(above).alias("_at")).join(own, "_at").groupBy("path").agg(F.min("_why").alias("_why"))
        seen = seen.join(hit, "path", "left").select("path", "size_bytes", F.coalesce("_why", "skip_reason").alias("skip_reason"))
    seen.write.parquet(f"{folder}/seen")
    seen = spark.read.schema(seen.schema).parquet(f"{folder}/seen")
    able = seen.where("skip_reason is null").drop("skip_reason")
    judged = catalog.discover(able.join(contents(spark, root, able, f"{folder}/contents"), "path", "left"))
    out = judged.unionByName(seen.where("skip_reason is not null").withColumn("content", F.lit(None).cast("string")))
    return catalog.limited(out, cap)


def link_reason(listing: DataFrame, root: str, follow: bool = False) -> DataFrame:
    """listing (path, link_target: null for what is no link) with skip_reason: a link is symlink if links are not followed, else symlink_escape if
    its target lies outside the root."""
    clean = root.rstrip("/") + "/"
    target = F.col("link_target")
    inside = F.startswith(target, F.lit(clean)) & ~target.rlike(r"(^|/)\.\.(/|$)")
    reason = F.when(target.isNull(), None).when(F.lit(not follow), "symlink").when(~inside, "symlink_escape")
    return listing.withColumn("skip_reason", reason.cast("string"))


def incremental(stored: DataFrame, current: DataFrame, changed_paths: DataFrame | None = None) -> DataFrame:
    """path, origin, content_hash of the snapshot that follows `stored` (path, content_hash). current: path, content of all files, or with
    changed_paths (path) of those paths that exist: other stored files stay unread, and named ones without content are gone. origin: new, changed
    or kept."""
    now = current.select("path", content_hash(F.col("content")).alias("now"))
    met = stored.select("path", F.col("content_hash").alias("was")).join(now, "path", "full_outer")
    if changed_paths is None:
        left = met.where("now is not null")
    else:
        named = changed_paths.select("path").distinct().withColumn("_named", F.lit(True))
        left = met.join(named, "path", "left").where("now is not null or _named is null")
    origin = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull() | (F.col("was") == F.col("now")), "kept").otherwise("changed")
    return left.select("path", origin.alias("origin"), F.coalesce("now", "was").alias("content_hash"))


def counts(stored: DataFrame, after: DataFrame) -> dict[str, int]:
    """How many files are new, changed, kept and deleted. after: incremental()'s rows."""
    found = {r.origin: r["count"] for r in after.groupBy("origin").count().collect()}
    gone = stored.join(after.select("path"), "path", "left_anti").count()
    return {"new": found.get("new", 0), "changed": found.get("changed", 0), "kept": found.get("kept", 0), "deleted": gone}


def touched_paths(changed: DataFrame, new: DataFrame) -> DataFrame:
    """path: each of either list once, without blank ones."""
    return changed.select(F.trim("path").alias("path")).unionByName(new.select(F.trim("path").alias("path"))).where("path <> ''").distinct()
