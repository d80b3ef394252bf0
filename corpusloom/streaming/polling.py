"""Polling a folder: the changes between listings, as a table that grows and that any number of streams can read.

Every trigger is one listing. Spark lists (names, sizes and times; nothing is opened), and the difference to the listing before is a join, so neither a listing nor a
difference passes through the driver. A batch's listing and its changes are written under its number before the batch is done: a batch that is
run again after a stop finds them and writes nothing, and so each change is there once, whenever the query was stopped.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.scratch import remove
from .changes import snapshot_changes

_LISTING = "path string, size long, mtime timestamp"
CHANGES = "folder string, path string, change_type string, event_time timestamp, batch long"
#: Listings that stay; a difference needs the last one only.
KEPT = 3


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path (below the folder), size, mtime of the files there, but for those in hidden paths; a folder that is not there has none."""
    root = folder.rstrip("/")
    try:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    except AnalysisException:
        return spark.createDataFrame([], _LISTING)
    bare = F.regexp_replace("path", "^[a-z0-9]+:/*(?=/)", "")
    plain = root.split(":", 1)[-1] if "://" in root else root
    return raw.select(F.substring(bare, len(plain.strip("/")) + 3, F.length(bare)).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


class Poller:
    """The written listings and changes of one folder."""

    def __init__(self, spark: SparkSession, folder: str, out: str):
        self.spark, self.folder, self.out = spark, folder, out.rstrip("/")

    def _done(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _listing(self, n: int) -> DataFrame | None:
        at = f"{self.out}/listings/{n:012d}"
        return self.spark.read.schema(_LISTING).parquet(at) if self._done(at) else None

    def _written(self) -> list[int]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.out}/listings")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(at)) if fs.exists(at) else []

    def poll(self, n: int) -> None:
        """Batch n: the first listing of all is what later ones are compared with, and has no changes."""
        at = f"{self.out}/listings/{n:012d}"
        before = [k for k in self._written() if k < n and self._done(f"{self.out}/listings/{k:012d}")]
        if not self._done(at):
            listing(self.spark, self.folder).write.mode("overwrite").parquet(at)
        to = f"{self.out}/changes/batch={n}"
        if before and not self._done(to):
            now = self._listing(n)
            found = snapshot_changes(self._listing(before[-1]), now).join(now.select("path", "mtime"), "path", "left")
            found.select(F.lit(self.folder).alias("folder"), "path", "change_type", F.coalesce("mtime", F.current_timestamp()).alias("event_time")).write.mode("overwrite").parquet(to)
        for k in before[: -KEPT]:
            remove(self.spark, f"{self.out}/listings/{k:012d}")

    def start(self, checkpoint: str, every: str = "1 second") -> StreamingQuery:
        """Poll until the query is stopped. The rate source only counts; its batch numbers go on after a restart."""
        ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return ticks.writeStream.foreachBatch(lambda _, n: self.poll(n)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()

    def changes(self) -> DataFrame:
        """All changes so far."""
        try:
            return self.spark.read.schema(CHANGES).parquet(f"{self.out}/changes")
        except AnalysisException:
            return self.spark.createDataFrame([], CHANGES)

    def stream(self) -> DataFrame:
        """The changes as a stream, to be debounced or coalesced."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.out}/changes")
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(at)
        return self.spark.readStream.schema(CHANGES).parquet(f"{self.out}/changes")
