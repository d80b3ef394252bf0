"""Cumulative totals of calls that survive restarts, and sums of what running queries report.

Totals are sums, so that a snapshot and a batch merge into the next snapshot by adding rows of the same tool. A snapshot names the batch that it
contains last: a batch that comes again changes nothing. Sessions are counted by a table of those seen, in a bucket each, so that a batch meets the
buckets of its own sessions only.
"""

from __future__ import annotations

import json
import threading
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators import telemetry
from ..sources.scratch import remove

COUNTERS = ("call_count", "request_tokens", "response_tokens", "total_tokens", "input_tokens_saved", "output_tokens_saved", "tokens_saved")
_SCHEMA = ", ".join(["tool_name string", *[f"{c} long" for c in COUNTERS], "duration_ms double", "first_recorded_at timestamp", "last_recorded_at timestamp"])
_BUCKETS = 64


def totals(calls: DataFrame) -> DataFrame:
    """Totals by tool of recorded calls (see telemetry.normalise_calls; a batch counts its logical calls). A call is recorded from its start, captured_at, to its
    end, a duration later."""
    own = telemetry.normalise_calls(calls)
    start = F.col("captured_at").cast("timestamp")
    end = F.timestamp_micros(F.unix_micros(start) + F.round(F.col("duration_ms") * 1000).cast("long"))
    sums = [F.sum("logical_calls" if c == "call_count" else c).alias(c) for c in COUNTERS]
    return own.groupBy("tool_name").agg(*sums, F.sum("duration_ms").alias("duration_ms"), F.min(start).alias("first_recorded_at"), F.max(end).alias("last_recorded_at"))


def merged(*parts: DataFrame) -> DataFrame:
    """Totals of all parts: counts are added, moments are the first and the last."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("tool_name").agg(*[F.sum(c).alias(c) for c in (*COUNTERS, "duration_ms")], F.min("first_recorded_at").alias("first_recorded_at"), F.max("last_recorded_at").alias("last_recorded_at"))


def overall(tools: DataFrame, session_count: int = 0, pricing: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """One row over all tools, with the cost avoided by each price list."""
    own = tools.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS], F.min("first_recorded_at").alias("first_recorded_at"), F.max("last_recorded_at").alias("last_recorded_at"))
    prices = {f"{n}_usd": telemetry.cost(F.col("input_tokens_saved"), F.col("output_tokens_saved"), p) for n, p in telemetry.normal_pricing(pricing)[0].items()}
    return own.withColumn("session_count", F.lit(session_count).cast("long")).withColumns(prices)


class Cumulative:
    """Totals below a path: state/<batch> is the snapshot after a batch, published by one small file that names it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _entries(self) -> list[int]:
        at, fs = self._fs(f"{self.path}/log")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(("_", ".")))

    def _entry(self) -> dict | None:
        known = self._entries()
        if not known:
            return None
        at, fs = self._fs(f"{self.path}/log/{known[-1]:012d}.json")
        stream = fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, entry: dict) -> None:
        own, fs = self._fs(f"{self.path}/log/_{uuid.uuid4().hex}")
        out = fs.create(own, True)
        out.write(json.dumps(entry).encode())
        out.close()
        final, _ = self._fs(f"{self.path}/log/{entry['number']:012d}.json")
        if not fs.rename(own, final):
            raise RuntimeError(f"{self.path}: snapshot {entry['number']} has been published by another writer")

    def tools(self) -> DataFrame:
        """Totals by tool of the last snapshot."""
        entry = self._entry()
        return self.spark.read.schema(_SCHEMA).parquet(f"{self.path}/{entry['state']}") if entry else self.spark.createDataFrame([], _SCHEMA)

    def snapshot(self) -> DataFrame:
        entry = self._entry()
        return overall(self.tools(), entry["sessions"] if entry else 0)

    def _save(self, state: DataFrame, sessions: int, stream: str | None, batch: int) -> None:
        entry = self._entry()
        at = f"state/{uuid.uuid4().hex}"
        state.coalesce(1).write.parquet(f"{self.path}/{at}")  # a row for each tool
        marks = (entry["marks"] if entry else {}) | ({stream: batch} if stream is not None else {})
        self._publish({"number": entry["number"] + 1 if entry else 0, "state": at, "sessions": sessions, "marks": marks})

    def restore(self, tools: DataFrame, session_count: int = 0) -> None:
        """Begin with totals from elsewhere, in the place of what is there."""
        names = [c.split()[0] for c in _SCHEMA.split(", ")]
        self._save(tools.select(*names), session_count, None, -1)

    def _new_sessions(self, calls: DataFrame, batch_key: str) -> int:
        """How many of the batch's sessions have not been seen before; they are noted under the batch's key, so that a repeated batch counts the same."""
        bucket = F.pmod(F.xxhash64("session"), F.lit(_BUCKETS)).cast("int")
        own = calls.where("session is not null").select(F.col("session").cast("string").alias("session")).distinct().withColumn("bucket", bucket)
        at = f"{self.path}/sessions/key={batch_key}"
        try:
            seen = self.spark.read.schema("session string, bucket int, key string").parquet(f"{self.path}/sessions").where(F.col("key") != batch_key)
            seen = seen.where(F.col("bucket").isin(*[r.bucket for r in own.select("bucket").distinct().collect()]))
        except AnalysisException:
            seen = self.spark.createDataFrame([], "session string, bucket int")
        own.join(seen.select("session"), "session", "left_anti").write.mode("overwrite").partitionBy("bucket").parquet(at)
        place, fs = self._fs(at)
        return self.spark.read.parquet(at).count() if any(s.isDirectory() for s in fs.listStatus(place)) else 0

    def add(self, calls: DataFrame, batch: int, stream: str = "stream") -> bool:
        """Add a batch of a stream; False if the totals already contain it. A batch without calls leaves the snapshot as it is."""
        entry = self._entry()
        if entry and batch <= entry["marks"].get(stream, -1):
            return False
        if not calls.head(1):
            return True
        new = self._new_sessions(calls, f"{stream}-{batch}") if "session" in calls.columns else 0
        self._save(merged(self.tools(), totals(calls)), (entry["sessions"] if entry else 0) + new, stream, batch)
        return True

    def start(self, stream: DataFrame, checkpoint: str, name: str = "stream", every: str = "30 seconds") -> StreamingQuery:
        """Flush a stream of calls into the totals at every trigger that has new ones."""
        return stream.writeStream.foreachBatch(lambda df, n: self.add(df, n, name) and None).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()

    def prune(self, keep: int = 10) -> int:
        """Delete all but the last snapshots; how many went."""
        gone = self._entries()[:-keep]
        for n in gone:
            at, fs = self._fs(f"{self.path}/log/{n:012d}.json")
            stream = fs.open(at)
            entry = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
            fs.delete(at, False)
            remove(self.spark, f"{self.path}/{entry['state']}")
        return len(gone)


# ---- what running queries report -----------------------------------------------------------------------------------

PROGRESS = "query string, run string, batch long, rows long, pending long, pending_batch boolean, in_flight boolean, state string, last_error string, at timestamp"


class ProgressLog(StreamingQueryListener):
    """Writes one JSON line for each event of the session's queries that watch something. pending: files or rows that a source
    has and the query has not read, where the source tells."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._lock = spark, path.rstrip("/"), threading.Lock()
        self._names: dict[str, str] = {}

    def _write(self, **row) -> None:
        with self._lock:
            jvm = self.spark._jvm
            at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{uuid.uuid4().hex}.json")
            out = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(at, False)
            out.write((json.dumps(row) + "\n").encode())
            out.close()

    def onQueryStarted(self, event) -> None:
        self._names[str(event.runId)] = event.name or str(event.id)
        self._write(query=event.name or str(event.id), run=str(event.runId), batch=-1, rows=0, pending=0, pending_batch=False, in_flight=False, state="started", last_error=None, at=event.timestamp)

    def _told(self, p, state: str) -> None:
        waiting = sum(int(s.metrics.get("numFilesOutstanding", s.metrics.get("offsetsBehindLatest", 0)) or 0) for s in p.sources if s.metrics)
        self._write(query=p.name or str(p.id), run=str(p.runId), batch=p.batchId, rows=p.numInputRows, pending=waiting, pending_batch=waiting > 0, in_flight=p.numInputRows > 0, state=state, last_error=None, at=p.timestamp)

    def onQueryProgress(self, event) -> None:
        self._told(event.progress, "progress")

    def onQueryIdle(self, event) -> None:
        self._write(query=self._names.get(str(event.runId), str(event.id)), run=str(event.runId), batch=-1, rows=0, pending=0, pending_batch=False, in_flight=False, state="idle", last_error=None, at=event.timestamp)

    def onQueryTerminated(self, event) -> None:
        self._write(query=self._names.get(str(event.runId), str(event.id)), run=str(event.runId), batch=-1, rows=0, pending=0, pending_batch=False, in_flight=False, state="stopped", last_error=event.exception, at=None)


def progress(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(PROGRESS).json(f"{path.rstrip('/')}/*.json")
    except AnalysisException:
        return spark.createDataFrame([], PROGRESS)


def backpressure(rows: DataFrame) -> DataFrame:
    """One row of sums over the last report of each query: how many are watched (have not been stopped), how many are at work, what is pending, and how
    many ended with an error; and over all reports, how many rows were read. rows: as ProgressLog writes them; a stop is a run's last report."""
    order = F.struct((F.col("state") == "stopped").alias("end"), "at", "batch")
    by_run = rows.groupBy("query", "run").agg(F.max_by(F.struct("pending", "pending_batch", "in_flight", "state", "last_error"), order).alias("l"), F.min("at").alias("began"), F.sum("rows").alias("read"))
    last = by_run.groupBy("query").agg(F.max_by("l", "began").alias("l"), F.sum("read").alias("read")).select("l.*", "read")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    live = F.col("state") != "stopped"
    return last.agg(
        n(live).alias("watched_count"), n(live & F.col("in_flight")).alias("active_count"), F.coalesce(F.max(live & F.col("in_flight")), F.lit(False)).alias("any_in_progress"),
        n(F.when(live, F.col("pending")).otherwise(0)).alias("pending_events"), n(live & F.col("pending_batch")).alias("pending_batches"), n(F.trim(F.coalesce("last_error", F.lit(""))) != "").alias("errors"), n(F.col("read")).alias("rows_read"),
    )
