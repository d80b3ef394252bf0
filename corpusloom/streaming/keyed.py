"""Net changes of paths on a stream: keyed state and event-time timers.

A path's changes that follow each other within a gap are one burst; when the path has been quiet for the gap, its burst's net change is emitted once.
State is what the folded part of the burst comes to, and the changes that are newer than the watermark: those below it can have no earlier ones any more, so they
are folded, and a long burst stays small. State is kept by RocksDB below the checkpoint; a restarted query goes on where it was.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from . import changes as ch

#: What a change makes of the net change before it, where that is not the change itself.
AFTER = {("added", "deleted"): "none", ("added", "modified"): "added", ("modified", "added"): "modified", ("deleted", "added"): "modified", ("deleted", "modified"): "deleted"}
KINDS = ("added", "modified", "deleted")
OUT = "folder int, path string, change_type string, first_at timestamp, last_at timestamp, n_changes long"
_EPOCH = dt.datetime(1970, 1, 1)


class _Bursts(StatefulProcessor):
    """Times are microseconds since the epoch; the session's time zone must be that of the workers, which `bursts` makes sure of by handing numbers over."""

    def __init__(self, gap_micros: int):
        self.gap = gap_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "at long, seq long, change_type string")
        self.net = handle.getValueState("net", "change_type string, first_at long, last_at long, n long")

    def _step(self, key, watermark: int) -> Iterator[Row]:
        """Fold what lies below the watermark, emit bursts that it has passed, keep the rest."""
        rows = sorted((tuple(r) for r in self.pending.get()), key=lambda r: (r[0], r[1] if r[1] is not None else -1))
        net = tuple(self.net.get()) if self.net.exists() else None
        left = []
        for at, seq, kind in rows:
            if at >= watermark:
                left.append((at, seq, kind))
                continue
            if net is not None and at >= net[2] + self.gap:
                yield from self._emit(key, net)
                net = None
            net = (kind, at, at, 1) if net is None else (AFTER.get((net[0], kind), kind), net[1], max(net[2], at), net[3] + 1)
        if net is not None and net[2] + self.gap <= watermark and not (left and left[0][0] < net[2] + self.gap):
            yield from self._emit(key, net)
            net = None
        if left:
            self.pending.put(left)
        else:
            self.pending.clear()
        if net is not None:
            self.net.update(net)
        else:
            self.net.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        last = [net[2] + self.gap] if net is not None else []
        last += [at + 1 for at, *_ in left[:1]]
        if last:
            self.handle.registerTimer(max(watermark // 1000 + 1, -(-min(last) // 1000)))

    def _emit(self, key, net) -> Iterator[Row]:
        if net[0] != "none":
            at = lambda m: _EPOCH + dt.timedelta(microseconds=m)
            yield Row(folder=key[0], path=key[1], change_type=net[0], first_at=at(net[1]), last_at=at(net[2]), n_changes=net[3])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = [r for r in rows if r.change_type in KINDS and r.at is not None]
        for r in known:
            self.pending.appendValue((r.at, r.seq, r.change_type))
        if known:
            yield from self._step(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._step(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that keyed state needs, unless the caller has chosen one."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (spark.conf.get(key, "") or ""):
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def bursts(stream: DataFrame, gap_seconds: float, watermark: str = "10 seconds") -> DataFrame:
    """folder, path, change_type, first_at, last_at, n_changes of each burst of a stream of changes (folder, path, change_type, event_time, seq) whose net
    change is not nothing. Other kinds of change, and changes without a time, are left out; what comes later than the watermark allows is
    dropped by Spark. The times that come out are in UTC."""
    use_rocksdb(stream.sparkSession)
    timed = stream.select(F.col("folder").cast("int").alias("folder"), "path", "change_type", F.col("event_time").cast("timestamp").alias("event_time"), F.col("seq").cast("long").alias("seq"))
    timed = timed.withColumn("at", F.unix_micros("event_time")).withWatermark("event_time", watermark)
    return timed.groupBy("folder", "path").transformWithState(statefulProcessor=_Bursts(int(gap_seconds * 1e6)), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def batch_bursts(rows: DataFrame, gap_seconds: float) -> DataFrame:
    """The same of a table that is complete: bursts by a window over each path, then the fold of changes.coalesce."""
    own = rows.where(F.col("change_type").isin(*KINDS) & F.col("event_time").isNotNull())
    at = F.unix_micros(F.col("event_time").cast("timestamp"))
    w = W.partitionBy("folder", "path").orderBy("event_time", "seq")
    new = F.coalesce(at - F.lag(at).over(w) >= int(gap_seconds * 1e6), F.lit(True))
    numbered = own.withColumn("_new", new).withColumn("burst", F.sum(F.col("_new").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    about = numbered.groupBy("folder", "path", "burst").agg(F.min("event_time").alias("first_at"), F.max("event_time").alias("last_at"), F.count("*").alias("n_changes"))
    net = ch.coalesce(numbered, "folder", "burst")
    return net.join(about, ["folder", "path", "burst"]).select("folder", "path", "change_type", "first_at", "last_at", "n_changes")
