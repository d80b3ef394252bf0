"""File changes as a stream: coalescing, debouncing, incremental upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _merge(before: Column, now: Column) -> Column:
    """What two changes of one path come to: none after added and deleted."""
    return (
        F.when(before.isNull() | (before == "none"), now)
        .when((before == "added") & (now == "deleted"), "none").when((before == "added") & (now == "modified"), "added")
        .when((before == "modified") & (now == "added"), "modified").when((before == "modified") & (now == "deleted"), "deleted").when((before == "deleted") & (now == "added"), "modified")
        .when((before == "deleted") & (now == "modified"), "deleted").otherwise(now)
    )


_STATES = ("none", "added", "modified", "deleted")


def _effect(start: Callable[[str], Column], apply: Callable[[Column], Column]) -> Column:
    """What a part of a path's history makes of each state that it may find."""
    return F.struct(*[apply(start(s)).alias(s) for s in _STATES])


def coalesce(changes: DataFrame, *keys: str) -> DataFrame:
    """The net change of each path over its changes in order of event_time and seq.

    Four states are closed under changes, so the effect of a stretch of a path's history is a map from state to state, and maps compose: changes
    are folded within seconds, seconds within hours, and hours at last. No list grows with all changes of one path."""
    own = changes.where(F.col("change_type").isin("added", "modified", "deleted"))
    hour = F.floor(F.unix_micros(F.col("event_time").cast("timestamp")) / 3_600_000_000)
    second = F.floor(F.unix_micros(F.col("event_time").cast("timestamp")) / 1_000_000)
    first = F.array_sort(F.collect_list(F.struct("event_time", "seq", "change_type")))
    same = F.struct(*[F.lit(s).alias(s) for s in _STATES])
    effect = F.aggregate(first, same, lambda a, x: _effect(lambda s: a[s], lambda now: _merge(now, x["change_type"])))
    parts = own.groupBy(*keys, "path", hour.alias("_h"), second.alias("_s")).agg(effect.alias("_e"))

    def after(e: Column, state: Column) -> Column:
        out = e["none"]
        for s in _STATES[1:]:
            out = F.when(state == s, e[s]).otherwise(out)
        return out

    for level in (["_h"], []):
        at = "_s" if level else "_h"
        whole = F.aggregate(F.array_sort(F.collect_list(F.struct(at, "_e"))), same, lambda a, x: _effect(lambda s: a[s], lambda now: after(x["_e"], now)))
        parts = parts.groupBy(*keys, "path", *level).agg(whole.alias("_e"))
    return parts.select(*keys, "path", F.col("_e.none").alias("change_type")).where("change_type <> 'none'")


def debounce(changes: DataFrame, gap: str = "200 milliseconds", watermark: str | None = None) -> DataFrame:
    """Batches of changes by folder: a batch ends when the folder is quiet for `gap`. With a watermark also on streams."""
    df = changes.withWatermark("event_time", watermark) if watermark else changes
    return df.groupBy("folder", F.session_window("event_time", gap).alias("w")).agg(F.count("*").alias("n_changes")).select("folder", F.col("w.start").alias("batch_start"), F.col("w.end").alias("batch_end"), "n_changes")


def buckets(events: DataFrame, step: str = "1 hour", watermark: str | None = None) -> DataFrame:
    """Tumbling counts of events (ts, event_type)."""
    df = events.withWatermark("ts", watermark) if watermark else events
    return df.groupBy(F.window("ts", step).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("value")).select(F.col("w.start").alias("bucket"), "event_type", "n", "value")


def snapshot_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes between two listings (path, size, mtime), hidden paths left out."""
    shown = lambda df: df.where(~F.col("path").rlike(r"(^|/)\."))
    a, b = shown(before).select("path", F.struct("size", "mtime").alias("a")), shown(after).select("path", F.struct("size", "mtime").alias("b"))
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "modified")
    return a.join(b, "path", "full_outer").select("path", kind.alias("change_type")).where("change_type is not null")


def apply_changes(files: DataFrame, changes: DataFrame) -> DataFrame:
    """files after net changes (path, change_type, content): deleted ones go, others are replaced or added."""
    net = changes.select("path", "change_type", "content")
    kept = files.join(net.select("path"), "path", "left_anti")
    new = net.where("change_type <> 'deleted'").select("path", "content", F.octet_length("content").cast("long").alias("size_bytes"))
    return kept.unionByName(new.select(*kept.columns))


def run_incremental(stream: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str, interval: str = "1 second") -> StreamingQuery:
    """Each micro-batch of a change stream, coalesced, goes to on_batch once."""
    return stream.writeStream.foreachBatch(lambda df, n: on_batch(coalesce(df, "folder"), n)).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def wait_for_fresh(query: StreamingQuery, timeout_ms: int = 500) -> bool:
    """True once no trigger is active and no data waits; False after the timeout."""
    import time

    end = time.monotonic() + timeout_ms / 1000
    while True:
        status = query.status
        if not status["isTriggerActive"] and not status["isDataAvailable"]:
            return True
        if time.monotonic() >= end:
            return False
        time.sleep(0.01)
