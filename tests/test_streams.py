"""Streams with state, restarted half-way, against their batch twins."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import tables as t
from corpusloom.streaming import changes, cumulative, keyed, polling

SF = "/root/testdata/sf0.001"
_CHANGES = "folder int, path string, change_type string, event_time timestamp, seq long"


def dealt(df, folder, parts):
    """The rows in so many files in order of time, each a batch; a last one far ahead moves the watermark on."""
    rows = df.orderBy("event_time", "seq").collect()
    step = -(-len(rows) // parts)
    spark = df.sparkSession
    return [(f"{folder}/{k:03d}", spark.createDataFrame(rows[a : a + step], df.schema)) for k, a in enumerate(range(0, len(rows), step))]


@pytest.mark.parametrize("gap", [3600.0, 10 * 365 * 86400.0])
def test_bursts_on_a_restarted_stream(spark, tmp_path, gap):
    """Net changes of a stream over events in eight batches, stopped after the fourth, equal the fold of the whole table."""
    own = t.changes(spark, SF).withColumn("event_time", F.col("event_time").cast("timestamp")).where("change_type is not null")
    parts = dealt(own, str(tmp_path / "in"), 8)
    far = spark.createDataFrame([(99, "sentinel", "added", dt.datetime(2090, 1, 1), 0)], own.schema)
    (tmp_path / "in").mkdir()

    def run(batches):
        stream = spark.readStream.schema(own.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = keyed.bursts(stream, gap, "1 second").writeStream.option("checkpointLocation", str(tmp_path / "cp")).format("parquet").option("path", str(tmp_path / "out")).outputMode("append").start()
        for at, df in batches:
            df.coalesce(1).write.parquet(at)
            q.processAllAvailable()
        q.stop()

    run(parts[:4])
    run([*parts[4:], (str(tmp_path / "in/far"), far)])
    got = spark.read.parquet(str(tmp_path / "out"))
    columns = ["folder", "path", "change_type", "first_at", "last_at", "n_changes"]
    want = keyed.batch_bursts(own, gap)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    if gap > 1e8:  # one burst a path: the net change over its whole history
        assert {(r.folder, r.path, r.change_type) for r in got.collect()} == {tuple(r) for r in changes.coalesce(t.changes(spark, SF), "folder").collect()}
    assert got.count() >= 15  # users


def test_rows_out_of_order(spark, tmp_path):
    """Within the watermark the order of time counts, not that of arrival; kinds that are no changes are left out."""
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    batches = [[(1, "a", "deleted", at(5), 2), (1, "b", "modified", at(5), 3)], [(1, "a", "added", at(1), 1), (1, "b", "opened", at(6), 4), (1, "b", "added", at(7), 5)], [(1, "z", "added", at(50), 9)]]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(_CHANGES).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = keyed.bursts(stream, 10, "8 seconds").writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, _CHANGES).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        q.processAllAvailable()
    q.stop()
    assert [(r.path, r.change_type, r.n_changes) for r in spark.sql("select * from late").collect()] == [("b", "modified", 2)]


def test_polling_gives_each_change_once(spark, tmp_path):
    """Stopped and started again between two listings, and a batch that is run twice."""
    root = tmp_path / "watched"
    (root / "sub").mkdir(parents=True)
    (root / "a.py").write_text("1")
    (root / "sub/b.py").write_text("2")
    (root / ".hidden").write_text("x")
    p = polling.Poller(spark, str(root), str(tmp_path / "out"))
    found = lambda: sorted((r.path, r.change_type) for r in p.changes().collect())

    def until(n):
        end = time.time() + 60
        while len(found()) < n and time.time() < end:
            time.sleep(0.3)
        assert len(found()) == n

    def listed(more):
        end, seen = time.time() + 60, p._written()[-1:] or [-1]
        while (p._written()[-1:] or [-1])[0] < seen[0] + more and time.time() < end:
            time.sleep(0.2)

    q = p.start(str(tmp_path / "cp"), "300 milliseconds")
    listed(2)
    (root / "c.py").write_text("3")
    until(1)
    q.stop()
    (root / "a.py").write_text("11")
    (root / "sub/b.py").unlink()
    q = p.start(str(tmp_path / "cp"), "300 milliseconds")
    until(3)
    listed(3)
    q.stop()
    assert found() == [("a.py", "modified"), ("c.py", "added"), ("sub/b.py", "deleted")]
    p.poll(p._written()[-1])  # the same batch again
    assert len(found()) == 3 and len(p._written()) <= polling.KEPT + 2
    stream = changes.coalesce(p.changes().withColumn("seq", F.col("batch")), "folder")
    assert {r.path for r in stream.collect()} == {"a.py", "c.py", "sub/b.py"}
    assert polling.listing(spark, str(tmp_path / "nowhere")).count() == 0


def test_cumulative_totals(spark, tmp_path):
    """A snapshot from elsewhere, a new session's call, a batch that comes again, a batch without calls, a new process."""
    own = cumulative.Cumulative(spark, str(tmp_path / "c"))
    assert own.snapshot().first().call_count == 0
    start = dt.datetime(2026, 4, 1, 12)
    old = spark.createDataFrame([("index_repo", 5, 500, 100, 600, 120, 30, 150, 0.0, start, start + dt.timedelta(hours=2))], cumulative._SCHEMA)
    own.restore(old, 2)
    kind = "captured_at timestamp, tool_name string, session string, duration_ms double, request_tokens long, response_tokens long, input_tokens_saved long, output_tokens_saved long"
    now = dt.datetime(2026, 5, 1, 10)
    call = spark.createDataFrame([(now - dt.timedelta(milliseconds=100), "search_text", "s3", 100.0, 25, 15, 10, 5)], kind)
    assert own.add(call, 0) and not own.add(call, 0)
    r = own.snapshot().first()
    assert (r.session_count, r.call_count, r.total_tokens, r.tokens_saved, r.first_recorded_at, r.last_recorded_at) == (3, 6, 640, 165, start, now)
    assert r.codex_usd == pytest.approx(0.00036 + (10 * 1.5 + 5 * 6) / 1e6)
    again = cumulative.Cumulative(spark, str(tmp_path / "c"))
    assert not again.add(call, 0) and again.add(call.limit(0), 1) and again.add(call, 2) and again.snapshot().first().session_count == 3
    assert again.add(call.withColumn("session", F.lit("s4")), 0, "other") and again.snapshot().first().session_count == 4
    assert {(x.tool_name, x.call_count) for x in again.tools().collect()} == {("index_repo", 5), ("search_text", 3)}
    assert again.prune(1) > 0 and again.snapshot().first().call_count == 8


def test_totals_on_a_stream(spark, tmp_path):
    """A stream over events, restarted half-way, equals the rollup of the table."""
    calls = t.call_events(spark, SF).withColumn("captured_at", F.col("captured_at").cast("timestamp"))
    own = cumulative.Cumulative(spark, str(tmp_path / "c"))
    for k in range(2):
        calls.where(F.col("event_id") % 2 == k).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        stream = spark.readStream.schema(calls.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        q = own.start(stream, str(tmp_path / "cp"), every="100 milliseconds")
        q.processAllAvailable()
        q.stop()
    columns = ["tool_name", *cumulative.COUNTERS, "first_recorded_at", "last_recorded_at"]
    assert sorted(map(tuple, own.tools().select(*columns).collect())) == sorted(map(tuple, cumulative.totals(calls).select(*columns).collect()))
    assert own.snapshot().first().session_count == calls.select("session").distinct().count()


def test_reports_of_queries(spark, tmp_path):
    """Sums over two live queries, one of which fails in the end."""
    log = cumulative.ProgressLog(spark, str(tmp_path / "log"))
    assert cumulative.backpressure(cumulative.progress(spark, str(tmp_path / "none"))).first().watched_count == 0
    spark.streams.addListener(log)
    try:
        events = t.table(spark, SF, "events")
        events.limit(100).coalesce(1).write.parquet(str(tmp_path / "in/0"))
        source = lambda: spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        good = source().writeStream.format("noop").queryName("good").option("checkpointLocation", str(tmp_path / "cp1")).start()

        def fail(df, n):
            if n:
                raise RuntimeError("lost")
            df.count()

        bad = source().writeStream.foreachBatch(fail).queryName("bad").option("checkpointLocation", str(tmp_path / "cp2")).start()
        good.processAllAvailable(), bad.processAllAvailable()
        sums = lambda: cumulative.backpressure(cumulative.progress(spark, str(tmp_path / "log"))).first()

        def until(holds):
            end = time.time() + 60
            while not holds(sums()) and time.time() < end:
                time.sleep(0.3)
            assert holds(sums()), sums()

        until(lambda r: r.watched_count == 2 and r.rows_read == 200 and r.errors == 0)
        events.limit(10).coalesce(1).write.parquet(str(tmp_path / "in/1"))
        good.processAllAvailable()
        until(lambda r: r.watched_count == 1 and r.errors == 1 and r.rows_read == 210)
        good.stop()
        until(lambda r: r.watched_count == 0 and r.active_count == 0 and r.rows_read == 210)
    finally:
        spark.streams.removeListener(log)
