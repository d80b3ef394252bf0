import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import store


def files(spark, **content):
    return spark.createDataFrame([(p.replace("_", "."), c, len(c)) for p, c in content.items()], "path string, content string, size_bytes long")


def test_repositories(spark, tmp_path):
    repos = store.RepoStore(spark, str(tmp_path))
    assert repos.list().count() == 0 and repos.resolve("x") is None
    repos.save("local/one", files(spark, a_py="1", b_py="2"), "head1", "2024-01-01 00:00:00")
    repos.save("other/two", files(spark, c_py="3"))
    assert [(r.repo, r.file_count) for r in repos.list().collect()] == [("local/one", 2), ("other/two", 1)]
    got = {r.path: r.change for r in repos.changes("local/one", files(spark, a_py="1", b_py="22", d_py="")).collect()}
    assert got == {"b.py": "changed", "d.py": "new"}
    net = spark.createDataFrame([("a.py", "deleted", None), ("b.py", "modified", "22"), ("e.py", "added", "5")], "path string, change_type string, content string")
    repos.save_changes("local/one", net, "head2")
    assert {(r.path, r.content) for r in repos.load("local/one").collect()} == {("b.py", "22"), ("e.py", "5")}
    assert repos.load("other/two").count() == 1 and repos.resolve("two") == "other/two"
    repos.save("third/two", files(spark, z_py="0"))
    with pytest.raises(ValueError, match="Ambiguous"):
        repos.resolve("two")
    assert repos.delete("other/two") and not repos.delete("other/two") and repos.resolve("two") == "third/two"


def test_calls(spark, tmp_path):
    calls = store.CallStore(spark, str(tmp_path / "calls"))
    at = lambda d: (dt.datetime(2024, 1, d, 12), "t", 1.0, 1, 1, 2, 0, 0)
    kind = store.CallStore.SCHEMA.removesuffix(", day date")
    calls.record(spark.createDataFrame([at(1), at(5)], kind))
    calls.record(spark.createDataFrame([at(9)], kind))
    assert calls.since("2024-01-05 12:00:00").count() == 2 and calls.since("2024-01-05 12:00:01").count() == 1
    assert calls.prune("2024-01-09 00:00:00", 5) == 1 and calls.since("2023-01-01 00:00:00").count() == 2


def test_reports(spark):
    as_json, as_text = store.report(spark.createDataFrame([("a", 1), (None, 2)], "k string, n int"), "T")
    assert json.loads(as_json)["rows"][0] == {"k": "a", "n": 1} and as_text.splitlines()[-1] == "|  | 2 |"
    with pytest.raises(ValueError):
        store.report(spark.range(3), "T", 2)
    assert store.payload_tokens({"b": "<", "a": 1}) == 5


def test_empty_snapshots_and_names(spark, tmp_path):
    from corpusloom.sources.store import RepoStore

    store = RepoStore(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([("a.py", "x", 1)], "path string, content string, size_bytes long")
    store.save("a/b__c", rows)
    store.save("a__b/c", rows.withColumn("path", F.lit("z.py")))
    assert [r.path for r in store.load("a/b__c").collect()] == ["a.py"] and [r.path for r in store.load("a__b/c").collect()] == ["z.py"]
    store.save("a/b__c", rows.where("false"))
    assert store.load("a/b__c").count() == 0 and store.load("a__b/c").count() == 1
    assert {r.repo: r.file_count for r in store.list().collect()} == {"a/b__c": 0, "a__b/c": 1}


def test_border_day_and_snapshots(spark, tmp_path):
    from corpusloom.sources.store import CallStore, SnapshotStore, read_index_json

    calls = CallStore(spark, str(tmp_path / "c"))
    kind = "captured_at timestamp, tool_name string, duration_ms double, request_tokens long, response_tokens long, total_tokens long, input_tokens_saved long, output_tokens_saved long"
    moments = ["2024-01-01 05:00:00", "2024-01-04 01:00:00", "2024-01-04 23:00:00", "2024-01-05 00:00:00"]
    calls.record(spark.createDataFrame([(m, "t") for m in moments], "at string, tool_name string").selectExpr("cast(at as timestamp) as captured_at", "tool_name", *[f"cast(0 as {k}) as {n}" for n, k in (x.split() for x in kind.split(", ")[2:])]))
    assert calls.prune("2024-01-09 12:00:00", 5) == 1
    assert sorted(str(r.captured_at) for r in calls.since("2023-01-01 00:00:00").collect()) == moments[2:]
    snaps = SnapshotStore(spark, str(tmp_path / "n"))
    for day, n, run in ((1, 5, ""), (2, 100, "bench"), (3, 8, ""), (4, 2, "")):
        snaps.capture(spark.createDataFrame([("t", n, n, n)], "tool_name string, call_count long, total_tokens long, tokens_saved long"), f"2024-01-0{day} 00:00:00", run)
    assert [r.call_count_delta for r in snaps.deltas().orderBy("captured_at").collect()] == [5, 3, 2]
    (tmp_path / "i.json").write_text('{"repo": "a/b", "symbols": [{"id": "1", "name": "f", "file": "x.py", "line": 3, "keywords": ["k"]}]}')
    assert [(r.repo, r.id, r.line, r.keywords, r.kind) for r in read_index_json(spark, str(tmp_path / "i.json")).collect()] == [("a/b", "1", 3, ["k"], None)]


def _stored(root):
    return {str(p.relative_to(root)) for p in (root / "data").rglob("*.parquet")}


def test_versions_copy_on_write(spark, tmp_path, monkeypatch):
    """Ten paths of a hundred thousand rewrite ten buckets at most; readers keep their version; a save that dies changes nothing; two writers."""
    from corpusloom.sources import versions

    root = tmp_path / "v"
    own = versions.Snapshots(spark, str(root), buckets=64)
    assert own.read().count() == 0 and own.versions() == [] and own.history().count() == 0
    many = spark.range(100_000).select(F.concat(F.lit("d/f"), "id", F.lit(".py")).alias("path"), F.lit("added").alias("change_type"), F.concat(F.lit("x = "), "id").alias("content"))
    assert own.commit(many, head="a") == 1
    first = _stored(root)
    assert len(first) == 64 and own.entry()["file_count"] == 100_000
    held = own.read(1)
    net = spark.createDataFrame([(f"d/f{k}.py", "modified", "y") for k in range(8)] + [("d/f9.py", "deleted", None), ("new.py", "added", "z")], "path string, change_type string, content string")
    assert own.commit(net, head="b") == 2
    second = _stored(root)
    assert first < second and 1 <= len(second - first) <= 10 and own.entry()["touched"] == len(second - first)
    assert own.read().count() == 100_000 and held.count() == 100_000 and held.where("path = 'new.py'").count() == 0
    assert {r.path: r.content for r in own.read(2, ["new.py", "d/f0.py", "d/f9.py", "nowhere"]).collect()} == {"new.py": "z", "d/f0.py": "y"}
    assert len(own.read(2, ["new.py"]).inputFiles()) == 1
    assert {(r.path, r.change) for r in own.changes(1, 2).collect()} == {*((f"d/f{k}.py", "changed") for k in range(8)), ("d/f9.py", "deleted"), ("new.py", "new")}

    real = versions.Snapshots._publish
    monkeypatch.setattr(versions.Snapshots, "_publish", lambda self, entry: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        own.commit(net)
    monkeypatch.setattr(versions.Snapshots, "_publish", real)
    assert own.versions() == [1, 2] and own.read().count() == 100_000 and _stored(root) > second

    other = versions.Snapshots(spark, str(root))
    beaten = []

    def slow(self, entry):  # another writer publishes first
        if not beaten:
            beaten.append(entry["version"])
            monkeypatch.setattr(versions.Snapshots, "_publish", real)
            other.commit(spark.createDataFrame([("other.py", "added", "o")], "path string, change_type string, content string"))
        return real(self, entry)

    monkeypatch.setattr(versions.Snapshots, "_publish", slow)
    assert own.commit(spark.createDataFrame([("mine.py", "added", "m")], "path string, change_type string, content string")) == 4 and beaten == [3]
    assert own.read().where("path in ('mine.py', 'other.py')").count() == 2
    with pytest.raises(ValueError, match="several"):
        own.commit(net.unionByName(net))
    assert own.commit(net.limit(0)) == 5 and own.entry()["manifest"] == own.entry(4)["manifest"]
    assert own.vacuum(keep=2, older_than=0) > 0 and own.versions() == [4, 5] and own.read().count() == 100_002 and own.read(4).count() == 100_002
    with pytest.raises(ValueError, match="no version"):
        own.read(1)
    assert own.commit(own.read().select("path", F.lit("deleted").alias("change_type"), F.lit(None).cast("string").alias("content"))) == 6 and own.read().count() == 0


def test_replacing_writes_what_differs(spark, tmp_path):
    from corpusloom.sources.versions import Snapshots

    own = Snapshots(spark, str(tmp_path / "r"), buckets=32)
    files = spark.range(500).select(F.concat(F.lit("f"), "id").alias("path"), F.col("id").cast("string").alias("content"))
    own.replace(files)
    own.replace(files.where("path <> 'f7'").withColumn("content", F.when(F.col("path") == "f8", "eight").otherwise(F.col("content"))))
    assert own.entry()["touched"] <= 2 and own.entry()["file_count"] == 499
    assert [(r.version, r.touched > 2) for r in own.history().orderBy("version").collect()] == [(1, True), (2, False)]
