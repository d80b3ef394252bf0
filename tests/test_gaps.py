"""Smaller parts: commits, run trends, prices, index files, import blocks, remote listings, paths, repositories of paths, workloads."""

import datetime as dt
import json
import posixpath
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom import api
from corpusloom.functions import text as tx
from corpusloom.operators import catalog, chunks, evaluation, history, symbols, telemetry, workloads
from corpusloom.sources import ingest, store
from corpusloom.streaming.cumulative import Cumulative


def test_commit_distance(spark):
    """Random histories with merges, several first commits and a long line, against plain ancestor sets."""
    r = random.Random(3)
    parents = {f"c{k}": [f"c{x}" for x in set(r.sample(range(max(0, k - 6), k), min(k, r.choice([0, 1, 1, 2]))))] for k in range(40)}
    rows = [(c, p) for c, own in parents.items() for p in own or [None]]
    df = spark.createDataFrame(rows + rows[:5], "commit string, parent string")

    def reach(c):
        out, todo = set(), [c]
        while todo:
            x = todo.pop()
            if x not in out:
                out.add(x)
                todo += parents[x]
        return out

    g = history.generations(df).persist()
    for base, head in (("c20", "c39"), ("c39", "c20"), ("c5", "c5"), ("c30", "c33")):
        assert {x[0] for x in history.ahead(df, base, head, g).collect()} == reach(head) - reach(base)
    with pytest.raises(ValueError, match="not found"):
        history.distance(df, "c1", "nowhere", g)
    corpus = api.Corpus(spark.createDataFrame([], "path string, content string, size_bytes long"), head="c30", commits=df)
    assert corpus.call("check_freshness", {"current_head": "c33"})["commits_behind"] == len(reach("c33") - reach("c30"))
    assert corpus.call("check_freshness", {"current_head": "c30"})["commits_behind"] == 0 and corpus.call("check_freshness", {"current_head": "x"})["commits_behind"] is None


def test_run_trend_and_filters(spark):
    score = "map<string,struct<tokens_saved:bigint,cost_saved_usd:double,savings_pct:double>>"
    kind = f"run_id string, captured_at timestamp, mode string, tokens_saved long, savings_pct double, scores {score}"
    day = lambda d: dt.datetime(2024, 1, d)
    runs = spark.createDataFrame([("a", day(1), "m", 10, 0.5, {"codex": (7, 0.1, 0.25)}), ("b", day(2), "m", 20, 0.6, None), ("c", day(3), "n", 30, 0.7, {})], kind)
    assert [r.run_id for r in evaluation.runs_in_order(runs, since="2024-01-02 00:00:00").collect()] == ["b", "c"]
    assert [r.run_id for r in evaluation.runs_in_order(runs, since="2024-01-01 00:00:00", exclude_run_id=" b ", mode="m").collect()] == ["a"]
    got = evaluation.run_trend(runs, spark.createDataFrame([("now", day(9), "m", 99, 0.9, {"amp": (5, 2.0, 0.1)})], kind), ["codex", "amp"])
    rows = {(r.competitor, r.captured_at.day): (r.tokens_saved, r.cost_saved_usd, r.savings_pct) for r in got.collect()}
    assert rows[("codex", 1)] == (7, 0.1, 0.25) and rows[("amp", 1)] == (10, 0.0, 0.5) and rows[("codex", 9)] == (99, 0.0, 0.9) and rows[("amp", 9)] == (5, 2.0, 0.9) and len(rows) == 8


def test_prices():
    prices, warnings = telemetry.normal_pricing({" Codex ": (float("nan"), 2.0), "amp": (-1, float("inf")), "unknown": (1, 1)})
    assert prices == {"claude_code": (3.0, 15.0), "codex": (1.5, 2.0), "amp": (1.5, 6.0)}
    assert warnings == ["codex input pricing must be finite and non-negative; using default 1.5 USD/MTok", "amp input pricing must be finite and non-negative; using default 1.5 USD/MTok", "amp output pricing must be finite and non-negative; using default 6 USD/MTok"]
    assert telemetry.normal_pricing(None) == (telemetry.PRICING, [])


def test_whole_index_files(spark, tmp_path):
    one = {"repo": "own/lib", "files": {"a.py": "h1", "b.py": "h2"}, "file_blob_shas": {"a.py": "s1"}, "file_mtimes": {"b.py": 5, "c.py": 6}, "languages": {"python": 2}, "git_head": "abc", "indexed_at": "2024-01-02T03:04:05Z", "symbols": [{"id": "x", "name": "f", "file": "a.py"}]}
    (tmp_path / "i").mkdir()
    (tmp_path / "i/one.json").write_text(json.dumps(one))
    (tmp_path / "i/two.json").write_text(json.dumps({"repo": "own/none", "file_count": 9, "index_version": 4}))
    found = store.read_index(spark, str(tmp_path / "i"))
    assert {(r.repo, r.display_name, r.file_count, r.symbol_count, r.index_version, r.git_head) for r in found.repos.collect()} == {("own/lib", "lib", 2, 1, 1, "abc"), ("own/none", "none", 9, 0, 4, None)}
    assert {(r.path, r.content_hash, r.blob_sha, r.mtime) for r in found.files.collect()} == {("a.py", "h1", "s1", None), ("b.py", "h2", None, 5), ("c.py", None, None, 6)}
    assert [tuple(r) for r in found.languages.collect()] == [("own/lib", "python", 2)] and [r.id for r in found.symbols.collect()] == ["x"]
    (tmp_path / "bad.json").write_text('{"files": {}}')
    with pytest.raises(Exception, match="no repo"):
        store.read_index(spark, str(tmp_path / "bad.json")).repos.collect()


def test_import_blocks_and_bases(spark):
    go = 'package x\nimport "fmt"\nimport (\n\t"os"\n\n\tb "bytes"\n)\nfunc f() {\n)\n}\nimport "late"'
    files = spark.createDataFrame([("a.go", go), ("b.py", "import x\ny = 1"), ("c.go", "import (\nnever ends"), ("d.txt", "import x"), ("e.go", "")], "path string, content string")
    got = {r.path: r.import_lines for r in chunks.import_lines(files).collect()}
    assert got == {"a.go": ['import "fmt"', "import (", '\t"os"', "", '\tb "bytes"', ")", 'import "late"'], "b.py": ["import x"], "c.go": ["import (", "never ends"]}
    signatures = {"A": "class A(Base<T>, lower, Other[X]{})", "B": "class B extends P<T> implements I<X>, J {", "C": "class C(Q(1))", "D": "class D"}
    df = spark.createDataFrame([(n, "Class", s) for n, s in signatures.items()], "name string, kind string, signature string")
    assert {(r.name, r.base) for r in symbols.class_bases(df).collect()} == {("A", "Base"), ("B", "P"), ("B", "I"), ("C", "Q")}


def test_remote_listing(spark):
    """Reasons in the order of a remote tree: the language before secrets; the cap counts what is left."""
    rows = [("./src/a.py", 1, "ABC "), ("src\\b.py", 1, None), ("x/../c.py", 1, ""), ("../d.py", 1, None), ("a/../../d.py", 1, None), (" / ", 1, None), (".", 1, None), ("dist/e.py", 1, None), ("secret.bin", 1, None), ("token.py", 1, None), ("big.py", 600_000, None), ("a//z.py", 1, None), (None, 1, None)]
    df = spark.createDataFrame(rows, "path string, size_bytes long, blob_sha string")
    got = {r.raw_path: (r.path, r.skip_reason) for r in catalog.discover_remote(df).collect()}
    assert got == {
        "./src/a.py": ("src/a.py", None), "src\\b.py": ("src/b.py", None), "x/../c.py": ("c.py", None), "../d.py": ("../d.py", "path_traversal"), "a/../../d.py": ("../d.py", "path_traversal"), " / ": ("", "skip_file"), ".": ("", "path_traversal"),
        "dist/e.py": ("dist/e.py", "skip_dir"), "secret.bin": ("secret.bin", "wrong_extension"), "token.py": ("token.py", "secret"), "big.py": ("big.py", "too_large"), "a//z.py": ("a/z.py", None), None: ("", "skip_file"),
    }
    capped = {r.path: r.skip_reason for r in catalog.discover_remote(df, cap=2).collect() if r.skip_reason in (None, "file_limit")}
    assert capped == {"src/a.py": None, "src/b.py": None, "c.py": "file_limit", "a/z.py": "file_limit"}
    assert {r.blob_sha for r in catalog.discover_remote(df).where("path = 'src/a.py'").collect()} == {"abc"}
    a, b = (spark.createDataFrame([(p,) for p in own], "path string") for own in ((" a", "b", ""), ("b", "c")))
    assert sorted(r.path for r in ingest.touched_paths(a, b).collect()) == ["a", "b", "c"]


def test_session_stats_with_windows(spark, tmp_path):
    now = dt.datetime(2024, 1, 10)
    kind = "captured_at timestamp, tool_name string, duration_ms double, request_tokens long, response_tokens long, total_tokens long, input_tokens_saved long, output_tokens_saved long, logical_calls long"
    calls = spark.createDataFrame([(now - dt.timedelta(hours=2), "a", 1.0, 1, 2, 3, 4, 0, 5), (now - dt.timedelta(days=3), "b", 1.0, 1, 2, 3, 4, 0, 1)], kind)
    totals = Cumulative(spark, str(tmp_path / "t"))
    totals.add(calls, 0)
    corpus = api.Corpus(spark.createDataFrame([], "path string, content string, size_bytes long"), calls=calls, totals=totals)
    got = corpus.call("get_session_stats", {"now": "2024-01-10 00:00:00", "trend_windows": ["last_24h", "last_7d"]})
    assert got["cumulative"]["call_count"] == 6 and [t["tool_name"] for t in got["cumulative"]["tools"]] == ["a", "b"]
    assert [len(w) for w in got["trend_windows"].values()] == [24, 7] and [t["call_count"] for p in got["trend_windows"]["last_24h"] for t in p["tools"]] == [5]
    assert [t["tool_name"] for p in got["trend_windows"]["last_7d"] for t in p["tools"]] == ["b", "a"]
    assert corpus.call("get_session_stats", {"trend_windows": ["last_year"]}) == {"error": "unknown trend window: last_year"}
    assert corpus.call("get_session_stats", {"now": "2024-01-10 00:00:00"})["trend_windows"] == {}


def test_paths_that_go_up(spark):
    """Paths with `.`, `..`, doubled slashes, back slashes and blanks, as the standard library cleans them."""
    r = random.Random(2)
    rows = ["", " ", ".", "/", "..", "/..", "../..", "a/..", "/a/../..", "a/../../b", " a\\\\b\\..\\c ", "./a/./b/.", "//a//b/", "/a/b/../../../c"]
    rows += ["".join(r.choice(["a", "b", "..", ".", "/", "//", "/"]) for _ in range(r.randint(1, 12))) for _ in range(300)]
    got = spark.createDataFrame([(p,) for p in rows], "p string").select("p", tx.normal_path(F.col("p")).alias("n"), tx.chunk_path(F.col("p")).alias("c")).collect()
    for x in got:
        plain = x.p.strip().replace("\\", "/")
        plain = re.sub("^/+", "/", posixpath.normpath(plain)) if plain else ""
        assert x.n == ("" if plain == "." else plain) == tx.clean_path(x.p), x.p
        inside = x.p.replace("\\", "/").strip().removeprefix("./").strip("/")
        inside = posixpath.normpath(inside) if inside else ""
        assert x.c == ("" if inside in (".", "..") or inside.startswith("../") else inside), x.p


def test_resolve_repo(spark, tmp_path):
    """A file's folder, then the root of the version control around it; links are followed; other folders are told how to be indexed."""
    top, inner = tmp_path / "top", tmp_path / "top/deep/inner"
    inner.mkdir(parents=True)
    (top / ".git").mkdir()
    (inner / "a.py").write_text("x = 1\n")
    (top / "b.sql").write_text("select 1\n")
    (tmp_path / "alias").symlink_to(inner)
    w = api.Workspace(spark)
    ask = lambda p: w.call("resolve_repo", {"path": str(p)})
    assert ask(inner / "a.py") == {"found": True, "indexed": False, "repo": api.repo_id(str(inner)), "hint": "call index_folder to index this path"}
    assert ask(tmp_path / "gone") == {"found": False, "indexed": False, "error": f"Path does not exist: {tmp_path}/gone"}
    repo = w.call("index_folder", {"path": str(top)})["repo"]
    for p in (inner / "a.py", inner, top, tmp_path / "alias", str(top) + "/"):
        got = ask(p)
        assert (got["repo"], got["source_root"], got["display_name"], got["file_count"], got["languages"], got["symbol_count"]) == (repo, str(top), "top", 2, {"python": 1, "sql": 1}, 0)
        assert got["found"] and got["indexed"] and got["indexed_at"]
    assert not ask(tmp_path)["indexed"]  # the folder above is not version controlled
    assert w.corpora[repo].call("resolve_repo", {"path": str(inner)})["indexed"]
    (inner / ".git").write_text("gitdir: elsewhere\n")  # a worktree of its own
    assert not ask(inner)["indexed"]
    assert w.call("get_file_content", {"file_path": " ./deep/../deep//inner/a.py"})["content"] == "x = 1\n"


def test_workloads(spark):
    files = spark.createDataFrame([(f"src/f{k}.ts", f"import {{ Name{k} }} from './f{k + 1}'\n", 40) for k in range(5)], "path string, content string, size_bytes long")
    corpus = api.Corpus(files)
    paths, names = workloads.paths(files, 100), workloads.identifiers(corpus.imports, files, 100)
    assert paths == [f"src/f{k}.ts" for k in range(5)] == workloads.paths(files, 5) and names[:5] == [f"Name{k}" for k in range(5)] and set(names) >= {f"f{k}" for k in range(6)}
    assert names == sorted(names) and len({n.lower() for n in names}) == len(names) and workloads.identifiers(corpus.imports, files, 3) == names[:3]
    assert workloads.selection(paths, 3, 4) == [paths[k] for k in (2, 3, 4, 0)] and workloads.selection([], 0) == []
    for name, (_, argument) in workloads.WORKLOADS.items():
        runs = workloads.run(spark, corpus.call, name, paths if argument == "file_paths" else names, runs=2, batch=3)
        assert [(r.run, r["items"], r.failed, r.error) for r in runs.orderBy("run").collect()] == [(0, 3, False, None), (1, 3, False, None)]
        total = evaluation.throughput(runs, "workload").first()
        assert total.workload == name and total.items_per_s > 0 and total.error_rate == 0 and total.p95_ms >= total.p50_ms
    broken = workloads.run(spark, lambda *_: {"error": "no"}, "tool_find_importers_fixture", paths, runs=2).collect()
    assert [(r["items"], r.ms, r.error) for r in broken] == [(0, None, "no")] * 2
    with pytest.raises(ValueError):
        workloads.run(spark, corpus.call, "other", paths)
