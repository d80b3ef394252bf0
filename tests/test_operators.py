"""Small fixtures with known results, for what the benchmark tables do not show."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import catalog, chunks, graph, search, symbols, telemetry, vectors
from corpusloom.sources import tables
from corpusloom.streaming import changes

NOW = dt.datetime(2024, 1, 10, 12)


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expr.alias("x")).first().x


@pytest.mark.parametrize(("name", "tokens"), [("getHTTPClientX", ["get", "httpclient"]), ("resolve_repo", ["resolve", "repo"]), ("a b", []), ("", [])])
def test_tokenize(spark, name, tokens):
    assert one(spark, tx.tokenize(F.col("n")), n=name) == tokens == tx.tokens_of(name)


@pytest.mark.parametrize(
    ("pattern", "path", "hit"),
    [("x.py", "x.py", True), ("x.py", "a/x.py", True), ("x.py", "a/b/x.py", False), ("src/*.py", "src/a.py", True), ("src/*.py", "src/a/b.py", False), ("[ab].py", "b.py", True), ("[a", "[a", False), ("", "any", True), ("a?.go", "ab.go", True)],
)
def test_path_glob(spark, pattern, path, hit):
    assert one(spark, tx.matches_path(F.col("p"), pattern), p=path) is hit


def test_user_regex_guards():
    for bad in ("(a+)+", "x" * 201, "(?=a)", r"(a)\1"):
        with pytest.raises(ValueError):
            tx.user_regex(bad)


def test_lines_and_slices(spark):
    files = spark.createDataFrame([("a", "x\r\ny\nz\n", 8), ("b", "", 0), ("c", "one", 3)], "path string, content string, size_bytes long")
    got = [(r.path, r.line, r.text) for r in tables.lines(files).orderBy("path", "line").collect()]
    assert got == [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "z"), ("c", 1, "one")]
    cut = {r.path: (r.start_line, r.end_line, r.content) for r in catalog.content_slice(files, 2, 99).collect()}
    assert cut["a"] == (2, 3, "y\nz") and cut["c"] == (1, 1, "one") and cut["b"][2] == ""


FILES = [
    ("src/utils/helper.ts", "export const helper = 1\n"),
    ("src/utils/runner.ts", "export const runner = 2\n"),
    ("src/app/main.ts", "import { helper as h, type T } from '../utils/helper'\nimport def, * as ns from \"../utils/runner\"\n"),
    ("src/app/consumer.ts", "import { helper } from '../utils/helper'\nconst r = require('../utils/helper.ts')\nhelper(helper2, helper)\n"),
    ("pkg/mod.py", "from pkg.sub.thing import A as B, C\nimport os.path as osp, pkg.other\n"),
    ("pkg/sub/thing.py", ""),
    ("pkg/other/index.js", ""),
    ("m.sql", "select * from {{ Ref('orders') }}"),
    ("orders.sql", "select 1"),
    ("a.c", '#include "inc/flags.h"\n'),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(p, c, len(c)) for p, c in FILES], "path string, content string, size_bytes long")


@pytest.fixture(scope="module")
def imports(spark, files):
    return graph.resolve_imports(graph.extract_imports(files, strict_language=True), files).cache()


def test_imports(imports):
    got = {(r.source_file, r.specifier): (sorted(r.names), r.resolved) for r in imports.collect()}
    assert got["src/app/main.ts", "../utils/helper"] == (["T", "helper"], "src/utils/helper.ts")
    assert got["src/app/main.ts", "../utils/runner"] == (["def", "ns"], "src/utils/runner.ts")
    assert got["src/app/consumer.ts", "../utils/helper.ts"] == ([], "src/utils/helper.ts")
    assert got["pkg/mod.py", "pkg/sub/thing"] == (["A", "C"], "pkg/sub/thing.py")
    assert got["pkg/mod.py", "os/path"] == (["osp"], None)
    assert got["pkg/mod.py", "pkg/other"] == (["other"], "pkg/other/index.js")
    assert got["m.sql", "orders"] == ([], "orders.sql")
    assert got["a.c", "inc/flags.h"] == ([], None)


def test_importers_and_references(spark, files, imports):
    assert [r.file for r in graph.importers(imports, "src/utils/helper.ts").collect()] == ["src/app/consumer.ts", "src/app/main.ts"]
    assert [r.file for r in graph.importers(imports, "src/utils/helper.ts", 1).collect()] == ["src/app/consumer.ts"]
    refs = {(r.identifier, r.file, r.match_type) for r in graph.references(imports, ["helper", "RUNNER"]).collect()}
    assert refs == {("helper", "src/app/main.ts", "named"), ("helper", "src/app/consumer.ts", "named"), ("helper", "src/app/consumer.ts", "specifier_stem"), ("RUNNER", "src/app/main.ts", "specifier_stem")}
    syms = spark.createDataFrame([("src/utils/helper.ts", "helper")], "file string, name string")
    got = {r.identifier: (r.import_files, r.content_files, r.is_referenced) for r in graph.check_references(imports, files, syms, ["helper", "nothing"]).collect()}
    assert got == {"helper": (2, 2, True), "nothing": (0, 0, False)}


def test_blast_radius(files, imports):
    edges = imports.where("resolved is not null").select(F.col("source_file").alias("source"), F.col("resolved").alias("target"))
    got = {r.path: (r.references, r.status) for r in graph.blast_radius(files, edges, "helper", "src/utils/helper.ts").collect()}
    assert got == {"src/app/main.ts": (2, "confirmed"), "src/app/consumer.ts": (5, "confirmed")}


def test_graph_levels(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (1, 1)], "source long, target long")
    nodes, met = graph.bfs(e, spark.createDataFrame([(1,)], "n long"), 2)
    assert {(r.node, r.level) for r in nodes.collect()} == {(1, 0), (2, 1), (3, 2)}
    assert {(r.source, r.target) for r in met.collect()} == {(1, 2), (2, 3)}


def test_class_hierarchy(spark):
    rows = [("Base", "class Base"), ("Child", "class Child(Base, object)"), ("Leaf", "class Leaf extends Child implements Seen"), ("Loop", "class Loop extends Loop")]
    bases = symbols.class_bases(spark.createDataFrame([(n, "class", s) for n, s in rows], "name string, kind string, signature string"))
    assert {(r.name, r.base) for r in bases.collect()} == {("Child", "Base"), ("Leaf", "Child"), ("Leaf", "Seen")}
    assert {(r.name, r.level) for r in symbols.closure(bases, "Leaf").collect()} == {("Child", 1), ("Seen", 1), ("Base", 2)}
    assert {r.name for r in symbols.closure(bases, "Base", up=False).collect()} == {"Child", "Leaf"}


SYMBOLS = [
    ("u.py::resolve_repo", "resolve_repo", "function", "python", "src/utils.py", 1, 3, "def resolve_repo(path)", "", "", ["repo"], 120),
    ("u.py::resolve_repo_path", "resolve_repo_path", "function", "python", "src/utils.py", 5, 9, "def resolve_repo_path()", "", "", [], 80),
    ("m.py::Runner", "Runner", "class", "python", "src/main.py", 1, 9, "class Runner", "runs the repo", "", [], 70),
    ("f.h::FLAG", "FLAG", "constant", "c", "include/flags.h", 1, 1, "#define FLAG", "", "", [], 32),
]
_KIND = "id string, name string, kind string, language string, file string, line int, end_line int, signature string, summary string, docstring string, keywords array<string>, byte_length int"


def test_symbol_search(spark):
    s = spark.createDataFrame(SYMBOLS, _KIND)
    best = symbols.ranked(symbols.search(s, "resolve_repo")).collect()
    assert [r.name for r in best] == ["resolve_repo", "resolve_repo_path", "Runner"]
    assert best[0].lexical == 3 * 2 + 2 + 2 * 2 and best[0].score == pytest.approx(12 + 0.3 * math.log(2))
    assert [r.name for r in symbols.search(s, "repo", kind="CLASS").collect()] == ["Runner"]
    assert {r.name for r in symbols.search(s, "").collect()} == {"resolve_repo", "resolve_repo_path"}
    packed = symbols.pack_budget(symbols.search(s, "repo"), 50).orderBy("rank").collect()
    assert [r.id for r in packed] == ["u.py::resolve_repo", "u.py::resolve_repo_path"] and packed[0].tokens_used == 50
    assert [r.id for r in symbols.pack_budget(symbols.search(s, "repo"), 48).orderBy("rank").collect()] == ["u.py::resolve_repo", "m.py::Runner"]


def test_hybrid(spark):
    lex = spark.createDataFrame([("a.go", 2, "TODO a", 1), ("b.go", 2, "TODO b", 1)], "path string, line int, text string, score int")
    sem = spark.createDataFrame([("a.go", 2, "TODO a", 0.10), ("b.go", 2, "TODO b", 0.90)], "path string, line int, text string, score double")
    order = lambda w: [r.path for r in search.fuse(lex, sem, w).collect()]
    assert order(search.hybrid_weights(0.1, 0.9)) == ["b.go", "a.go"] and order(search.hybrid_weights(1.0, 0.0)) == ["a.go", "b.go"]
    assert search.hybrid_weights(-1, None) == (0.5, 0.5) == search.hybrid_weights(0, 0)


def test_vectors(spark):
    v = spark.createDataFrame([("main", i, e) for i, e in (("id-c", [1.0, 0.0]), ("id-a", [1.0, 0.0]), ("id-b", [1.0, 0.0]))] + [("other", "x", [0.0, 1.0])], "namespace string, id string, embedding array<float>")
    q = spark.createDataFrame([("q", "main", [1.0, 0.0])], "query_id string, namespace string, embedding array<float>")
    top = lambda df: [(r.id, round(r.score, 6)) for r in vectors.top_k(df, q, 3).orderBy("rank").collect()]
    assert top(v) == [("id-a", 1.0), ("id-b", 1.0), ("id-c", 1.0)]
    new = spark.createDataFrame([("main", "id-b", [1.0, 1.0], 1), ("main", "id-b", [0.0, 1.0], 2)], "namespace string, id string, embedding array<float>, seq int")
    v = vectors.upsert(v, new)
    assert top(v) == [("id-a", 1.0), ("id-c", 1.0), ("id-b", 0.0)]
    left, gone = vectors.delete(v, "main", [" id-b ", "", "missing", "id-b"])
    assert gone == 1 and left.count() == 3
    assert not one(spark, vectors.valid(F.col("v")), v=[0.0, 0.0]) and not one(spark, vectors.valid(F.col("v")), v=[float("nan")])


def test_retrieval_measures(spark):
    ranked = lambda ids: spark.createDataFrame([("q", d, k + 1) for k, d in enumerate(ids)], "query_id string, id string, rank int")
    judged = lambda rel: spark.createDataFrame([("q", d, r) for d, r in rel.items()], "query_id string, id string, relevance int")
    recall = lambda ids, rel, k: vectors.recall_at_k(ranked(ids), judged(rel), k).first().recall
    assert recall("aabc", {"a": 1, "b": 2, "x": 1, "c": 0}, 3) == pytest.approx(2 / 3)
    assert recall("acb", {"a": 1, "b": 1}, 1) == 0.5 and recall("a", {"b": 0}, 1) == 0
    mrr = lambda ids, k: vectors.mrr_at_k(ranked(ids), judged({"b": 1}), k).first().reciprocal_rank
    assert mrr("bac", 3) == 1 and mrr("acb", 3) == pytest.approx(1 / 3) and mrr("acb", 2) == 0
    ms = telemetry.latency(spark.createDataFrame([(-5.0,), (100.0,), (30.0,), (20.0,)], "ms double"), "ms").first()
    assert (ms.p50, ms.p95) == (25.0, 89.5)


def test_chunks(spark):
    files = spark.createDataFrame([("z.go", "package z"), ("a.go", "l1\nl2\nl3"), ("w.go", " \n\t\n"), ("long.go", "x" * 20 + "\nyy\n")], "path string, content string")
    got = {(r.path, r.start_line, r.end_line, r.chunk_text) for r in chunks.chunk(files, "r", 2, 500).collect()}
    assert got == {("z.go", 1, 1, "package z"), ("a.go", 1, 2, "l1\nl2"), ("a.go", 3, 3, "l3"), ("long.go", 1, 2, "x" * 20 + "\nyy")}
    assert {(r.start_line, r.end_line) for r in chunks.chunk(files.where("path = 'long.go'"), "r", 80, 10).collect()} == {(1, 1), (2, 2)}
    crlf = spark.createDataFrame([("a.go", "l1\r\nl2\r\nl3")], "path string, content string")
    ids = lambda df: sorted(r.chunk_id for r in chunks.chunk(df, "r", 2, 500).collect())
    assert ids(crlf) == ids(files.where("path = 'a.go'"))


def test_symbol_source_and_bundle(spark, imports):
    import hashlib

    files = spark.createDataFrame([("src/utils/helper.ts", "import x from 'y'\na\nb\nc\n")], "path string, content string")
    s = spark.createDataFrame([("h", "helper", "src/utils/helper.ts", 2, 3, hashlib.sha256(b"a\nb").hexdigest())], "id string, name string, file string, line int, end_line int, content_hash string")
    r = chunks.symbol_source(s, files, ["h", "h"], 1).first()
    assert (r.source, r.start_line, r.end_line, r.content_verified) == ("import x from 'y'\na\nb\nc", 1, 4, True)
    b = chunks.context_bundle(s, files, imports, ["h"], callers=True)
    assert b.first().import_lines == ["import x from 'y'"] and b.first().callers == ["src/app/consumer.ts", "src/app/main.ts"]
    assert "## helper" in chunks.markdown(b).first().markdown


def test_discovery(spark):
    rows = [("src/a.py", "x"), ("node_modules/b.js", "x"), ("conf/my_token.py", "x"), ("docs/secret.md", "x"), ("x.bin", "x"), ("c.py", "a\0b"), ("d.py", "ÿÿÿÿ"), ("../e.py", "x"), ("gen/f.py", "x"), ("z.py", "x"), ("lib/y.py", "x"), ("g.py", "text\twith\nlines"), ("h.py", None)]
    df = spark.createDataFrame([(p, c, len(c or "")) for p, c in rows], "path string, content string, size_bytes long")
    got = {r.path: r.skip_reason for r in catalog.discover(df, extra_ignore=["gen/"], cap=3).collect()}
    assert got == {"src/a.py": None, "node_modules/b.js": "skip_dir", "conf/my_token.py": "secret", "docs/secret.md": "wrong_extension", "x.bin": "wrong_extension", "c.py": "binary", "d.py": "binary", "../e.py": "path_traversal", "gen/f.py": "extra_ignore", "z.py": "file_limit", "lib/y.py": None, "g.py": None, "h.py": "unreadable"}
    counts = {r.skip_reason: r.n for r in catalog.skip_counts(catalog.discover(df)).collect()}
    assert len(counts) == 13 and counts["binary"] == 2 and counts["symlink"] == 0


def test_roots(spark):
    roots = spark.createDataFrame([("/a", "r1"), ("/a/b", "r2")], "root string, repo string")
    got = {r.path: r.repo for r in catalog.latest_per_root(spark.createDataFrame([("/a/b/c.py",), ("/a/x.py",), ("/z",)], "path string"), roots).collect()}
    assert got == {"/a/b/c.py": "r2", "/a/x.py": "r1"}


def test_columns(spark):
    rows = [("dbt", "orders", "order_id", "the order id"), ("dbt", "orders", "customer_id", "who"), ("sqlmesh", "payments", "payment_id", None)]
    df = spark.createDataFrame(rows, "source string, model string, column string, description string")
    got = [(r.column, r.score) for r in chunks.search_columns(df, "order_id").collect()]
    assert got == [("order_id", 30)]
    assert [(r.column, r.score) for r in chunks.search_columns(df, "id").collect()][0] == ("order_id", 23)
    assert [r.model for r in chunks.search_columns(df, "id", "pay*").collect()] == ["payments"]


def test_telemetry(spark):
    rows = [(NOW - dt.timedelta(hours=2), "search_text", -5.0, 10, 20, 0, -1, 5), (NOW - dt.timedelta(hours=36), " ", 3.0, 1, 1, 9, 2, 2), (NOW, "late", 1.0, 1, 1, 2, 0, 0)]
    calls = telemetry.normalise_calls(spark.createDataFrame(rows, "captured_at timestamp, tool_name string, duration_ms double, request_tokens long, response_tokens long, total_tokens long, input_tokens_saved long, output_tokens_saved long"))
    got = {r.tool_name: (r.total_tokens, r.tokens_saved, r.logical_calls, r.duration_ms) for r in calls.collect()}
    assert got == {"search_text": (30, 5, 1, 0.0), "unknown": (9, 4, 1, 3.0), "late": (2, 0, 1, 1.0)}
    t = telemetry.trends(calls, str(NOW)).first()
    assert (t.last_24h_calls, t.last_7d_calls) == (1, 2)
    assert telemetry.trend(calls, "last_24h", str(NOW)).count() == 24
    assert telemetry.trend(calls, "last_24h", str(NOW + dt.timedelta(minutes=30))).count() == 25
    assert telemetry.trend(calls, "last_7d", str(NOW)).count() == 8
    snaps = spark.createDataFrame([(1, 10, 4), (2, 15, 6), (3, 3, 7)], "captured_at int, a long, b long")
    assert [(r.a_delta, r.b_delta) for r in telemetry.snapshot_deltas(snaps, ["a", "b"]).orderBy("captured_at").collect()] == [(10, 4), (5, 2), (3, 7)]
    run = spark.createDataFrame([(100, 0, 40, 20)], "baseline_in long, baseline_out long, tool_in long, tool_out long")
    d = telemetry.benchmark_delta(run).first()
    assert d.tokens_saved == 40 and d.saved_ratio == 0.4 and d.claude_code_usd == pytest.approx((60 * 3 - 20 * 15) / 1e6)


@pytest.mark.parametrize(("kinds", "net"), [(("added", "deleted"), None), (("added", "modified"), "added"), (("modified", "deleted"), "deleted"), (("deleted", "added"), "modified"), (("deleted", "modified"), "deleted"), (("added", "deleted", "added"), "added")])
def test_coalescing(spark, kinds, net):
    rows = [(1, "p", k, NOW, n) for n, k in enumerate(kinds)]
    got = changes.coalesce(spark.createDataFrame(rows, "folder int, path string, change_type string, event_time timestamp, seq long"), "folder").collect()
    assert [r.change_type for r in got] == ([net] if net else [])


def test_stream_of_changes(spark, tmp_path):
    schema = "folder int, path string, change_type string, event_time timestamp, seq long"
    rows = [(1, "a", "added", NOW, 1), (1, "a", "deleted", NOW, 2), (1, "b", "modified", NOW, 3), (2, "c", "added", NOW + dt.timedelta(seconds=9), 4)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    q = changes.run_incremental(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), lambda df, n: seen.extend((r.folder, r.path, r.change_type) for r in df.collect()), str(tmp_path / "cp"))
    q.processAllAvailable()
    assert changes.wait_for_fresh(q, 5000)
    q.stop()
    assert sorted(seen) == [(1, "b", "modified"), (2, "c", "added")]
    stream = changes.debounce(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "200 milliseconds", "1 second")
    q = stream.writeStream.format("memory").queryName("batches").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.folder, r.n_changes) for r in spark.sql("select * from batches").collect()] == [(1, 3)]


def test_apply_changes(spark):
    files = spark.createDataFrame([("a", "1", 1), ("b", "2", 1)], "path string, content string, size_bytes long")
    net = spark.createDataFrame([("a", "deleted", None), ("b", "modified", "22"), ("c", "added", "3")], "path string, change_type string, content string")
    assert {(r.path, r.content) for r in changes.apply_changes(files, net).collect()} == {("b", "22"), ("c", "3")}
    s = lambda rows: spark.createDataFrame(rows, "path string, size long, mtime long")
    got = changes.snapshot_changes(s([("a", 1, 1), ("b", 1, 1), (".h", 1, 1)]), s([("b", 1, 2), ("c", 1, 1), (".h", 2, 2)])).collect()
    assert {(r.path, r.change_type) for r in got} == {("a", "deleted"), ("b", "modified"), ("c", "added")}


def test_exact_quantiles(spark):
    from corpusloom.operators.quantiles import exact_quantiles

    rng = random.Random(4)
    rows = [(k, None if rng.random() < 0.05 else float(rng.choice([rng.randint(0, 9), rng.random() * 1e6]))) for k in ("a", "b", None) for _ in range({"a": 3000, "b": 7, None: 40}[k])] + [("c", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    for ranges in (3, 200):
        got = {r.k: r[1:] for r in exact_quantiles(df, "v", [0.0, 0.5, 0.95, 1.0], "k", ranges=ranges).collect()}
        want = {r.k: tuple(r.q) for r in df.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, (0.0, 0.5, 0.95, 1.0)))).alias("q")).where("q is not null").collect()}
        assert set(got) == {"a", "b", None} and all(got[k] == pytest.approx(want[k]) for k in want)
    assert exact_quantiles(df, "v", [0.5]).count() == 1


def test_coalesce_is_a_fold(spark):
    rng = random.Random(6)
    rows = [(1, f"p{rng.randint(0, 5)}", rng.choice(["added", "modified", "deleted", "other"]), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.choice([0, 1, 4000, 9999]), microseconds=rng.randint(0, 3)), k) for k in range(400)]
    net = {}
    for _, path, now, _, _ in sorted((r for r in rows if r[2] != "other"), key=lambda r: (r[1], r[3], r[4])):
        before = net.get(path, "none")
        net[path] = {("added", "deleted"): "none", ("added", "modified"): "added", ("modified", "added"): "modified", ("deleted", "added"): "modified", ("deleted", "modified"): "deleted"}.get((before, now), now)
    got = changes.coalesce(spark.createDataFrame(rows, "folder int, path string, change_type string, event_time timestamp, seq long"), "folder")
    assert {r.path: r.change_type for r in got.collect()} == {p: s for p, s in net.items() if s != "none"}


def test_hierarchy_of_many_levels(spark):
    bases = spark.createDataFrame([(f"c{k}", f"c{k + 1}") for k in range(45)] + [("c45", "c0")], "name string, base string")
    assert {r.name: r.level for r in symbols.closure(bases, "c0").collect()} == {f"c{k}": k for k in range(1, 46)}


def test_scoped_ignores(spark):
    rows = [(".gitignore", "build/\n# x\n!keep.py\n"), ("a/.gitignore", "*.log\r\nsub/x?.py\nlit.dir\n\n"), ("a/b/.gitignore", "[ab].py\n"), *[(p, "") for p in ("build/x.py", "a/build/x.py", "t.log", "a/t.log", "a/b/t.log", "a/sub/x1.py", "a/sub/x12.py", "a/lit.dir/y.py", "lit.dir", "a/b/a.py", "a/a.py", "keep.py")]]
    files = spark.createDataFrame(rows, "path string, content string")
    got = {r.path for r in catalog.scoped_ignored(files, catalog.ignore_rules(files)).collect()}
    assert got == {"build/x.py", "a/t.log", "a/b/t.log", "a/sub/x1.py", "a/lit.dir/y.py", "a/b/a.py"}


def test_tree_digest_tells_trees_apart(spark):
    files = spark.createDataFrame([(f"d{k % 2}/f{k}", str(k)) for k in range(50)], "path string, content string")
    digest = lambda df: {r.directory: (r.tree_sha256, r.file_count) for r in catalog.tree_digest(df).collect()}
    a, b = digest(files.repartition(5)), digest(files.withColumn("content", F.when(F.col("path") == "d1/f7", "x").otherwise(F.col("content"))))
    assert a == digest(files) and a["d0"] == b["d0"] and a["d1"] != b["d1"] and a["d1"][1] == 25


def test_vector_faults_are_errors(spark):
    v = spark.createDataFrame([("m", "a", [1.0, 0.0]), ("m", "b", [0.0, 0.0])], "namespace string, id string, embedding array<double>")
    q = spark.createDataFrame([("q", "m", [1.0, 0.0, 0.0])], "query_id string, namespace string, embedding array<double>")
    with pytest.raises(Exception, match="zero norm"):
        vectors.top_k(v, q.withColumn("embedding", F.slice("embedding", 1, 2)), 1).collect()
    with pytest.raises(Exception, match="unequal sizes"):
        vectors.top_k(v.where("id = 'a'"), q, 1).collect()
