"""The facade: every named query once, and what goes wrong as a payload."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpusloom import api
from corpusloom.operators import chunks
from tests.test_operators import FILES, SYMBOLS, _KIND


@pytest.fixture(scope="module")
def corpus(spark):
    files = spark.createDataFrame([(p, c, len(c)) for p, c in FILES], "path string, content string, size_bytes long")
    more = [("Base", "Base", "class", "typescript", "src/utils/helper.ts", 1, 1, "class Base", "", "", ["base"], 30), ("Child", "Child", "class", "typescript", "src/app/main.ts", 1, 1, "class Child extends Base", "", "", [], 30), ("helper", "helper", "function", "typescript", "src/utils/helper.ts", 1, 1, "const helper", "", "", ["help", "base"], 30)]
    syms = spark.createDataFrame([*SYMBOLS, *more], _KIND).withColumn("content_hash", F.lit(""))
    other = api.Corpus(files, syms.where("name <> 'Runner'").withColumn("signature", F.when(F.col("name") == "helper", "changed").otherwise(F.col("signature"))), name="local/other")
    cols = spark.createDataFrame([("dbt", "orders", "order_id", "the id")], "source string, model string, column string, description string")
    now = dt.datetime(2024, 1, 1)
    calls = spark.createDataFrame([(now, "search_text", 1.0, 1, 2, 3, 4, 0)], "captured_at timestamp, tool_name string, duration_ms double, request_tokens long, response_tokens long, total_tokens long, input_tokens_saved long, output_tokens_saved long")
    cut = chunks.chunk(files, "r")
    vecs = cut.select(F.lit("main").alias("namespace"), F.col("chunk_id").alias("id"), F.array(F.when(F.contains("chunk_text", F.lit("helper")), 1.0).otherwise(0.1), F.lit(0.5)).alias("embedding"), "path", "start_line", "chunk_text")
    return api.Corpus(files, syms, cols, calls, other, embed=lambda q: [1.0, 0.5], chunk_vectors=vecs, head="abc")


def test_all_tools_have_arguments():
    assert len(api.ARGUMENTS) == 27 and all(hasattr(api.Corpus, t) for t in api.ARGUMENTS)


CASES = {
    "list_repos": ({}, lambda r: [x["repo"] for x in r["repos"]] == ["local/corpus", "local/other"]),
    "resolve_repo": ({"path": "/tmp"}, lambda r: r["repo"].startswith("local/tmp-") and r["found"] and not r["indexed"]),
    "get_file_tree": ({"path_prefix": "src/"}, lambda r: [x["path"] for x in r["tree"]] == ["app/", "utils/"] and r["tree"][1]["children"][0] == {"language": "typescript", "path": "src/utils/helper.ts", "symbol_count": 0, "type": "file"} and r["file_count"] == 4 and r["directories"][0] == {"directory": "(root)", "file_count": 4, "size_bytes": sum(len(c) for p, c in FILES if p.startswith("src/"))}),
    "get_file_outline": ({"file_paths": ["m.sql", "no"]}, lambda r: r["results"][0]["language"] == "sql" and "error" in r["results"][1]),
    "get_file_content": ({"file_path": "src/app/main.ts", "start_line": "2"}, lambda r: r["content"].startswith("import def") and r["end_line"] == 2),
    "get_symbol_source": ({"symbol_ids": ["helper", "no"]}, lambda r: r["results"][0]["source"] == "export const helper = 1" and "error" in r["results"][1]),
    "search_symbols": ({"query": "resolve_repo", "max_results": 1}, lambda r: r["result_count"] == 1 and r["results"][0]["name"] == "resolve_repo" and r["total_symbols"] == 7),
    "search_text": ({"query": "HELPER", "context_lines": 1}, lambda r: r["results"][0]["file"] == "src/app/consumer.ts" and r["results"][0]["matches"][0]["after"]),
    "get_repo_outline": ({}, lambda r: r["directories"]["src/"] == 4 and r["kinds"]["class"] == 3 and r["languages"]["typescript"] == 4),
    "find_importers": ({"file_path": "src/utils/helper.ts"}, lambda r: r["importer_count"] == 2 and len(r["importers"]) == 2),
    "find_references": ({"identifier": "helper"}, lambda r: [x["file"] for x in r["references"]] == ["src/app/consumer.ts", "src/app/main.ts"]),
    "check_references": ({"identifiers": ["helper", "nope"]}, lambda r: [x["is_referenced"] for x in r["results"]] == [True, False]),
    "search_columns": ({"query": "order_id"}, lambda r: r["results"][0]["score"] == 30 and "source" not in r["results"][0] and r["total_models"] == 1),
    "get_context_bundle": ({"symbol_id": "helper", "include_callers": "yes"}, lambda r: r["symbols"][0]["callers"] == ["src/app/consumer.ts", "src/app/main.ts"]),
    "get_session_stats": ({"now": "2024-01-01 01:00:00"}, lambda r: r["windows"]["last_24h_calls"] == 1 and r["tools"][0]["tool_name"] == "search_text"),
    "get_dependency_graph": ({"file": "src/app/main.ts"}, lambda r: len(r["nodes"]) == 3 and len(r["edges"]) == 2 and r["neighbors"]["src/utils/helper.ts"] == {"imported_by": ["src/app/main.ts"]}),
    "get_symbol_diff": ({}, lambda r: [x["name"] for x in r["removed"]] == ["Runner"] and [x["name"] for x in r["changed"]] == ["helper"] and r["unchanged_count"] == 5),
    "get_class_hierarchy": ({"class_name": "child"}, lambda r: r["ancestors"] == [{"name": "Base", "level": 1, "indexed": True}] and r["descendants"] == []),
    "get_related_symbols": ({"symbol_id": "u.py::resolve_repo"}, lambda r: r["related"][0]["id"] == "u.py::resolve_repo_path" and r["related"][0]["score"] == 4.0),
    "suggest_queries": ({}, lambda r: r["top_keywords"][0] == "base" and r["most_imported"][0] == {"file": "src/utils/helper.ts", "imported_by": 3}),
    "get_blast_radius": ({"symbol": "helper"}, lambda r: {x["path"] for x in r["confirmed"]} == {"src/app/main.ts", "src/app/consumer.ts"}),
    "wait_for_fresh": ({}, lambda r: r["fresh"] is True),
    "check_freshness": ({"current_head": "def"}, lambda r: r["fresh"] is False),
    "invalidate_cache": ({}, lambda r: r["success"]),
}


@pytest.mark.parametrize("tool", CASES)
def test_tool(corpus, tool):
    arguments, holds = CASES[tool]
    got = corpus.call(tool, arguments)
    assert "error" not in got and holds(got), got


@pytest.mark.parametrize("mode", ["semantic", "hybrid"])
def test_vector_modes(corpus, mode):
    got = corpus.call("search_text", {"query": "helper", "retrieval_mode": mode})
    assert got["retrieval_mode"] == mode and got["result_count"] > 0
    plain = api.Corpus(corpus.files).call("search_text", {"query": "helper", "retrieval_mode": mode})
    assert plain["degraded"] and plain["retrieval_mode"] == "lexical" and plain["result_count"] > 0


def test_budget_and_markdown(corpus):
    got = corpus.call("search_symbols", {"query": "repo", "token_budget": 50})
    assert got["tokens_used"] == 50 and got["result_count"] == 2
    assert corpus.call("get_context_bundle", {"symbol_id": "helper", "output_format": "markdown"})["markdown"].startswith("## helper")


@pytest.mark.parametrize(("tool", "arguments"), [("nothing", {}), ("search_text", {}), ("search_text", {"query": "(a+)+", "is_regex": True}), ("search_text", {"query": "a", "is_regex": "maybe"}), ("search_text", {"query": "a", "retrieval_mode": "x"}), ("find_importers", {}), ("find_importers", {"file_path": "a", "file_paths": ["b"]}), ("get_file_content", {"file_path": "no"}), ("get_blast_radius", {"symbol": "no"}), ("get_class_hierarchy", {"class_name": "no"}), ("find_references", {"identifiers": ["x"] * 300})])
def test_errors_are_payloads(corpus, tool, arguments):
    assert set(corpus.call(tool, arguments)) == {"error"}


def test_index_folder(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("import b\n")
    (tmp_path / "b.py").write_text("x = 1\n")
    (tmp_path / "c.bin").write_bytes(b"\0")
    corpus = api.Corpus(spark.createDataFrame([("b.py", "old", 3), ("gone.py", "", 0)], "path string, content string, size_bytes long"))
    got = corpus.call("index_folder", {"path": str(tmp_path)})
    assert (got["file_count"], got["new"], got["changed"], got["deleted"]) == (2, 1, 1, 1) and got["skipped"]["wrong_extension"] == 1
    assert corpus.call("find_importers", {"file_path": "b.py"})["importer_count"] == 1
    assert corpus.call("index_repo", {"url": "https://example.org/x"}) == {"error": "only stores that Spark reads can be indexed"}
    (tmp_path / "b.py").write_text("y = 2\n")
    assert corpus.call("index_file", {"path": str(tmp_path / "b.py")})["success"]


def test_references_of_each_identifier(spark):
    """An identifier with many files leaves the others their own."""
    rows = [(f"f{k}.ts", "import { aaa } from './a'") for k in range(5)] + [("g.ts", "import { bbb } from './b'")]
    files = spark.createDataFrame([(p, c, len(c)) for p, c in rows], "path string, content string, size_bytes long")
    found = api.Corpus(files, None).call("find_references", {"identifiers": ["aaa", "bbb"], "max_results": 1})
    assert [[x["file"] for x in r["references"]] for r in found["results"]] == [["f0.ts"], ["g.ts"]]


def test_workspace(spark, tmp_path):
    """Several repositories, by name and by path; incremental indexing with changed paths, links, ignore files in folders, and deletion."""
    from corpusloom.operators.vectors import hashed_embedding
    from corpusloom.sources.store import RepoStore

    one, two = tmp_path / "one", tmp_path / "two/inner"
    (one / "pkg").mkdir(parents=True)
    two.mkdir(parents=True)
    (one / "pkg/a.py").write_text("import b\n")
    (one / "pkg/skipped.py").write_text("x\n")
    (one / "pkg/.gitignore").write_text("skip*.py\n")
    (one / "__init__.py").write_text("helper = 0\n")
    (one / "b.py").write_text("helper = 1\n")
    (two / "c.py").write_text("other = 1\n")
    (one / "link.py").symlink_to(tmp_path / "outside.py")
    (tmp_path / "outside.py").write_text("secretive = 1\n")
    store = RepoStore(spark, str(tmp_path / "store"))
    w = api.Workspace(spark, store=store, embed=lambda text: hashed_embedding(text, 16))
    first = w.call("index_folder", {"path": str(one)})
    assert (first["new"], first["skipped"]["gitignore"], first["skipped"]["symlink"]) == (3, 1, 1)
    assert w.call("index_folder", {"path": str(one)})["message"] == "No changes detected"
    second = w.call("index_folder", {"path": str(two)})
    assert second["new"] == 1 and [r["file_count"] for r in w.call("list_repos")["repos"]] == [1, 3]
    vectors_before = {r.id for r in w.corpora[first["repo"]].chunk_vectors.collect()}
    (one / "b.py").write_text("helper = 2\n")
    (one / "pkg/a.py").write_text("import c\n")
    part = w.call("index_folder", {"path": str(one), "changed_paths": ["b.py", "gone.py"]})
    assert (part["new"], part["changed"], part["deleted"], part["file_count"]) == (0, 1, 0, 3)
    after = {r.id for r in w.corpora[first["repo"]].chunk_vectors.collect()}
    assert len(after) == 3 and len(after & vectors_before) == 2
    assert w.call("index_folder", {"path": str(one), "changed_paths": ["../x"]}) == {"error": "a changed path is outside the folder"}
    found = w.call("resolve_repo", {"path": str(two / "c.py")})
    assert (found["repo"], found["indexed"], found["source_root"]) == (second["repo"], True, str(two))
    assert w.call("index_file", {"path": str(two / "c.py")})["repo"] == second["repo"]
    assert "error" in w.call("index_file", {"path": "/nowhere/x.py"}) and "error" in w.call("get_file_tree", {"repo": "nothing"}) and "error" in w.call("get_file_tree", {})
    assert w.call("search_text", {"repo": "one", "query": "helper", "retrieval_mode": "semantic"})["result_count"] > 0
    assert {r.repo for r in store.list().collect()} == {first["repo"], second["repo"]}
    assert w.call("invalidate_cache", {"repo": second["repo"]})["success"]
    assert [r.repo for r in store.list().collect()] == [first["repo"]] and list(w.corpora) == [first["repo"]]
    copy = api.Workspace(spark, dict.fromkeys(["x/lib", "y/lib"], w.corpora[first["repo"]]))
    assert copy.call("get_file_tree", {"repo": "lib"}) == {"error": "Ambiguous repository name: lib"}


def test_content_references(corpus):
    got = corpus.call("check_references", {"identifier": "helper"})
    assert got["content_count"] == len(got["content_references"]) and got["import_count"] == len(got["import_references"]) and got["is_referenced"]
    assert "content_references" not in corpus.call("check_references", {"identifier": "helper", "search_content": False})


def test_index_file_answers(spark, tmp_path):
    """Every answer of index_file; the snapshot is a written one, which later changes in the folder do not reach; vectors follow."""
    from corpusloom.operators.vectors import hashed_embedding
    from corpusloom.sources.store import RepoStore

    root = tmp_path / "r"
    (root / "sub").mkdir(parents=True)
    for name, text in (("a.py", "one = 1\n"), ("sub/b.py", "two = 2\n"), ("_own.py", "three = 3\n")):
        (root / name).write_text(text)
    store = RepoStore(spark, str(tmp_path / "store"), 16)
    w = api.Workspace(spark, store=store, embed=lambda text: hashed_embedding(text, 8))
    assert w.call("index_file", {"path": str(root / "a.py")})["error"].startswith("No indexed folder found that contains")
    repo = w.call("index_folder", {"path": str(root)})["repo"]
    own = w.corpora[repo]
    (root / "a.py").write_text("changed = 1\n")
    assert own.files.where("path = 'a.py'").first().content == "one = 1\n"
    files = lambda: {r.path: r.content for r in store.load(repo).collect()}
    ask = lambda p: {k: v for k, v in w.call("index_file", {"path": str(root / p)}).items() if k not in ("_meta", "duration_seconds", "indexed_at", "repo")}
    assert ask("a.py") == {"success": True, "file": "a.py", "is_new": False, "symbol_count": 0} and files()["a.py"] == "changed = 1\n"
    assert store.snapshots(repo).entry()["touched"] == 1
    assert ask("a.py") == {"success": True, "message": "File unchanged", "file": "a.py"}
    (root / "sub/__new__.py").write_text("four = 4\n")
    assert ask("sub/../sub/__new__.py") == {"success": True, "file": "sub/__new__.py", "is_new": True, "symbol_count": 0}
    assert {r.path for r in own.chunk_vectors.select("path").collect()} == {"a.py", "sub/b.py", "_own.py", "sub/__new__.py"} == set(files())
    (root / "pic.BIN").write_bytes(b"\0")
    (root / ".env.local").write_text("x")
    assert ask("pic.BIN") == {"success": False, "error": "Unsupported file type: .bin. File not recognized as a supported language."}
    assert ask(".env.local")["error"].startswith("Unsupported file type: .local.")
    assert ask("gone.py") == {"success": False, "error": f"File not found: {root}/gone.py"} and ask("sub") == {"success": False, "error": f"Path is not a file: {root}/sub"}
    assert ask("../store")["success"] is False and len(store.snapshots(repo).versions()) == 3
    again = api.Workspace(spark, store=store)  # a new process: the last version counts
    assert again.call("index_folder", {"path": str(root)})["message"] == "No changes detected" and again.call("index_file", {"path": str(root / "a.py")})["message"] == "File unchanged"


def test_ingest_opens_what_it_may_take(spark, tmp_path, monkeypatch):
    """Files that paths and sizes rule out stay unread; no hidden file is lost, however many; ignored files do not count against the cap."""
    from corpusloom.sources import ingest

    root = tmp_path / "r"
    (root / "node_modules").mkdir(parents=True)
    (root / "pkg").mkdir()
    for k in range(30):
        (root / f"pkg/_h{k}.py").write_text(f"x = {k}\n" + "#" * 100)
        (root / f"node_modules/m{k}.js").write_text("x")
        (root / f"pkg/skip{k}.py").write_text("x")
    (root / "pkg/.gitignore").write_text("skip*\n")
    (root / "pkg/large.py").write_text("x" * 600_000)
    monkeypatch.setattr(ingest, "_HELD_BYTES", 500)
    read = []
    real = ingest.contents
    monkeypatch.setattr(ingest, "contents", lambda s, r, wanted, f: (read.extend(x.path for x in wanted.collect()), real(s, r, wanted, f))[1])
    seen = {r.path: r.skip_reason for r in ingest.take(spark, str(root), str(tmp_path / "w"), cap=20).collect()}
    assert sorted(read) == sorted(["pkg/.gitignore", *(f"pkg/_h{k}.py" for k in range(30))])
    assert sum(v is None for v in seen.values()) == 20 and sum(v == "file_limit" for v in seen.values()) == 10
    assert sum(v == "gitignore" for v in seen.values()) == 30 and seen["pkg/large.py"] == "too_large" and sum(v == "skip_dir" for v in seen.values()) == 30
    monkeypatch.setattr(ingest, "_MOST_NAMED", 3)
    all_seen = {r.path: r.content for r in ingest.take(spark, str(root), str(tmp_path / "w2"), links=spark.createDataFrame([("pkg/_h1.py", "symlink")], "path string, skip_reason string")).where("skip_reason is null").collect()}
    assert len(all_seen) == 29 and all_seen["pkg/_h7.py"].startswith("x = 7")
