"""Queries over whole tables, against plain versions."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import graph as imports_graph
from corpusloom.operators import history, symbols, vectors
from corpusloom.plans import registry
from corpusloom.sources import tables as t

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def graph(spark):
    """All edges, computed apart, and a plain breadth-first search."""
    n = t.table(spark, SF_DIR, "supplier").count()
    pairs = {(r.l_suppkey, r.l_partkey % n) for r in t.table(spark, SF_DIR, "lineitem").select("l_suppkey", "l_partkey").collect()}
    edges = {(a, b) for a, b in pairs if a != b}

    def walk(depth, back=False):
        near = defaultdict(set)
        for a, b in edges:
            near[b if back else a].add(a if back else b)
        level, front = {1: 0}, {1}
        for k in range(1, depth + 1):
            front = {b for a in front for b in near[a]} - set(level)
            level |= dict.fromkeys(front, k)
        return level

    return edges, walk


def test_whole_graph(spark, graph):
    edges, walk = graph
    rows = lambda name: [tuple(r) for r in registry.QUERIES[name](spark, SF_DIR).collect()]
    assert sorted(rows("dependency_nodes")) == sorted(walk(2).items())
    assert sorted(rows("dependency_importers")) == sorted(walk(3, True).items())
    below = {n for n, k in walk(2).items() if k < 2}
    assert sorted(rows("dependency_edges")) == sorted(e for e in edges if e[0] in below)
    inside = set(walk(1))
    own = {n: (sum(a == n and b in inside for a, b in edges), sum(b == n and a in inside for a, b in edges)) for n in inside}
    assert sorted(rows("dependency_neighbours")) == sorted((n, *v) for n, v in own.items() if any(v))
    names = {r.s_suppkey for r in t.table(spark, SF_DIR, "supplier").collect()}
    met = {(r[0], r[1]) for r in rows("blast_radius")}
    assert met == {(str(n), k) for n, k in walk(2, True).items() if k and n in names}


def test_whole_vectors(spark):
    e = [(r.vec_id, r.label, np.array(r.embedding, float)) for r in t.table(spark, SF_DIR, "embeddings").collect()]
    unit = {i: v / np.sqrt(v @ v) for i, _, v in e}
    label = {i: y for i, y, _ in e}
    asked = [i for i in unit if i % 20 == 0]
    assert max(asked) >= 20
    near = {q: sorted(unit, key=lambda i: (-round(float(unit[q] @ unit[i]), 12), str(i)))[:10] for q in asked}
    found = defaultdict(list)
    for r in registry.QUERIES["vector_topk"](spark, SF_DIR).orderBy("rank").collect():
        found[int(r.query_id)].append(int(r.id))
    assert found == {q: n[:5] for q, n in near.items()}
    same = Counter(label.values())
    recall = {q: sum(label[i] == label[q] for i in n) / same[label[q]] for q, n in near.items()}
    assert {int(r.query_id): r.recall for r in registry.QUERIES["recall_at_k"](spark, SF_DIR).collect()} == pytest.approx(recall, abs=1e-6)
    mrr = {q: next((1 / k for k, i in enumerate(n, 1) if label[i] == label[q]), 0) for q, n in near.items()}
    assert {int(r.query_id): r.reciprocal_rank for r in registry.QUERIES["mrr_at_k"](spark, SF_DIR).collect()} == pytest.approx(mrr, abs=1e-6)


def test_whole_overlap(spark):
    tokens = {r.p_partkey: set(re.findall("[a-z0-9]{2,}", r.p_name.lower())) for r in t.table(spark, SF_DIR, "part").collect()}
    want = {(str(a), str(b), len(tokens[a] & tokens[b])) for a in tokens if a % 20 == 0 for b in tokens if a != b and tokens[a] & tokens[b]}
    assert {tuple(r) for r in registry.QUERIES["token_overlap"](spark, SF_DIR).collect()} == want


def test_whole_files(spark):
    paths = sorted(r.path for r in t.files(spark, SF_DIR).select("path").collect())
    rows = lambda name: {r[0]: r[1] for r in registry.QUERIES[name](spark, SF_DIR).collect()}
    reason = rows("discovery_filter")
    assert sorted(reason) == paths and len({p.split("/")[1] for p in paths}) > 1
    assert all((reason[p] == "gitignore") == p.startswith("src3/") for p in paths)
    assert rows("skip_counts")["gitignore"] == sum(p.startswith("src3/") for p in paths)
    cap = rows("file_cap")
    able = [p for p in paths if cap[p] in (None, "file_limit")]
    assert sorted(p for p, r in cap.items() if r is None) == able[:100] and sorted(cap) == paths


def test_whole_sources(spark):
    d = {r.doc_id: r.text for r in t.table(spark, SF_DIR, "documents").collect()}
    got = {int(r.id): r for r in registry.QUERIES["symbol_source"](spark, SF_DIR).collect()}
    parts = t.table(spark, SF_DIR, "part").collect()
    assert sorted(got) == sorted(p.p_partkey for p in parts)
    for p in parts:
        lines = (d[p.p_partkey % len(d)] or "").split("\n")
        a, z = (max(min(k, len(lines)), 1) for k in (p.p_size, p.p_size + 3))
        assert got[p.p_partkey].source == "\n".join(x.removesuffix("\r") for x in lines[a - 1 : z])


def test_token_overlap_meets_lists_not_ids(spark):
    """Equal names are compared once; repeated ids count together, and an id without tokens or a null id is in no pair."""
    rows = [(str(k), "red ring" if k % 2 else "old_ring Red") for k in range(1500)] + [("7", "redRing"), ("x", "?"), (None, "red ring"), ("y", None)]
    s = spark.createDataFrame(rows, "id string, name string")
    met = symbols.token_overlap(s, F.expr("id in ('0', '7')"))
    tokens = defaultdict(Counter)
    for i, name in rows:
        if i is not None and name is not None:
            tokens[i].update(set(re.findall("[a-z0-9]{2,}", re.sub("([a-z])([A-Z])", r"\1_\2", name).lower())))
    shared = lambda a, b: sum(n * tokens[b][w] for w, n in tokens[a].items())
    want = {(a, b, shared(a, b)) for a in ("0", "7") for b in tokens if a != b and shared(a, b)}
    assert {tuple(r) for r in met.collect()} == want and met.count() == len(want) == 2998


def test_token_overlap_deals_pairs_out(spark, monkeypatch):
    """Blocks of few bytes are many tasks, and the pairs of a whole block are not held at once: the two loops are compiled apart."""
    monkeypatch.setattr(symbols, "_BLOCK", 7)
    names = ["red ring", "Red_ring", "blue ring", "old red bolt", "?", "green nut"]
    s = spark.createDataFrame([(str(k), names[k % 6]) for k in range(240)], "id string, name string")
    met = symbols.token_overlap(s, F.expr("cast(id as int) % 4 < 3"))
    assert met.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    tokens = [set(re.findall("[a-z0-9]{2,}", n.lower())) for n in names]
    shared = lambda a, b: len(tokens[a % 6] & tokens[b % 6])
    want = {(str(a), str(b), shared(a, b)) for a in range(240) for b in range(240) if a % 4 < 3 and a != b and shared(a, b)}
    rows = met.collect()
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want
    plan = met._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    loops = re.findall(r"\*\((\d+)\) Generate explode\(([ab]_ids)", plan)
    assert sorted(ids for _, ids in loops) == ["a_ids", "b_ids"] and loops[0][0] != loops[1][0]


def test_relevance_by_label_is_counted(spark):
    """Judgments are of what is ranked, not of every vector of a query's label; recall is over all of these."""
    v = spark.createDataFrame([("main", str(k), [1.0, k / 100], k % 2 if k % 7 else None) for k in range(60)], "namespace string, id string, embedding array<double>, label int")
    q = v.where("cast(id as int) % 5 = 0").select(F.col("id").alias("query_id"), "namespace", "embedding", F.col("label").alias("q_label"))
    ranked = vectors.top_k(v, q, 4).cache()
    judged, total = vectors.judged_by_label(ranked, v, q)
    every = q.join(v.select("id", "label"), F.col("q_label") == F.col("label")).select("query_id", "id", F.lit(1).alias("relevance"))
    assert judged.count() <= 12 * 4 < every.count()
    assert sorted(vectors.recall_at_k(ranked, judged, 4, total).collect()) == sorted(vectors.recall_at_k(ranked, every, 4).collect())
    assert sorted(vectors.mrr_at_k(ranked, judged, 4).collect()) == sorted(vectors.mrr_at_k(ranked, every, 4).collect())


def test_best_of_groups_of_queries(spark, monkeypatch):
    """Small products, many batches and many equal vectors: what is kept is what a full sort keeps."""
    monkeypatch.setattr(vectors, "_CELLS", 15)
    monkeypatch.setattr(vectors, "_ROWS", 5)
    rng = np.random.default_rng(4)
    rows = [("ab"[k % 2], f"v{k}", rng.integers(1, 3, 3).astype(float).tolist()) for k in range(90)]
    v = spark.createDataFrame(rows, "namespace string, id string, embedding array<double>")
    met = vectors.top_k(v, v.where("id like '%0'").withColumnRenamed("id", "query_id"), 7).collect()
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in met}
    for n, i, e in rows:
        if i.endswith("0"):
            cos = lambda x: float(np.dot(e, x) / np.sqrt(np.dot(e, e) * np.dot(x, x)))
            want = sorted(((-round(cos(x), 12), j) for m, j, x in rows if m == n))[:7]
            assert [got[i, k + 1][0] for k in range(7)] == [j for _, j in want]


def test_one_question_needs_no_generations(spark, monkeypatch):
    """What head reaches and base does not, followed from these two only; a round writes what it meets for the first time."""
    monkeypatch.setattr(history, "generations", lambda parents: pytest.fail("generations of all commits"))
    rng = np.random.default_rng(5)
    above = {k: sorted({int(x) for x in rng.integers(max(0, k - 6), k, 1 + k % 3)}) if k else [] for k in range(40)}
    df = spark.createDataFrame([(str(k), str(p)) for k, ps in above.items() for p in ps] + [("0", None)], "commit string, parent string")

    def reach(k):
        out, todo = set(), [k]
        while todo:
            if (x := todo.pop()) not in out:
                out.add(x)
                todo += above[x]
        return out

    for base, head in ((30, 39), (39, 30), (12, 12)):
        assert sorted(int(r[0]) for r in history.ahead(df, str(base), str(head)).collect()) == sorted(reach(head) - reach(base))
    with pytest.raises(ValueError, match="Commit not found: 99"):
        history.ahead(df, "3", "99")


def test_a_specifier_is_resolved_once(spark, monkeypatch):
    """Not once for every file that imports it; a relative one once for each folder."""
    calls = spark.sparkContext.accumulator(0)
    paths = [f"{'ab'[k % 2]}/f{k}.py" for k in range(200)]
    files = spark.createDataFrame([(p,) for p in [*paths, "pkg/m.py", "a/near.py", "b/near.py"]], "path string")
    found = spark.createDataFrame([(p, s, ["x"]) for p in paths for s in ("pkg/m", "./near", "none")], "source_file string, specifier string, names array<string>")
    plain = imports_graph.resolve_imports(found, files)
    assert {(r.source_file, r.specifier, r.resolved) for r in plain.collect()} == {x for p in paths for x in ((p, "pkg/m", "pkg/m.py"), (p, "./near", f"{p[0]}/near.py"), (p, "none", None))}
    assert [(r.file, r.specifier, r.has_importers) for r in imports_graph.importers(plain, "pkg/m.py", 3).collect()] == [(p, "pkg/m", False) for p in sorted(paths)[:3]]

    @F.udf("array<string>")
    def asked(specifier):
        calls.add(1)
        return [specifier]

    monkeypatch.setattr(imports_graph, "candidates", lambda: asked("specifier"))
    assert imports_graph.resolve_imports(found, files).count() == 600 and calls.value <= 20
