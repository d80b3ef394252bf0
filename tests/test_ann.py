"""Exact and approximate search against plain versions."""

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from corpusloom.operators import ann, vectors
from corpusloom.plans import registry

_KIND = "namespace string, id string, embedding array<float>"


def frame(spark, x, namespace="n", first=0):
    return spark.createDataFrame([(namespace, str(first + k), [float(c) for c in v]) for k, v in enumerate(x)], _KIND).repartition(3)


def asked(df, every=20):
    return df.where(f"cast(id as int) % {every} = 0").select(F.col("id").alias("query_id"), "namespace", "embedding")


def plain(x, q, k):
    u = np.float32(x).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    ids = [str(i) for i in range(len(x))]
    return {str(i): sorted(ids, key=lambda j: (-round(float(u[i] @ u[int(j)]), 12), j))[:k] for i in q}


def listed(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.id)
    return out


def test_exact_search(spark, monkeypatch):
    """Equal vectors tie by id in every task, whatever the order of sums; two namespaces; blocks of queries."""
    x = np.random.default_rng(1).normal(size=(200, 33))
    x[50:130] = x[50]
    df = frame(spark, x).unionByName(frame(spark, x[:5], "other", 1000))
    want = plain(x, range(0, 200, 20), 7)
    assert listed(vectors.top_k(df, asked(df).where("namespace = 'n'"), 7)) == want
    monkeypatch.setattr(vectors, "MOST_QUERY_BYTES", 700)
    monkeypatch.setattr(vectors, "_CELLS", 300)
    got = listed(vectors.top_k(df, asked(df), 7))
    assert {q: own for q, own in got.items() if q != "1000"} == want and len(got["1000"]) == 5
    for bad in ([0.0, 0.0], [1.0, float("nan")], [], None, [1.0, None], [1.0, 2.0, 3.0]):
        rows = spark.createDataFrame([("n", "1", [1.0, 2.0]), ("n", "2", bad)], _KIND)
        with pytest.raises((PythonException, ValueError)):
            vectors.top_k(rows, asked(rows, 1).where("query_id = '1'"), 1).collect()
    assert vectors.top_k(df, asked(df).limit(0), 3).count() == 0 and vectors.top_k(df.limit(0), asked(df), 3).count() == 0


def test_inverted_file(spark, tmp_path, monkeypatch):
    """Clustered vectors: few cells hold what is near; every row is indexed; the share of codes and of exact scores; the exact way agrees."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 32))[rng.integers(0, 40, 4000)] + 0.25 * rng.normal(size=(4000, 32))
    x[100:200] = x[100]  # a crowded point
    df = frame(spark, x)
    index = ann.build(df, str(tmp_path / "i"), cells=64)
    assert index.rows().count() == index.sizes.sum() == 4000 and index.rows().select("id").distinct().count() == 4000
    q = asked(df)
    probes = ann.tune(index, df, q, 10)
    u = x[::20] / np.linalg.norm(x[::20], axis=1, keepdims=True)
    assert index.share(u, probes) < 0.25
    want = plain(x, range(0, 4000, 20), 10)
    got = listed(ann.search(ann.load(spark, str(tmp_path / "i")), q, 10, probes))
    recall = np.mean([len(set(got[i]) & set(want[i])) / 10 for i in want])
    assert recall >= 0.9
    full = ann.search(index, q, 10, 64)
    assert np.mean([len(set(own) & set(want[i])) / 10 for i, own in listed(full).items()]) >= 0.99
    exact = {(r.query_id, r.id): r.score for r in vectors.top_k(df, q, 10).collect()}
    assert all(exact[r.query_id, r.id] == pytest.approx(r.score, abs=1e-12) for r in full.collect() if (r.query_id, r.id) in exact)
    plan = index.rows().where(F.col("cell").isin(1, 2))._jdf.queryExecution().toString()
    assert "PushedFilters: [In(cell" in plan
    assert ann.search(ann.build(df.limit(0), str(tmp_path / "e")), q, 10, 3).count() == 0 and ann.search(index, q.limit(0), 10, 3).count() == 0


def test_recall_of_the_query(spark):
    """Every id divisible by 20 against all rows of the given table, which has no clusters at all."""
    sf = "/root/testdata/sf0.01"
    got, want = listed(registry.QUERIES["ann_topk"](spark, sf)), listed(registry._ranked(spark, sf)[0])
    assert set(got) == set(want) and np.mean([len(set(got[q]) & set(want[q])) / 10 for q in want]) >= 0.9
