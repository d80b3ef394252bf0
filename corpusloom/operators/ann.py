"""Approximate nearest neighbours: an inverted file over cells, eight-bit codes, and exact scores for what the codes let through.

Centroids are fitted by spherical k-means on a bounded sample; every vector is then assigned to its nearest one and stored with its cell and its code (a unit vector in
whole numbers up to 127). A search reads only the cells that some query probes, scores their codes, and computes exact cosines for the few that may be
among the k best. `tune` finds how many cells to probe for a wanted recall against exact search (vectors.top_k, which stays the exact way).
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import vectors as exact

#: Vectors that centroids are fitted on at most (those whose ids have the smallest hashes), and rounds of k-means.
SAMPLE, ROUNDS = 20_000, 12
#: Candidates by code for each wanted neighbour.
RERANK = 4
#: Queries that `tune` measures with, at most.
TUNING = 200
_SCHEMA = "namespace string, id string, cell int, code binary, embedding array<double>"


def _kmeans(x: np.ndarray, cells: int) -> np.ndarray:
    """Unit centroids of unit vectors. A cell that loses all its vectors takes the one that is farthest from its centroid."""
    c = x[np.random.default_rng(5).choice(len(x), cells, replace=False)].copy()
    for _ in range(ROUNDS):
        score = x @ c.T
        own, far = score.argmax(1), score.max(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        length = np.sqrt((sums * sums).sum(1))
        empty = np.flatnonzero(length < 1e-12)
        c = sums / np.maximum(length, 1e-12)[:, None]
        c[empty] = x[np.argsort(far, kind="stable")[: len(empty)]]
    return c


@dataclass(frozen=True)
class Index:
    """path: Parquet sorted by cell, so that a reader skips what it does not probe. sizes: vectors by cell."""

    spark: SparkSession
    path: str
    centroids: np.ndarray
    sizes: np.ndarray

    def rows(self) -> DataFrame:
        return self.spark.read.schema(_SCHEMA).parquet(f"{self.path}/cells")

    def order(self, q: np.ndarray) -> np.ndarray:
        """Cells of each unit query, the nearest first."""
        return np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")

    def share(self, q: np.ndarray, probes: int) -> float:
        """The share of all vectors whose codes are scored for a query, on average."""
        return float(self.sizes[self.order(q)[:, :probes]].sum(1).mean() / max(1, self.sizes.sum()))


def build(vectors: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE) -> Index:
    """An index of vectors (namespace, id, embedding) at a path. cells: by default about four for each square root of the sample. Every row is
    indexed, equal ones and repeated ids too; vectors that are not valid are errors. An empty table has an index without cells."""
    spark = vectors.sparkSession
    v = vectors.select(F.col("namespace").cast("string").alias("namespace"), F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    own = v.orderBy(F.xxhash64("namespace", "id"), "namespace", "id").limit(sample).select("embedding").toArrow().combine_chunks()["embedding"].combine_chunks()
    if not len(own):
        spark.createDataFrame([], _SCHEMA).write.parquet(f"{path}/cells")
        return Index(spark, path, np.zeros((0, 0)), np.zeros(0, np.int64))
    x = np.unique(exact.unit(exact.matrix(own)), axis=0)
    c = _kmeans(x, min(len(x), cells or max(1, int(4 * len(x) ** 0.5))))

    def run(batches):
        for b in batches:
            u = exact.unit(exact.matrix(b.column(2)))
            if u.shape[1] != c.shape[1]:
                raise ValueError("vectors of unequal sizes")
            code = np.rint(127 * u / np.abs(u).max(1)[:, None]).astype(np.int8)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((u @ c.T).argmax(1).astype(np.int32)), pa.array([r.tobytes() for r in code], pa.binary()), b.column(2)], ["namespace", "id", "cell", "code", "embedding"])

    # by ranges of cell and id: a cell of very many vectors is in several files
    v.mapInArrow(run, _SCHEMA).repartitionByRange("cell", F.xxhash64("id")).sortWithinPartitions("cell").write.option("parquet.block.size", 16 << 20).parquet(f"{path}/cells")
    sizes = np.zeros(len(c), np.int64)
    for r in spark.read.parquet(f"{path}/cells").groupBy("cell").count().collect():  # one row a cell
        sizes[r.cell] = r["count"]
    spark.createDataFrame([(json.dumps(c.tolist()), sizes.tolist())], "centroids string, sizes array<long>").coalesce(1).write.parquet(f"{path}/centroids")
    return Index(spark, path, c, sizes)


def load(spark: SparkSession, path: str) -> Index:
    r = spark.read.parquet(f"{path}/centroids").first()
    return Index(spark, path, np.array(json.loads(r.centroids)), np.array(r.sizes))


def _collected(queries: DataFrame) -> tuple[pa.Table, np.ndarray]:
    own = queries.select("query_id", F.col("namespace").cast("string").alias("namespace"), F.col("embedding").cast("array<double>").alias("embedding")).toArrow().combine_chunks()
    if own.nbytes > exact.MOST_QUERY_BYTES:
        raise ValueError(f"queries of more than {exact.MOST_QUERY_BYTES} bytes: ask in blocks")
    return own, exact.unit(exact.matrix(own["embedding"].combine_chunks())) if len(own) else np.zeros((0, 0))


def search(index: Index, queries: DataFrame, k: int, probes: int, rerank: int = RERANK) -> DataFrame:
    """query_id, id, score, rank as in vectors.top_k, of vectors in the `probes` nearest cells of each query. Scores are exact cosines; with probes for all
    cells only the codes can hide a neighbour.

    Queries are a stated set, sent to every task with the cells that they probe. A task keeps k rows for each query."""
    spark = index.spark
    own, q = _collected(queries)
    kind = queries.schema["query_id"].dataType
    empty = spark.createDataFrame([], "id string, score double, rank int").withColumn("query_id", F.lit(None).cast(kind)).select("query_id", "id", "score", "rank")
    if not len(own) or not len(index.centroids):
        return empty
    if q.shape[1] != index.centroids.shape[1]:
        raise ValueError("vectors of unequal sizes")
    order = index.order(q)[:, :probes]
    spaces = np.array(own["namespace"].to_pylist(), object)
    asked = {}
    flat = order.ravel()
    by = np.argsort(flat, kind="stable")
    for cell, at in zip(*(lambda u: (u[0], np.split(by, u[1][1:])))(np.unique(flat[by], return_index=True)), strict=True):
        asked[int(cell)] = at // order.shape[1]
    sent = spark.sparkContext.broadcast((asked, q, spaces))

    def run(batches):
        asked, q, spaces = sent.value
        best, rough = exact.Best(k), np.full(len(q), -np.inf)  # rough: the last of the best by code so far, for each query
        q32 = q.astype(np.float32)
        for b in batches:
            cell = b.column(2).to_numpy(zero_copy_only=False)
            names = np.array(b.column(0).to_pylist(), object)
            ids = np.array(b.column(1).to_pylist())
            code = np.frombuffer(b"".join(b.column(3).to_pylist()), np.int8).reshape(len(b), -1).astype(np.float32)
            code /= np.sqrt(np.einsum("ij,ij->i", code, code))[:, None]
            for c in np.unique(cell):
                for name in set(names[cell == c]):
                    rows = np.flatnonzero((cell == c) & (names == name))
                    at = asked[int(c)][spaces[asked[int(c)]] == name]
                    step = max(1, (1 << 20) // len(rows))
                    for a in range(0, len(at), step):
                        part = at[a : a + step]
                        score = q32[part] @ code[rows].T
                        few = min(k * rerank, len(rows))
                        last = np.partition(score, len(rows) - few, axis=1)[:, -few]
                        full = few == k * rerank
                        if full:
                            rough[part] = np.maximum(rough[part], last)
                        i, j = np.nonzero(score >= np.where(full, np.maximum(last, rough[part]), rough[part])[:, None] - 1e-6)
                        if len(i):
                            x = exact.unit(exact.matrix(b.column(4).take(rows[np.unique(j)])))
                            j2 = np.searchsorted(np.unique(j), j)
                            best.add(part[i], np.clip(np.einsum("ij,ij->i", q[part[i]], x[j2]), -1, 1), ids[rows[j]])
        yield pa.RecordBatch.from_arrays([pa.array(best.query), pa.array(best.id.tolist(), pa.string()), pa.array(best.score)], ["at", "id", "score"])

    names = spark.createDataFrame(own.select(["query_id"]).append_column("at", pa.array(np.arange(len(own)))))
    found = index.rows().where(F.col("cell").isin(*asked)).mapInArrow(run, "at long, id string, score double")
    rank = F.row_number().over(W.partitionBy("at").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).join(F.broadcast(names), "at").select(F.col("query_id").cast(kind).alias("query_id"), "id", "score", "rank")


def tune(index: Index, vectors: DataFrame, queries: DataFrame, k: int, recall: float = 0.95) -> int:
    """The smallest number of probes with which the true k nearest of the queries are in probed cells so often, measured by exact search for at most
    TUNING of them (those whose ids have the smallest hashes)."""
    some = queries.select("query_id", "namespace", "embedding").orderBy(F.xxhash64("query_id"), "query_id").limit(TUNING)
    own, q = _collected(some)
    if not len(own) or not len(index.centroids):
        return 1
    place = np.empty((len(q), len(index.centroids)), np.int64)
    np.put_along_axis(place, index.order(q), np.arange(len(index.centroids))[None, :].repeat(len(q), 0), axis=1)
    at = {x: j for j, x in enumerate(own["query_id"].to_pylist())}
    spaces = own["namespace"].to_pylist()
    true = exact.top_k(vectors, some, k).select("query_id", "id")
    names = index.spark.createDataFrame([(x, n) for x, n in zip(at, spaces, strict=True)], some.select("query_id", F.col("namespace").cast("string").alias("namespace")).schema)
    cells = true.join(F.broadcast(names), "query_id").join(index.rows().select("namespace", "id", "cell"), ["namespace", "id"]).collect()  # k rows a query
    need = np.sort([place[at[r.query_id], r.cell] for r in cells])
    return int(need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)]) + 1 if len(need) else 1


def nearest(vectors: DataFrame, queries: DataFrame, k: int, path: str, recall: float = 0.95, cells: int | None = None) -> DataFrame:
    """Build, tune and search in one go."""
    index = build(vectors, path, cells)
    return search(index, queries, k, tune(index, vectors, queries, k, recall))
