"""Vectors: validation, exact cosine search, upsert and delete, and the measures of retrieval."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx


def _double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def valid(v: Column) -> Column:
    """Not empty, all finite, not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & finite & (norm(v) > 0)


def cosine(a: Column, b: Column) -> Column:
    """Clamped to -1..1; an error for a zero norm or unequal sizes."""
    score = dot(a, b) / (norm(a) * norm(b))
    checked = F.when((F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0), score).otherwise(F.raise_error(F.lit("vectors of zero norm or unequal sizes")).cast("double"))
    return F.least(F.greatest(checked, F.lit(-1.0)), F.lit(1.0))


def _checked(v: Column) -> Column:
    """The vector; an error if it is empty, not finite or of zero norm."""
    return F.when(valid(v), v).otherwise(F.raise_error(F.lit("a vector is empty, not finite or of zero norm")).cast("array<double>"))


#: Bytes of queries that are sent to every task at most, scores that a task holds at once, and vectors that they are of.
MOST_QUERY_BYTES, _CELLS, _ROWS = 64 << 20, 2 << 20, 8192


def matrix(column, what: str = "vector") -> np.ndarray:
    """The vectors of an Arrow column as rows; an error if one is null, empty, not finite, of zero norm, or of another size than the others."""
    ends = column.value_lengths().to_numpy(zero_copy_only=False) if len(column) else np.zeros(0)
    if column.null_count or (len(ends) and not ends.min()):
        raise ValueError(f"a {what} is empty, not finite or of zero norm")
    if len(ends) and (ends != ends[0]).any():
        raise ValueError("vectors of unequal sizes")
    out = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    if not (np.isfinite(out).all() and out.any(1).all()):
        raise ValueError(f"a {what} is empty, not finite or of zero norm")
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class Best:
    """The k best (score, id) of each query so far; ties by id."""

    def __init__(self, k: int):
        self.k, self.query, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0), np.zeros(0, "U1")

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        q, s, i = np.concatenate([self.query, query]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((i, -s, q))
        q = q[order]
        first = np.concatenate([[True], q[1:] != q[:-1]]) if len(q) else np.zeros(0, bool)
        rank = np.arange(len(q)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        keep = rank < self.k
        self.query, self.score, self.id = q[keep], s[order][keep], i[order][keep]

    def least(self, n: int) -> np.ndarray:
        """The last score that each of the queries 0 to n has; minus infinity, if it has fewer than k."""
        out = np.full(n, -np.inf)
        full = np.flatnonzero(np.bincount(self.query, minlength=n) == self.k)
        out[full] = self.score[np.searchsorted(self.query, full, "right") - 1]
        return out


def near(q: np.ndarray, v: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of q, row of v) that hold the k best of v for each of q, with all that tie with the last. Both are of unit length. least: a score for each
    of q below which nothing is wanted; where all have one, that is what decides."""
    score = q @ v.T
    if least is not None and np.isfinite(least).all():
        return np.nonzero(score >= least[:, None] - 1e-9)
    if v.shape[0] > k:
        last = np.partition(score, v.shape[0] - k, axis=1)[:, -k]
        return np.nonzero(score >= last[:, None] - 1e-9)
    return np.nonzero(np.ones(score.shape, bool))


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, score, rank of the k nearest of each query in its namespace; ties by id. Vectors that are not valid, and queries of another
    size than the vectors, are errors.

    queries (query_id, namespace, embedding) is a stated set: it is collected in blocks of bounded bytes, and each block goes once over all vectors. Scores are
    products of matrices; a task keeps k rows for each query, whose scores it computes again by one and the same sum, so that equal vectors tie
    exactly and products rounded in another order cannot decide. What is kept is sorted by small groups of queries, and a vector enters only where it is no
    worse than the last; vectors are dealt out evenly, however few files they are in."""
    spark = vectors.sparkSession
    q = queries.select("query_id", F.col("namespace").cast("string").alias("namespace"), "embedding")
    size = q.agg(F.sum(F.coalesce(F.size("embedding"), F.lit(0)) * 8 + 64)).first()[0] or 0
    parts = max(1, -(-size // MOST_QUERY_BYTES))
    v = vectors.select(F.col("namespace").cast("string").alias("namespace"), F.col("id").cast("string").alias("id"), "embedding")
    v = v.repartition(2 * spark.sparkContext.defaultParallelism)
    kind = queries.schema["query_id"].dataType
    out, group, most = None, max(1, _CELLS // _ROWS), _ROWS
    for p in range(parts):
        own = (q if parts == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p)).toArrow().combine_chunks()
        spaces = own["namespace"].to_pylist()
        by_space = {n: np.array([j for j, x in enumerate(spaces) if x == n], np.int64) for n in set(spaces)}
        asked = {n: (at, unit(matrix(own["embedding"].take(at).combine_chunks()))) for n, at in by_space.items()}
        sent = spark.sparkContext.broadcast(asked)

        def run(batches, sent=sent):
            best: dict = {}
            for b in batches:
                names = np.array(b.column(0).to_pylist(), object)
                for n, (at, m) in sent.value.items():
                    rows = np.flatnonzero(names == n)
                    for r in range(0, len(rows), most):
                        x = matrix(b.column(2).take(rows[r : r + most]))
                        if x.shape[1] != m.shape[1]:
                            raise ValueError("vectors of unequal sizes")
                        x, ids = unit(x), np.array(b.column(1).take(rows[r : r + most]).to_pylist())
                        for a in range(0, len(m), group):
                            own, q = best.setdefault((n, a), Best(k)), m[a : a + group]
                            i, j = near(q, x, k, own.least(len(q)))
                            if len(i):
                                own.add(i, np.clip(np.einsum("ij,ij->i", q[i], x[j]), -1, 1), ids[j])
            for (n, a), own in best.items():
                at = sent.value[n][0][a : a + group]
                yield pa.RecordBatch.from_arrays([pa.array(at[own.query]), pa.array(own.id.tolist(), pa.string()), pa.array(own.score)], ["at", "id", "score"])

        names = spark.createDataFrame(own.select(["query_id"]).append_column("at", pa.array(np.arange(len(own)))))
        found = v.mapInArrow(run, "at long, id string, score double")
        rank = F.row_number().over(W.partitionBy("at").orderBy(F.desc("score"), "id"))
        best = found.withColumn("rank", rank).where(F.col("rank") <= k).join(F.broadcast(names), "at").select(F.col("query_id").cast(kind).alias("query_id"), "id", "score", "rank")
        out = best if out is None else out.unionByName(best)
    return out


def upsert(vectors: DataFrame, rows: DataFrame) -> DataFrame:
    """rows replace those of the same namespace and id; of equal ones in rows the last by seq stays."""
    last = rows.groupBy("namespace", "id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("namespace", "id", "seq")]), "seq").alias("r")).select("namespace", "id", "r.*")
    kept = vectors.join(last.select("namespace", "id"), ["namespace", "id"], "left_anti")
    return kept.unionByName(last.select(*vectors.columns))


def delete(vectors: DataFrame, namespace: str, ids: list[str] | None) -> tuple[DataFrame, int]:
    """(what is left, how many went). ids are trimmed, blanks dropped; None deletes the namespace."""
    gone = F.col("namespace") == namespace
    if ids is not None:
        gone = gone & F.col("id").isin(*sorted({i.strip() for i in ids if i.strip()}) or [""])
    return vectors.where(~gone), vectors.where(gone).count()


def hashed_embedding(text: Column, dimensions: int = 64, bucket: Callable[[Column], Column] | None = None) -> Column:
    """A deterministic embedding without a model: how often the text's tokens fall in each bucket of their hashes; a text without a token has
    the first bucket. bucket: from a token to a number."""
    bucket = bucket or F.xxhash64
    own = F.transform(tx.tokenize(text), lambda x: F.pmod(bucket(x), F.lit(dimensions)).cast("int"))
    own = F.when(F.size(own) > 0, own).otherwise(F.array(F.lit(0)))

    @F.pandas_udf("array<double>")
    def counts(buckets: pd.Series) -> pd.Series:
        return buckets.map(lambda b: np.bincount(b, minlength=dimensions).astype(float))

    return counts(own)


def embed_chunks(chunks: DataFrame, namespace: str, embed: Callable[[Column], Column] = hashed_embedding) -> DataFrame:
    """Vector rows (namespace, id, embedding, path, start_line, end_line, chunk_text) of chunks. embed: an expression, or a pandas UDF around a model;
    it sees all texts of a batch at once. A vector that is not valid is an error."""
    return chunks.select(F.lit(namespace).alias("namespace"), F.col("chunk_id").alias("id"), _checked(embed(F.col("chunk_text"))).alias("embedding"), "path", "start_line", "end_line", "chunk_text")


def sync_chunks(stored: DataFrame, chunks: DataFrame, touched: DataFrame, namespace: str, embed: Callable[[Column], Column] = hashed_embedding) -> DataFrame:
    """stored vector rows after files have changed. touched (path): files that are new, changed or deleted; chunks: those of touched files as they are
    now. Of touched files only chunks that are not stored yet are embedded, and stored ones that are gone go; other files and namespaces stay."""
    own = stored.where(F.col("namespace") == namespace)
    now = chunks.join(touched.select("path").distinct(), "path", "left_semi")
    gone = own.join(touched.select("path").distinct(), "path", "left_semi").join(now.select("path", F.col("chunk_id").alias("id")), ["path", "id"], "left_anti")
    kept = stored.join(gone.select("namespace", "path", "id"), ["namespace", "path", "id"], "left_anti").select(*stored.columns)
    new = now.join(own.select("path", F.col("id").alias("chunk_id")), ["path", "chunk_id"], "left_anti")
    return kept.unionByName(embed_chunks(new, namespace, embed).select(*stored.columns))


def judged_by_label(ranked: DataFrame, vectors: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What recall_at_k and mrr_at_k need where the vectors (id, label) of a query's label (query_id, q_label) are relevant to it: judgments of what is ranked,
    and how many are relevant in all (query_id, total). A label's vectors are counted, never paired with its queries."""
    own, labels = vectors.select("id", "label").distinct(), queries.select("query_id", "q_label").distinct()
    met = ranked.select("query_id", "id").distinct().join(labels, "query_id").join(own, "id").where("label = q_label")
    total = labels.join(own.groupBy(F.col("label").alias("q_label")).agg(F.count("*").alias("total")), "q_label").groupBy("query_id").agg(F.sum("total").alias("total"))
    return met.select("query_id", "id", F.lit(1).alias("relevance")), total


def recall_at_k(ranked: DataFrame, judged: DataFrame, k: int, total: DataFrame | None = None) -> DataFrame:
    """query_id, recall: distinct relevant ids in the first k over all relevant ones (relevance above 0). total (query_id, total): how many there are, where
    judged has only those that are ranked."""
    relevant = judged.where("relevance > 0").select("query_id", "id").distinct()
    total = relevant.groupBy("query_id").agg(F.count("*").alias("total")) if total is None else total
    found = ranked.where(F.col("rank") <= k).select("query_id", "id").distinct().join(relevant, ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("found"))
    asked = ranked.select("query_id").unionByName(judged.select("query_id")).unionByName(total.select("query_id")).distinct()
    return asked.join(total, "query_id", "left").join(found, "query_id", "left").select("query_id", F.coalesce(F.coalesce("found", F.lit(0)) / F.col("total"), F.lit(0.0)).alias("recall"))


def mrr_at_k(ranked: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """query_id, reciprocal_rank of the first relevant id within k, else 0."""
    relevant = judged.where("relevance > 0").select("query_id", "id").distinct()
    first = ranked.where(F.col("rank") <= k).join(relevant, ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("r"))
    return ranked.select("query_id").distinct().join(first, "query_id", "left").select("query_id", F.coalesce(1.0 / F.col("r"), F.lit(0.0)).alias("reciprocal_rank"))


def gate(metrics: DataFrame, min_recall: float = 0.70, min_mrr: float = 0.70, max_p50: float = 5000.0, max_p95: float = 5000.0) -> DataFrame:
    """Rows of recall, mrr, p50_ms, p95_ms with passed."""
    return metrics.withColumn("passed", (F.col("recall") >= min_recall) & (F.col("mrr") >= min_mrr) & (F.col("p50_ms") <= max_p50) & (F.col("p95_ms") <= max_p95))
