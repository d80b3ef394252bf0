"""Lexical search over lines, and fusion with semantic hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx


def matching_lines(lines: DataFrame, query: str, is_regex: bool = False, file_pattern: str = "") -> DataFrame:
    """path, line, text (clamped), score of every line that contains the query without regard to case. An empty query matches all.

    score: occurrences that do not overlap, at least 1. The path filter comes first, so that it prunes before texts are read."""
    if len(query.encode()) > 500:
        raise ValueError("the query is longer than 500 bytes")
    where: Column
    if is_regex:
        pattern = tx.user_regex(query)
        where, count = F.col("text").rlike(pattern), F.regexp_count("text", F.lit(pattern))
    else:
        where, count = F.contains(F.lower("text"), F.lit(query.lower())), tx.count_literal(F.col("text"), query)
    found = lines.where(tx.matches_path(F.col("path"), file_pattern)).where(where)
    return found.select("path", "line", tx.clamp_line(F.col("text")).alias("text"), F.greatest(count, F.lit(1)).cast("int").alias("score"))


def with_context(lines: DataFrame, hits: DataFrame, n: int) -> DataFrame:
    """hits with the clamped lines before and after each, n at most on either side, in order. Joined on path and line, so only
    files with a hit are looked at."""
    near = hits.select("path", "line", F.explode(F.sequence(F.col("line") - n, F.col("line") + n)).alias("at"))
    texts = lines.select(F.col("path").alias("_path"), F.col("line").alias("at"), tx.clamp_line(F.col("text")).alias("_text"))
    met = near.where("at <> line").join(texts, (near.path == texts._path) & (near["at"] == texts["at"])).select("path", "line", texts["at"].alias("at"), "_text")
    side = lambda keep: F.transform(F.filter(F.array_sort(F.collect_list(F.struct("at", "line", "_text"))), keep), lambda x: x["_text"])
    around = met.groupBy("path", "line").agg(side(lambda x: x["at"] < x["line"]).alias("before"), side(lambda x: x["at"] > x["line"]).alias("after"))
    none = F.array().cast("array<string>")
    return hits.join(around, ["path", "line"], "left").withColumns({"before": F.coalesce("before", none), "after": F.coalesce("after", none)})


def first_lines(hits: DataFrame, most: int = 20) -> DataFrame:
    """The first `most` hits in file order, with truncated: whether the limit was reached."""
    top = hits.orderBy("path", "line").limit(max(1, min(most, 100)))
    return top.withColumn("truncated", F.count("*").over(W.partitionBy(F.lit(0))) >= most)  # at most 100 rows


def by_file(hits: DataFrame) -> DataFrame:
    """Hits of each file: how many, the first line, all lines in order."""
    return hits.groupBy("path").agg(F.count("*").alias("match_count"), F.min("line").alias("first_line"), F.sum("score").alias("score"))


def hybrid_weights(lexical: float | None, semantic: float | None, default: tuple[float, float] = (0.5, 0.5)) -> tuple[float, float]:
    """Overrides below zero are ignored; two zeros mean halves; the sum is 1."""
    w_l = default[0] if lexical is None or lexical < 0 else lexical
    w_s = default[1] if semantic is None or semantic < 0 else semantic
    return (0.5, 0.5) if w_l + w_s == 0 else (w_l / (w_l + w_s), w_s / (w_l + w_s))


def _unit(c: str) -> Column:
    """Scaled to 0..1 over the positive scores; 1 where all are equal; 0 where there is none."""
    own = F.when(F.col(c) > 0, F.col(c))
    low, high = (f(own).over(W.partitionBy(F.lit(0))) for f in (F.min, F.max))
    return F.when(own.isNull(), 0.0).when(high == low, 1.0).otherwise((own - low) / (high - low))


def fuse(lexical: DataFrame, semantic: DataFrame, weights: tuple[float, float], most: int = 20) -> DataFrame:
    """Lexical and semantic hits (path, line, text, score) by weighted sum of their scaled scores, best first.

    Both sides are already limited (250 lines or four times the wanted number; three times the wanted vectors), so one window over
    them is small."""
    side = lambda df, name: df.groupBy("path", "line").agg(F.max("score").cast("double").alias(name), F.min("text").alias(f"{name}_text"))
    met = side(lexical, "lexical").join(side(semantic, "semantic"), ["path", "line"], "full_outer")
    met = met.select("path", "line", F.coalesce("lexical_text", "semantic_text").alias("text"), _unit("lexical").alias("lexical_score"), _unit("semantic").alias("semantic_score"))
    met = met.withColumn("score", weights[0] * F.col("lexical_score") + weights[1] * F.col("semantic_score"))
    order = [F.desc("score")] + [F.desc(f"{n}_score") for n, w in zip(("lexical", "semantic"), weights) if w > 0] + [F.col("path"), F.col("line"), F.col("text")]
    return met.orderBy(*order).limit(most)
