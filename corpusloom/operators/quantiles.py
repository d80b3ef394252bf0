"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges of values that a group is cut into.
RANGES = 200


def _same(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return out


def exact_quantiles(rows: DataFrame, value: str, probabilities: list[float], *keys: str, ranges: int = RANGES) -> DataFrame:
    """keys and q0, q1, ...: quantiles of `value` with linear interpolation; nulls do not count, and a group of nulls has null quantiles.

    No task holds all values of a group: values are counted first, an approximate sketch cuts each group into ranges, the counts of ranges tell in
    which ones the wanted ranks lie, and only their values are ranked. However rough the sketch is, the result is exact."""
    own = list(keys)
    counts = rows.where(F.col(value).isNotNull()).groupBy(*own, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    edges = rows.groupBy(*own).agg(F.percentile_approx(F.col(value).cast("double"), F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), 2000).alias("edges"))
    edges = edges.select(*[F.col(k).alias(f"_{k}") for k in own], "edges")
    placed = counts.join(edges, _same(own)).withColumn("r", F.size(F.filter("edges", lambda e: e < F.col("v")))).select(*own, "r", "v", "n")
    before = W.partitionBy(*own).orderBy("r").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*own)
    sums = placed.groupBy(*own, "r").agg(F.sum("n").alias("size"))  # `ranges` rows a group at most
    sums = sums.withColumns({"skip": F.coalesce(F.sum("size").over(before), F.lit(0)), "total": F.sum("size").over(whole)})
    wanted = F.array(*[F.struct(F.lit(k).alias("_n"), (F.lit(float(p)) * (F.col("total") - 1)).alias("_at")) for k, p in enumerate(probabilities)])
    asked = sums.select(*own, "r", "size", "skip", F.explode(wanted).alias("w")).select(*own, "r", "size", "skip", "w.*")
    asked = asked.select(*own, "r", "size", "skip", "_n", "_at", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))).alias("rank"))
    asked = asked.where((F.col("rank") >= F.col("skip")) & (F.col("rank") < F.col("skip") + F.col("size")))
    asked = asked.select(*[F.col(k).alias(f"_{k}") for k in own], F.col("r").alias("_r"), "skip", "_n", "_at", "rank")
    near = placed.join(asked.select(*[f"_{k}" for k in own], "_r").distinct(), _same([*own, "r"]), "left_semi")
    upto = F.sum("n").over(W.partitionBy(*own, "r").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    ranked = near.withColumn("upto", upto)
    met = ranked.join(asked, _same([*own, "r"])).where((F.col("rank") < F.col("skip") + F.col("upto")) & (F.col("rank") >= F.col("skip") + F.col("upto") - F.col("n")))
    low, high = F.min("v"), F.max("v")
    by = met.groupBy(*own, "_n").agg((low + (high - low) * (F.first("_at") - F.floor(F.first("_at")))).alias("q"))
    return by.groupBy(*own).agg(*[F.max(F.when(F.col("_n") == k, F.col("q"))).alias(f"q{k}") for k in range(len(probabilities))])
