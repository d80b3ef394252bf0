"""Robust multivariate outliers of text statistics, by language and source.

For each group the minimum covariance determinant is approached from two deterministic starts by concentration steps:
distances under the present estimate, their quantile in the group, then mean and covariance of the rows below it. The start that ends
with the smaller determinant gives the estimate. It is scaled so that the median distance is that of a normal group, then refined
once from the rows that are not outlying. Small groups lean on their language, small languages on the whole.

Everything is DataFrame expressions. Texts are read once into a table of numbers; each step is one pass over that table with
map-side sums, so the size of a group does not matter.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textstats
from ._columns import named
from ._store import Scratch

#: Statistics and the standard deviation that each has at least: a group in which nothing ever has a symbol does not reject the first
#: text with one.
FLOORS = {"length": 0.4, "word_length": 0.06, "symbols": 0.06, "dup_lines": 0.15, "repeats": 0.15, "capitals": 0.05}

#: Quantiles of chi-square with 6 degrees of freedom: the median, 0.975 and 0.9999.
CHI2_MEDIAN, CHI2_REFINE, CHI2_REJECT = 5.348, 14.449, 27.856

_X = list(FLOORS)
_PAIRS = list(combinations_with_replacement(_X, 2))


def _m(a: str) -> Column:
    return F.col(f"m_{a}")


def _c(a: str, b: str) -> Column:
    return F.col(f"c_{a}_{b}" if _X.index(a) <= _X.index(b) else f"c_{b}_{a}")


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """n, means and covariances of the statistics in each group."""
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(a).alias(f"m_{a}") for a in _X], *[F.avg(F.col(a) * F.col(b)).alias(f"c_{a}_{b}") for a, b in _PAIRS])
    return sums.select(*keys, "n", *[_m(a) for a in _X], *[(_c(a, b) - _m(a) * _m(b)).alias(f"c_{a}_{b}") for a, b in _PAIRS])


def _precision(params: DataFrame, keep: list[str]) -> DataFrame:
    """The inverse covariance (p_a_b) and the log determinant, through the Cholesky factor; floors are added to the variances."""
    df = params.withColumns({f"c_{a}_{a}": F.greatest(_c(a, a), F.lit(0.0)) + F.lit(FLOORS[a] ** 2) for a in _X})
    low = lambda i, j: F.col(f"l_{i}_{j}")
    inv = lambda i, j: F.col(f"v_{i}_{j}")
    total = lambda xs: sum(xs, F.lit(0.0))
    size = range(len(_X))
    for j in size:
        df = df.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(_c(_X[j], _X[j]) - total(low(j, k) * low(j, k) for k in range(j)), F.lit(FLOORS[_X[j]] ** 2 / 4))))
        df = df.withColumns({f"l_{i}_{j}": (_c(_X[i], _X[j]) - total(low(i, k) * low(j, k) for k in range(j))) / low(j, j) for i in range(j + 1, len(_X))})
    for i in size:
        df = df.withColumns({f"v_{i}_{j}": (F.lit(1.0) / low(i, i) if i == j else -total(low(i, k) * inv(k, j) for k in range(j, i)) / low(i, i)) for j in range(i + 1)})
    own = {f"p_{a}_{b}": total(inv(k, _X.index(a)) * inv(k, _X.index(b)) for k in range(_X.index(b), len(_X))) for a, b in _PAIRS}
    return df.select(*keep, *[_m(a) for a in _X], *[v.alias(k) for k, v in own.items()], (2 * total(F.log(low(i, i)) for i in size)).alias("log_det"))


def _distance() -> Column:
    """Squared Mahalanobis distance of a row that carries its group's means and precision."""
    off = {a: F.col(a) - _m(a) for a in _X}
    return sum(((1 if a == b else 2) * F.col(f"p_{a}_{b}") * off[a] * off[b] for a, b in _PAIRS), F.lit(0.0))


def _meet(rows: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    params = params.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = rows[keys[0]].eqNullSafe(params[f"_{keys[0]}"])
    for k in keys[1:]:
        on = on & rows[k].eqNullSafe(params[f"_{k}"])
    return rows.join(params, on).drop(*[f"_{k}" for k in keys])


def _leaning(params: DataFrame, keys: list[str], weight: int) -> DataFrame:
    """Means and covariances drawn towards the level above, which counts as `weight` rows: first those of each value of the first key
    towards the overall ones, then those of two keys towards these, and so on."""
    values = [f"m_{a}" for a in _X] + [f"c_{a}_{b}" for a, b in _PAIRS]

    def level(own: list[str]) -> DataFrame:
        return params.groupBy(*own).agg(F.sum("n").alias("n"), *[(F.sum(F.col("n") * F.col(v)) / F.sum("n")).alias(v) for v in values])

    above = level([])
    for depth in range(1, len(keys) + 1):
        own = params.select(*keys, "n", *values) if depth == len(keys) else level(keys[:depth])
        upper = above.drop("n").withColumnsRenamed({v: f"u_{v}" for v in values})
        met = _meet(own, upper, keys[: depth - 1]) if depth > 1 else own.crossJoin(F.broadcast(upper))  # one row
        above = met.select(*keys[:depth], "n", *[((F.col("n") * F.col(v) + weight * F.col(f"u_{v}")) / (F.col("n") + weight)).alias(v) for v in values])
    return above


def estimates(rows: DataFrame, keys: list[str], scratch: Scratch, share: float = 0.75, steps: int = 3, weight: int = 20) -> DataFrame:
    """For each group of `keys`: means (m_*), inverse covariance (p_*) of the minimum covariance determinant estimate."""
    middle = rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.percentile_approx(a, 0.5, 1000).alias(f"m_{a}") for a in _X])
    spread = _meet(rows, middle.drop("n"), keys).groupBy(*keys).agg(*[F.percentile_approx(F.abs(F.col(a) - _m(a)), 0.5, 1000).alias(f"d_{a}") for a in _X])
    zero = F.lit(0.0)
    start = _meet(middle, spread, keys).select(*keys, "n", *[_m(a) for a in _X], *[(F.pow(1.4826 * F.col(f"d_{a}"), 2) if a == b else zero).alias(f"c_{a}_{b}") for a, b in _PAIRS])
    starts = start.withColumn("start", F.lit(0)).unionByName(_moments(rows, keys).withColumn("start", F.lit(1)))
    own = ["start", *keys]
    params = scratch.save(_precision(starts, own), "start")
    for k in range(steps):
        both = rows.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
        near = _meet(both, params, own).select(*own, *_X, _distance().alias("d2"))
        limit = scratch.save(near.groupBy(*own).agg(F.percentile_approx("d2", share, 1000).alias("limit")), f"limit{k}")
        kept = _meet(near, limit, own).where("d2 <= limit")
        found = scratch.save(_moments(kept, own), f"step{k}")
        params = _precision(found, [*own, "n"]) if k == steps - 1 else scratch.save(_precision(found, own), f"params{k}")
    least = params.groupBy(*keys).agg(F.min_by("start", F.struct("log_det", "start")).alias("start"))
    best = _leaning(_meet(found, least, own), keys, weight)
    params = scratch.save(_precision(best, keys), "best")
    scale = _meet(rows, params, keys).select(*keys, _distance().alias("d2")).groupBy(*keys).agg(F.greatest(F.percentile_approx("d2", 0.5, 1000) / CHI2_MEDIAN, F.lit(1.0)).alias("scale"))
    scale = scratch.save(scale, "scale")
    near = _meet(_meet(rows, params, keys).select(*keys, *_X, _distance().alias("d2")), scale, keys).where(F.col("d2") <= CHI2_REFINE * F.col("scale"))
    return scratch.save(_precision(_leaning(_moments(near, keys), keys, weight), keys), "estimates")


def reject_outliers(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", cutoff: float = CHI2_REJECT) -> DataFrame:
    """doc_id, the statistics of textstats, base_failed, distance (squared) and kept.

    A null or empty text fails the base rules. A null language or source is a group of its own; a group of which no row passes the
    base rules has a null distance and keeps nothing. Repeated rows and ties are treated alike. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "outliers")
    stats = textstats.word_statistics(docs, [named(doc_id), named(lang).cast("string"), named(source).cast("string")], text)
    stats = stats.withColumnsRenamed({"_keep0": "_doc", "_keep1": "_lang", "_keep2": "_source"}).withColumn("base_failed", textstats.base_failed())
    stats = scratch.save(stats.withColumns(textstats.vector()), "stats")
    keys = ["_lang", "_source"]
    params = estimates(stats.where("not base_failed").select(*keys, *_X), keys, scratch)
    renamed = params.withColumnsRenamed({k: f"{k}_" for k in keys})
    met = stats.join(renamed, stats._lang.eqNullSafe(renamed._lang_) & stats._source.eqNullSafe(renamed._source_), "left")
    out = met.withColumn("distance", _distance()).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(False)))
    return out.select(F.col("_doc").alias(doc_id), *textstats.COLUMNS, "base_failed", "distance", "kept")
