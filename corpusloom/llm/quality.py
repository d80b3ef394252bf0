"""Quality classifier: regularised quadratic discriminant analysis of text statistics.

Each class has a mean and a covariance that is shrunk towards the pooled one and towards a multiple of the identity. The score is the
log density difference of the two classes, from Mahalanobis distances under their Cholesky factors, put on the scale of
probabilities. Spark sums the moments of the labelled rows (a few rows reach the driver); the factors are made once and
the score is an expression of constants, so scoring is one pass with no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textstats
from ._columns import named
from ._store import Scratch

#: Statistics, and the standard deviation of measurement that is added to each class: rare values of a statistic that is
#: nearly always zero stay possible.
NOISE = {"length": 0.3, "word_length": 0.03, "symbols": 0.05, "dup_lines": 0.15, "repeats": 0.12, "capitals": 0.03, "distinct": 0.1, "marks": 0.02, "line_length": 0.3}
_X = list(NOISE)
_PAIRS = list(combinations_with_replacement(range(len(_X)), 2))


def statistics(docs: DataFrame, keep: list[Column], text: str = "text") -> DataFrame:
    """The columns `keep`, as _keep0, ..., and the classifier's statistics. A null text counts as empty; every row has a row, repeated ones equal
    ones; no other column is read."""
    return textstats.word_statistics(docs, keep, text).select(*[f"_keep{k}" for k in range(len(keep))], *[v.alias(k) for k, v in textstats.steady().items()])


@dataclass
class Model:
    """Class means, the inverses of their Cholesky factors, the constant of the log density difference, and its scale."""

    means: np.ndarray
    inverses: np.ndarray
    constant: float
    scale: float = 1.0
    shift: float = 0.0

    def logit(self) -> Column:
        """Of label 1, as an expression over the statistics."""
        sums = []
        for mean, inverse in zip(self.means, self.inverses):
            off = [F.col(x) - float(m) for x, m in zip(_X, mean)]
            parts = [sum((float(inverse[i, j]) * off[j] for j in range(i + 1)), F.lit(0.0)) for i in range(len(_X))]
            sums.append(sum((p * p for p in parts), F.lit(0.0)))
        return F.lit(self.scale) * (0.5 * (sums[0] - sums[1]) + F.lit(self.constant)) + F.lit(self.shift)


def fit(labelled: DataFrame, label: str, towards_pooled: float = 0.1, towards_identity: float = 0.02) -> Model | None:
    """labelled: statistics and a label 0 or 1. None if there are fewer than two rows of either class."""
    one = labelled.where(F.col(label).isin(0, 1))
    sums = one.groupBy(label).agg(F.count("*").alias("n"), *[F.avg(x).alias(x) for x in _X], *[F.avg(F.col(_X[i]) * F.col(_X[j])).alias(f"c{i}_{j}") for i, j in _PAIRS])
    by = {r[label]: r for r in sums.collect()}  # two rows
    if len(by) < 2 or min(r.n for r in by.values()) < 2:
        return None
    n = np.array([by[k].n for k in (0, 1)], float)
    means = np.array([[by[k][x] for x in _X] for k in (0, 1)])
    own = np.zeros((2, len(_X), len(_X)))
    for k in (0, 1):
        for i, j in _PAIRS:
            own[k, i, j] = own[k, j, i] = by[k][f"c{i}_{j}"] - means[k, i] * means[k, j]
    pooled = np.tensordot(n / n.sum(), own, 1)
    noise = np.diag(np.square(list(NOISE.values())))
    scale = np.sqrt(np.diag(pooled + noise))
    inverses, log_dets = [], []
    for k in (0, 1):
        cov = (1 - towards_pooled) * own[k] + towards_pooled * pooled + noise
        unit = cov / np.outer(scale, scale)
        unit = (1 - towards_identity) * unit + towards_identity * np.trace(unit) / len(_X) * np.eye(len(_X))
        low = np.linalg.cholesky(unit * np.outer(scale, scale))
        inverses.append(np.linalg.inv(low))
        log_dets.append(2 * np.log(np.diag(low)).sum())
    constant = 0.5 * (log_dets[0] - log_dets[1]) + np.log(n[1] / n[0])
    return Model(means, np.array(inverses), float(constant))


def calibrate(model: Model, labelled: DataFrame, label: str, cuts: int = 200) -> Model:
    """Fit scale and shift of the logit to the labels, from counts in bins of the logit."""
    bin_ = F.round(F.greatest(F.least(model.logit(), F.lit(20.0)), F.lit(-20.0)) * (cuts / 40))
    rows = labelled.where(F.col(label).isin(0, 1)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.sum(label).alias("ones")).collect()  # cuts + 1 rows at most
    x = np.array([r.bin for r in rows]) * (40 / cuts)
    n, y = np.array([r.n for r in rows], float), np.array([r.ones for r in rows], float)
    w = np.array([0.5, 0.0])
    for _ in range(50):  # Newton's method, with a weak pull to the start
        p = 1 / (1 + np.exp(-np.clip(w[0] * x + w[1], -30, 30)))
        g = np.array([((n * p - y) * x).sum(), (n * p - y).sum()]) + 0.5 * (w - [0.5, 0])
        v = n * p * (1 - p)
        w = w - np.linalg.solve(np.array([[(v * x * x).sum(), (v * x).sum()], [(v * x).sum(), v.sum()]]) + 0.5 * np.eye(2), g)
        w[0] = max(w[0], 0.01)
    return Model(model.means, model.inverses, model.constant, float(w[0]), float(w[1]))


def train(stats: DataFrame, labels: DataFrame, doc_id: str = "_keep0", label_id: str = "doc_id", label: str = "quality") -> Model | None:
    """Fit and calibrate on all rows of statistics whose id has a label. Only numbers and ids are joined, never texts. Rows without a
    label, or with another than 0 and 1, are left out. Repeated ids count each; labels has one row for each id."""
    known = labels.select(named(label_id).alias("_id"), named(label).cast("int").alias("label")).where("label in (0, 1)")
    rows = Scratch(stats.sparkSession, "quality").save(stats.join(known, named(doc_id) == F.col("_id")).select("label", *_X), "labelled")
    model = fit(rows, "label")
    return model and calibrate(model, rows, "label")


def logistic(model: Model | None) -> Column:
    """The probability of label 1, as an expression over the statistics; 0.5 with no model."""
    logit = F.lit(0.0) if model is None else F.greatest(F.least(model.logit(), F.lit(30.0)), F.lit(-30.0))
    return 1 / (1 + F.exp(-logit))


def score(docs: DataFrame, model: Model | None, keep: list[Column], text: str = "text") -> DataFrame:
    """The columns `keep`, as _keep0, ..., and score: the probability of label 1. A null text counts as empty. With no model all score 0.5."""
    stats = statistics(docs, keep, text)
    # as the output of a generator, so that a filter on the score stays above it: pushed below the projections, it would turn every
    # use of a column in them into a copy of that column's whole expression
    kept = [f"_keep{k}" for k in range(len(keep))]
    return stats.select(*kept, logistic(model).alias("_score")).select(*kept, F.explode(F.array("_score")).alias("score"))
