"""Checks of evaluation data, and gates on measured figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_quantiles
from .telemetry import with_quantiles


def fixture_faults(docs: DataFrame, queries: DataFrame, judged: DataFrame) -> DataFrame:
    """fault, n of a test collection: blank or repeated documents (id, text), judgments of unknown queries or documents or outside 0 to 3,
    queries without a judgment. Zeros included."""
    bad = F.lit(False)
    for c in ("id", "text"):
        bad = bad | (F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "")
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("fault"), "n")
    parts = [
        one(docs.where(bad), "blank_document"), one(docs.groupBy("id").count().where("count > 1"), "repeated_document"),
        one(judged.join(docs.select(F.col("id")).distinct(), "id", "left_anti"), "unknown_document"), one(judged.join(queries.select("query_id").distinct(), "query_id", "left_anti"), "unknown_query"),
        one(judged.where("relevance is null or relevance not between 0 and 3"), "relevance_range"), one(queries.select("query_id").distinct().join(judged, "query_id", "left_anti"), "query_without_judgment"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def throughput(runs: DataFrame, *keys: str) -> DataFrame:
    """Items a second, mean, p50 and p95 of latency, and error rate of runs (items, ms, failed)."""
    sums = runs.groupBy(*keys).agg(F.round(F.sum("items") / (F.sum("ms") / 1000), 6).alias("items_per_s"), F.round(F.avg("ms"), 6).alias("mean_ms"), F.round(F.avg(F.col("failed").cast("int")), 6).alias("error_rate"))
    met = with_quantiles(sums, exact_quantiles(runs, "ms", [0.5, 0.95], *keys), *keys)
    return met.select(*keys, "items_per_s", "mean_ms", F.round("q0", 6).alias("p50_ms"), F.round("q1", 6).alias("p95_ms"), "error_rate")


def against_baseline(candidate: DataFrame, baseline: DataFrame, key: str, least_throughput: float = 1.10, most_p95: float = 1.25, most_error_delta: float = 0.0) -> DataFrame:
    """Ratios of a candidate's throughput() to a baseline's, and passed."""
    b = baseline.withColumnsRenamed({c: f"base_{c}" for c in baseline.columns if c != key})
    met = candidate.join(b, key).select(key, F.round(F.col("items_per_s") / F.col("base_items_per_s"), 6).alias("throughput_ratio"), F.round(F.col("p95_ms") / F.col("base_p95_ms"), 6).alias("p95_ratio"), F.round(F.col("error_rate") - F.col("base_error_rate"), 6).alias("error_delta"))
    return met.withColumn("passed", (F.col("throughput_ratio") >= least_throughput) & (F.col("p95_ratio") <= most_p95) & (F.col("error_delta") <= most_error_delta))


#: What runs can be selected by.
DIMENSIONS = ("run_id", "suite", "case_id", "repo", "model", "mode")


def combine_runs(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Runs by run_id: a new one replaces the stored one. A table has no order; runs_in_order gives it."""
    kept = stored.join(new.select("run_id"), "run_id", "left_anti")
    return kept.unionByName(new.select(*stored.columns))


def runs_in_order(runs: DataFrame, most: int | None = None, since: str | None = None, exclude_run_id: str = "", **wanted: str) -> DataFrame:
    """Runs in order of captured_at and run_id, those with the given values of DIMENSIONS (blank: any), captured at or after `since`, and but for one run; the
    newest `most` if given. Times are compared to the second."""
    own = runs
    if since is not None:
        own = own.where(F.unix_timestamp(F.col("captured_at").cast("timestamp")) >= F.unix_timestamp(F.lit(since).cast("timestamp")))
    if exclude_run_id.strip():
        own = own.where(F.col("run_id") != exclude_run_id.strip())
    for name, value in wanted.items():
        if name not in DIMENSIONS:
            raise ValueError(f"runs are not selected by {name}")
        if str(value).strip():
            own = own.where(F.col(name) == value)
    if most is not None:
        own = own.orderBy(F.desc("captured_at"), F.desc("run_id")).limit(most)
    return own.orderBy("captured_at", "run_id")


def mean_measures(recall: DataFrame, reciprocal_rank: DataFrame) -> DataFrame:
    """One row: query_count, mean_recall and mean_mrr over queries (query_id, recall; query_id, reciprocal_rank); zeros where there are none. A query
    that one of the tables lacks counts as 0 there."""
    met = recall.join(reciprocal_rank, "query_id", "full_outer")
    mean = lambda c: F.coalesce(F.avg(F.coalesce(c, F.lit(0.0))), F.lit(0.0))
    return met.agg(F.count("*").alias("query_count"), mean("recall").alias("mean_recall"), mean("reciprocal_rank").alias("mean_mrr"))


def tokens_of_bytes(size: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.ceil(size / 4).cast("long")


def token_savings(cases: DataFrame, files: DataFrame, payloads: DataFrame) -> DataFrame:
    """What answers save against reading whole files. cases (case_id, path): the files that a case would read; payloads (case_id, payload): the
    text of the answer. case_id, baseline_tokens, tool_tokens, tokens_saved, saved_ratio; files that do not exist count nothing."""
    size = files.select("path", tokens_of_bytes(F.octet_length("content")).alias("tokens"))
    base = cases.select("case_id", "path").distinct().join(size, "path").groupBy("case_id").agg(F.sum("tokens").alias("baseline_tokens"))
    tool = payloads.groupBy("case_id").agg(F.sum(tokens_of_bytes(F.octet_length("payload"))).alias("tool_tokens"))
    met = tool.join(base, "case_id", "left").withColumn("baseline_tokens", F.coalesce("baseline_tokens", F.lit(0)))
    saved = F.col("baseline_tokens") - F.col("tool_tokens")
    ratio = F.when(F.col("baseline_tokens") <= 0, 0.0).otherwise(F.round(saved / F.col("baseline_tokens"), 6))
    return met.select("case_id", "baseline_tokens", "tool_tokens", saved.alias("tokens_saved"), ratio.alias("saved_ratio"))


def run_trend(runs: DataFrame, current: DataFrame, competitors: list[str]) -> DataFrame:
    """competitor, captured_at, tokens_saved, cost_saved_usd, savings_pct: a point for each run and competitor, and one for the current report.

    runs and current: captured_at, tokens_saved, savings_pct and scores, a map from competitor to a struct (tokens_saved, cost_saved_usd, savings_pct). A run
    without a competitor's score counts with its own totals and no cost; the current report's share is that of the whole."""
    names = F.array(*map(F.lit, competitors)).cast("array<string>")
    point = lambda df: df.select("*", F.explode(names).alias("competitor")).withColumn("score", F.try_element_at("scores", F.col("competitor")))
    tokens = F.coalesce("score.tokens_saved", "tokens_saved").cast("long").alias("tokens_saved")
    cost = F.round(F.coalesce("score.cost_saved_usd", F.lit(0.0)), 6).alias("cost_saved_usd")
    past = point(runs).select("competitor", "captured_at", tokens, cost, F.round(F.when(F.col("score").isNotNull(), F.col("score.savings_pct")).otherwise(F.col("savings_pct")), 6).alias("savings_pct"))
    return past.unionByName(point(current).select("competitor", "captured_at", tokens, cost, F.round("savings_pct", 6).alias("savings_pct")))
