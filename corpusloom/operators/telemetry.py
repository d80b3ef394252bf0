"""Calls, rollups, trends, costs and benchmark deltas."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quantiles import exact_quantiles

#: USD for a million input and output tokens.
PRICING = {"claude_code": (3.00, 15.00), "codex": (1.50, 6.00), "amp": (1.50, 6.00)}

#: Look-back and step of each trend window, in seconds.
WINDOWS = {"last_24h": (86_400, 3_600), "last_7d": (604_800, 86_400), "last_30d": (2_592_000, 86_400)}

_COUNTS = ("request_tokens", "response_tokens", "total_tokens", "input_tokens_saved", "output_tokens_saved", "tokens_saved", "logical_calls")


def normalise_calls(calls: DataFrame) -> DataFrame:
    """Negatives become 0, a blank tool `unknown`, totals at least their parts, at least one logical call."""
    zero = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)) if c in calls.columns else F.lit(0)
    out = calls.withColumns({c: zero(c).cast("long") for c in _COUNTS} | {"duration_ms": F.greatest(F.coalesce("duration_ms", F.lit(0.0)), F.lit(0.0)), "tool_name": F.when(F.trim(F.coalesce("tool_name", F.lit(""))) == "", "unknown").otherwise(F.trim("tool_name"))})
    return out.withColumns({
        "total_tokens": F.greatest("total_tokens", F.col("request_tokens") + F.col("response_tokens")),
        "tokens_saved": F.greatest("tokens_saved", F.col("input_tokens_saved") + F.col("output_tokens_saved")),
        "logical_calls": F.greatest("logical_calls", F.lit(1)),
    })


def rollup(calls: DataFrame, *keys: str) -> DataFrame:
    """Sums, first and last call, for the given keys (none: one row)."""
    return calls.groupBy(*keys).agg(
        F.count("*").alias("call_count"), *[F.sum(c).alias(c) for c in _COUNTS], F.round(F.sum("duration_ms"), 6).alias("duration_ms"),
        F.min("captured_at").alias("first_call_at"), F.max("captured_at").alias("last_call_at"),
    )


def cost(inputs: Column, outputs: Column, price: tuple[float, float]) -> Column:
    return F.round((inputs * F.lit(float(price[0])) + outputs * F.lit(float(price[1]))) / 1e6, 12)


def competitor_costs(calls: DataFrame, *keys: str, pricing: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Cost avoided for each price list, from tokens summed first: one pass, rounded once."""
    sums = calls.groupBy(*keys).agg(F.sum("input_tokens_saved").alias("i"), F.sum("output_tokens_saved").alias("o"))
    rows = F.array(*[F.struct(F.lit(name).alias("competitor"), cost(F.col("i"), F.col("o"), price).alias("cost_avoided_usd")) for name, price in normal_pricing(pricing)[0].items()])
    return sums.select(*keys, F.col("i").alias("input_tokens_saved"), F.col("o").alias("output_tokens_saved"), F.explode(rows).alias("c")).select(*keys, "input_tokens_saved", "output_tokens_saved", "c.*")


def trend(calls: DataFrame, window: str, now: str) -> DataFrame:
    """Zero-filled buckets of a trend window that ends at `now`: bucket, call_count, total_tokens, tokens_saved. Events count from the
    window's start up to but without `now`; buckets are aligned to the epoch in UTC, so an unaligned window has one more."""
    span, step = WINDOWS[window]
    end = F.unix_timestamp(F.lit(now).cast("timestamp"))
    at = F.unix_seconds(F.col("captured_at").cast("timestamp"))
    own = calls.where((F.col("captured_at") >= (F.lit(now).cast("timestamp") - F.expr(f"interval {span} seconds")).cast(calls.schema["captured_at"].dataType)) & (F.col("captured_at") < F.lit(now).cast("timestamp").cast(calls.schema["captured_at"].dataType)))
    sums = own.groupBy((F.floor(at / step) * step).alias("b")).agg(F.count("*").alias("call_count"), F.sum("total_tokens").alias("total_tokens"), F.sum("tokens_saved").alias("tokens_saved"))
    spine = calls.sparkSession.range(1).select(F.explode(F.sequence((F.floor((end - span) / step) * step).cast("long"), end - 1, F.lit(step).cast("long"))).alias("b"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return spine.join(sums, "b", "left").select(F.timestamp_seconds("b").cast("timestamp_ntz").alias("bucket"), zero("call_count"), zero("total_tokens"), zero("tokens_saved"))


def trend_by_tool(calls: DataFrame, window: str, now: str) -> DataFrame:
    """The points of a trend window by tool: bucket, tool_name, sums of the calls there; only tools that were called have a row. calls as from
    normalise_calls; a batch counts its logical calls."""
    span, step = WINDOWS[window]
    limit, moment = F.lit(now).cast("timestamp"), F.col("captured_at").cast("timestamp")
    own = calls.where((moment >= limit - F.expr(f"interval {span} seconds")) & (moment < limit))
    bucket = F.timestamp_seconds((F.floor(F.unix_seconds(moment) / step) * step).cast("long")).cast("timestamp_ntz")
    sums = [F.sum("logical_calls").alias("call_count"), *[F.sum(c).alias(c) for c in _COUNTS if c != "logical_calls"]]
    return own.groupBy(bucket.alias("bucket"), "tool_name").agg(*sums)


def normal_pricing(pricing: dict[str, tuple[float, float]] | None) -> tuple[dict[str, tuple[float, float]], list[str]]:
    """(prices, warnings): every known price list, its own default in the place of a price that is missing, not finite or negative; unknown lists are
    left out. Names are compared without case and blanks at their ends."""
    given = {name.strip().lower(): own for name, own in (pricing or {}).items()}
    out, warnings = {}, []
    for name, default in PRICING.items():
        both = []
        for kind, price, fallback in zip(("input", "output"), given.get(name, default), default, strict=True):
            good = isinstance(price, (int, float)) and math.isfinite(price) and price >= 0
            both.append(float(price) if good else fallback)
            if not good:
                warnings.append(f"{name} {kind} pricing must be finite and non-negative; using default {fallback:g} USD/MTok")
        out[name] = (both[0], both[1])
    return out, warnings


def trends(calls: DataFrame, now: str) -> DataFrame:
    """All windows in one scan: conditional sums."""
    t, limit = F.col("captured_at").cast("timestamp"), F.lit(now).cast("timestamp")
    out = []
    for name, (span, _) in WINDOWS.items():
        inside = (t >= limit - F.expr(f"interval {span} seconds")) & (t < limit)
        out += [F.count(F.when(inside, 1)).alias(f"{name}_calls"), F.coalesce(F.sum(F.when(inside, F.col("tokens_saved"))), F.lit(0)).alias(f"{name}_tokens_saved")]
    return calls.agg(*out)


def snapshot_deltas(snapshots: DataFrame, counters: list[str], at: str = "captured_at", series: list[str] | None = None) -> DataFrame:
    """The growth of counters since the snapshot before; if any of them fell, the counters were reset and the present values count.
    Snapshots of one series are in one task: they are rollups, one for each day or hour. With no series all rows are one."""
    w = W.partitionBy(*(series or [F.lit(0)])).orderBy(at)
    before = {c: F.lag(c).over(w) for c in counters}
    df = snapshots.withColumns({f"_{c}": v for c, v in before.items()})
    reset = F.lit(False)
    for c in counters:
        reset = reset | (F.col(c) < F.col(f"_{c}"))
    return df.withColumns({f"{c}_delta": F.when(F.col(f"_{c}").isNull() | reset, F.col(c)).otherwise(F.col(c) - F.col(f"_{c}")) for c in counters}).drop(*[f"_{c}" for c in counters])


def latency(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Mean, median and 95th percentile with linear interpolation; negatives count as 0."""
    own = rows.select(*keys, F.greatest(F.col(value), F.lit(0.0)).alias("v"))
    return with_quantiles(own.groupBy(*keys).agg(F.round(F.avg("v"), 6).alias("mean")), exact_quantiles(own, "v", [0.5, 0.95], *keys), *keys).select(*keys, "mean", F.round("q0", 6).alias("p50"), F.round("q1", 6).alias("p95"))


def with_quantiles(sums: DataFrame, quantiles: DataFrame, *keys: str) -> DataFrame:
    """Both by key; keys may be null, and with no key there is one row."""
    if not keys:
        return sums.crossJoin(quantiles)  # one row each
    q = quantiles.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return sums.join(q, on, "left").drop(*[f"_{k}" for k in keys])


def retain(calls: DataFrame, now: str, days: int = 30) -> DataFrame:
    return calls.where(F.col("captured_at").cast("timestamp") >= F.lit(now).cast("timestamp") - F.expr(f"interval {days} days"))


def newest(calls: DataFrame, most: int = 2048) -> DataFrame:
    """The newest calls that a pending buffer keeps."""
    return calls.orderBy(F.desc("captured_at"), F.desc("event_id")).limit(most)


def benchmark_delta(runs: DataFrame, pricing: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Of runs with baseline and tool tokens (in, out): tokens saved, ratio, and cost saved for each price list (may be negative)."""
    base, own = F.col("baseline_in") + F.col("baseline_out"), F.col("tool_in") + F.col("tool_out")
    df = runs.withColumns({"tokens_saved": base - own, "saved_ratio": F.when(base <= 0, 0.0).otherwise(F.round((base - own) / base, 6))})
    return df.withColumns({f"{name}_usd": cost(F.col("baseline_in") - F.col("tool_in"), F.col("baseline_out") - F.col("tool_out"), price) for name, price in normal_pricing(pricing)[0].items()})


def logical_calls(batch_size: Column, succeeded: Column) -> Column:
    """A batch that succeeded counts its items."""
    return F.when(succeeded & (batch_size > 1), batch_size).otherwise(1)
