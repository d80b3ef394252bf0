"""Timed runs of the batch queries over a corpus: the rows that evaluation.throughput sums up."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

#: Names of workloads, their query and its argument.
WORKLOADS = {
    "tool_get_file_outline_fixture": ("get_file_outline", "file_paths"),
    "tool_find_importers_fixture": ("find_importers", "file_paths"),
    "tool_find_references_fixture": ("find_references", "identifiers"),
    "tool_check_references_fixture": ("check_references", "identifiers"),
}
RUNS, BATCH = 30, 32


def paths(files: DataFrame, most: int) -> list[str]:
    """The first `most` paths: what that many turns can ask for."""
    return [r.path for r in files.select("path").distinct().orderBy("path").limit(most).collect()]


def identifiers(imports: DataFrame, files: DataFrame, most: int) -> list[str]:
    """The first `most` of the names that imports bring in and of the stems of their specifiers and of all paths; of names that differ in case only the
    first by code points."""
    stem = lambda c: F.regexp_replace(tx.path_base(c), r"(?<=.)\.[^.]*$", "")
    own = imports.select(F.explode(F.concat("names", F.array(stem(F.col("specifier"))))).alias("name")).unionByName(files.select(stem(F.col("path")).alias("name")))
    own = own.select(tx.trim_unicode(F.col("name")).alias("name")).where("name <> ''")
    return [r.name for r in own.groupBy(F.lower("name")).agg(F.min("name").alias("name")).orderBy("name").limit(most).collect()]


def selection(items: list[str], run: int, batch: int = BATCH) -> list[str]:
    """The items of a run: `batch` in turn, from the first again after the last."""
    return [items[(run * batch + k) % len(items)] for k in range(batch)] if items else []


def run(spark: SparkSession, call: Callable[[str, dict[str, Any]], dict[str, Any]], workload: str, items: list[str], runs: int = RUNS, batch: int = BATCH) -> DataFrame:
    """workload, run, items, ms, failed, error of each run. A run fails if its answer is an error or has not one result for each distinct item; it
    then counts no items, and no latency."""
    if workload not in WORKLOADS:
        raise ValueError(f"unknown workload: {workload}")
    tool, argument = WORKLOADS[workload]
    rows = []
    for k in range(runs):
        asked = selection(items, k, batch)
        began = time.perf_counter()
        answer = call(tool, {argument: asked})
        ms = (time.perf_counter() - began) * 1000
        error = answer.get("error") or (None if len(answer.get("results", [])) == len(set(asked)) > 0 else "the answer lacks results")
        rows.append((workload, k, 0 if error else len(asked), None if error else ms, error is not None, error))
    return spark.createDataFrame(rows, "workload string, run int, items long, ms double, failed boolean, error string")
