"""Folders for tables that outlive a plan: in the cluster's shared folder, deleted when the driver's Python ends."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, on a local master only, one of the application's own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if not at and app not in _own:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: written tables need a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, folder, True)
        _own[app] = f"file://{folder}"
    return (at or _own[app]).rstrip("/")


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder of any store; whether it was there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def folder(spark: SparkSession, name: str) -> str:
    """A path that no other call gets, deleted at exit."""
    path = f"{shared(spark)}/{name}-{uuid.uuid4().hex}"

    def clear() -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone
            remove(spark, path)

    atexit.register(clear)
    return path


class Steps:
    """Tables of one computation in steps: each is written and read again, so the next one's plan begins at files that lost executors leave whole."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, folder(spark, name), 0

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        at = f"{self.path}/{self.n}"
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)
