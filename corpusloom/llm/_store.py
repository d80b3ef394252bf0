"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ._columns import small_batches


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset (tests, a laptop), one of our own for the application."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if not at and app not in _own:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, folder, True)
        _own[app] = f"file://{folder}"
    return (at or _own[app]).rstrip("/")


_made: list[list[Scratch]] = []


@contextlib.contextmanager
def cleared():
    """Delete at the end what operators called inside have written, once the result is in other files."""
    _made.append([])
    try:
        yield
    finally:
        for scratch in _made.pop():
            scratch.clear()


class Scratch:
    """A folder of tables that one call of an operator writes. A written table survives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.clear)
        if _made:
            _made[-1].append(self)
        small_batches(spark)

    def clear(self) -> None:
        """Delete all tables, at the latest when the driver's Python ends; nothing reads them after that."""
        with contextlib.suppress(Exception):  # the JVM may be gone
            self.drop("")

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as Parquet and read it again: what follows starts from the files."""
        at = f"{self.path}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
