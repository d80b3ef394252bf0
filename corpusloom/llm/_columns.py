"""Columns computed from whole texts in Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that are worked on at once; a longer text is one block. Bounds the memory of a Python worker.
BLOCK_BYTES = 1 << 20


def named(c: str):
    """The column of exactly this name, whatever signs are in it."""
    return F.col("`" + c.replace("`", "``") + "`")


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without the columns that an operator is about to add; names are compared without case, as Spark does."""
    new = {n.lower() for n in names}
    return df.select(*[named(c) for c in df.columns if c.lower() not in new])


#: Bytes and rows of one Arrow batch between the JVM and Python. Texts are long: at Spark's own limits a batch is tens of MB on both sides.
_BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def small_batches(spark: SparkSession) -> None:
    """Set the batch limits of this session, which a plan reads when it runs; limits that the caller has set stay."""
    given = spark.conf.getAll
    for key, value in _BATCH.items():
        if key not in given:
            spark.conf.set(key, value)


def released(run: Callable) -> Callable:
    """run, an iterator of batches, that hands unused memory back to the system when it ends: a Python worker lives on for other tasks."""

    def outer(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other systems
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return outer


def append(df: DataFrame, fields: list[T.StructField], make: Callable[[], Callable[[pa.RecordBatch], list]]) -> DataFrame:
    """df with more columns. make() runs once a task and returns a function from a batch to one array for each field."""
    base = without(df, [f.name for f in fields])
    schema = T.StructType([*base.schema.fields, *fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, *work(b)], names)

    small_batches(df.sparkSession)
    return base.mapInArrow(released(run), schema)


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a string column: first row, row after the last, their UTF-8 bytes, and where each text begins in
    them (one more than rows). A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_binary(column.type):
        column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
