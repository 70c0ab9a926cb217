"""Arrow batches through a Python function, column lists in and out."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows a function gets at once, so that its own arrays stay small.
AT_ONCE = 2_000
#: Sizes of the batches that executors exchange with Python, in place of Spark's defaults; a session's own settings are left alone.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b")}


def bound_batches(spark: SparkSession) -> None:
    """Long texts make large batches; a task holds a few at a time, inside and outside the JVM's heap."""
    for name, (default, small) in BATCHES.items():
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, small)


def release() -> None:
    """Gives back to the system what this process no longer needs; it lives on beside others and serves other tasks."""
    gc.collect()  # caches and what fills them refer to each other
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, and at its end nothing that it held stays with the process."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return whole


def map_lists(df: DataFrame, make: Callable[[], Callable[..., tuple]], schema: str) -> DataFrame:
    """``make()`` runs once a task and returns a function from the lists of ``df``'s columns
    to a tuple of equally long lists or arrays, the columns of ``schema``."""
    bound_batches(df.sparkSession)
    out = T.StructType.fromDDL(schema)
    fields = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                columns = step(*(c.to_pylist() for c in batch.slice(at, AT_ONCE).columns))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)

    return df.mapInArrow(giving_back(run), out)


def array_sum(df: DataFrame, make: Callable[[], Callable[..., np.ndarray]], width: int) -> np.ndarray:
    """``make()`` runs once a task and returns a function from the lists of ``df``'s columns to ``width`` doubles; their sum over all rows.

    Each task gives one array; some are added by other tasks, so that the driver sees about as many as the root of their number.
    """
    bound_batches(df.sparkSession)

    def one(total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, total = make(), np.zeros(width)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                total += step(*(c.to_pylist() for c in batch.slice(at, AT_ONCE).columns))
        yield one(total)

    def then(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for v in batch.column(0).to_pylist():
                total += np.frombuffer(v)
        yield one(total)

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = df.mapInArrow(giving_back(first), "v binary").repartition(max(1, int(tasks**0.5))).mapInArrow(then, "v binary").collect()
    return sum((np.frombuffer(r.v) for r in found), np.zeros(width))
