"""Resuming: only units that a finished-results table lacks are computed, and appended to it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame


def finished(df: DataFrame, path: str, keys: list[str]) -> DataFrame | None:
    """Keys of the units in the Parquet folder, None if there is none yet."""
    try:
        return df.sparkSession.read.parquet(path).select(*keys).distinct()
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def pending(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Rows of units that are not in the folder; rows with a null key are never finished."""
    done = finished(df, path, keys)
    return df if done is None else df.join(done, keys, "left_anti")


def resume(df: DataFrame, path: str, keys: list[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All results, computing what is missing; a unit without result rows is computed again next time."""
    compute(pending(df, path, keys)).write.mode("append").parquet(path)
    return df.sparkSession.read.parquet(path)
