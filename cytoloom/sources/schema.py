"""The canonical cell table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Display names of the canonical columns.
DISPLAY = {"slide_id": "Slide ID", "roi_id": "tag", "x": "Cell X Position", "y": "Cell Y Position"}
PREFIX = "Phenotype "

CORE = T.StructType([T.StructField("slide_id", T.StringType()), T.StructField("roi_id", T.StringType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])


def to_display(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(DISPLAY)


def from_display(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({v: k for k, v in DISPLAY.items()})


def trim(df: DataFrame, keep: list[str] | None = None, suffix: str | None = None) -> DataFrame:
    """Only core columns, ``Phenotype ...`` columns, kept extras and columns of a suffix."""
    wanted = [c for c in df.columns if c in DISPLAY or c in DISPLAY.values() or c.startswith(PREFIX) or c in (keep or ()) or (suffix and c.endswith(suffix))]
    return df.select(*[F.col(f"`{c}`") for c in wanted])


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN of floating columns as null, so that aggregates pass over missing values."""
    floats = [c for c, k in df.dtypes if k in ("double", "float")]
    return df.withColumns({c: F.nanvl(F.col(f"`{c}`"), F.lit(None).cast("double")).cast(dict(df.dtypes)[c]) for c in floats}) if floats else df


def call_of(value: Column) -> Column:
    """0/1 as ``-``/``+``; null stays null."""
    return F.when(value.cast("int") == 1, "+").when(value.isNotNull(), "-")
