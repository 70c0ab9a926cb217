"""Reading cell tables and annotation regions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import summaries


def separator(path: str) -> str:
    """Comma for ``.csv``, tab for anything else."""
    return "," if path.rsplit(".", 1)[-1] == "csv" else "\t"


def read_table(spark: SparkSession, path: str, schema=None, images: tuple[str, list] | None = None) -> DataFrame:
    """Parquet by its extension, else delimited text with a header; ``images`` filters at the scan.

    Give a schema for large files: inferring one reads them twice.
    """
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        reader = spark.read.option("header", True).option("sep", separator(path))
        df = (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)
    if df.columns and df.columns[0].startswith("﻿"):
        df = df.withColumnRenamed(df.columns[0], df.columns[0].lstrip("﻿"))
    return df if images is None else df.where(F.col(f"`{images[0]}`").isin(list(images[1])))


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names alone."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path).columns
    return spark.read.option("header", True).option("sep", separator(path)).csv(path).columns


def image_ids(df: DataFrame, column: str) -> DataFrame:
    """Distinct trimmed image ids, sorted; reads one column."""
    return df.select(F.trim(F.col(f"`{column}`").cast("string")).alias("image_id")).distinct().orderBy("image_id")


def read_many(spark: SparkSession, paths: list[str], schema=None) -> DataFrame:
    """All files over the columns they share, and input_filename."""
    frames = [read_table(spark, p, schema).withColumn("input_filename", F.lit(p.rstrip("/").rsplit("/", 1)[-1])) for p in paths]
    return summaries.intersection_union(frames)


def read_annotations(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Regions of ``<image>__...__<region>.csv`` files with image_id and region_type."""
    frames = []
    for path in paths:
        name = path.rstrip("/").rsplit("/", 1)[-1]
        df = read_table(spark, path)
        frames.append(df.withColumns({"image_id": F.lit(name.split("__")[0]), "region_type": F.lit(name.split(".")[0].split("__")[-1])}))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def annotation_name(path) -> tuple:
    """image_id and region_type expressions of a file path column."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    stem = F.substring_index(name, ".", 1)
    return F.substring_index(name, "__", 1), F.substring_index(stem, "__", -1)
