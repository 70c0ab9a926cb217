"""Writing tables."""

from __future__ import annotations

from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import phenotype


def stamp(zone: str = "America/New_York") -> str:
    return datetime.now(ZoneInfo(zone)).strftime("%Y%m%d_%H%M%S")


def write_unified(df: DataFrame, folder: str, name: str, kind: str = "parquet") -> str:
    """The standardised table under a stamped name; Parquet clustered by image, or CSV. Returns the path."""
    path = f"{folder.rstrip('/')}/{name}_{stamp()}.{kind}"
    write = df.write.mode("errorifexists")
    write.parquet(path) if kind == "parquet" else write.option("header", True).csv(path)
    return path


def write_by_slide(df: DataFrame, path: str, slide: str = "slide_id", mode: str = "errorifexists") -> None:
    """Canonical Parquet, partitioned by slide so that image filters prune folders; large slides keep many files."""
    df.repartition(F.col(slide), F.pmod(F.xxhash64("x", "y"), F.lit(16))).write.mode(mode).partitionBy(slide).parquet(path)


def write_tsv(df: DataFrame, path: str) -> None:
    """Reformatted table with a header; never overwrites."""
    df.write.mode("errorifexists").option("header", True).option("sep", "\t").csv(path)


def write_gates(rules: DataFrame, path: str) -> None:
    rules.coalesce(1).write.mode("errorifexists").option("header", True).csv(path)  # a row a phenotype


def write_identification(summary: DataFrame, path: str) -> None:
    """Phenotype assignments: index, count, percent, markers, phenotype, without header, all-negative species left out."""
    rows = phenotype.identification(summary).select("idx", "species_count", "species_percent", "species_name_short", "phenotype")
    rows.coalesce(1).write.mode("errorifexists").option("sep", "\t").csv(path)  # a row a species
