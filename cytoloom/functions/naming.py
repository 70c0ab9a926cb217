"""Names: columns, images, phenotypes, affixes."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def image_name(path: Column) -> Column:
    """Last part of a path without extension, spaces and dots as ``__``."""
    last = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.regexp_replace(F.regexp_replace(last, r"\.[^.]*$", ""), r"[ .]", "__")


def safe_phenotype(name: Column) -> Column:
    """``+`` and ``-`` spelled out for file and column names."""
    return F.replace(F.replace(name, F.lit("+"), F.lit("(plus)")), F.lit("-"), F.lit("(dash)"))


def composite_id(columns: list[str], strip_path: bool = False) -> Column:
    """Values joined by ``__``; nulls count as empty strings so that ids keep their arity."""
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns]
    if strip_path:
        parts = [F.regexp_extract(p, r"([^/\\]*)$", 1) for p in parts]
    return F.concat_ws("__", *parts)


def feature_pair(name1: str, name2: str) -> Column:
    """Two columns as one label: name1 value1 __ name2 value2."""
    return F.concat(F.lit(name1), F.col(f"`{name1}`").cast("string"), F.lit("__"), F.lit(name2), F.col(f"`{name2}`").cast("string"))


def common_prefix(values: list[str]) -> str:
    return os.path.commonprefix(values)


def common_suffix(values: list[str]) -> str:
    return os.path.commonprefix([v[::-1] for v in values])[::-1]


def strip_common_affixes(df: DataFrame, column: str) -> DataFrame:
    """Removes what all values of a column begin and end with; from its least and greatest values, and the same reversed."""
    c = F.col(f"`{column}`")
    a, b, y, z = df.agg(F.min(c), F.max(c), F.min(F.reverse(c)), F.max(F.reverse(c))).first()
    if a is None or a == b:
        return df
    start = len(common_prefix([a, b]))
    end = min(len(common_prefix([y, z])), min(len(a), len(b)) - start)
    return df.withColumn(column, F.expr(f"substring(`{column}`, {start + 1}, greatest(0, char_length(`{column}`) - {start + max(end, 0)}))"))


def natural_key(value: Column) -> Column:
    """Sort key under which digit runs compare as numbers: each run is padded to 20 digits."""
    parts = F.regexp_extract_all(value, F.lit(r"\d+|\D+"), 0)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 20, "0")).otherwise(p)), "")


def natural_sorted(values: list[str]) -> list[str]:
    return sorted(values, key=lambda v: [(int(p), "") if p.isdigit() else (-1, p) for p in re.findall(r"\d+|\D+", v)])


def with_column_at(df: DataFrame, name: str, value: Column, position: int) -> DataFrame:
    """Inserts or replaces a column and puts it at a position."""
    others = [c for c in df.columns if c != name]
    out = df.withColumn(name, value)
    return out.select(*[F.col(f"`{c}`") for c in [*others[:position], name, *others[position:]]])


def move_column(df: DataFrame, name: str, position: int) -> DataFrame:
    return with_column_at(df, name, F.col(f"`{name}`"), position)


def rename_prefix(df: DataFrame, old: str, new: str) -> DataFrame:
    """Columns that begin with one prefix begin with another."""
    return df.withColumnsRenamed({c: new + c[len(old) :] for c in df.columns if c.startswith(old)})


def override_phenotypes(df: DataFrame, names: dict[str, str], prefix: str = "Phenotype ") -> DataFrame:
    """Only the named marker columns stay, under the prefix and their new names."""
    others = [c for c in df.columns if not c.startswith(prefix) and c not in names]
    return df.select(*[F.col(f"`{c}`") for c in others], *[F.col(f"`{c}`").alias(prefix + n) for c, n in names.items()])
