"""Bounded samples of labelled rows for fitting classifiers on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Stored, beside

GRAIN = 1 << 20
#: Rows and characters drawn of all classes together. Classes share them evenly, and each has a row at least.
ROWS, CHARACTERS = 400_000, 400_000_000
#: Texts of more characters are drawn only where a class has no others.
LONGEST = 100_000


def draw(rows: DataFrame, most: int, key: Column) -> tuple[DataFrame, DataFrame, int]:
    """Of rows with a column ``class``, about ``most`` to twice as many a class by a hash of ``key``, in column ``h``;
    how many rows there are of each class (class, count); and ``most``, smaller where there are many classes."""
    counts = Stored(rows.groupBy("class").count(), "classes").df
    most = max(1, min(most, ROWS // max(1, counts.count())))
    limit = F.least(F.lit(GRAIN), F.floor(F.lit(2 * most * GRAIN) / F.col("count")) + 1)
    limits = beside(counts.select(F.col("class").alias("__class"), limit.alias("__limit")))
    rows = rows.withColumn("h", F.pmod(F.xxhash64(key), F.lit(GRAIN)))
    taken = rows.join(limits, (F.col("class") == F.col("__class")) & (F.col("h") < F.col("__limit")), "left_semi")
    return taken, counts, most


def smallest(drawn: DataFrame, most: int) -> list[tuple]:
    """(text, class) of the ``most`` smallest hashes of each class among drawn rows of class, h, text; one text a hash,
    so that an id that repeats does not add to what is collected.

    A class's texts have its share of ``CHARACTERS`` together, its first text
    aside. Which ones stay is decided on lengths alone; only those are collected.
    """
    texts = Stored(drawn.groupBy("class", "h").agg(F.min("text").alias("text")), "drawn").df
    sizes = texts.select("class", "h", F.char_length("text").alias("size"))
    share = CHARACTERS // max(1, sizes.select("class").distinct().count())
    own = Window.partitionBy("class").orderBy(F.greatest(F.col("size") - LONGEST, F.lit(0)), "h")  # a class has few rows here
    ranked = sizes.withColumns({"rank": F.row_number().over(own), "sum": F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0))})
    stay = ranked.where((F.col("rank") <= most) & ((F.col("rank") == 1) | (F.col("sum") <= share))).select("class", "h")
    kept = texts.join(beside(stay), ["class", "h"], "left_semi").collect()
    return [(r["text"], r["class"]) for r in sorted(kept, key=lambda r: (r["class"], r["h"]))]
