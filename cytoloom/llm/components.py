"""Connected components of an edge table that never leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Stored


def stars(edges: DataFrame) -> bool:
    """Whether each u has one v and no v is a u: the work is done."""
    if not edges.groupBy("u").count().where("count > 1").isEmpty():
        return False
    return edges.join(edges.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi").isEmpty()


def components(edges: DataFrame, label: str = "edges") -> DataFrame:
    """node, component (its smallest node) for the nodes of ``edges`` (src, dst).

    Alternates large-star and small-star steps until stars are left; each
    turns the edges into stars around smaller nodes and is written out, so the
    number of rounds grows with the logarithm of the longest chain. Nodes'
    minima are aggregated map-side and written before they are joined back:
    both sides of a join are then shuffled for it alone, and adaptive execution
    can split a node of very many edges. No edges give no rows.
    """
    kept = Stored(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), label)
    while not stars(kept.df):
        both = kept.df.unionByName(kept.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = Stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")), label)
        large = both.where("v > u").join(least.df, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = Stored(large.where("u <> v").distinct(), label)
        low = Stored(large.df.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m"), label)
        small = large.df.join(low.df, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.where("u <> v").unionByName(low.df.select(F.col("w").alias("u"), F.col("m").alias("v")))
        after = Stored(small.distinct(), label)
        for table in (kept, least, large, low):
            table.drop()
        kept = after
    return kept.df.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        kept.df.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
