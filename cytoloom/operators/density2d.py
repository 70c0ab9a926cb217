"""Two-dimensional densities: histograms on shared edges, differences, masks, bins of cells."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import clustering


def bin_of(value: Column, low: float | Column, high: float | Column, bins: int) -> Column:
    """Bin of equal width, the top edge in the last; null outside."""
    k = F.least(F.floor((value - low) * bins / (high - low)), F.lit(bins - 1))
    return F.when((value >= low) & (value <= high), k).cast("int")


def with_bins(df: DataFrame, x: str, y: str, bins: int, limits: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Adds bx and by. Without limits the extent of the table is used."""
    if limits is None:
        limits = df.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    lo_x, hi_x, lo_y, hi_y = map(float, limits)
    return df.withColumns({"bx": bin_of(F.col(x), F.lit(lo_x), F.lit(hi_x), bins), "by": bin_of(F.col(y), F.lit(lo_y), F.lit(hi_y), bins)})


def grid(spark, bins: int) -> DataFrame:
    """All (bx, by)."""
    n = F.lit(bins)
    return spark.range(bins * bins).select((F.col("id") % n).cast("int").alias("bx"), F.floor(F.col("id") / n).cast("int").alias("by"))


def density(df: DataFrame, bins: int, weight: str | None = None, dense: bool = True) -> DataFrame:
    """(bx, by, n, d, empty) with d = 100 (n + 1) / sum(n + 1) over all bins, or the weights' share of their total.

    The grid has bins x bins rows whatever the size of the table.
    """
    total = F.count(F.lit(1)) if weight is None else F.sum(weight)
    each = df.where("bx IS NOT NULL AND by IS NOT NULL").groupBy("bx", "by").agg(total.alias("n"))
    each = grid(df.sparkSession, bins).join(F.broadcast(each), ["bx", "by"], "left").withColumn("empty", F.col("n").isNull()).na.fill(0, ["n"])
    one = 1 if weight is None else 0
    all_ = each.agg(F.sum(F.col("n") + one).alias("total"))
    out = each.crossJoin(F.broadcast(all_)).withColumn("d", (100.0 if weight is None else 1.0) * (F.col("n") + one) / F.col("total")).drop("total")
    return out if dense else out.where("NOT empty")


def kernel(sigma: float, truncate: float = 4.0) -> list[float]:
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [v / sum(w) for v in w]


def smooth(grid: DataFrame, value: str, bins: int, sigma: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """Gaussian smoothing of a dense (bx, by) grid, of each group of ``by``, edges mirrored; the two axes one after the other."""
    weights, own = kernel(sigma), by or []
    r = len(weights) // 2
    for axis in ("bx", "by"):
        steps = F.array(*[F.struct(F.lit(k - r).alias("o"), F.lit(w).alias("w")) for k, w in enumerate(weights)])
        other = "by" if axis == "bx" else "bx"
        to = F.col(axis) + F.col("s.o")
        mirrored = F.when(to < 0, -1 - to).when(to >= bins, 2 * bins - 1 - to).otherwise(to)
        spread = grid.withColumn("s", F.explode(steps))
        grid = spread.groupBy(*own, mirrored.cast("int").alias("__to"), other).agg(F.sum(F.col(value) * F.col("s.w")).alias(value)).withColumnRenamed("__to", axis)
    return grid.select(*own, "bx", "by", value)


def weighted_density(df: DataFrame, bins: int, weight: str, sigma: float = 0.5) -> DataFrame:
    """(bx, by, d, empty): weights summed in each bin, smoothed twice, as a share of their total; empty where no row is."""
    each = density(df, bins, weight)
    twice = smooth(smooth(each.select("bx", "by", F.col("n").cast("double").alias("d")), "d", bins, sigma), "d", bins, sigma)
    all_ = twice.agg(F.sum("d").alias("__total"))
    out = twice.join(each.select("bx", "by", "empty"), ["bx", "by"]).crossJoin(F.broadcast(all_))  # one row
    return out.select("bx", "by", F.try_divide("d", "__total").alias("d"), "empty")


def log_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(bx, by, empty, diff): log10 of one density less that of the other; empty where both are."""
    left = a.select("bx", "by", F.col("d").alias("d0"), F.col("empty").alias("e0"))
    right = b.select("bx", "by", F.col("d").alias("d1"), F.col("empty").alias("e1"))
    return left.join(right, ["bx", "by"]).select("bx", "by", (F.col("e0") & F.col("e1")).alias("empty"), (F.log10("d0") - F.log10("d1")).alias("diff"))


def mask(diff: DataFrame, cutoff: float) -> DataFrame:
    """1 above the cutoff, -1 below its negative, 0 in empty bins, the value itself in between."""
    d = F.col("diff")
    return diff.withColumn("mask", F.when(F.col("empty"), 0.0).when(d > cutoff, 1.0).when(d < -cutoff, -1.0).otherwise(d))


def ternary_mask(diff: DataFrame, fraction: float) -> DataFrame:
    """1, -1 or 0 by a cutoff that is a fraction of the largest absolute difference."""
    top = diff.agg((F.max(F.abs("diff")) * fraction).alias("__cut"))
    d = F.col("diff")
    return diff.crossJoin(F.broadcast(top)).withColumn("mask", F.when(d > F.col("__cut"), 1).when(d < -F.col("__cut"), -1).otherwise(0)).drop("__cut")


def in_bins(cells: DataFrame, bins: DataFrame, label: str) -> DataFrame:
    """Cells with the label of their bin, null where the bins have none; bins are at most a grid."""
    return cells.join(bins.select("bx", "by", label), ["bx", "by"], "left")


def bin_summary(cells: DataFrame, values: list[str], image: str = "slide_id", label: str | None = None, least: int = 1) -> DataFrame:
    """Means, standard deviations, number of cells and of distinct images of each bin, those of fewer cells left out."""
    stats = [f for v in values for f in (F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_std"))]
    extra = [F.min(label).alias(label)] if label else []
    out = cells.where("bx IS NOT NULL AND by IS NOT NULL").groupBy("bx", "by").agg(*stats, F.count(F.lit(1)).alias("n_cells"), F.count_distinct(image).alias("n_images"), *extra)
    return out.where(F.col("n_cells") >= least)


def group_densities(df: DataFrame, group: str, x: str, y: str, bins: int = 200, sigma: float = 0.5) -> DataFrame:
    """(group, bx, by, d): smoothed share density of each group on the whole table's edges, all groups in one plan.

    The grid of every group is made whole, so its rows number groups x bins x bins.
    """
    binned = with_bins(df, x, y, bins).where("bx IS NOT NULL AND by IS NOT NULL")
    each = binned.groupBy(group, "bx", "by").agg(F.count(F.lit(1)).alias("n"))
    total = each.groupBy(group).agg(F.sum("n").alias("total"))
    whole = total.crossJoin(F.broadcast(grid(df.sparkSession, bins)))  # groups by bins
    seen = each.select(F.col(group).alias("__g"), F.col("bx").alias("__x"), F.col("by").alias("__y"), "n")
    same = F.col(group).eqNullSafe(F.col("__g")) & (F.col("bx") == F.col("__x")) & (F.col("by") == F.col("__y"))
    dense = whole.join(seen, same, "left").select(group, "bx", "by", (F.coalesce("n", F.lit(0)) / F.col("total")).alias("d"))
    return smooth(dense, "d", bins, sigma, [group])


def sign_clusters(masked: DataFrame, left: int, right: int, seed: int = 0) -> DataFrame:
    """(bx, by, label): bins of mask 1 and -1 clustered by place, each sign for itself, as ``Left Cluster i`` and ``Right Cluster i`` from the largest.

    Others are ``No Cluster``. Bins are a grid, whatever the size of the table.
    """
    found = [masked.where("mask NOT IN (1, -1)").select("bx", "by", F.lit("No Cluster").alias("label"))]
    for sign, k, name in ((1, left, "Left Cluster"), (-1, right, "Right Cluster")):
        part = masked.where(F.col("mask") == sign).select("bx", "by", F.col("bx").cast("double").alias("__x"), F.col("by").cast("double").alias("__y"))
        n = part.count()
        if n:
            clustered, _ = clustering.k_means(part, ["__x", "__y"], min(k, n), seed=seed)
            found.append(relabel_by_size(clustered, "cluster", name).select("bx", "by", "label"))
    return union_bins(found)


def relabel_by_size(df: DataFrame, cluster: str, prefix: str) -> DataFrame:
    """Cluster numbers as ``<prefix> 1``, 2, ... from the largest; ties by number."""
    sizes = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("__n"))
    names = sizes.select(cluster, F.concat(F.lit(prefix + " "), F.row_number().over(Window.orderBy(F.desc("__n"), cluster)).cast("string")).alias("label"))  # of clusters
    return df.join(names, cluster)


def union_bins(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
