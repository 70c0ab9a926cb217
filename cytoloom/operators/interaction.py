"""Spatial interaction of species in ROIs: Poisson and permutation tests, averages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric
from ..session import written
from . import spatial, statistics, whole


def by_roi(cells: DataFrame, roi: list[str], species: str, cell_id: str) -> DataFrame:
    """``__roi``, id, place and species of each cell, written: centers, neighbours, counts and bounds all read it."""
    return written(cells.select(F.struct(*roi).alias("__roi"), F.col(cell_id).alias("__id"), "x", "y", F.col(species).alias("__species")))


def tallies(keyed: DataFrame, radius: float) -> DataFrame:
    """Of a table of ``by_roi``: (__roi, center, neighbor, n_valid, n_neighbor, k)."""
    roi = ["__roi"]
    centers = spatial.valid_centers(keyed, radius, roi)
    valid = centers.groupBy("__roi", F.col("__species").alias("center")).agg(F.count(F.lit(1)).alias("n_valid"))
    pairs = spatial.band_pairs(centers, keyed, radius, "__roi", keep=["__species"], keep_neighbor=["__species"])
    pairs = pairs.where(F.col("d2") < radius * radius)
    k = pairs.groupBy("__roi", F.col("c___species").alias("center"), F.col("n___species").alias("neighbor")).agg(F.count(F.lit(1)).alias("k"))
    there = keyed.groupBy("__roi", F.col("__species").alias("neighbor")).agg(F.count(F.lit(1)).alias("n_neighbor"))
    out = valid.join(there, "__roi").join(k, ["__roi", "center", "neighbor"], "left")  # species by species of an ROI
    own = F.col("center") == F.col("neighbor")
    return out.withColumn("k", (F.coalesce("k", F.lit(0)) - F.when(own, F.col("n_valid")).otherwise(0)).cast("bigint"))


def tallied(cells: DataFrame, radius: float, roi: list[str], species: str, cell_id: str) -> DataFrame:
    """roi..., center, neighbor, n_valid, n_neighbor, k, width and height of each ROI's extent: ROIs that fit a task are counted in it, others by a join."""
    rows = cells.select(*roi, F.col(cell_id).alias("id"), "x", "y", F.col(species).alias("species"))
    rows, large = whole.split(rows, roi)
    out = whole.roi_counts(rows, roi, radius, by_number=False)
    own = F.col("center") == F.col("neighbor")
    out = out.withColumn("k", (F.col("k") - F.when(own, F.col("n_valid")).otherwise(0)).cast("bigint"))
    if large is None:
        return out
    keyed = by_roi(large, roi, "species", "id")
    extent = spatial.bounds(keyed, ["__roi"]).select("__roi", "width", "height")
    more = tallies(keyed, radius).join(extent, "__roi").withColumns({c: F.col(f"__roi.{c}") for c in roi})
    return out.unionByName(more.drop("__roi"))


def observed(cells: DataFrame, radius: float, roi: list[str], species: str = "phenotype", cell_id: str = "cell_id") -> DataFrame:
    """For each (roi, center, neighbor): k neighbours in [0, radius) of n_valid edge-valid centers, the centers themselves taken off once."""
    return tallied(cells, radius, roi, species, cell_id).select(*roi, "center", "neighbor", "n_valid", "n_neighbor", "k")


def poisson_test(cells: DataFrame, radius: float, roi: list[str], spacing: float = 1.0, species: str = "phenotype", cell_id: str = "cell_id", floor: float = -25.0, min_centers: int = 1) -> DataFrame:
    """Observed counts against a Poisson of the ROI's density: mean, log10 of P(X <= k) (left) and P(X >= k) (right), floored."""
    seen = tallied(cells, radius, roi, species, cell_id).where(F.col("n_valid") >= min_centers)
    area = spatial.effective_area(F.col("width"), F.col("height"), spacing)
    possible = F.col("n_neighbor") - F.when(F.col("center") == F.col("neighbor"), 1).otherwise(0)
    out = seen.withColumn("mean", F.col("n_valid") * possible / area * spatial.slice_area(0.0, radius, spacing))
    left, right = numeric.poisson_left(F.col("k"), F.col("mean")), numeric.poisson_right(F.col("k"), F.col("mean"))
    out = out.withColumns({"log_p_left": numeric.floored_log10(left, floor), "log_p_right": numeric.floored_log10(right, floor)})
    return out.select(*roi, "center", "neighbor", "n_valid", "n_neighbor", "k", "mean", "log_p_left", "log_p_right")


def slide_average(pvals: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """Mean log p of ROIs in each (by, center, neighbor), weighted by valid centers unless told otherwise; nulls are passed over."""
    w = F.col("n_valid") if weight is None else weight

    def mean(c: str) -> Column:
        known = F.col(c).isNotNull()
        return F.try_divide(F.sum(F.when(known, w * F.col(c))), F.sum(F.when(known, w)))

    return pvals.groupBy(*by, "center", "neighbor").agg(mean("log_p_left").alias("log_p_left"), mean("log_p_right").alias("log_p_right"), F.count(F.lit(1)).alias("n_rois"))


def max_centers(pvals: DataFrame, roi: list[str]) -> DataFrame:
    return pvals.groupBy(*roi).agg(F.max("n_valid").alias("max_valid_centers"))


def joined_number_counts(cells: DataFrame, radius: float, roi: list[str], species: str, cell_id: str) -> DataFrame:
    """``whole.roi_counts`` by number of ROIs that no task has to hold, by joins."""
    keyed = cells.withColumn("__roi", F.struct(*roi))
    centers = spatial.valid_centers(keyed, radius, roi).select("__roi", cell_id, "x", "y", species)
    pairs = spatial.band_pairs(centers, keyed.select("__roi", cell_id, "x", "y", species), radius, "__roi", keep=[cell_id, species], keep_neighbor=[cell_id, species])
    pairs = pairs.where((F.col("d2") < radius * radius) & (F.col("c_" + cell_id) != F.col("n_" + cell_id)))
    per = pairs.groupBy("__roi", F.col("c_" + cell_id).alias("id"), F.col("c_" + species).alias("center"), F.col("n_" + species).alias("neighbor")).agg(F.count(F.lit(1)).alias("n"))
    seen = per.groupBy("__roi", "center", "neighbor", "n").agg(F.count(F.lit(1)).alias("centers"))
    valid = centers.groupBy("__roi", F.col(species).alias("center")).agg(F.count(F.lit(1)).alias("n_valid"))
    there = keyed.groupBy("__roi", F.col(species).alias("neighbor")).agg(F.count(F.lit(1)).alias("n_neighbor"))
    some = seen.groupBy("__roi", "center", "neighbor").agg(F.sum("centers").alias("some"))
    zero = valid.join(there, "__roi").join(some, ["__roi", "center", "neighbor"], "left").select("__roi", "center", "neighbor", F.lit(0).cast("bigint").alias("n"), (F.col("n_valid") - F.coalesce("some", F.lit(0))).alias("centers"))
    out = seen.unionByName(zero).join(valid, ["__roi", "center"]).join(there, ["__roi", "neighbor"])
    out = out.join(spatial.bounds(keyed, roi).select(F.struct(*roi).alias("__roi"), "width", "height"), "__roi")
    return out.select(*[F.col(f"__roi.{c}").alias(c) for c in roi], "center", "neighbor", "n_valid", "n_neighbor", "width", "height", "n", "centers")


def count_pmf(cells: DataFrame, radius: float, roi: list[str], spacing: float = 1.0, species: str = "phenotype", cell_id: str = "cell_id") -> DataFrame:
    """Distribution of neighbour counts against the Poisson one: for each (roi, center, neighbor, n) the centers seen and expected, z, and binomial tails.

    ROIs that fit a task are counted in it, others by joins.
    """
    rows = cells.select(*roi, F.col(cell_id).alias("id"), "x", "y", F.col(species).alias("species")).na.drop(subset=roi)
    rows, large = whole.split(rows, roi)
    out = whole.roi_counts(rows, roi, radius, by_number=True)
    if large is not None:
        out = out.unionByName(joined_number_counts(large, radius, roi, "species", "id"))
    area = spatial.effective_area(F.col("width"), F.col("height"), spacing)
    possible = F.col("n_neighbor") - F.when(F.col("center") == F.col("neighbor"), 1).otherwise(0)
    out = out.withColumn("mean", possible / area * spatial.slice_area(0.0, radius, spacing))
    p = F.when(F.col("mean") > 0, F.exp(F.col("n") * F.log("mean") - F.col("mean") - numeric.log_factorial(F.col("n")))).otherwise((F.col("n") == 0).cast("double"))
    out = out.withColumn("pmf", p).withColumn("expected", F.col("pmf") * F.col("n_valid"))
    out = out.withColumn("z", F.try_divide(F.col("centers") - F.col("expected"), F.sqrt(F.col("expected") * (1 - F.col("pmf")))))

    @F.pandas_udf("left double, right double")
    def tails(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("left", "right"), numeric.binomial_tails(k.to_numpy(np.int64), n.to_numpy(np.int64), p.to_numpy(float)))))

    out = out.withColumn("t", tails("centers", "n_valid", "pmf"))
    return out.select(*roi, "center", "neighbor", "n", "n_valid", "centers", "expected", "z", F.col("t.left").alias("p_left"), F.col("t.right").alias("p_right"))


def pmf_average(pmf: DataFrame, by: list[str]) -> DataFrame:
    """(by..., center, neighbor, n, seen, expected, n_rois): shares of centers with n neighbours over ROIs, weighted by their valid centers."""
    weighed = pmf.where(F.col("n_valid") > 0)
    share = lambda c: F.sum(c) / F.sum("n_valid")
    return weighed.groupBy(*by, "center", "neighbor", "n").agg(share("centers").alias("seen"), share("expected").alias("expected"), F.count(F.lit(1)).alias("n_rois"))


def joined_shuffled_counts(cells: DataFrame, radius: float, roi: list[str], permutations: int, seed: int, species: str, cell_id: str) -> DataFrame:
    """``whole.shuffled_counts`` of ROIs that no task has to hold, by joins."""
    keyed = cells.select(F.struct(*roi).alias("__roi"), F.col(cell_id).alias("id"), "x", "y", F.col(species).cast("string").alias("species"))
    keyed = keyed.groupBy("__roi", "id").agg(F.min(F.struct("x", "y", "species")).alias("c")).select("__roi", "id", "c.x", "c.y", "c.species")
    there = keyed.groupBy("__roi").agg(F.count(F.lit(1)).alias("cells"), F.count_distinct("species").alias("kinds")).where("cells > 2 AND kinds > 1")
    keyed = written(keyed.join(there.select("__roi"), "__roi", "left_semi"))
    edges = written(spatial.radius_graph(keyed.select("__roi", "id", "x", "y"), radius, "id", "__roi").select("__roi", "src", "dst"))
    place = Window.partitionBy("__roi", "shuffle")
    lot = lambda k: F.xxhash64("__roi", "shuffle", "id", F.lit(seed), F.lit(k))
    every = keyed.select("__roi", "id", "species", F.explode(F.sequence(F.lit(0), F.lit(permutations))).alias("shuffle"))
    shuffled = every.where("shuffle > 0")
    giving = shuffled.select("__roi", "shuffle", "species", F.row_number().over(place.orderBy(lot(0), "id")).alias("rank"))
    taking = shuffled.select("__roi", "shuffle", "id", F.row_number().over(place.orderBy(lot(1), "id")).alias("rank"))
    labels = taking.join(giving, ["__roi", "shuffle", "rank"]).select("__roi", "shuffle", "id", "species")
    labels = labels.unionByName(every.where("shuffle = 0").select("__roi", "shuffle", "id", "species"))
    # one row a cell with its labels in all shuffles, so that edges meet them once
    lists = labels.groupBy("__roi", "id").agg(F.array_sort(F.collect_list(F.struct("shuffle", "species"))).alias("l")).select("__roi", "id", F.col("l.species").alias("l"))
    lists = written(lists)
    met = edges.join(lists.select("__roi", F.col("id").alias("src"), F.col("l").alias("a")), ["__roi", "src"]).join(lists.select("__roi", F.col("id").alias("dst"), F.col("l").alias("b")), ["__roi", "dst"])
    tally = met.select("__roi", F.posexplode(F.arrays_zip("a", "b")).alias("shuffle", "e")).groupBy("__roi", "shuffle", F.col("e.a").alias("center"), F.col("e.b").alias("neighbor")).agg(F.count(F.lit(1)).alias("n"))
    null, n = F.col("shuffle") > 0, F.col("n").cast("double")
    stats = tally.where("center IS NOT NULL AND neighbor IS NOT NULL").groupBy("__roi", "center", "neighbor").agg(F.coalesce(F.sum(F.when(~null, F.col("n"))), F.lit(0)).alias("edges"), F.sum(F.when(null, n)).alias("__s"), F.sum(F.when(null, n * n)).alias("__q"))
    kinds = keyed.where("species IS NOT NULL").select("__roi", "species").distinct()
    pairs = kinds.select("__roi", F.col("species").alias("center")).join(kinds.select("__roi", F.col("species").alias("neighbor")), "__roi")
    pairs = pairs.join(edges.select("__roi").distinct(), "__roi", "left_semi")  # species by species of an ROI that has edges
    out = pairs.join(stats, ["__roi", "center", "neighbor"], "left").na.fill(0, ["edges"]).na.fill(0.0, ["__s", "__q"])
    return out.select(*[F.col(f"__roi.{c}").alias(c) for c in roi], "center", "neighbor", "edges", "__s", "__q")


def permutation_test(cells: DataFrame, radius: float, roi: list[str], permutations: int = 200, seed: int = 0, species: str = "phenotype", cell_id: str = "cell_id") -> DataFrame:
    """Neighbourhood enrichment in each ROI: roi..., center, neighbor, edges, z and normal tail probabilities against shuffled labels, and the edges these make on average.

    A shuffle gives each cell the label of the cell whose rank by one hash its
    own rank by another hash equals, both of (ROI, shuffle, cell); ranks are
    within an ROI and a shuffle. So labels are permuted and not drawn, an ROI
    is gathered only where it fits a task, and no plan changes a result. A tally a shuffle is all that
    is kept of its edges. Null labels keep a place of their own and are not
    reported. ROIs of one species or of at most two cells are passed over; a
    cell id counts once an ROI.
    """
    if dict(cells.dtypes)[cell_id] in ("int", "bigint"):
        rows = cells.select(*roi, F.xxhash64(F.struct(*roi)).alias("__hash"), F.col(cell_id).alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col(species).cast("string").alias("species"))
        rows, large = whole.split(rows, roi)
        out = whole.shuffled_counts(rows, roi, radius, permutations, seed)
        if large is not None:
            out = out.unionByName(joined_shuffled_counts(large, radius, roi, permutations, seed, "species", "id"))
    else:
        out = joined_shuffled_counts(cells, radius, roi, permutations, seed, species, cell_id)
    mean = F.col("__s") / permutations
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("__q") / permutations - mean * mean))
    out = out.withColumn("z", F.when(spread > 1e-9, (F.col("edges") - mean) / spread).otherwise(float("nan")))
    return out.select(*roi, "center", "neighbor", "edges", "z", numeric.normal_cdf(F.col("z")).alias("p_left"), numeric.normal_cdf(-F.col("z")).alias("p_right"), mean.alias("expected"))


def bootstrap_counts(counts: DataFrame, by: list[str], value: str, resamples: int, row: list[str], seed: int = 0) -> DataFrame:
    """Seeded resamples of a group's total of ``value``: by..., resample, total; ``row`` names a row, so that equal values draw for themselves."""
    return statistics.resampled(counts, by, value, resamples, row, seed).select(*by, "resample", F.col("total"))


def is_symmetric(matrix: DataFrame, row: str, column: str, value: str, tolerance: float = 1e-8) -> DataFrame:
    """Entries of a long matrix that differ from their mirror image; none if it is symmetric."""
    mirror = matrix.select(F.col(row).alias("__c"), F.col(column).alias("__r"), F.col(value).alias("__v"))
    joined = matrix.join(mirror, (F.col(row) == F.col("__r")) & (F.col(column) == F.col("__c")), "left")
    return joined.where(F.col("__v").isNull() != F.col(value).isNull()).unionByName(joined.where(F.abs(F.col(value) - F.col("__v")) > tolerance)).select(row, column, value)


def roi_arrays(cells: DataFrame, roi: list[str], species: str = "phenotype") -> DataFrame:
    """A row an ROI with its cells as a sorted array of (x, y, species): for hand-over, not for joins."""
    return cells.groupBy(*roi).agg(F.array_sort(F.collect_list(F.struct("x", "y", F.col(species).alias("species")))).alias("cells"))
