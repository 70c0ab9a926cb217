"""Neighbourhood profiles: densities and proportions by ring, cluster profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import spatial

RADII = [0.0, 25.0, 50.0, 100.0, 150.0, 200.0]


def areas(radii: list[float], lattice: bool = True) -> list[float]:
    """Ring areas: lattice points of the strict disk, or pi (r2^2 - r1^2)."""
    if not lattice:
        return spatial.ring_areas(radii)
    cumulative = [0, *spatial.lattice_areas(radii[1:])]
    return [float(b - a) for a, b in zip(cumulative, cumulative[1:])]


def densities(counts: DataFrame, radii: list[float] = RADII, lattice: bool = True) -> DataFrame:
    """Adds density: neighbours of a phenotype and ring over the ring's area."""
    each = F.array(*[F.lit(a) for a in areas(radii, lattice)])
    return counts.withColumn("density", F.col("n") / each[F.col("ring")])


def proportions(counts: DataFrame, keys: list[str], total: str | None = None) -> DataFrame:
    """Adds proportion: a phenotype's share of all neighbours in the ring, which the column ``total`` has if it is given; null where there is none."""
    return counts.withColumn("proportion", F.try_divide(F.col("n"), F.col(total) if total else F.sum("n").over(Window.partitionBy(*keys, "ring"))))


def area_filter(cells: DataFrame, ratios: str, threshold: float) -> DataFrame:
    """Cells whose rings all have more than a share of their full area inside the tissue."""
    return cells.where(F.forall(F.col(ratios), lambda r: r > threshold))


def cluster_profile(densities: DataFrame, cluster: str = "cluster", value: str = "density", scale: float = 1e6) -> DataFrame:
    """Mean and standard error of densities by (cluster, neighbor, ring), in units of 1/scale."""
    return densities.groupBy(F.col(cluster).alias("cluster"), "neighbor", "ring").agg(
        (F.avg(value) * scale).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value)) * scale).alias("sem"), F.count(value).alias("n")
    )


def compare_profiles(profile: DataFrame, first: str, second: str, how: str = "difference", hide: tuple[str, ...] = ("Other", "No Cluster")) -> DataFrame:
    """Difference or ratio of two clusters' mean profiles."""
    shown = profile.where(~F.col("neighbor").isin(*hide))
    a = shown.where(F.col("cluster") == F.lit(first)).select("neighbor", "ring", F.col("mean").alias("a"))
    b = shown.where(F.col("cluster") == F.lit(second)).select("neighbor", "ring", F.col("mean").alias("b"))
    value = F.col("a") - F.col("b") if how == "difference" else F.try_divide(F.col("a"), F.col("b"))
    return a.join(b, ["neighbor", "ring"]).select("neighbor", "ring", value.alias(how))


def log_weights(df: DataFrame, weight: str, by: list[str]) -> DataFrame:
    """Weights shifted to be no less than 0, then log(0.1 w + 0.1) less its minimum; nulls and NaN go."""
    out = df.where(F.col(weight).isNotNull() & ~F.isnan(weight))
    low = out.groupBy(*by).agg(F.min(weight).alias("__low"))
    out = out.join(low, by) if by else out.crossJoin(F.broadcast(low))  # one row
    shifted = F.log(0.1 * (F.col(weight) - F.least(F.col("__low"), F.lit(0.0))) + 0.1)
    least = F.log(0.1 * (F.col("__low") - F.least(F.col("__low"), F.lit(0.0))) + 0.1)
    return out.withColumn("log_weight", shifted - least).drop("__low")


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled to 0..1 over the table; a constant one becomes 0."""
    ends = df.agg(*[f for c in columns for f in (F.min(c).alias(f"__lo_{c}"), F.max(c).alias(f"__hi_{c}"))])
    out = df.crossJoin(F.broadcast(ends))  # one row
    scaled = {c: F.coalesce((F.col(c) - F.col(f"__lo_{c}")) / F.nullif(F.col(f"__hi_{c}") - F.col(f"__lo_{c}"), F.lit(0.0)), F.lit(0.0)) for c in columns}
    return out.withColumns(scaled).drop(*[x for c in columns for x in (f"__lo_{c}", f"__hi_{c}")])


def spatial_mean(cells: DataFrame, features: list[str], radius: float, image: str = "slide_id", cell_id: str = "cell_id") -> DataFrame:
    """Mean of the features over each cell's neighbours within ``radius``, itself included."""
    slim = cells.select(image, cell_id, "x", "y", *features)
    pairs = spatial.band_pairs(slim, slim, radius, image, keep=[cell_id], keep_neighbor=features)
    return pairs.groupBy(image, F.col("c_" + cell_id).alias(cell_id)).agg(*[F.avg("n_" + f).alias(f) for f in features])


def hide(label: Column, names: tuple[str, ...] = ("Other", "No Cluster")) -> Column:
    return ~label.isin(*names)
