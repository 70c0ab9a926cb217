"""Annotation regions: pixels, ROI weights, weighted averages."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def to_pixels(df: DataFrame, columns: list[str], scale: float, shift: float = 0.0) -> DataFrame:
    """Whole pixels of coordinates, cut towards zero."""
    return df.withColumns({c: (F.col(c) / scale - shift).cast("bigint") for c in columns})


def image_of_slide(slide: Column) -> Column:
    """Second ``_`` part of a slide's name, by which annotations are matched."""
    return F.get(F.split(slide, "_"), F.lit(1))


def objects_in_windows(objects: DataFrame, windows: DataFrame, image: str, size: float) -> DataFrame:
    """(image, roi_id, n_objects): objects whose centre lies in each window [min, max), windows of none included.

    Both sides meet on buckets of the windows' size, so the join is an
    equi-join whatever the number of windows.
    """
    b = lambda c: F.floor(F.col(c) / float(size))
    spots = objects.select(F.col(image).alias("image"), F.col("x").alias("ox"), F.col("y").alias("oy"), b("x").alias("gx"), b("y").alias("gy"))
    w = windows.select(F.col(image).alias("image"), "roi_id", "roi_x_min", "roi_x_max", "roi_y_min", "roi_y_max").distinct()
    tiles = w.withColumn("gx", F.explode(F.sequence(b("roi_x_min"), b("roi_x_max")))).withColumn("gy", F.explode(F.sequence(b("roi_y_min"), b("roi_y_max"))))
    inside = (F.col("ox") >= F.col("roi_x_min")) & (F.col("ox") < F.col("roi_x_max")) & (F.col("oy") >= F.col("roi_y_min")) & (F.col("oy") < F.col("roi_y_max"))
    n = tiles.join(spots, ["image", "gx", "gy"]).where(inside).groupBy("image", "roi_id").agg(F.count(F.lit(1)).alias("n"))
    return w.select("image", "roi_id").join(n, ["image", "roi_id"], "left").select(F.col("image").alias(image), "roi_id", F.coalesce("n", F.lit(0)).alias("n_objects"))


def footprint(rectangles: DataFrame, image: str, tile: int = 256) -> DataFrame:
    """(image, px, py): distinct pixels that whole-number rectangles [x0, x1) x [y0, y1) cover."""
    x = F.explode(F.sequence(F.col("x0"), F.col("x1") - 1))
    y = F.explode(F.sequence(F.col("y0"), F.col("y1") - 1))
    return rectangles.where("x1 > x0 AND y1 > y0").withColumn("px", x).withColumn("py", y).select(image, "px", "py").distinct()


def footprint_runs(rectangles: DataFrame, image: str) -> DataFrame:
    """(image, py, start, stop): what whole-number rectangles [x0, x1) x [y0, y1) cover of each row of pixels, as runs that neither overlap nor touch.

    Rows grow with the heights of rectangles, not with their areas; a window
    holds the rectangles that cross one row of pixels.
    """
    rows = rectangles.where("x1 > x0 AND y1 > y0").select(image, F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)).alias("py"), "x0", "x1")
    row = Window.partitionBy(image, "py").orderBy("x0", "x1")
    reach = F.max("x1").over(row.rowsBetween(Window.unboundedPreceding, -1))
    opened = rows.withColumn("opens", F.when(reach.isNull() | (F.col("x0") > reach), 1).otherwise(0))
    opened = opened.withColumn("run", F.sum("opens").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    return opened.groupBy(image, "py", "run").agg(F.min("x0").alias("start"), F.max("x1").alias("stop")).drop("run")


def covered(windows: DataFrame, cover: DataFrame, image: str, size: float) -> DataFrame:
    """(image, roi_id, footprint): pixels of each window [min, max) that ``cover`` holds: runs (image, py, start, stop) or pixels (image, px, py).

    Runs are cut at columns of buckets as wide as a window and meet, row of
    pixels by row of pixels, the windows that reach into the bucket.
    """
    runs = cover.select(F.col(image).alias("image"), "py", F.col("px").alias("start"), (F.col("px") + 1).alias("stop")) if "px" in cover.columns else cover.select(F.col(image).alias("image"), "py", "start", "stop")
    wide = max(1, math.ceil(size))
    b = lambda c: F.floor(F.col(c) / wide)
    pieces = runs.withColumn("bx", F.explode(F.sequence(b("start"), F.floor((F.col("stop") - 1) / wide))))
    pieces = pieces.withColumns({"start": F.greatest("start", F.col("bx") * wide), "stop": F.least("stop", (F.col("bx") + 1) * wide)})
    w = windows.select(F.col(image).alias("image"), "roi_id", *[F.ceil(f"roi_{a}_{e}").alias(f"{a}_{e}") for a in "xy" for e in ("min", "max")]).distinct().where("x_max > x_min AND y_max > y_min")
    strips = w.withColumn("bx", F.explode(F.sequence(b("x_min"), F.floor((F.col("x_max") - 1) / wide)))).withColumn("py", F.explode(F.sequence(F.col("y_min"), F.col("y_max") - 1)))
    shared = F.least("stop", "x_max") - F.greatest("start", "x_min")
    found = strips.join(pieces, ["image", "bx", "py"]).where(shared > 0)
    return found.groupBy(F.col("image").alias(image), "roi_id").agg(F.sum(shared).alias("footprint"))


def raw_weights(windows: DataFrame, cover: DataFrame, objects: DataFrame, image: str, radius: float, size: float) -> DataFrame:
    """Of each ROI: valid_area (inset by the radius), int_area, n_objects and covered pixels inside that inset; zeros if it is too small.

    ``cover`` is a footprint, as pixels or as runs of them.
    """
    w = windows.select(image, "roi_id", "roi_x_min", "roi_x_max", "roi_y_min", "roi_y_max").distinct()
    inset = w.withColumns({"roi_x_min": F.col("roi_x_min") + radius, "roi_x_max": F.col("roi_x_max") - radius, "roi_y_min": F.col("roi_y_min") + radius, "roi_y_max": F.col("roi_y_max") - radius})
    wide, high = F.col("roi_x_max") - F.col("roi_x_min"), F.col("roi_y_max") - F.col("roi_y_min")
    ok = (wide > 0) & (high > 0)
    area = inset.select(image, "roi_id", F.when(ok, wide * high).otherwise(0.0).alias("valid_area"), F.when(ok, F.floor(wide) * F.floor(high)).otherwise(0).alias("int_area"))
    n = objects_in_windows(objects, inset.where(ok), image, size)
    return area.join(n, [image, "roi_id"], "left").join(covered(inset.where(ok), cover, image, size), [image, "roi_id"], "left").na.fill(0, ["n_objects", "footprint"])


def standardise_weights(df: DataFrame, weight: str, by: list[str], log: bool = False) -> DataFrame:
    """Weights scaled to 0..1 over the finite ones of a group, a constant one 0.5, others 0; optionally of their log10."""
    w = F.col(weight).cast("double")
    if log:
        w = F.when(w > 0, F.log10(w))
    finite = F.when(w.isNotNull() & ~F.isnan(w) & (F.abs(w) < float("inf")), w)
    df = df.withColumn("__w", finite)
    ends = df.groupBy(*by).agg(F.min("__w").alias("__lo"), F.max("__w").alias("__hi"))
    out = df.join(ends, by) if by else df.crossJoin(F.broadcast(ends))  # one row
    scaled = F.when(F.col("__hi") > F.col("__lo"), (F.col("__w") - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(0.5)
    return out.withColumn("weight", F.when(F.col("__w").isNull(), 0.0).otherwise(scaled)).drop("__w", "__lo", "__hi")


def collapse_equal_columns(df: DataFrame, columns: list[str], name: str, tolerance: float = 1e-8) -> DataFrame:
    """Columns that agree in every row become one."""
    spread = df.agg(F.max(F.greatest(*[F.col(c) for c in columns]) - F.least(*[F.col(c) for c in columns]))).first()[0]
    if spread is None or spread < tolerance:
        return df.withColumn(name, F.col(columns[0])).drop(*[c for c in columns if c != name])
    return df


def annotation_average(pvals: DataFrame, weights: DataFrame, roi: list[str], by: list[str]) -> DataFrame:
    """Mean log p of (by, center, neighbor) over ROIs, weighted by the ROI's annotation weight."""
    from .interaction import slide_average

    return slide_average(pvals.join(weights.select(*roi, "weight"), roi), by, F.col("weight"))
