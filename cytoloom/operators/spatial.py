"""Distances within images: band joins, ring counts, graphs, ROI grids, rings, rectangles.

Distance joins bucket space: the grid's cells are as wide as the largest
radius, so a cell's partners lie in its own bucket or one of the eight around
it. Neighbours go to those nine buckets, and an equi-join on (image, bucket)
does the rest; no image needs to fit a task and no pair beyond the nine
buckets is ever made. A table joined to itself makes each pair of two buckets
once and mirrors it after it is filtered or counted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from . import whole

CLOSED_LEFT, CLOSED_RIGHT = "[)", "(]"


def ring_of(d2: Column, radii: list[float], closed: str = CLOSED_LEFT) -> Column:
    """Number of the ring [r_i, r_i+1) or (r_i, r_i+1] that a squared distance is in, null beyond all."""
    out = F.lit(None).cast("int")
    for k in reversed(range(len(radii) - 1)):
        low, high = float(radii[k]) ** 2, float(radii[k + 1]) ** 2
        inside = (d2 >= low) & (d2 < high) if closed == CLOSED_LEFT else (d2 > low) & (d2 <= high)
        out = F.when(inside, F.lit(k)).otherwise(out)
    return out


#: The bucket itself and those around it; of a table joined to itself half of them do, as each pair of two buckets meets once.
AROUND = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
HALF = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]


def band_pairs(
    centers: DataFrame, neighbors: DataFrame, radius: float, image: str = "slide_id", x: str = "x", y: str = "y", keep: list[str] | None = None, keep_neighbor: list[str] | None = None, half: bool = False
) -> DataFrame:
    """Pairs of one image within ``radius``: the image, center columns ``c_*``, neighbour columns ``n_*`` and d2.

    Cells without coordinates pair with none; coincident cells and, where both
    tables hold it, a cell with itself do. With ``half``, for a table and
    itself, of a pair in two buckets one order is made and ``mirrored`` is true.
    """
    keep = [c for c in centers.columns if c != image] if keep is None else keep
    keep_neighbor = [c for c in neighbors.columns if c != image] if keep_neighbor is None else keep_neighbor
    side = F.lit(float(radius))

    def bucket(c: str) -> Column:
        return F.floor(F.col(c) / side)

    left = centers.select(F.col(image).alias("image"), F.col(x).alias("cx"), F.col(y).alias("cy"), bucket(x).alias("gx"), bucket(y).alias("gy"), *[F.col(f"`{c}`").alias("c_" + c) for c in keep])
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in (HALF if half else AROUND)])
    right = neighbors.select(F.col(image).alias("image"), F.col(x).alias("nx"), F.col(y).alias("ny"), F.explode(around).alias("o"), *[F.col(f"`{c}`").alias("n_" + c) for c in keep_neighbor])
    mirrored = [((F.col("o.i") != 0) | (F.col("o.j") != 0)).alias("mirrored")] if half else []
    right = right.select("image", "nx", "ny", (F.floor(F.col("nx") / side) + F.col("o.i")).alias("gx"), (F.floor(F.col("ny") / side) + F.col("o.j")).alias("gy"), *[F.col(f"`n_{c}`") for c in keep_neighbor], *mirrored)
    dx, dy = F.col("cx") - F.col("nx"), F.col("cy") - F.col("ny")
    pairs = left.join(right, ["image", "gx", "gy"]).withColumn("d2", dx * dx + dy * dy)
    return pairs.where(F.col("d2") <= float(radius) ** 2).drop("gx", "gy").withColumnRenamed("image", image)


def ring_counts(
    cells: DataFrame, radii: list[float], closed: str = CLOSED_RIGHT, cell_id: str = "cell_id", image: str = "slide_id", phenotype: str = "phenotype", exclude_self: bool = False, center: str | None = None, total: str | None = None
) -> DataFrame:
    """(image, cell_id, neighbor phenotype, ring, n) with n > 0: neighbours of each cell by phenotype and ring.

    ``(]`` leaves out distance 0, the cell itself and coincident ones; ``[)``
    counts them, less the cell itself if ``exclude_self``. ``center`` names a
    column for the cell's own phenotype, ``total`` one for a ring's neighbours
    of all phenotypes. Images that fit a task are counted in it, so that only
    cells are moved; others by a join.
    """
    rows, large = whole.split(cells.select(image, cell_id, "x", "y", phenotype).where(F.col(f"`{image}`").isNotNull()), [image])
    kinds = dict(rows.dtypes)
    schema = f"`{image}` {kinds[image]}, `{cell_id}` {kinds[cell_id]}, {f'`{center}` {kinds[phenotype]}, ' if center else ''}neighbor {kinds[phenotype]}, ring int, n bigint{f', `{total}` bigint' if total else ''}"
    found = whole.ring_counts(rows, radii, closed == CLOSED_LEFT, exclude_self, image, cell_id, phenotype, center, total, schema)
    if large is None:
        return found
    joined = joined_ring_counts(large, radii, closed, cell_id, image, phenotype, exclude_self, center)
    return found.unionByName(joined.withColumn(total, F.sum("n").over(Window.partitionBy(image, cell_id, "ring"))) if total else joined)


def joined_ring_counts(cells: DataFrame, radii: list[float], closed: str, cell_id: str, image: str, phenotype: str, exclude_self: bool, center: str | None) -> DataFrame:
    """``ring_counts`` by a join, for images that no task has to hold."""
    slim = cells.select(image, cell_id, "x", "y", phenotype, F.col(phenotype).alias("own"))
    if center:  # of rows that share an id the least; known before cells meet, so that pairs are only hashed
        least = slim.groupBy(image, cell_id).agg(F.min("own").alias("own"))
        slim = slim.drop("own").join(least, [image, cell_id], "left")
    carried = [cell_id, phenotype, *(["own"] if center else [])]
    pairs = band_pairs(slim, slim, max(radii), image, keep=carried, keep_neighbor=carried, half=True)
    pairs = pairs.withColumn("ring", ring_of(F.col("d2"), radii, closed)).where("ring IS NOT NULL")
    if exclude_self:
        pairs = pairs.where(F.col("c_" + cell_id) != F.col("n_" + cell_id))
    end = lambda a, b: F.struct(F.col(f"`{a}_{cell_id}`").alias("id"), *([F.col(f"{a}_own").alias("own")] if center else []), F.col(f"`{b}_{phenotype}`").alias("other"))
    ends = F.explode(F.when(F.col("mirrored"), F.array(end("c", "n"), end("n", "c"))).otherwise(F.array(end("c", "n"))))
    pairs = pairs.select(image, "ring", ends.alias("e"))
    own = [F.col("e.own").alias(center)] if center else []
    return pairs.groupBy(image, F.col("e.id").alias(cell_id), *own, F.col("e.other").alias("neighbor"), "ring").agg(F.count(F.lit(1)).alias("n"))


def phenotype_rings(cells: DataFrame, radii: list[float], closed: str = CLOSED_RIGHT, image: str = "slide_id", phenotype: str = "phenotype") -> DataFrame:
    """(image, phenotype, neighbor, ring, n): pairs of an image by the phenotypes of both and the ring, summed before anything is shuffled."""
    slim = cells.select(image, "x", "y", phenotype)
    pairs = band_pairs(slim, slim, max(radii), image, keep=[phenotype], keep_neighbor=[phenotype], half=True)
    pairs = pairs.withColumn("ring", ring_of(F.col("d2"), radii, closed)).where("ring IS NOT NULL")
    each = pairs.groupBy(image, F.col("c_" + phenotype).alias("a"), F.col("n_" + phenotype).alias("b"), "ring", "mirrored").agg(F.count(F.lit(1)).alias("n"))
    end = lambda a, b: F.struct(F.col(a).alias("own"), F.col(b).alias("other"))
    both = F.explode(F.when(F.col("mirrored"), F.array(end("a", "b"), end("b", "a"))).otherwise(F.array(end("a", "b"))))
    each = each.select(image, both.alias("e"), "ring", "n")
    return each.groupBy(image, F.col("e.own").alias(phenotype), F.col("e.other").alias("neighbor"), "ring").agg(F.sum("n").alias("n"))


def wide_counts(counts: DataFrame, radii: list[float], phenotypes: list[str], cell_id: str = "cell_id", image: str = "slide_id") -> DataFrame:
    """Ring counts as one column a phenotype and ring, ``<phenotype> in (r0, r1]``, 0 where there is none."""
    label = F.lit(None).cast("string")
    names = [f"({radii[k]:g}, {radii[k + 1]:g}]" for k in range(len(radii) - 1)]
    for k, name in enumerate(names):
        label = F.when(F.col("ring") == k, F.concat("neighbor", F.lit(f" in {name}"))).otherwise(label)
    columns = [f"{p} in {n}" for p in phenotypes for n in names]
    return counts.withColumn("label", label).groupBy(image, cell_id).pivot("label", columns).agg(F.sum("n").cast("int")).na.fill(0, columns)


def radius_graph(cells: DataFrame, radius: float, cell_id: str = "cell_id", image: str = "slide_id", loops: bool = False) -> DataFrame:
    """Edges (image, src, dst, distance) both ways between cells at most ``radius`` apart; with ``loops`` each cell's own."""
    slim = cells.select(image, cell_id, "x", "y")
    pairs = band_pairs(slim, slim, radius, image, keep=[cell_id], keep_neighbor=[cell_id])
    edges = pairs.select(image, F.col("c_" + cell_id).alias("src"), F.col("n_" + cell_id).alias("dst"), F.sqrt("d2").alias("distance"))
    return edges if loops else edges.where("src <> dst")


#: How much finer than the radius a pyramid begins, in halvings; buckets an axis has at most.
FINER, MOST = 4, 1 << 40


def nearest(cells: DataFrame, k: int, radius: float, cell_id: str = "cell_id", image: str = "slide_id", of: DataFrame | None = None) -> DataFrame:
    """The k nearest others of each cell in its image (image, src, dst, distance, rank), ties by id; all others where there are fewer.

    A pyramid of buckets whose sides double, from a sixteenth of ``radius`` on,
    is counted once. The smallest bucket about a cell that holds more than k
    cells is looked at first: the k-th nearest in it bounds how far the cell
    has to be searched, in buckets as wide as that, so that cells in dense and
    in sparse places meet about as few others. Cells whose bucket lacks k
    others, as few cells or ids that repeat can make it, meet their whole
    image. Rows that share an id are ranked as one cell, each with its own
    pairs. ``of`` keeps to some rows of ``cells``. Coordinates that are not
    finite find and are found by none. Images that fit a task are searched in
    it, unless ``of`` is given or ids are structs.
    """
    if of is None and not dict(cells.dtypes)[cell_id].startswith("struct"):
        known = cells.select(image, F.col(cell_id).alias("id"), "x", "y").where(" AND ".join(f"abs({c}) < double('infinity')" for c in "xy")).na.drop(subset=[image, "id"])
        rows, large = whole.split(known, [image])
        kinds = dict(rows.dtypes)
        found = whole.nearest(rows, k, image, f"`{image}` {kinds[image]}, src {kinds['id']}, dst {kinds['id']}, distance double, rank int")
        return found if large is None else found.unionByName(met_by_level(large, k, radius, "id", image))
    return met_by_level(cells, k, radius, cell_id, image, of)


def met_by_level(cells: DataFrame, k: int, radius: float, cell_id: str, image: str, of: DataFrame | None = None) -> DataFrame:
    """``nearest`` by joins, for images that no task has to hold."""
    finite = " AND ".join(f"abs({c}) < double('infinity')" for c in "xy")  # neither null nor NaN
    slim = cells.select(image, cell_id, "x", "y").where(finite)
    far = slim.agg(F.max(F.greatest(F.abs("x"), F.abs("y")))).first()[0] or 0.0
    side = max(float(radius) / 2**FINER, 4.0 * far / MOST)
    top = max(1, math.ceil(math.log2(max(1.0, 2.0 * far / side))))  # two buckets an axis hold all
    above = lambda c, n: F.expr(f"shiftright({c}, {n})")

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumns({"gx": F.floor(F.col("x") / side), "gy": F.floor(F.col("y") / side)})

    slim = written(placed(slim).select(F.col(image).alias("image"), F.col(cell_id).alias("id"), "x", "y", "gx", "gy"))
    finest = slim.groupBy("image", "gx", "gy").agg(F.count(F.lit(1)).alias("n"))
    every = finest.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top)))).withColumns({"hx": above("gx", "level"), "hy": above("gy", "level")})
    full = every.groupBy("image", "level", "hx", "hy").agg(F.sum("n").alias("held")).where(F.col("held") > k).drop("held")
    reach = every.join(full, ["image", "level", "hx", "hy"]).groupBy("image", "gx", "gy").agg(F.min("level").alias("level"))
    asked = slim if of is None else placed(of.select(F.col(image).alias("image"), F.col(cell_id).alias("id"), "x", "y").where(finite))
    asked = written(asked.join(reach, ["image", "gx", "gy"], "left").fillna(top, ["level"]))

    def meet(left: DataFrame, rows: DataFrame) -> DataFrame:
        """Pairs, with d2, of ``left`` (image, level, hx, hy, ...) and the cells in its buckets at the levels of ``rows``."""
        levels = [r[0] for r in rows.select("level").distinct().collect()] or [top]  # as many as the pyramid has at most
        right = slim.select("image", F.col("id").alias("dst"), F.col("x").alias("nx"), F.col("y").alias("ny"), "gx", "gy", F.explode(F.array(*[F.lit(n) for n in levels])).alias("level"))
        right = right.select("image", "dst", "nx", "ny", "level", above("gx", "level").alias("hx"), above("gy", "level").alias("hy"))
        dx, dy = F.col("x") - F.col("nx"), F.col("y") - F.col("ny")
        return left.join(right, ["image", "level", "hx", "hy"]).where("id <> dst").withColumn("d2", dx * dx + dy * dy)

    rank = F.row_number().over(Window.partitionBy("image", "id").orderBy("d2", "dst"))
    some = asked.where(F.col("level") < top)
    own = meet(some.withColumns({"hx": above("gx", "level"), "hy": above("gy", "level")}), some).withColumn("rank", rank).where(F.col("rank") == k)
    finer = F.greatest(F.lit(0), F.ceil(F.log2(F.sqrt("d2") / side))).cast("int")  # log2 of 0 is null
    tight = written(own.select("image", "id", "x", "y", "gx", "gy", F.coalesce(finer, F.lit(0)).alias("level"), F.col("d2").alias("bound")))
    rest = asked.where(F.col("level") >= top)
    if tight.count() < some.count():
        known = tight.select("image", "id", F.col("level").alias("finer"), "bound")
        rest = rest.unionByName(some.join(known, ["image", "id"], "left_anti"))
        tight = some.join(known, ["image", "id"]).withColumn("level", F.col("finer")).drop("finer")
    todo = tight.unionByName(rest.withColumns({"level": F.lit(top), "bound": F.lit(float("inf"))}))

    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in AROUND])
    wide = F.lit(side) * F.pow(F.lit(2.0), F.col("level"))
    left = todo.withColumn("o", F.explode(around)).withColumns({"hx": above("gx", "level") + F.col("o.i"), "hy": above("gy", "level") + F.col("o.j"), "wide": wide})
    gap = lambda c, h: F.greatest(F.lit(0.0), F.col(h) * F.col("wide") - F.col(c), F.col(c) - (F.col(h) + 1) * F.col("wide"))
    touched = gap("x", "hx") * gap("x", "hx") + gap("y", "hy") * gap("y", "hy") <= F.col("bound") * (1 + 1e-9)
    left = left.where(touched).select("image", "id", "x", "y", "level", "hx", "hy", "bound")
    found = meet(left, todo).where(F.col("d2") <= F.col("bound")).withColumn("rank", rank).where(F.col("rank") <= k)
    return found.select(F.col("image").alias(image), F.col("id").alias("src"), "dst", F.sqrt("d2").alias("distance"), "rank")


def bounds(cells: DataFrame, by: list[str]) -> DataFrame:
    """Extent of each group: x_min, x_max, y_min, y_max, width, height, n_cells."""
    out = cells.groupBy(*by).agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"), F.count(F.lit(1)).alias("n_cells"))
    return out.withColumns({"width": F.col("x_max") - F.col("x_min"), "height": F.col("y_max") - F.col("y_min")})


def recommended_radius(roi_bounds: DataFrame) -> DataFrame:
    """A tenth of the smaller mean side of the ROIs, rounded half to even."""
    return roi_bounds.agg(F.bround(F.least(F.avg("width"), F.avg("height")) * 0.1).alias("radius"))


def roi_grid(extents: DataFrame, size: float, overlap: float, image: str = "slide_id") -> DataFrame:
    """Windows along each axis: n_x, n_y, start_x, start_y and their common step; the grid is centred on the cells."""
    step = float(size - overlap)

    def count(a: str) -> Column:
        return F.greatest(F.lit(1), F.ceil((F.col(f"{a}_max") - F.col(f"{a}_min") - overlap) / step)).cast("bigint")

    def start(a: str) -> Column:
        return (F.col(f"{a}_min") + F.col(f"{a}_max")) / 2 - (F.col(f"n_{a}") * step + overlap) / 2

    return extents.withColumns({"n_x": count("x"), "n_y": count("y")}).withColumns({"start_x": start("x"), "start_y": start("y")}).select(image, "n_x", "n_y", "start_x", "start_y", F.lit(step).alias("step"))


def assign_rois(cells: DataFrame, size: float, overlap: float, image: str = "slide_id") -> DataFrame:
    """A row for each half-open window [lo, hi) that a cell is in: roi_x, roi_y, roi_id and the window's bounds.

    The windows of a coordinate are an interval of numbers in closed form, so
    no cell is joined with windows; up to four rows a cell where they overlap.
    roi_id is named by the window's centre, rounded half to even and padded to
    the digits of the image's largest coordinate; centres are told apart while
    windows are a unit or more apart.
    """
    step = float(size - overlap)
    extents = bounds(cells, [image])
    digits = F.char_length(F.floor(F.greatest("x_max", "y_max")).cast("string"))
    grid = roi_grid(extents, size, overlap, image).join(extents.select(image, digits.alias("digits")), image)

    def windows(a: str) -> Column:
        off = F.col(a) - F.col(f"start_{a}")
        low = F.greatest(F.floor((off - float(size)) / step) + 1, F.lit(0).cast("bigint"))
        high = F.least(F.floor(off / step), F.col(f"n_{a}") - 1)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))

    out = cells.join(grid.drop("step"), image)  # a row an image
    out = out.withColumn("roi_x", F.explode(windows("x"))).withColumn("roi_y", F.explode(windows("y")))
    out = out.withColumns({"roi_x_min": F.col("start_x") + F.col("roi_x") * step, "roi_y_min": F.col("start_y") + F.col("roi_y") * step})
    out = out.withColumns({"roi_x_max": F.col("roi_x_min") + float(size), "roi_y_max": F.col("roi_y_min") + float(size)})
    middle = [F.bround((F.col(f"roi_{a}_min") + F.col(f"roi_{a}_max")) / 2).cast("bigint") for a in ("x", "y")]
    return out.withColumn("roi_id", padded_roi_name(F.col(image), *middle, F.col("digits"))).drop("n_x", "n_y", "start_x", "start_y", "digits")


def padded(number: Column, width: Column) -> Column:
    """An integer with zeros in front up to a width, a minus sign included; longer ones stay whole."""
    bare = F.abs(number).cast("string")
    sign = F.when(number < 0, "-").otherwise("")
    return F.concat(sign, F.lpad(bare, F.greatest(width - F.char_length(sign), F.char_length(bare)), F.lit("0")))


def padded_roi_name(image: Column, x: Column, y: Column, digits: Column) -> Column:
    """``<image>_roi_[X,Y]`` from integer coordinates padded to one number of digits."""
    return F.concat(image.cast("string"), F.lit("_roi_["), padded(x, digits), F.lit(","), padded(y, digits), F.lit("]"))


def whole_image_rois(cells: DataFrame, image: str = "slide_id") -> DataFrame:
    """One ROI an image, named by its centre rounded half up."""
    extents = bounds(cells, [image])
    middle = {a: F.floor((F.col(f"{a}_min") + F.col(f"{a}_max")) / 2 + 0.5) for a in ("x", "y")}
    return extents.withColumn("roi_id", padded_roi_name(F.col(image), middle["x"], middle["y"], F.lit(5)))


def drop_single_point_rois(cells: DataFrame, roi: list[str]) -> DataFrame:
    """Without ROIs whose cells all share one coordinate pair."""
    single = cells.groupBy(*roi).agg(F.count_distinct("x", "y").alias("places")).where("places = 1")
    return cells.join(single.select(*roi), roi, "left_anti")


def valid_centers(cells: DataFrame, radius: float, roi: list[str]) -> DataFrame:
    """Cells at least ``radius`` inside their ROI's extent; the upper edges are open."""
    b = bounds(cells, roi).select(*roi, "x_min", "x_max", "y_min", "y_max")
    inside = [(F.col(a) >= F.col(f"{a}_min") + radius) & (F.col(a) < F.col(f"{a}_max") - radius) for a in ("x", "y")]
    return cells.join(b, roi).where(inside[0] & inside[1])


def radial_rings(cells: DataFrame, width: float, image: str = "slide_id") -> DataFrame:
    """Ring of each cell about the middle of its image's extent, named by its outer radius: the inner edge is open, the centre in the first."""
    b = bounds(cells, [image]).select(image, ((F.col("x_min") + F.col("x_max")) / 2).alias("mid_x"), ((F.col("y_min") + F.col("y_max")) / 2).alias("mid_y"), F.floor(F.least("width", "height") / 2 / width).alias("whole_rings"))
    d = F.sqrt(F.pow(F.col("x") - F.col("mid_x"), F.lit(2.0)) + F.pow(F.col("y") - F.col("mid_y"), F.lit(2.0)))
    return cells.join(b, image).withColumn("ring", F.greatest(F.lit(1), F.ceil(d / width)) * width)


def chamber_rings(cells: DataFrame, center_x: float, center_y: float, width: float, image: str = "slide_id") -> DataFrame:
    """Outer radii of whole rings about a given centre, up to the nearest of an image's four extremes."""
    b = bounds(cells, [image])
    most = F.least(F.lit(center_x) - F.col("x_min"), F.col("x_max") - center_x, F.lit(center_y) - F.col("y_min"), F.col("y_max") - center_y)
    n = F.floor(most / width)
    return b.where(n >= 1).select(image, F.explode(F.sequence(F.lit(1).cast("bigint"), n)).alias("k")).select(image, (F.col("k") * width).alias("ring"))


def lattice_areas(radii: list[float]) -> list[int]:
    """Cumulative counts of lattice points with i^2 + j^2 < (r + 1)^2."""
    out = []
    for r in radii:
        limit = (r + 1) ** 2
        out.append(sum(2 * math.isqrt(math.ceil(limit - i * i) - 1) + 1 for i in range(-int(r + 1), int(r + 1) + 1) if i * i < limit))
    return out


def lattice_area(radius: Column) -> Column:
    """``lattice_areas`` of a column of radii, 0 for radius 0: the lattice points of each row of the disc are counted in closed form."""
    limit = F.pow(radius + 1, F.lit(2.0))
    reach = F.floor(radius + 1)
    row = lambda i: F.when(i * i < limit, 2 * F.floor(F.sqrt(F.ceil(limit - i * i) - 1)) + 1).otherwise(0)
    return F.when(radius > 0, F.aggregate(F.sequence(-reach, reach), F.lit(0).cast("bigint"), lambda total, i: total + row(i))).otherwise(0)


def ring_densities(cells: DataFrame, width: float, image: str = "slide_id") -> DataFrame:
    """Cells of each radial ring of an image over the ring's area in lattice points: image, ring, n, pixels, density.

    Areas are computed for the few rings that occur, behind the aggregate over cells.
    """
    rings = radial_rings(cells, width, image).groupBy(image, "ring").agg(F.count(F.lit(1)).alias("n"))
    rings = rings.withColumn("pixels", lattice_area(F.col("ring")) - lattice_area(F.col("ring") - width))
    return rings.withColumn("density", F.col("n") / F.col("pixels"))


def ring_areas(radii: list[float]) -> list[float]:
    """Areas between consecutive radii."""
    return [math.pi * (b * b - a * a) for a, b in zip(radii, radii[1:])]


def effective_area(width: Column, height: Column, spacing: float) -> Column:
    return (width + spacing) * (height + spacing) - spacing**2


def slice_area(inner: float, outer: float, spacing: float) -> float:
    """Area of an annulus, less a cell's own place where it begins at 0."""
    return math.pi * (outer**2 - inner**2) - (spacing**2 if inner < 1e-8 else 0.0)


def min_spacing(cells: DataFrame, by: list[str]) -> DataFrame:
    """Smallest non-zero gap between distinct coordinates of an axis in each group, rounded to 8."""
    axes = cells.select(*by, F.explode(F.array(F.struct(F.lit("x").alias("axis"), F.col("x").alias("v")), F.struct(F.lit("y").alias("axis"), F.col("y").alias("v")))).alias("a")).select(*by, "a.axis", "a.v").distinct()
    gap = F.col("v") - F.lag("v").over(Window.partitionBy(*by, "axis").orderBy("v"))
    return axes.withColumn("gap", gap).where("gap > 1e-8").groupBy(*by).agg(F.round(F.min("gap"), 8).alias("min_spacing"))


def centroid(df: DataFrame, units: float = 1.0) -> DataFrame:
    """x and y as the middle of XMin..XMax and YMin..YMax, in other units."""
    return df.withColumns({"x": (F.col("XMin") + F.col("XMax")) / 2 * units, "y": (F.col("YMin") + F.col("YMax")) / 2 * units})


def depatch(cells: DataFrame, species: str = "phenotype", image: str = "slide_id") -> DataFrame:
    """Distinct (image, x, y, species): undoes the repeats of overlapping windows."""
    return cells.select(image, "x", "y", species).distinct()


def recompound(cells: DataFrame, species: str = "species_int", image: str = "slide_id") -> DataFrame:
    """Species of all rows at one place as one number: their bits together."""
    return cells.groupBy(image, "x", "y").agg(F.bit_or(species).alias(species))
