"""Tissue outlines of images, what part of each cell's rings lies inside, and synthetic ROIs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from . import spatial, whole

#: Points near a hull's corner that make it part of the tissue, and nearest points of each corner that an outline is fitted to.
COMPANY, NEAREST = 5, 50


#: Directions whose farthest points span what a hull's interior surely holds.
TURNS = np.stack([np.cos(np.arange(16) * math.pi / 8), np.sin(np.arange(16) * math.pi / 8)])


def outer(points: np.ndarray) -> np.ndarray:
    """Indices of points that may be corners of the hull: those not well inside the polygon of the farthest in some directions."""
    with np.errstate(invalid="ignore", over="ignore"):
        far = points[(points @ TURNS).argmax(axis=0)]
        side = np.roll(far, -1, axis=0) - far
        side, far = side[(side != 0).any(axis=1)], far[(side != 0).any(axis=1)]
        gap = points[:, None, :] - far[None, :, :]
        slack = 1e-9 * np.abs(points).max() * np.abs(side).sum(axis=1)
        inside = (side[:, 0] * gap[:, :, 1] - side[:, 1] * gap[:, :, 0] > slack).all(axis=1) & (len(side) > 2)
    return np.flatnonzero(~inside)


def hull(points: np.ndarray) -> np.ndarray:
    """Indices of the corners of the convex hull, counter-clockwise, by monotone chains."""
    some = outer(points) if len(points) > 40 else np.arange(len(points))
    order = some[np.lexsort((points[some, 1], points[some, 0]))]
    placed = list(zip(order.tolist(), *points[order].T.tolist()))

    def chain(rows) -> list[int]:
        out: list[tuple] = []
        for row in rows:
            while len(out) > 1:
                (_, px, py), (_, qx, qy) = out[-2:]
                if (qx - px) * (row[2] - py) - (qy - py) * (row[1] - px) > 0:
                    break
                out.pop()
            out.append(row)
        return [r[0] for r in out[:-1]]

    return np.array([*chain(placed), *chain(placed[::-1])] or [int(order[0])])


def simplexes(f, start: np.ndarray, rounds: int = 1500, tolerance: float = 1e-7) -> np.ndarray:
    """Least points of many functions by the downhill simplex method, all in step; f(which, points) gives a value for each.

    Each goes its own way: what a function's simplex does depends on its
    values alone.
    """
    m, n = start.shape
    x = np.repeat(start[:, None, :], n + 1, axis=1)
    k = np.arange(n)
    x[:, k + 1, k] += np.where(start != 0, 0.05 * start, 0.00025)
    y = np.stack([f(np.arange(m), x[:, i]) for i in range(n + 1)], axis=1)
    go = np.arange(m)
    for _ in range(rounds):
        order = y[go].argsort(axis=1, kind="stable")
        x[go], y[go] = np.take_along_axis(x[go], order[:, :, None], 1), np.take_along_axis(y[go], order, 1)
        go = go[~((y[go, -1] - y[go, 0] < tolerance) & (np.abs(x[go] - x[go, :1]).max(axis=(1, 2)) < tolerance))]
        if not len(go):
            break
        middle, worst = x[go, :-1].mean(axis=1), x[go, -1]
        at = lambda t, some: middle[some] + t * (worst[some] - middle[some])
        every = np.arange(len(go))
        p = at(-1.0, every)
        v = f(go, p)
        low, high, last = y[go, 0], y[go, -2], y[go, -1]
        some = np.flatnonzero(v < low)
        if len(some):
            far = at(-2.0, some)
            w = f(go[some], far)
            better = w < v[some]
            p[some[better]], v[some[better]] = far[better], w[better]
        some = np.flatnonzero(v >= high)
        if len(some):
            near = np.where((v[some] < last[some])[:, None], at(-0.5, some), at(0.5, some))
            p[some], v[some] = near, f(go[some], near)
        shrink = np.zeros(len(go), bool)
        shrink[some] = v[some] >= last[some]
        keep, small = go[~shrink], go[shrink]
        x[keep, -1], y[keep, -1] = p[~shrink], v[~shrink]
        if len(small):
            x[small, 1:] = x[small, :1] + 0.5 * (x[small, 1:] - x[small, :1])
            for i in range(1, n + 1):
                y[small, i] = f(small, x[small, i])
    return x[np.arange(m), y.argmin(axis=1)]


def inside(points: np.ndarray, ellipse: np.ndarray) -> np.ndarray:
    """Ellipse function: 1 on the border, below inside. ellipse: centre x, y, half axes, rotation."""
    cx, cy, a, b, turn = ellipse
    dx, dy = points[..., 0] - cx, points[..., 1] - cy
    c, s = math.cos(turn), math.sin(turn)
    return ((c * dx + s * dy) / a) ** 2 + ((s * dx - c * dy) / b) ** 2


#: Lattice points that are tried at once.
AT_ONCE = 1 << 21


def inside_counts(centres: np.ndarray, ellipses: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the points around each centre lie in its ellipse; many centres at once, each with an ellipse of its own."""
    out, step = np.full(len(centres), np.nan), max(1, AT_ONCE // max(1, len(offsets)))
    if len(offsets):  # the root of the ellipse function is a norm: places wholly inside or outside need no count
        c, s = np.cos(ellipses[:, 4]), np.sin(ellipses[:, 4])
        dx, dy = centres[:, 0] - ellipses[:, 0], centres[:, 1] - ellipses[:, 1]
        norm = np.hypot((c * dx + s * dy) / ellipses[:, 2], (s * dx - c * dy) / ellipses[:, 3])
        reach = np.sqrt((offsets**2).sum(axis=1).max()) / ellipses[:, 2:4].min(axis=1)
        out[norm + reach < 1 - 1e-9], out[norm - reach > 1 + 1e-9] = len(offsets), 0
        some = np.flatnonzero(np.isnan(out))
        if len(some) < len(out):
            out[some] = inside_counts(centres[some], ellipses[some], offsets) if len(some) else 0
            return out
    turn = np.stack([np.cos(ellipses[:, 4]), np.sin(ellipses[:, 4])], axis=1)
    for at in range(0, len(centres), step):
        part = slice(at, at + step)
        e, (c, s) = ellipses[part], turn[part].T[:, :, None]
        dx, dy = (centres[part, k, None] + offsets[None, :, k] - e[:, k, None] for k in (0, 1))
        out[part] = (((c * dx + s * dy) / e[:, 2, None]) ** 2 + ((s * dx - c * dy) / e[:, 3, None]) ** 2 <= 1).sum(axis=1)
    return out


def fit_borders(borders: list[np.ndarray], most: np.ndarray) -> np.ndarray:
    """Ellipses of least mean absolute deviation of the ellipse function from 1 along each border; ``most``: the images' largest x and y."""
    size = np.maximum(most, 1.0)
    start = np.hstack([size / 2, np.log(size), np.zeros((len(size), 1))])
    count = np.array([len(b) for b in borders])
    first = count.cumsum() - count
    points = np.concatenate(borders)

    def off(which: np.ndarray, p: np.ndarray) -> np.ndarray:
        n = count[which]
        end = n.cumsum()
        x, y = points[np.arange(end[-1]) + np.repeat(first[which] - end + n, n)].T
        turn = p[:, 4].tolist()
        c, s = (np.repeat([f(t) for t in turn], n) for f in (math.cos, math.sin))
        cx, cy, a, b = np.repeat(np.hstack([p[:, :2], np.exp(p[:, 2:4])]), n, axis=0).T
        dx, dy = x - cx, y - cy
        gap = np.abs(((c * dx + s * dy) / a) ** 2 + ((s * dx - c * dy) / b) ** 2 - 1)
        return np.array([gap[e - m : e].sum() for e, m in zip(end.tolist(), n.tolist())]) / n  # a sum an image: as if it were alone

    best = simplexes(off, start)
    best[:, 2:4] = np.exp(best[:, 2:4])
    return best


def fit_border(border: np.ndarray, most: np.ndarray) -> np.ndarray:
    """``fit_borders`` of one."""
    return fit_borders([border], np.asarray(most, float)[None, :])[0]


def ring_offsets(radii: list[float]) -> list[np.ndarray]:
    """Lattice points of each ring: i^2 + j^2 < (r + 1)^2, less those of the ring before."""
    out, below = [], 0.0
    for r in radii:
        n = int(r) + 1
        i, j = np.meshgrid(np.arange(-n, n + 1), np.arange(-n, n + 1), indexing="ij")
        d2 = i * i + j * j
        take = (d2 < (r + 1) ** 2) & (d2 >= below)
        out.append(np.stack([i[take], j[take]], axis=1))
        below = (r + 1) ** 2
    return out


def edges_of(corner: np.ndarray) -> list[list[float]]:
    """Start and direction of each side of a hull."""
    return np.hstack([corner, np.roll(corner, -1, axis=0) - corner]).tolist()


def merged_hulls(points: DataFrame, image: str) -> DataFrame:
    """(image, edges): the convex hull of each image's points, from hulls of what each task has met, as sides (x, y, dx, dy)."""
    kind = dict(points.dtypes)[image]

    def partial(batches):
        held: dict = {}
        for batch in batches:
            for key, rows in batch.groupby(image, sort=False):
                p = rows[["x", "y"]].to_numpy(float)
                p = np.vstack([held[key], p]) if key in held else p
                held[key] = p[hull(p)]
        for key, p in held.items():
            yield pd.DataFrame({image: [key] * len(p), "x": p[:, 0], "y": p[:, 1]})

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        p = rows[["x", "y"]].drop_duplicates().to_numpy(float)
        return pd.DataFrame({image: [key[0]], "edges": [edges_of(p[hull(p)])]})

    corners = points.select(image, "x", "y").mapInPandas(partial, f"`{image}` {kind}, x double, y double")
    return corners.groupBy(image).applyInPandas(merge, f"`{image}` {kind}, edges array<array<double>>")


def strip(points: np.ndarray, company: np.ndarray, total: int, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Of candidates, those stripped and the hull corners (all that is left, where three or fewer are) when every corner has company."""
    company, kept = company.copy(), np.arange(len(points))
    while total > 3:
        corner = kept[hull(points[kept])]
        lone = corner[company[corner] < COMPANY]
        if not len(lone):
            return np.setdiff1d(np.arange(len(points)), kept), corner
        for i in lone:
            company -= ((points - points[i]) ** 2).sum(axis=1) < reach * reach
        kept, total = np.setdiff1d(kept, lone), total - len(lone)
    return np.setdiff1d(np.arange(len(points)), kept), kept


#: Rows of an image whose outline is found in one task at most.
OUTLINED = 50_000


def along_border(points: np.ndarray, reach: float) -> np.ndarray:
    """Points along the border of an image seen whole; points: distinct, by x and y."""
    kept = np.arange(len(points))
    while len(kept) > 3:
        corner = hull(points[kept])
        d2 = ((points[kept[corner]][:, None, :] - points[kept][None, :, :]) ** 2).sum(axis=2)
        lone = (d2 < reach * reach).sum(axis=1) < COMPANY
        if not lone.any():
            if len(kept) <= NEAREST:
                return points[kept]
            limit = np.partition(d2, NEAREST - 1, axis=1)[:, NEAREST - 1]
            row, at = np.nonzero(d2 <= limit[:, None])
            order = np.lexsort((at, d2[row, at], row))  # ties by place
            some = np.arange(len(row)) - np.searchsorted(row, row, "left") < NEAREST
            return points[kept[np.unique(at[order][some])]]
        kept = np.delete(kept, corner[lone])
    return points[kept]


def borders(table, group: np.ndarray, reach: float):
    """Number of the first row, points along the border and largest x and y of each group of five distinct points or more that has a border."""
    x, y = whole.floats(table, "x", "y")
    order = np.lexsort((y, x, group))
    g, p = group[order], np.stack([x[order], y[order]], axis=1)
    new = np.r_[True, (g[1:] != g[:-1]) | (p[1:] != p[:-1]).any(axis=1)]
    g, p, order = g[new], p[new], order[new]
    for rows in np.split(np.arange(len(g)), np.flatnonzero(g[1:] != g[:-1]) + 1):
        if len(rows) >= COMPANY:
            border = along_border(p[rows], reach)
            if len(border):
                yield order[rows[0]], border, p[rows].max(axis=0), len(rows)


def finite_points(cells: DataFrame, image: str) -> tuple[DataFrame, DataFrame | None]:
    """Points of images that a task outlines whole, and of larger ones."""
    points = cells.select(image, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(" AND ".join(f"abs({c}) < double('infinity')" for c in "xy")).na.drop(subset=[image])
    return whole.split(points, [image], OUTLINED)


def outlines(cells: DataFrame, reach: float, image: str = "slide_id") -> DataFrame:
    """(image, x, y, n, most_x, most_y): the points along each image's border, with what the image holds; of images of five points or more."""
    points, large = finite_points(cells, image)

    def work(table, group):
        for row, border, most, n in borders(table, group, reach):
            yield {image: table.column(image).take(np.full(len(border), row)), "x": border[:, 0], "y": border[:, 1], "n": np.full(len(border), n), "most_x": np.full(len(border), most[0]), "most_y": np.full(len(border), most[1])}

    kind = dict(points.dtypes)[image]
    found = whole.by_group(points, [image], work, f"`{image}` {kind}, x double, y double, n bigint, most_x double, most_y double")
    return found if large is None else found.unionByName(merged_outlines(large, reach, image).select(*found.columns))


def merged_outlines(cells: DataFrame, reach: float, image: str = "slide_id") -> DataFrame:
    """(image, x, y, n, most_x, most_y): the points along each image's border, with what the image holds; of images of five points or more.

    Points of a square that fits into ``reach`` and holds five are never
    stripped, nor is anything inside their hull. So hulls of such points are
    merged over tasks, and only points outside are candidates, of which there
    are at most four a square. Their company is counted by a distance join,
    one task an image strips candidates alone, and what lies nearest to the
    corners that are left is found by ``spatial.nearest``.
    """
    finite = " AND ".join(f"abs({c}) < double('infinity')" for c in "xy")
    side = reach / math.sqrt(2) * (1 - 1e-9)
    points = cells.select(image, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(finite).distinct()
    points = written(points.withColumns({"gx": F.floor(F.col("x") / side), "gy": F.floor(F.col("y") / side)}))
    sizes = points.groupBy(image).agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("most_x"), F.max("y").alias("most_y")).where(F.col("n") >= COMPANY)
    dense = points.groupBy(image, "gx", "gy").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= COMPANY).drop("m")
    hulls = merged_hulls(points.join(dense, [image, "gx", "gy"]), image)
    slack = 1e-9 * F.greatest(F.abs("x"), F.abs("y"), F.lit(1.0))
    left_of = lambda e: e[2] * (F.col("y") - e[1]) - e[3] * (F.col("x") - e[0]) > slack * (F.abs(e[2]) + F.abs(e[3]))
    outside = points.join(sizes.select(image, "n"), image).join(hulls, image, "left").where(F.col("edges").isNull() | ~F.forall("edges", left_of))
    candidates = written(outside.select(image, "x", "y", "n"))
    near = spatial.band_pairs(candidates, points, reach, image, keep=["n"], keep_neighbor=[]).where(F.col("d2") < reach * reach)
    counted = near.groupBy(image, F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("c_n").alias("n")).agg(F.count(F.lit(1)).alias("company"))

    def peel(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        p = rows[["x", "y"]].to_numpy(float)
        gone, corner = strip(p, rows["company"].to_numpy(np.int64), int(rows["n"].iloc[0]), reach)
        at = np.r_[gone, corner].astype(int)
        return pd.DataFrame({image: [key[0]] * len(at), "x": p[at, 0], "y": p[at, 1], "corner": np.r_[np.zeros(len(gone), bool), np.ones(len(corner), bool)]})

    kind = dict(points.dtypes)[image]
    peeled = written(counted.groupBy(image).applyInPandas(peel, f"`{image}` {kind}, x double, y double, corner boolean"))
    place = F.struct("x", "y")
    kept = points.join(sizes.select(image), image).join(peeled.where("NOT corner"), [image, "x", "y"], "left_anti").select(image, "x", "y", place.alias("place"))
    corners = peeled.where("corner").select(image, "x", "y", place.alias("place"))
    along = spatial.nearest(kept, NEAREST - 1, reach, "place", image, of=corners).select(image, "dst.x", "dst.y")
    return along.unionByName(corners.drop("place")).distinct().join(sizes, image)


def ellipses(cells: DataFrame, reach: float = 100.0, image: str = "slide_id") -> DataFrame:
    """Outline ellipse of each image: cx, cy, a, b, turn; null for images of fewer than five distinct points, or where no corner has company.

    The fit sees the border's points alone: at most fifty a corner of the
    hull. Images that fit a task are outlined and fitted in it, many in step.
    """
    points, large = finite_points(cells, image)
    kind = dict(points.dtypes)[image]
    schema = f"`{image}` {kind}, cx double, cy double, a double, b double, turn double"

    def work(table, group):
        seen = list(borders(table, group, reach))
        if seen:
            rows, along, most, _ = zip(*seen)
            found = fit_borders(list(along), np.array(most))
            yield {image: table.column(image).take(np.array(rows))} | {c: found[:, i] for i, c in enumerate(("cx", "cy", "a", "b", "turn"))}

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = fit_border(rows.sort_values(["x", "y"])[["x", "y"]].to_numpy(float), rows[["most_x", "most_y"]].to_numpy(float)[0])
        return pd.DataFrame([[*key, *found]], columns=[image, "cx", "cy", "a", "b", "turn"])

    found = whole.by_group(points, [image], work, schema)
    if large is not None:
        found = found.unionByName(merged_outlines(large, reach, image).groupBy(image).applyInPandas(fit, schema))
    return cells.select(image).distinct().join(found, image, "left")


def ring_shares(cells: DataFrame, radii: list[float], reach: float = 100.0, scale: float = 1.0, image: str = "slide_id", cell_id: str = "cell_id") -> DataFrame:
    """(image, cell_id, areas, ratios): lattice points of each ring inside the image's ellipse, and their share of the ring.

    ``scale`` below 1 counts on a coarser lattice.
    """
    found = ellipses(cells, reach, image)
    rows = cells.select(image, cell_id, "x", "y").join(found, image)
    offsets = ring_offsets([r * scale for r in radii])

    def count(batches):
        for batch in batches:
            centre = np.trunc(batch[["x", "y"]].to_numpy(float) * scale)
            shape = batch[["cx", "cy", "a", "b", "turn"]].to_numpy(float, copy=True)
            shape[:, :4] *= scale
            areas = np.stack([inside_counts(centre, shape, o) for o in offsets], axis=1)
            ratios = areas / np.array([len(o) for o in offsets])
            yield pd.DataFrame({image: batch[image], cell_id: batch[cell_id], "areas": list(areas), "ratios": list(ratios)})

    kinds = dict(cells.dtypes)
    return rows.mapInPandas(count, f"`{image}` {kinds[image]}, `{cell_id}` {kinds[cell_id]}, areas array<double>, ratios array<double>")


def synthetic_like(cells: DataFrame, spacing: float, seed: int = 0, image: str = "slide_id", cell_id: str = "cell_id") -> DataFrame:
    """A uniform image beside each given one, of the same extent and number of cells, some two thirds of them A: image, cell_id, x, y, Phenotype A, Phenotype B.

    Each cell's place and kind are drawn from a digest of seed, image and its
    id, so nothing is numbered or gathered and a lost task draws the same
    again; cells that share an id fall together. Places lie ``spacing`` apart.
    """
    extent = spatial.bounds(cells, [image]).select(F.col(image), *[F.floor((F.col(f"{a}_max") - F.col(f"{a}_min")) / spacing).alias(f"__{a}") for a in "xy"], "x_min", "y_min")
    rows = cells.select(image, cell_id).join(extent, image)
    name = lambda k: F.concat_ws("|", F.lit(str(seed)), F.lit(k), F.col(image).cast("string"), F.col(cell_id).cast("string"))
    share = lambda k: F.conv(F.substring(F.md5(name(k).cast("binary")), 1, 8), 16, 10).cast("bigint") / float(1 << 32)
    is_a = share("kind") < 2 / 3
    place = {a: F.col(f"{a}_min") + F.floor(share(a) * (F.col(f"__{a}") + 1)) * spacing for a in "xy"}
    return rows.select(image, cell_id, place["x"].alias("x"), place["y"].alias("y"), F.when(is_a, "A+").otherwise("A-").alias("Phenotype A"), F.when(is_a, "B-").otherwise("B+").alias("Phenotype B"))


def synthetic_rois(spark: SparkSession, densities: list[float], cells: int, spacing: float, doubling: int = 0, seed: int = 0) -> DataFrame:
    """Uniform ROIs of given densities with two thirds of their cells A: tag, x, y, Phenotype A, Phenotype B.

    doubling 0 puts B at places of its own, 1 on every A as a cell of its own,
    2 on every A as one compound cell.
    """
    sizes = spark.createDataFrame([(f"pop_dens_{d:09.7f}", float(round(math.sqrt(cells / d) / spacing))) for d in densities], "tag string, steps double")
    n_a, n_b = int(2 * cells / 3), int(cells / 3)
    rows = sizes.crossJoin(spark.range(n_a + n_b if doubling == 0 else n_a))  # a generated table: densities by cells
    place = lambda k: F.floor(F.pmod(F.xxhash64("tag", "id", F.lit(k), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40) * F.col("steps")) * spacing
    is_a = F.col("id") < n_a
    out = rows.select("tag", place(0).alias("x"), place(1).alias("y"), F.lit("1A-only_slide").alias("slide_id"), F.when(is_a, "A+").otherwise("A-").alias("Phenotype A"), F.when(is_a & F.lit(doubling != 2), "B-").otherwise("B+").alias("Phenotype B"))
    if doubling == 1:
        out = out.unionByName(out.withColumns({"Phenotype A": F.lit("A-"), "Phenotype B": F.lit("B+")}))
    return out
