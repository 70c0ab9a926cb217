"""Searches, densities, footprints and outlines that no longer see a group whole, against those that do."""

import math

import numpy as np
import pytest

from cytoloom.operators import annotations, interaction, spatial, statistics, tissue


def nearest_by_force(rows, k):
    """{(image, id): ids of the k nearest others} of rows (image, id, x, y)."""
    out = {}
    for s, i, x, y in rows:
        others = sorted(((x - b[2]) ** 2 + (y - b[3]) ** 2, b[1]) for b in rows if b[0] == s and b[1] != i)
        out[s, i] = [j for _, j in others[:k]]
    return out


@pytest.fixture(scope="module")
def mixed(spark):
    """A dense image, a sparse one with a dense knot, one of two cells, one of a single cell, one of coincident cells."""
    r = np.random.default_rng(3)
    dense = [(1, i, *map(float, p)) for i, p in enumerate(r.uniform(-20, 20, (150, 2)))]
    sparse = [(2, i, *map(float, p)) for i, p in enumerate(np.vstack([r.uniform(-1e6, 1e6, (40, 2)), r.uniform(0, 3, (60, 2))]))]
    few = [(3, 0, 0.0, 0.0), (3, 1, 9e5, -9e5), (4, 0, 5.0, 5.0)]
    same = [(5, i, 7.0, 7.0) for i in range(6)] + [(5, 6, 7.0, 9.0)]
    rows = dense + sparse + few + same
    return spark.createDataFrame(rows, "slide_id int, cell_id int, x double, y double"), rows


@pytest.mark.parametrize("radius", [1.0, 50.0, 1e5])
def test_nearest_in_dense_and_sparse_places(mixed, radius):
    df, rows = mixed
    got = {}
    for r in sorted(spatial.nearest(df, 4, radius).collect(), key=lambda r: r["rank"]):
        got.setdefault((r.slide_id, r.src), []).append(r.dst)
    assert got == {k: v for k, v in nearest_by_force(rows, 4).items() if v}


def test_nearest_of_some_rows(mixed):
    df, rows = mixed
    got = {}
    for r in sorted(spatial.nearest(df, 3, 10.0, of=df.where("cell_id % 7 = 0")).collect(), key=lambda r: r["rank"]):
        got.setdefault((r.slide_id, r.src), []).append(r.dst)
    assert got == {k: v for k, v in nearest_by_force(rows, 3).items() if v and k[1] % 7 == 0}


def test_nearest_where_ids_repeat_or_nothing_is_finite(spark):
    rows = [(1, 0, 0.0, 0.0)] * 9 + [(1, 1, 500.0, 0.0), (1, 2, 600.0, 0.0), (1, 3, None, 0.0), (1, 4, float("inf"), 0.0), (1, 5, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "slide_id int, cell_id int, x double, y double")
    got = spatial.nearest(df, 2, 4.0).collect()
    assert {r.dst for r in got if r.src == 0} == {1}
    assert {r.src for r in got} == {0, 1, 2}
    assert spatial.nearest(df.where("x > 1e9 AND x < 1e10"), 2, 4.0).count() == 0


def test_nearest_pools_rows_of_one_id(spark):
    rows = [(1, 0, 182.0, 627.0)] * 2 + [(1, 1, 195.0, 657.0), (1, 2, 147.0, 603.0), (1, 3, 400.0, 600.0), (1, 3, 180.0, 900.0)]
    df = spark.createDataFrame(rows, "slide_id int, cell_id int, x double, y double")
    got = {}
    for r in spatial.nearest(df, 3, 50.0).collect():
        got.setdefault(r.src, {})[r["rank"]] = (round(r.distance, 6), r.dst)
    for i in range(4):
        near = sorted((round(math.hypot(a[2] - b[2], a[3] - b[3]), 6), b[1]) for a in rows for b in rows if a[1] == i != b[1])[:3]
        assert [got[i][k + 1] for k in range(3)] == near


@pytest.mark.parametrize("points", [50, 500])
def test_density_of_bins_equals_that_of_rows(spark, points):
    r = np.random.default_rng(4)
    groups = {"normal": r.normal(3, 2, 700), "tail": r.exponential(5, 300), "two": np.r_[r.normal(-40, 0.5, 50), r.normal(30, 0.1, 50)], "one": np.array([1.0]), "flat": np.full(9, 2.0)}
    df = spark.createDataFrame([(g, float(v)) for g, values in groups.items() for v in values] + [("normal", None)], "g string, v double")
    got = {(x.g, round(x.x, 6)): x.density for x in statistics.kernel_density(df, "v", ["g"], points).collect()}
    everything = np.concatenate(list(groups.values()))
    grid = np.linspace(everything.min(), everything.max(), points)
    assert {g for g, _ in got} == {"normal", "tail", "two"}
    for g in ("normal", "tail", "two"):
        v = groups[g]
        h = len(v) ** -0.2 * v.std(ddof=1)
        want = np.exp(-0.5 * ((grid[:, None] - v) / h) ** 2).sum(axis=1) / (len(v) * h * math.sqrt(2 * math.pi))
        assert np.abs(np.array([got[g, round(float(x), 6)] for x in grid]) - want).max() < 1e-10


def test_density_without_groups(spark):
    df = spark.createDataFrame([(float(v),) for v in np.random.default_rng(5).normal(0, 1, 200)], "v double")
    out = sorted((r.x, r.density) for r in statistics.kernel_density(df, "v", [], 100).collect())
    assert len(out) == 100 and abs(np.trapezoid([d for _, d in out], [x for x, _ in out]) - 1) < 0.05


def test_weights_from_runs_equal_those_from_pixels(spark):
    r = np.random.default_rng(6)
    corners = r.integers(-30, 60, (40, 2))
    rectangles = [(f"i{k % 2}", int(a), int(a + w), int(b), int(b + h)) for k, ((a, b), (w, h)) in enumerate(zip(corners, r.integers(1, 25, (40, 2))))]
    df = spark.createDataFrame(rectangles, "image string, x0 long, x1 long, y0 long, y1 long")
    windows = [(f"i{k % 2}", f"w{k}", float(a), float(a) + 20, float(b), float(b) + 20) for k, (a, b) in enumerate(r.uniform(-40, 70, (25, 2)))] + [("i0", "whole", 0.0, 20.0, 0.0, 20.0)]
    w = spark.createDataFrame(windows, "image string, roi_id string, roi_x_min double, roi_x_max double, roi_y_min double, roi_y_max double")
    objects = spark.createDataFrame([("i0", 5.0, 5.0)], "image string, x double, y double")
    pixels = annotations.footprint(df, "image")
    a, b = ({x.roi_id: x.footprint for x in annotations.raw_weights(w, c, objects, "image", 3.0, 20.0).collect()} for c in (pixels, annotations.footprint_runs(df, "image")))
    spots = [(p.image, p.px, p.py) for p in pixels.collect()]
    want = {i: sum(s == image and x0 + 3 <= x < x1 - 3 and y0 + 3 <= y < y1 - 3 for s, x, y in spots) for image, i, x0, x1, y0, y1 in windows}
    assert a == b == want and any(want.values())


def outline(points, reach):
    """Points along the border of an image seen whole."""
    kept = np.arange(len(points))
    while len(kept) > 3:
        corner = tissue.hull(points[kept])
        d2 = ((points[kept][:, None, :] - points[kept][corner][None, :, :]) ** 2).sum(axis=2)
        lone = (d2 < reach * reach).sum(axis=0) < tissue.COMPANY
        if not lone.any():
            return kept[np.unique(np.argsort(d2, axis=0, kind="stable")[: tissue.NEAREST])]
        kept = np.delete(kept, corner[lone])
    return kept


def test_outlines_equal_those_of_images_seen_whole(spark):
    r = np.random.default_rng(7)
    images = {
        1: np.vstack([r.normal(0, 40, (400, 2)), r.uniform(-400, 400, (12, 2))]),
        2: r.uniform(0, 3000, (60, 2)),  # too sparse for any square to be dense
        3: np.array([[0.0, 0], [1, 1], [2, 2], [3, 3], [4, 4], [5, 5]]),
        4: np.vstack([r.uniform(0, 30, (80, 2)), r.uniform(300, 330, (80, 2)), [[150.0, 150.0], [-90.0, 400.0]]]),
        5: np.array([[0.0, 0], [900, 0], [0, 900], [900, 900], [5000, 450]]),
        6: np.array([[0.0, 0.0], [3.0, 4.0]]),
    }
    df = spark.createDataFrame([(k, float(x), float(y)) for k, p in images.items() for x, y in p] * 2 + [(1, None, 2.0)], "slide_id int, x double, y double")
    got = {}
    for row in tissue.outlines(df, 25.0).collect():
        got.setdefault(row.slide_id, set()).add((row.x, row.y))
    want = {k: {tuple(q) for q in p[outline(p, 25.0)].tolist()} for k, p in images.items() if len(p) >= 5}
    assert got == {k: v for k, v in want.items() if v} and not want[5]
    found = {e.slide_id: e for e in tissue.ellipses(df, 25.0).collect()}
    assert set(found) == set(images) and found[6].a is None and found[5].a is None and found[1].a > 0


def test_poisson_of_rois_of_two_columns(spark):
    r = np.random.default_rng(8)
    rows = [(s, t, k, float(x), float(y), "AB"[k % 2]) for s in "ab" for t in (1, 2) for k, (x, y) in enumerate(r.uniform(0, 50, (60, 2)))]
    df = spark.createDataFrame(rows, "s string, t int, cell_id int, x double, y double, phenotype string")
    seen = {(o.s, o.t, o.center, o.neighbor): (o.n_valid, o.n_neighbor, o.k) for o in interaction.observed(df, 8.0, ["s", "t"]).collect()}
    tested = interaction.poisson_test(df, 8.0, ["s", "t"])
    assert tested.columns[:2] == ["s", "t"] and {(o.s, o.t, o.center, o.neighbor): (o.n_valid, o.n_neighbor, o.k) for o in tested.collect()} == seen
    for (s, t, a, b), (n, m, k) in seen.items():
        own = [q for q in rows if q[:2] == (s, t)]
        xs, ys = [q[3] for q in own], [q[4] for q in own]
        centers = [q for q in own if q[5] == a and min(xs) + 8 <= q[3] < max(xs) - 8 and min(ys) + 8 <= q[4] < max(ys) - 8]
        pairs = sum(q[5] == b and q[2] != c[2] and (q[3] - c[3]) ** 2 + (q[4] - c[4]) ** 2 < 64 for c in centers for q in own)
        assert (n, m, k) == (len(centers), sum(q[5] == b for q in own), pairs)
