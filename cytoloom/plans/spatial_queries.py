"""Queries over places of cells: rings, ROIs, interaction tests, densities, annotations."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import annotations, density2d, interaction, phenotype, profiles, radial, spatial, tissue
from .fixtures import CELLS, SPECIES, cells, table
from .registry import query

RADII = [0.0, 25.0, 50.0, 100.0]


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(F.col(c), digits) + 0.0 for c in columns})  # no -0.0


def _binned(sql: str) -> str:
    """``by`` is a reserved word in the SQL that results are compared with."""
    return re.sub(r"\bby\b", '"by"', sql)


#: Pairs of a slide within 100, for the comparison.
PAIRS = f"""{CELLS}, pairs AS (SELECT a.slide_id, a.cell_id AS c, b.cell_id AS n, a.phenotype AS cp, b.phenotype AS np, pow(a.x - b.x, 2) + pow(a.y - b.y, 2) AS d2, b.quantity AS nq
    FROM cells a JOIN cells b ON a.slide_id = b.slide_id AND b.x BETWEEN a.x - 100 AND a.x + 100 AND b.y BETWEEN a.y - 100 AND a.y + 100)"""

RINGS = "CASE WHEN d2 > 0 AND d2 <= 625 THEN 0 WHEN d2 > 625 AND d2 <= 2500 THEN 1 WHEN d2 > 2500 AND d2 <= 10000 THEN 2 END"


@query(f"WITH {PAIRS} SELECT slide_id, cp AS phenotype, np AS neighbor, CAST({RINGS} AS INT) AS ring, count(*) AS n FROM pairs WHERE {RINGS} IS NOT NULL GROUP BY ALL")
def neighbor_rings(spark, sf):
    return spatial.phenotype_rings(cells(spark, sf), RADII)


@query(f"WITH {PAIRS} SELECT slide_id, c AS cell_id, np AS neighbor, CAST({RINGS} AS INT) AS ring, count(*) AS n FROM pairs WHERE {RINGS} IS NOT NULL GROUP BY ALL")
def neighbor_ring_counts(spark, sf):
    return spatial.ring_counts(cells(spark, sf), RADII)


@query(f"WITH {PAIRS} SELECT slide_id, c AS cell_id, np AS neighbor, CASE WHEN d2 < 625 THEN 0 ELSE 1 END AS ring, count(*) AS n FROM pairs WHERE d2 < 2500 AND c <> n GROUP BY ALL")
def neighbor_counts_half_open(spark, sf):
    return spatial.ring_counts(cells(spark, sf), [0.0, 25.0, 50.0], closed="[)", exclude_self=True)


@query(f"WITH {PAIRS} SELECT slide_id, c AS cell_id, " + ", ".join(f"CAST(count(*) FILTER (WHERE np = '{p}') AS INT) AS \"{p} in (0, 25]\"" for p in ("AF", "AO", "NF", "NO", "RF", "RO")) + " FROM pairs WHERE d2 > 0 AND d2 <= 625 GROUP BY 1, 2")
def wide_ring_counts(spark, sf):
    c = cells(spark, sf)
    names = sorted(r[0] for r in c.select("phenotype").distinct().collect() if r[0] is not None)
    return spatial.wide_counts(spatial.ring_counts(c, [0.0, 25.0]), [0.0, 25.0], names)


@query(f"WITH {PAIRS} SELECT slide_id, c AS src, n AS dst, round(sqrt(d2), 6) AS distance FROM pairs WHERE d2 <= 225 AND c <> n")
def radius_graph(spark, sf):
    return _rounded(spatial.radius_graph(cells(spark, sf), 15.0), "distance")


@query(f"""WITH {CELLS}, d AS (SELECT a.slide_id, a.cell_id AS src, min({{'d': pow(a.x - b.x, 2) + pow(a.y - b.y, 2), 'i': b.cell_id}}, 3) AS best FROM cells a JOIN cells b ON a.slide_id = b.slide_id AND a.cell_id <> b.cell_id GROUP BY 1, 2)
    SELECT slide_id, src, best[k].i AS dst, round(sqrt(best[k].d), 6) AS distance, CAST(k AS INT) AS rank FROM d, range(1, 4) t(k) WHERE k <= len(best)""")
def spatial_knn(spark, sf):
    return _rounded(spatial.nearest(cells(spark, sf), 3, 50.0), "distance")


@query(f"WITH {PAIRS} SELECT slide_id, c AS cell_id, round(avg(nq), 6) AS quantity FROM pairs WHERE d2 <= 400 GROUP BY 1, 2")
def utag_mean(spark, sf):
    return _rounded(profiles.spatial_mean(cells(spark, sf), ["quantity"], 20.0), "quantity")


@query(f"WITH {CELLS} SELECT slide_id, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, count(*) AS n_cells, max(x) - min(x) AS width, max(y) - min(y) AS height FROM cells GROUP BY 1")
def roi_bounds(spark, sf):
    return spatial.bounds(cells(spark, sf), ["slide_id"])


@query(f"WITH {CELLS}, b AS (SELECT max(x) - min(x) AS w, max(y) - min(y) AS h FROM cells GROUP BY slide_id) SELECT round_even(least(avg(w), avg(h)) * 0.1, 0) AS radius FROM b")
def recommended_radius(spark, sf):
    return spatial.recommended_radius(spatial.bounds(cells(spark, sf), ["slide_id"]))


#: Windows of 400 with an overlap of 80, each cell tried against each.
ROIS = f"""{CELLS}, ext AS (SELECT slide_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM cells GROUP BY 1),
    grid AS (SELECT *, greatest(1, ceil((x1 - x0 - 80) / 320))::BIGINT AS nx, greatest(1, ceil((y1 - y0 - 80) / 320))::BIGINT AS ny FROM ext),
    starts AS (SELECT *, (x0 + x1) / 2 - (nx * 320 + 80) / 2.0 AS sx, (y0 + y1) / 2 - (ny * 320 + 80) / 2.0 AS sy FROM grid),
    wins AS (SELECT slide_id, i AS roi_x, j AS roi_y, sx + i * 320 AS wx, sy + j * 320 AS wy, length(CAST(floor(greatest(x1, y1))::BIGINT AS VARCHAR)) AS digits FROM starts, range(0, 8) a(i), range(0, 8) b(j) WHERE i < nx AND j < ny),
    rois AS (SELECT c.*, roi_x, roi_y, printf('%d_roi_[%0' || digits || 'd,%0' || digits || 'd]', c.slide_id, round_even(wx + 200, 0)::BIGINT, round_even(wy + 200, 0)::BIGINT) AS roi_id, wx, wy
             FROM cells c JOIN wins w ON c.slide_id = w.slide_id AND c.x >= wx AND c.x < wx + 400 AND c.y >= wy AND c.y < wy + 400)"""


def _rois(spark, sf):
    return spatial.assign_rois(cells(spark, sf), 400.0, 80.0)


@query(f"WITH {ROIS} SELECT slide_id, cell_id, roi_id FROM rois")
def roi_grid_assign(spark, sf):
    return _rois(spark, sf).select("slide_id", "cell_id", "roi_id")


@query(f"WITH {ROIS} SELECT slide_id, nx AS n_x, ny AS n_y, CAST(sx AS DOUBLE) AS start_x, CAST(sy AS DOUBLE) AS start_y, CAST(320 AS DOUBLE) AS step FROM starts")
def roi_grid(spark, sf):
    return spatial.roi_grid(spatial.bounds(cells(spark, sf), ["slide_id"]), 400.0, 80.0)


@query(f"WITH {CELLS} SELECT slide_id, slide_id || '_roi_[' || printf('%05d', floor((min(x) + max(x)) / 2 + 0.5)::BIGINT) || ',' || printf('%05d', floor((min(y) + max(y)) / 2 + 0.5)::BIGINT) || ']' AS roi_id FROM cells GROUP BY 1")
def whole_image_rois(spark, sf):
    return spatial.whole_image_rois(cells(spark, sf)).select("slide_id", "roi_id")


@query(f"WITH {ROIS} SELECT roi_id, phenotype, quantity, count(*) AS n FROM rois GROUP BY 1, 2, 3 HAVING count(DISTINCT (x, y)) > 1")
def single_coord_roi_drop(spark, sf):
    parts = ["roi_id", "phenotype", "quantity"]
    return spatial.drop_single_point_rois(_rois(spark, sf), parts).groupBy(*parts).agg(F.count(F.lit(1)).alias("n"))


CENTERS = """, b AS (SELECT roi_id, min(x) AS bx0, max(x) AS bx1, min(y) AS by0, max(y) AS by1 FROM rois GROUP BY 1),
    valid AS (SELECT r.* FROM rois r JOIN b USING (roi_id) WHERE x >= bx0 + 40 AND x < bx1 - 40 AND y >= by0 + 40 AND y < by1 - 40)"""


@query(f"WITH {ROIS}{CENTERS} SELECT roi_id, phenotype, count(*) AS n FROM valid GROUP BY 1, 2")
def valid_centers(spark, sf):
    return spatial.valid_centers(_rois(spark, sf), 40.0, ["roi_id"]).groupBy("roi_id", "phenotype").agg(F.count(F.lit(1)).alias("n"))


OBSERVED = f"""{ROIS}{CENTERS}, nv AS (SELECT roi_id, phenotype AS center, count(*) AS n_valid FROM valid GROUP BY 1, 2), nn AS (SELECT roi_id, phenotype AS neighbor, count(*) AS n_neighbor FROM rois GROUP BY 1, 2),
    k AS (SELECT v.roi_id, v.phenotype AS center, r.phenotype AS neighbor, count(*) AS k FROM valid v JOIN rois r ON v.roi_id = r.roi_id AND r.x BETWEEN v.x - 40 AND v.x + 40 AND r.y BETWEEN v.y - 40 AND v.y + 40 WHERE pow(v.x - r.x, 2) + pow(v.y - r.y, 2) < 1600 GROUP BY 1, 2, 3),
    seen AS (SELECT nv.roi_id, nv.center, nn.neighbor, n_valid, n_neighbor, coalesce(k, 0) - CASE WHEN nv.center = nn.neighbor THEN n_valid ELSE 0 END AS k
             FROM nv JOIN nn USING (roi_id) LEFT JOIN k ON k.roi_id = nv.roi_id AND k.center = nv.center AND k.neighbor = nn.neighbor)"""

POISSON = f"""{OBSERVED}, m AS (SELECT s.*, n_valid * (n_neighbor - CASE WHEN center = neighbor THEN 1 ELSE 0 END) / ((bx1 - bx0 + 1) * (by1 - by0 + 1) - 1) * (pi() * 1600 - 1) AS mean FROM seen s JOIN b USING (roi_id) WHERE n_valid >= 1),
    t AS (SELECT roi_id, center, neighbor, n_valid, k, mean,
          CASE WHEN mean <= 0 THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(i * ln(mean) - mean - lgamma(i + 1)))) END AS pl,
          CASE WHEN k <= 0 THEN 1.0 WHEN mean <= 0 THEN 0.0 ELSE list_sum(list_transform(range(k, greatest(k, mean::BIGINT) + 400), lambda i: exp(i * ln(mean) - mean - lgamma(i + 1)))) END AS pr FROM m),
    p AS (SELECT *, CASE WHEN pl <= 0 THEN -25.0 ELSE greatest(log10(least(pl, 1)), -25.0) END AS log_p_left, CASE WHEN pr <= 0 THEN -25.0 ELSE greatest(log10(least(pr, 1)), -25.0) END AS log_p_right FROM t)"""


def _poisson(spark, sf):
    return interaction.poisson_test(_rois(spark, sf), 40.0, ["slide_id", "roi_id"])


@query(f"WITH {OBSERVED} SELECT roi_id, center, neighbor, n_valid, n_neighbor, k FROM seen")
def interaction_counts(spark, sf):
    return interaction.observed(_rois(spark, sf), 40.0, ["roi_id"])


@query(f"WITH {POISSON} SELECT roi_id, center, neighbor, round(mean, 6) AS mean, round(log_p_left, 6) + 0.0 AS log_p_left FROM p")
def poisson_left(spark, sf):
    return _rounded(_poisson(spark, sf), "mean", "log_p_left").select("roi_id", "center", "neighbor", "mean", "log_p_left")


@query(f"WITH {POISSON} SELECT roi_id, center, neighbor, round(log_p_right, 6) + 0.0 AS log_p_right FROM p")
def poisson_right(spark, sf):
    return _rounded(_poisson(spark, sf), "log_p_right").select("roi_id", "center", "neighbor", "log_p_right")


@query(f"""WITH {POISSON} SELECT CAST(split_part(roi_id, '_', 1) AS BIGINT) AS slide_id, center, neighbor, round(sum(n_valid * log_p_left) / sum(n_valid), 6) + 0.0 AS log_p_left, round(sum(n_valid * log_p_right) / sum(n_valid), 6) + 0.0 AS log_p_right, count(*) AS n_rois FROM p GROUP BY 1, 2, 3""")
def slide_avg_logp(spark, sf):
    return _rounded(interaction.slide_average(_poisson(spark, sf), ["slide_id"]), "log_p_left", "log_p_right")


@query(f"WITH {OBSERVED} SELECT roi_id, max(n_valid) AS max_valid_centers FROM seen GROUP BY 1")
def max_valid_centers(spark, sf):
    return interaction.max_centers(interaction.observed(_rois(spark, sf), 40.0, ["roi_id"]), ["roi_id"])


@query()
def permutation_test(spark, sf):
    return interaction.permutation_test(cells(spark, sf), 40.0, ["slide_id"], 50).withColumn("roi", F.col("slide_id").cast("string"))


#: Centers of each neighbour count in an ROI, and what a Poisson distribution expects.
PMF = f"""{ROIS}{CENTERS}, nv AS (SELECT roi_id, phenotype AS center, count(*) AS n_valid FROM valid GROUP BY 1, 2), nn AS (SELECT roi_id, phenotype AS neighbor, count(*) AS n_neighbor FROM rois GROUP BY 1, 2),
    k AS (SELECT v.roi_id, v.cell_id, v.phenotype AS center, r.phenotype AS neighbor, count(*) AS n FROM valid v JOIN rois r ON v.roi_id = r.roi_id AND r.x BETWEEN v.x - 40 AND v.x + 40 AND r.y BETWEEN v.y - 40 AND v.y + 40
          WHERE pow(v.x - r.x, 2) + pow(v.y - r.y, 2) < 1600 AND v.cell_id <> r.cell_id GROUP BY ALL),
    counted AS (SELECT roi_id, center, neighbor, n, count(*) AS centers FROM k GROUP BY ALL),
    every AS (SELECT * FROM counted UNION ALL SELECT roi_id, center, neighbor, 0, n_valid - coalesce((SELECT sum(centers) FROM counted s WHERE s.roi_id = nv.roi_id AND s.center = nv.center AND s.neighbor = nn.neighbor), 0) FROM nv JOIN nn USING (roi_id)),
    m AS (SELECT e.*, n_valid, (n_neighbor - CASE WHEN e.center = e.neighbor THEN 1 ELSE 0 END) / ((bx1 - bx0 + 1) * (by1 - by0 + 1) - 1) * (pi() * 1600 - 1) AS mean FROM every e JOIN nv USING (roi_id, center) JOIN nn USING (roi_id, neighbor) JOIN b USING (roi_id)),
    p AS (SELECT *, CASE WHEN mean > 0 THEN exp(n * ln(mean) - mean - lgamma(n + 1)) ELSE CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END END AS pmf FROM m)"""


@query(f"WITH {PMF} SELECT roi_id, center, neighbor, CAST(n AS BIGINT) AS n, CAST(centers AS BIGINT) AS centers, round(pmf * n_valid, 6) AS expected FROM p")
def neighbor_count_pmf(spark, sf):
    """Without z and the binomial tails, which SQL lacks; ``neighbor_count_tails`` has those."""
    return _rounded(interaction.count_pmf(_rois(spark, sf), 40.0, ["roi_id"]).select("roi_id", "center", "neighbor", "n", "centers", "expected"), "expected")


@query()
def neighbor_count_tails(spark, sf):
    return interaction.count_pmf(_rois(spark, sf), 40.0, ["roi_id"])


@query(f"""WITH {PMF}, w AS (SELECT CAST(split_part(roi_id, '_', 1) AS BIGINT) AS slide_id, center, neighbor, CAST(n AS BIGINT) AS n, n_valid, centers, pmf FROM p)
    SELECT slide_id, center, neighbor, n, round(sum(n_valid * (centers / n_valid)) / sum(n_valid), 6) AS seen, round(sum(n_valid * pmf) / sum(n_valid), 6) AS expected, count(*) AS n_rois FROM w GROUP BY 1, 2, 3, 4""")
def pmf_over_rois(spark, sf):
    pmf = interaction.count_pmf(_rois(spark, sf), 40.0, ["slide_id", "roi_id"])
    return _rounded(interaction.pmf_average(pmf, ["slide_id"]), "seen", "expected")


@query(f"WITH {PAIRS}, e AS (SELECT slide_id, c AS cell_id, np AS neighbor, CAST({RINGS} AS INT) AS ring, count(*) AS n FROM pairs WHERE {RINGS} IS NOT NULL GROUP BY ALL) SELECT slide_id, cell_id, neighbor, ring, round(n / CASE ring WHEN 0 THEN 2109.0 WHEN 1 THEN 6052.0 ELSE 23844.0 END::DOUBLE, 9) AS density FROM e")
def ring_density(spark, sf):
    return _rounded(profiles.densities(spatial.ring_counts(cells(spark, sf), RADII), RADII).drop("n"), "density", digits=9)


@query(f"WITH {PAIRS}, c AS (SELECT slide_id, c AS cell_id, np AS neighbor, CAST({RINGS} AS INT) AS ring, count(*) AS n FROM pairs WHERE {RINGS} IS NOT NULL GROUP BY ALL) SELECT slide_id, cell_id, neighbor, ring, round(n / sum(n) OVER (PARTITION BY slide_id, cell_id, ring), 6) AS proportion FROM c")
def ring_proportion(spark, sf):
    return _rounded(profiles.proportions(spatial.ring_counts(cells(spark, sf), RADII, total="all"), ["slide_id", "cell_id"], "all").drop("n", "all"), "proportion")


PROFILE = f"""{PAIRS}, d AS (SELECT slide_id, c AS cell_id, min(cp) AS cluster, np AS neighbor, CAST({RINGS} AS INT) AS ring, count(*) / CASE {RINGS} WHEN 0 THEN 2109.0 WHEN 1 THEN 6052.0 ELSE 23844.0 END AS density FROM pairs WHERE {RINGS} IS NOT NULL GROUP BY slide_id, c, np, {RINGS}),
    profile AS (SELECT cluster, neighbor, ring, avg(density) * 1e6 AS mean, stddev_samp(density) / sqrt(count(density)) * 1e6 AS sem, count(density) AS n FROM d GROUP BY 1, 2, 3)"""


def _profile(spark, sf):
    return profiles.cluster_profile(profiles.densities(spatial.ring_counts(cells(spark, sf), RADII, center="cluster"), RADII))


@query(f"WITH {PROFILE} SELECT cluster, neighbor, ring, round(mean, 6) AS mean, round(sem, 6) AS sem, n FROM profile")
def cluster_profile_sem(spark, sf):
    return _rounded(_profile(spark, sf), "mean", "sem")


@query(f"WITH {PROFILE} SELECT a.neighbor, a.ring, round(a.mean - b.mean, 6) AS difference FROM profile a JOIN profile b USING (neighbor, ring) WHERE a.cluster = 'RF' AND b.cluster = 'NO'")
def compare_profiles(spark, sf):
    return _rounded(profiles.compare_profiles(_profile(spark, sf), "RF", "NO"), "difference")


@query(f"WITH {CELLS}, m AS (SELECT slide_id, (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my FROM cells GROUP BY 1) SELECT slide_id, cell_id, greatest(1, ceil(sqrt(pow(x - mx, 2) + pow(y - my, 2)) / 250)) * 250.0::DOUBLE AS ring FROM cells JOIN m USING (slide_id)")
def radial_rings(spark, sf):
    return spatial.radial_rings(cells(spark, sf), 250.0).select("slide_id", "cell_id", "ring")


@query(f"""WITH {CELLS}, m AS (SELECT slide_id, (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my, floor(least(max(x) - min(x), max(y) - min(y)) / 2 / 250) AS k FROM cells GROUP BY 1),
    r AS (SELECT slide_id, mr, k, greatest(1, ceil(sqrt(pow(x - mx, 2) + pow(y - my, 2)) / 250)) * 250.0::DOUBLE AS ring FROM cells JOIN m USING (slide_id)) SELECT slide_id, ring, round(avg(mr * 100.0), 6) AS percent, count(*) AS n FROM r WHERE ring <= k * 250 GROUP BY 1, 2""")
def percent_by_ring(spark, sf):
    return _rounded(radial.percent_by_whole_ring(spatial.radial_rings(cells(spark, sf), 250.0), phenotype.positive("Phenotype R")), "percent")


@query(f"WITH {CELLS}, b AS (SELECT slide_id, floor(least(500 - min(x), max(x) - 500, 480 - min(y), max(y) - 480) / 100) AS n FROM cells GROUP BY 1) SELECT slide_id, k * 100.0::DOUBLE AS ring FROM b, range(1, 20) t(k) WHERE k <= n")
def chamber_rings(spark, sf):
    return spatial.chamber_rings(cells(spark, sf), 500.0, 480.0, 100.0)


@query(f"""WITH {CELLS}, m AS (SELECT slide_id, (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my FROM cells GROUP BY 1),
    r AS (SELECT slide_id, greatest(1, ceil(sqrt(pow(x - mx, 2) + pow(y - my, 2)) / 50)) * 50.0::DOUBLE AS ring, count(*) AS n FROM cells JOIN m USING (slide_id) GROUP BY 1, 2),
    d AS (SELECT DISTINCT CAST(ring AS BIGINT) AS r FROM r UNION SELECT CAST(ring AS BIGINT) - 50 FROM r),
    a AS (SELECT r, CASE WHEN r = 0 THEN 0 ELSE list_sum(list_transform(range(-r, r + 1), lambda i: 2 * floor(sqrt((r + 1) * (r + 1) - i * i - 1)) + 1)) END AS disc FROM d)
    SELECT slide_id, ring, n, CAST(o.disc - i.disc AS BIGINT) AS pixels, round(n / (o.disc - i.disc), 9) AS density FROM r JOIN a o ON o.r = ring JOIN a i ON i.r = ring - 50""")
def lattice_areas(spark, sf):
    return _rounded(spatial.ring_densities(cells(spark, sf), 50.0), "density", digits=9)


@query(f"WITH {CELLS}, a AS (SELECT DISTINCT slide_id, 'x' AS axis, x AS v FROM cells UNION SELECT DISTINCT slide_id, 'y', y FROM cells), g AS (SELECT slide_id, v - lag(v) OVER (PARTITION BY slide_id, axis ORDER BY v) AS gap FROM a) SELECT slide_id, round(min(gap), 8) AS min_spacing FROM g WHERE gap > 1e-8 GROUP BY 1")
def min_spacing(spark, sf):
    return spatial.min_spacing(cells(spark, sf), ["slide_id"])


@query(f"WITH {ROIS} SELECT DISTINCT slide_id, x, y, phenotype FROM rois")
def depatch(spark, sf):
    return spatial.depatch(_rois(spark, sf))


@query(f"WITH {SPECIES} SELECT slide_id, x, y, CAST(bit_or(species_int) AS BIGINT) AS species_int FROM species GROUP BY 1, 2, 3")
def recompound(spark, sf):
    return spatial.recompound(phenotype.with_species(cells(spark, sf)))


BINS = f"""{CELLS}, binned AS (SELECT *, CAST(least(floor(x * 20 / 1000), 19) AS INT) AS bx, CAST(least(floor(y * 20 / 1000), 19) AS INT) AS by FROM cells WHERE x <= 1000 AND y <= 1000),
    grid AS (SELECT CAST(a.i AS INT) AS bx, CAST(b.i AS INT) AS by FROM range(0, 20) a(i), range(0, 20) b(i))"""


def _bins(spark, sf):
    return density2d.with_bins(cells(spark, sf), "x", "y", 20, (0.0, 1000.0, 0.0, 1000.0))


def density_sql(where: str, name: str) -> str:
    return f"{name}c AS (SELECT bx, by, count(*) AS n FROM binned WHERE {where} GROUP BY 1, 2), {name} AS (SELECT bx, by, coalesce(n, 0) AS n, n IS NULL AS empty, 100.0 * (coalesce(n, 0) + 1) / sum(coalesce(n, 0) + 1) OVER () AS d FROM grid LEFT JOIN {name}c USING (bx, by))"


@query(_binned(f"WITH {BINS}, {density_sql('true', 'e')} SELECT bx, by, n, empty, round(d, 6) AS d FROM e"))
def density2d_histogram(spark, sf):
    return _rounded(density2d.density(_bins(spark, sf), 20), "d")


@query(_binned(f"WITH {BINS}, s AS (SELECT bx, by, sum(quantity) AS n FROM binned GROUP BY 1, 2) SELECT bx, by, round(n / sum(n) OVER (), 8) AS d FROM s"))
def density2d_weighted(spark, sf):
    return _rounded(density2d.density(_bins(spark, sf), 20, "quantity", dense=False).select("bx", "by", "d"), "d", digits=8)


DIFF = f"""{BINS}, {density_sql("mr = 1", "p")}, {density_sql("mr = 0", "q")}, diffs AS (SELECT p.bx, p.by, p.empty AND q.empty AS empty, log10(p.d) - log10(q.d) AS diff FROM p JOIN q USING (bx, by))"""


def _diff(spark, sf):
    b, hit = _bins(spark, sf), phenotype.positive("Phenotype R")
    return density2d.log_difference(density2d.density(b.where(hit), 20), density2d.density(b.where(~hit), 20))


@query(_binned(f"WITH {DIFF} SELECT bx, by, empty, round(diff, 6) AS diff, round(CASE WHEN empty THEN 0 WHEN diff > 0.1 THEN 1 WHEN diff < -0.1 THEN -1 ELSE diff END, 6) AS mask FROM diffs"))
def density_diff_mask(spark, sf):
    return _rounded(density2d.mask(_diff(spark, sf), 0.1), "diff", "mask")


@query(_binned(f"WITH {DIFF} SELECT bx, by, CASE WHEN diff > 0.375 * m THEN 1 WHEN diff < -0.375 * m THEN -1 ELSE 0 END::INT AS mask FROM diffs, (SELECT max(abs(diff)) AS m FROM diffs)"))
def density_ternary_mask(spark, sf):
    return density2d.ternary_mask(_diff(spark, sf), 0.375).select("bx", "by", "mask")


@query(_binned(f"WITH {BINS}, g AS (SELECT bx, by, CASE WHEN count(*) > 150 THEN 'dense' END AS label FROM binned GROUP BY 1, 2) SELECT coalesce(label, 'none') AS label, count(*) AS n FROM binned JOIN g USING (bx, by) GROUP BY 1"))
def cells_in_bins(spark, sf):
    b = _bins(spark, sf)
    dense = b.groupBy("bx", "by").count().where("count > 150").select("bx", "by", F.lit("dense").alias("label"))
    return density2d.in_bins(b, dense, "label").groupBy(F.coalesce("label", F.lit("none")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(_binned(f"WITH {BINS} SELECT bx, by, round(avg(quantity), 6) AS quantity_mean, round(stddev_samp(quantity), 6) AS quantity_std, count(*) AS n_cells, count(DISTINCT slide_id) AS n_images FROM binned GROUP BY 1, 2 HAVING count(*) >= 5"))
def bin_summary(spark, sf):
    return _rounded(density2d.bin_summary(_bins(spark, sf), ["quantity"], least=5), "quantity_mean", "quantity_std")


def smooth_sql(source: str, name: str, bins: int = 20) -> str:
    """CTEs that smooth ``source`` (bx, by, d) along one axis and then the other with a Gaussian of 0.5, edges mirrored."""
    weights = density2d.kernel(0.5)
    values = ", ".join(f"({k - len(weights) // 2}, {w!r}::DOUBLE)" for k, w in enumerate(weights))
    mirrored = lambda c: f"CASE WHEN {c} + o < 0 THEN -1 - ({c} + o) WHEN {c} + o >= {bins} THEN {2 * bins - 1} - ({c} + o) ELSE {c} + o END"
    return f"{name}k(o, w) AS (VALUES {values}), {name}x AS (SELECT {mirrored('bx')} AS bx, by, sum(d * w) AS d FROM {source}, {name}k GROUP BY 1, 2), {name} AS (SELECT CAST(bx AS INT) AS bx, CAST({mirrored('by')} AS INT) AS by, sum(d * w) AS d FROM {name}x, {name}k GROUP BY 1, 2)"


@query(_binned(f"WITH {BINS}, {density_sql('true', 'e')}, {smooth_sql('e', 's')} SELECT bx, by, round(d, 8) AS d FROM s"))
def density2d_smoothed(spark, sf):
    return _rounded(density2d.smooth(density2d.density(_bins(spark, sf), 20).select("bx", "by", "d"), "d", 20, 0.5), "d", digits=8)


@query(_binned(f"WITH {BINS}, w AS (SELECT bx, by, sum(quantity) AS d FROM binned GROUP BY 1, 2), e AS (SELECT bx, by, coalesce(d, 0) AS d, d IS NULL AS empty FROM grid LEFT JOIN w USING (bx, by)), {smooth_sql('e', 'once')}, {smooth_sql('once', 'twice')} SELECT bx, by, round(twice.d / sum(twice.d) OVER (), 8) AS d, empty FROM twice JOIN e USING (bx, by)"))
def density2d_weighted_smoothed(spark, sf):
    return _rounded(density2d.weighted_density(_bins(spark, sf), 20, "quantity"), "d", digits=8)


#: Bins between the least and the largest coordinates there are.
EXTENT = BINS.replace("FROM cells WHERE x <= 1000 AND y <= 1000)", "FROM cells, ends)").replace("binned AS (", "ends AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM cells), binned AS (").replace("x * 20 / 1000", "(x - x0) * 20 / (x1 - x0)").replace("y * 20 / 1000", "(y - y0) * 20 / (y1 - y0)")


@query(_binned(f"WITH {EXTENT}, t AS (SELECT phenotype, count(*) AS total FROM binned GROUP BY 1), n AS (SELECT phenotype, bx, by, count(*) AS n FROM binned GROUP BY 1, 2, 3), e AS (SELECT phenotype, bx, by, coalesce(n, 0) / total AS d FROM (SELECT * FROM t, grid) g LEFT JOIN n USING (phenotype, bx, by)), "
    + smooth_sql("e", "s").replace("by, sum(d", "by, phenotype, sum(d").replace("AS by, sum(d", "AS by, phenotype, sum(d").replace("GROUP BY 1, 2", "GROUP BY 1, 2, 3") + " SELECT phenotype, bx, by, round(d, 9) AS d FROM s"))
def density2d_by_group(spark, sf):
    return _rounded(density2d.group_densities(cells(spark, sf), "phenotype", "x", "y", 20), "d", digits=9)


@query()
def sign_clusters(spark, sf):
    masked = density2d.mask(_diff(spark, sf), 0.05)
    return density2d.sign_clusters(masked, 3, 3)


@query(f"WITH {ROIS}, w AS (SELECT DISTINCT slide_id, roi_id, wx, wy FROM rois), o AS (SELECT slide_id, x, y FROM cells WHERE phenotype = 'RF') SELECT w.slide_id, roi_id, count(x) AS n_objects FROM w LEFT JOIN o ON o.slide_id = w.slide_id AND x >= wx AND x < wx + 400 AND y >= wy AND y < wy + 400 GROUP BY 1, 2")
def objects_in_windows(spark, sf):
    return annotations.objects_in_windows(cells(spark, sf).where("phenotype = 'RF'"), _rois(spark, sf), "slide_id", 400.0)


@query(f"WITH {CELLS}, r AS (SELECT slide_id, x::BIGINT AS x0, y::BIGINT AS y0 FROM cells WHERE phenotype = 'AF'), p AS (SELECT DISTINCT slide_id, x0 + i AS px, y0 + j AS py FROM r, range(0, 3) a(i), range(0, 2) b(j)) SELECT slide_id, count(*) AS pixels FROM p GROUP BY 1")
def annotation_footprint(spark, sf):
    r = cells(spark, sf).where("phenotype = 'AF'").select("slide_id", F.col("x").cast("bigint").alias("x0"), F.col("y").cast("bigint").alias("y0")).withColumns({"x1": F.col("x0") + 3, "y1": F.col("y0") + 2})
    return annotations.footprint_runs(r, "slide_id").groupBy("slide_id").agg(F.sum(F.col("stop") - F.col("start")).alias("pixels"))


@query(f"WITH {CELLS}, w AS (SELECT slide_id, phenotype, count(*) AS n FROM cells GROUP BY 1, 2), e AS (SELECT slide_id, min(n) AS lo, max(n) AS hi FROM w GROUP BY 1) SELECT slide_id, phenotype, round(CASE WHEN hi > lo THEN (n - lo) / (hi - lo) ELSE 0.5 END, 6) AS weight FROM w JOIN e USING (slide_id)")
def standardised_weights(spark, sf):
    w = cells(spark, sf).groupBy("slide_id", "phenotype").agg(F.count(F.lit(1)).alias("n"))
    return _rounded(annotations.standardise_weights(w, "n", ["slide_id"]).select("slide_id", "phenotype", "weight"), "weight")


@query(f"""WITH {POISSON}, w AS (SELECT roi_id, count(*) AS n FROM rois GROUP BY 1), e AS (SELECT min(n) AS lo, max(n) AS hi FROM w), z AS (SELECT roi_id, (n - lo) / (hi - lo) AS weight FROM w, e)
    SELECT CAST(split_part(roi_id, '_', 1) AS BIGINT) AS slide_id, center, neighbor, round(sum(weight * log_p_left) / nullif(sum(weight), 0), 6) + 0.0 AS log_p_left, round(sum(weight * log_p_right) / nullif(sum(weight), 0), 6) + 0.0 AS log_p_right, count(*) AS n_rois FROM p JOIN z USING (roi_id) GROUP BY 1, 2, 3""")
def annotation_average(spark, sf):
    rois = _rois(spark, sf)
    w = annotations.standardise_weights(rois.groupBy("roi_id").agg(F.count(F.lit(1)).alias("n")), "n", [])
    return _rounded(annotations.annotation_average(_poisson(spark, sf), w, ["roi_id"], ["slide_id"]), "log_p_left", "log_p_right")


@query(f"WITH {CELLS} SELECT cell_id, trunc(x / 0.5 - 3)::BIGINT AS x, trunc(y / 0.5 - 3)::BIGINT AS y FROM cells")
def pixel_transform(spark, sf):
    return annotations.to_pixels(cells(spark, sf).select("cell_id", "x", "y"), ["x", "y"], 0.5, 3.0)


@query("SELECT s_suppkey, split_part(s_name, '#', 2) AS image FROM supplier")
def annotation_images(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", annotations.image_of_slide(F.replace("s_name", F.lit("#"), F.lit("_"))).alias("image"))
    return s


@query(f"WITH {SPECIES}, m AS (SELECT phenotype AS a, species_name_short AS b, count(*) AS n FROM species GROUP BY 1, 2) SELECT a, b, CAST(n AS DOUBLE) AS n FROM m WHERE a <> b")
def asymmetric_entries(spark, sf):
    m = phenotype.with_species(cells(spark, sf)).groupBy(F.col("phenotype").alias("a"), F.col("species_name_short").alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return interaction.is_symmetric(m, "a", "b", "n")


@query(f"""WITH {CELLS}, m AS (SELECT phenotype, avg(price) AS m, stddev_samp(price) AS s FROM cells GROUP BY 1), z AS (SELECT cell_id, (price - m) / s AS z FROM cells JOIN m USING (phenotype))
    SELECT cell_id, round(z, 6) AS z, round(0.5 + exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 60), lambda k: pow(z, 2 * k + 1) * exp(k * ln(2) + lgamma(k + 1) - lgamma(2 * k + 2)))), 6) AS p FROM z""")
def normal_cdf(spark, sf):
    c = cells(spark, sf)
    moments = c.groupBy("phenotype").agg(F.avg("price").alias("m"), F.stddev_samp("price").alias("s"))
    z = c.join(moments, "phenotype").withColumn("z", (F.col("price") - F.col("m")) / F.col("s"))
    return _rounded(z.select("cell_id", "z", numeric.normal_cdf(F.col("z")).alias("p")), "z", "p")


@query()
def tissue_ellipses(spark, sf):
    return tissue.ellipses(cells(spark, sf), 100.0)


@query()
def tissue_ring_shares(spark, sf):
    return tissue.ring_shares(cells(spark, sf).select("slide_id", "cell_id", "x", "y"), [25.0, 50.0], 100.0, 0.2)


def _share(k: str) -> str:
    return f"('0x' || substr(md5('7|{k}|' || slide_id || '|' || cell_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query(f"""WITH {CELLS}, e AS (SELECT slide_id, min(x) AS x0, min(y) AS y0, floor((max(x) - min(x)) / 0.5) AS nx, floor((max(y) - min(y)) / 0.5) AS ny FROM cells GROUP BY 1),
    s AS (SELECT slide_id, cell_id, {_share('x')} AS sx, {_share('y')} AS sy, {_share('kind')} < 2.0::DOUBLE / 3 AS a FROM cells)
    SELECT slide_id, cell_id, x0 + floor(sx * (nx + 1)) * 0.5 AS x, y0 + floor(sy * (ny + 1)) * 0.5 AS y, CASE WHEN a THEN 'A+' ELSE 'A-' END AS "Phenotype A", CASE WHEN a THEN 'B-' ELSE 'B+' END AS "Phenotype B" FROM s JOIN e USING (slide_id)""")
def synthetic_rois(spark, sf):
    return tissue.synthetic_like(cells(spark, sf), 0.5, 7)
