"""Operators against brute force, hand-made tables and invariants."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoloom.functions import naming, numeric
from cytoloom.operators import annotations, clustering, density2d, interaction, phenotype, profiles, radial, spatial, statistics, summaries
from cytoloom.sources import formats, readers, settings, sinks
from cytoloom.streaming import resume


@pytest.fixture(scope="module")
def points(spark):
    r = random.Random(3)
    rows = [(s, k, float(r.randint(-60, 200)), float(r.randint(0, 150)), r.choice("ABC")) for s in (1, 2) for k in range(150)]
    return spark.createDataFrame(rows, "slide_id int, cell_id int, x double, y double, phenotype string"), rows


@pytest.mark.parametrize("closed", ["[)", "(]"])
def test_ring_counts_equal_all_pairs(points, closed):
    df, rows = points
    radii = [0.0, 10.0, 25.0, 40.0]
    want = {}
    for a in rows:
        for b in rows:
            if a[0] == b[0]:
                d2 = (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2
                for k in range(3):
                    low, high = radii[k] ** 2, radii[k + 1] ** 2
                    if low <= d2 < high if closed == "[)" else low < d2 <= high:
                        key = (a[0], a[1], b[4], k)
                        want[key] = want.get(key, 0) + 1
    got = {(r.slide_id, r.cell_id, r.neighbor, r.ring): r.n for r in spatial.ring_counts(df, radii, closed).collect()}
    assert got == want


def test_band_join_makes_no_nested_loop(points):
    plan = spatial.ring_counts(points[0], [0.0, 10.0])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_nearest_equals_brute_force(points):
    df, rows = points
    got = {(r.slide_id, r.src, r.rank): r.dst for r in spatial.nearest(df, 3, 5.0).collect()}
    for s, k, x, y, _ in rows:
        near = sorted(((x - b[2]) ** 2 + (y - b[3]) ** 2, b[1]) for b in rows if b[0] == s and b[1] != k)[:3]
        assert [got[s, k, i + 1] for i in range(3)] == [n for _, n in near]


def test_windows_equal_trying_each(points):
    df, rows = points
    got = sorted((r.slide_id, r.cell_id, r.roi_x, r.roi_y) for r in spatial.assign_rois(df, 50.0, 20.0).collect())
    want = []
    for s in (1, 2):
        own = [r for r in rows if r[0] == s]
        axes = []
        for a in (2, 3):
            lo, hi = min(r[a] for r in own), max(r[a] for r in own)
            n = max(1, math.ceil((hi - lo - 20) / 30))
            start = (lo + hi) / 2 - (n * 30 + 20) / 2
            axes.append([(start + 30 * k, start + 30 * k + 50) for k in range(n)])
        for r in own:
            want += [(s, r[1], i, j) for i, (a, b) in enumerate(axes[0]) if a <= r[2] < b for j, (c, d) in enumerate(axes[1]) if c <= r[3] < d]
    assert got == sorted(want)


def test_poisson_tails(spark):
    cases = [(0, 0.5), (3, 0.01), (40, 33.3), (33, 33.3), (200, 33.3), (0, 0.0), (5, 0.0), (900, 1000.0), (1100, 1000.0), (1, 1000.0)]
    df = spark.createDataFrame(cases, "k long, m double").select("k", "m", numeric.poisson_left(F.col("k"), F.col("m")).alias("a"), numeric.poisson_right(F.col("k"), F.col("m")).alias("b"))
    for r in df.collect():
        term = lambda i, m=r.m: math.exp(i * math.log(m) - m - math.lgamma(i + 1)) if m > 0 else float(i == 0)
        left, right = math.fsum(term(i) for i in range(r.k + 1)), math.fsum(term(i) for i in range(r.k, r.k + 3000)) if r.k else 1.0
        assert r.a == pytest.approx(left, rel=1e-8, abs=1e-200) and r.b == pytest.approx(right, rel=1e-8, abs=1e-200)


def test_floor_of_log_p(spark):
    df = spark.createDataFrame([(0.0,), (1e-30,), (0.01,), (None,)], "p double").select(numeric.floored_log10(F.col("p"), -25.0).alias("l"))
    assert [r.l for r in df.collect()] == [-25.0, -25.0, -2.0, None]


def test_permutation_is_seeded_and_centred(points):
    a, b = (sorted(map(tuple, interaction.permutation_test(points[0], 20.0, ["slide_id"], 60).collect())) for _ in range(2))
    assert a == b and abs(np.nanmean([r[4] for r in a])) < 1


def test_species_and_gates(spark):
    df = spark.createDataFrame([("x+", "-", 5.0), ("-", "+", None), ("-", None, 1.0)], "`Phenotype A` string, `Phenotype B` string, v double")
    out = phenotype.with_species(df).collect()
    assert [r.species_int for r in out] == [2, 1, 0] and [r.species_name_short for r in out] == ["A+", "B+", "Other"]
    rules = phenotype.rules_of([{"Phenotype": "g", "v [[min]]": 1.0, "v [[max]]": 5.0, "w [[min]]": None}])
    assert [r["Phenotype g"] for r in phenotype.gate(df, rules).collect()] == ["+", "-", "+"]


def test_pivot_of_the_small_case(spark):
    rows = [("r1", 1, 10, 5), ("r1", 2, 11, 5), ("r2", 1, 12, 6), ("r2", 2, 13, 6)]
    df = spark.createDataFrame(rows, "row string, ch int, d int, a int")
    assert {tuple(r) for r in summaries.pivot_first(df, ["row", "a"], "ch", ["d"], [1, 2]).collect()} == {("r1", 5, 10, 11), ("r2", 6, 12, 13)}
    assert {r.column: r.repeated for r in summaries.repeated_columns(df, ["row"], ["d", "a"]).collect()} == {"d": False, "a": True}
    assert summaries.duplicate_columns(df.withColumn("b", F.col("d"))) == [("d", "b")]


def test_samples_are_disjoint_and_equal(points):
    rows = summaries.train_test(points[0], ["slide_id"], ["cell_id"], 0.3, 0.3, 2).collect()
    sets = {}
    for r in rows:
        sets.setdefault((r.set, r.slide_id), set()).add(r.cell_id)
    assert {len(v) for v in sets.values()} == {45}
    assert all(not sets["train", s] & sets[t, s] for s in (1, 2) for t in ("test_0", "test_1"))


@pytest.mark.parametrize(
    "name, columns, row, marker",
    [
        ("HALO", ["Image Location", "XMin", "XMax", "YMin", "YMax", "CD8", "DAPI x Positive Classification"], ["a/b c.tif", 0, 4, 2, 4, 1, 0], "CD8"),
        ("Native", ["tag", "Slide ID", "Cell X Position", "Cell Y Position", "Phenotype CD8"], ["t", "1A-x", 2.0, 3.0, "CD8+"], "CD8"),
        ("GMBSecondGeneration", ["tag.x", "Slide ID", "Cell X Position", "Cell Y Position", "Phenotype CD8"], ["t", "s-MACRO-POS", 2.0, 3.0, "CD8+"], "CD8"),
        ("REEC", ["HYPOXICIN", "ImageFile", "tNt", "CentroidX", "CentroidY", "CD8_HI", "NUC_X_HI"], [1, "p/a b.tif", "T x", 2.0, 3.0, 1, 0], "CD8"),
        ("Ultivue", ["Ultivue_DAPIPositiveClassification", "ShortName", "CentroidX", "CentroidY", "pheno_20230327_152849"], [1, "s", 2.0, 3.0, "CD8+ X-"], "CD8"),
        ("QuPath", ["Image", "Class", "Centroid X µm", "Centroid Y µm"], ["a.qptiff - b c", "CD8: Other", 2.0, 3.0], "CD8"),
        ("Steinbock", ["Image", "centroid-0", "centroid-1", "Phenotype CD8"], ["S.tiff", 2.0, 3.0, "+"], "CD8"),
        ("Standardized", ["Image ID_(standardized)", "Centroid X (µm)_(standardized)", "Centroid Y (µm)_(standardized)", "Phenotype_(standardized) CD8"], ["s", 2.0, 3.0, "+"], "CD8"),
    ],
)
def test_formats(spark, name, columns, row, marker):
    df = spark.createDataFrame([row], columns)
    assert formats.detect(columns).name == name
    out = formats.standardise(df).first()
    assert abs(out.x - 2) < 0.2 and abs(out.y - 3) < 0.2 and out["Phenotype " + marker] == "+"
    assert formats.detect(["nothing"]) is None


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("i", 1.5, "+")], ["Image", "v", "Phenotype A"])
    sinks.write_tsv(df, str(tmp_path / "t.tsv"))
    assert readers.read_table(spark, str(tmp_path / "t.tsv")).first().v == 1.5
    assert readers.header(spark, str(tmp_path / "t.tsv")) == df.columns
    (tmp_path / "im__x__region.csv").write_text("XMin,XMax\n1,2\n")
    got = readers.read_annotations(spark, [str(tmp_path / "im__x__region.csv")]).first()
    assert (got.image_id, got.region_type) == ("im", "region")
    many = readers.read_many(spark, [str(tmp_path / "t.tsv"), str(tmp_path / "t.tsv")])
    assert many.count() == 2 and "input_filename" in many.columns
    summary = spark.createDataFrame([("A+", "x-y", 3, 60.0), ("Other", "Other", 2, 40.0)], "species_name_short string, phenotype string, species_count int, species_percent double")
    sinks.write_identification(summary, str(tmp_path / "ids"))
    assert spark.read.option("sep", "\t").csv(str(tmp_path / "ids")).first()[4] == "x(dash)y"
    cells = spark.createDataFrame([("s", 1.0, 2.0)], "slide_id string, x double, y double")
    sinks.write_by_slide(cells, str(tmp_path / "cells"))
    assert spark.read.parquet(str(tmp_path / "cells")).where("slide_id = 's'").count() == 1


def test_resume_computes_what_is_missing(spark, tmp_path):
    df, path = spark.range(6).withColumn("u", F.col("id") % 3), str(tmp_path / "r")
    first = resume.resume(df.where("u < 2"), path, ["u"], lambda d: d)
    assert first.count() == 4
    seen = []
    resume.resume(df, path, ["u"], lambda d: (seen.append(d.count()), d)[1])
    assert seen == [2]


def test_settings():
    assert settings.Settings.from_sections({"phenotyping": {"method": "Marker"}, "analysis": {"n_neighs": 5}}).n_neighs == 5
    for bad in ({"analysis": {"neighbor_radius": -1}}, {"phenotyping": {"method": "Custom"}}, {"x": {"nope": 1}}, {"analysis": {"n_neighs": 1.5}}):
        with pytest.raises(ValueError):
            settings.Settings.from_sections(bad)


def test_names(spark):
    assert naming.natural_sorted(["a10", "a2", "a1"]) == ["a1", "a2", "a10"]
    df = spark.createDataFrame([("pre_a_suf",), ("pre_bb_suf",)], ["s"])
    assert {r.s for r in naming.strip_common_affixes(df, "s").collect()} == {"a", "bb"}
    assert [r[0] for r in spark.createDataFrame([("x10",), ("x9",)], ["s"]).orderBy(naming.natural_key(F.col("s"))).collect()] == ["x9", "x10"]
    assert naming.move_column(df.withColumn("t", F.lit(1)), "t", 0).columns == ["t", "s"]


def test_smoothing_keeps_the_total(spark):
    g = density2d.grid(spark, 6).withColumn("d", F.when((F.col("bx") == 0) & (F.col("by") == 3), 1.0).otherwise(0.0))
    assert density2d.smooth(g, "d", 6).agg(F.sum("d")).first()[0] == pytest.approx(1.0)


def test_k_means_of_one_and_of_separate_groups(spark):
    rows = [(float(g * 100 + k), float(g)) for g in range(3) for k in range(5)]
    df = spark.createDataFrame(rows, ["a", "b"])
    x = np.array(rows)
    assert clustering.k_means(df, ["a", "b"], 1)[1] == pytest.approx(((x - x.mean(axis=0)) ** 2).sum())
    out, cost = clustering.k_means(df, ["a", "b"], 3)
    assert cost == pytest.approx(3 * 10.0) and len({(r.b, r.cluster) for r in out.collect()}) == 3
    assert [n for n in clustering.variable_features(df, ["a", "b"])] == ["a"]


def test_communities_of_two_cliques(spark):
    pairs = [(a, b) for o in (0, 10) for a in range(o, o + 5) for b in range(o, o + 5) if a < b]
    out = clustering.communities(spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, w double"), 8)
    assert len({r.community for r in out.collect()}) == 2


def test_jaccard(spark):
    e = spark.createDataFrame([(1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2)], "src long, dst long")
    assert {round(r.w, 6) for r in clustering.jaccard_edges(e).collect()} == {round(1 / 3, 6)}


def test_wilcoxon_adjusts(spark):
    rows = [(f, g, float(v + 5 * g * (f == 0))) for f in range(3) for g in (0, 1) for v in range(8)]
    out = statistics.wilcoxon(spark.createDataFrame(rows, "f int, g int, v double"), "f", "g", "v").collect()
    assert all(r.p_adjusted >= r.p - 1e-12 for r in out)
    assert min(out, key=lambda r: r.p).f == 0


def test_footprint_and_weights(spark):
    r = spark.createDataFrame([("i", 0, 3, 0, 2), ("i", 1, 4, 0, 2)], "image string, x0 long, x1 long, y0 long, y1 long")
    assert annotations.footprint(r, "image").count() == 8
    w = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),), (None,)], "w double")
    assert sorted(x.weight for x in annotations.standardise_weights(w, "w", []).collect()) == [0.0, 0.0, 0.0, 1.0]
    c = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0)], "a double, b double")
    assert annotations.collapse_equal_columns(c, ["a", "b"], "m").columns == ["m"]


def test_lattice_areas():
    assert spatial.lattice_areas([25, 50, 100, 150, 200]) == [2109, 8161, 32005, 71609, 126905]
    assert profiles.areas([0.0, 25.0, 50.0]) == [2109.0, 6052.0]


def test_radial_preprocessing(spark):
    rows = [(f"c{k}", ch, float(k % 7 + ch), "im") for k in range(40) for ch in (1, 2)]
    out = radial.preprocess(spark.createDataFrame(rows, "row string, ch int, v double, im string"), "row", "ch", ["v"], [1, 2], [], "im")
    assert out.count() == 40 and "v1_z" in out.columns


def test_empty_tables(spark):
    none = spark.createDataFrame([], "slide_id int, cell_id int, x double, y double, phenotype string")
    assert spatial.ring_counts(none, [0.0, 5.0]).count() == 0
    assert spatial.assign_rois(none, 50.0, 10.0).count() == 0
    assert interaction.poisson_test(none, 5.0, ["slide_id"]).count() == 0


def test_ellipse_of_a_disc_and_shares(spark):
    from cytoloom.operators import tissue

    r = np.random.default_rng(0)
    t, d = r.uniform(0, 2 * np.pi, 900), np.sqrt(r.uniform(0, 1, 900))
    x, y = 300 + 200 * d * np.cos(t), 250 + 120 * d * np.sin(t)
    rows = [(1, k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y))] + [(1, 900, 300.0, 250.0), (1, 901, 520.0, 250.0), (2, 1, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "slide_id int, cell_id int, x double, y double")
    found = {e.slide_id: e for e in tissue.ellipses(df, 60.0).collect()}
    assert abs(found[1].cx - 300) < 15 and abs(found[1].cy - 250) < 15 and found[2].a is None
    got = {c.cell_id: c.ratios for c in tissue.ring_shares(df.where("slide_id = 1"), [10.0, 30.0], 60.0).collect()}
    assert got[900] == [1.0, 1.0] and got[901][0] < 0.3
    assert [len(o) for o in tissue.ring_offsets([25, 50])] == [2109, 6052]


def test_hull_holds_all_points():
    from cytoloom.operators import tissue

    p = np.random.default_rng(2).integers(0, 30, (200, 2)).astype(float)
    corner = p[tissue.hull(p)]
    for a, b in zip(corner, np.roll(corner, -1, axis=0)):
        assert ((b[0] - a[0]) * (p[:, 1] - a[1]) - (b[1] - a[1]) * (p[:, 0] - a[0]) >= 0).all()


@pytest.mark.parametrize("doubling, rows", [(0, 90), (1, 120), (2, 60)])
def test_synthetic_rois(spark, doubling, rows):
    from cytoloom.operators import tissue

    df = tissue.synthetic_rois(spark, [0.01], 90, 0.5, doubling)
    assert df.count() == rows and df.agg(F.max("x")).first()[0] <= math.sqrt(90 / 0.01)
