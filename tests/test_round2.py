"""Names, tails, resamples, neighbours and small helpers against plain Python."""

import math
import os
import random
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoloom.functions import numeric
from cytoloom.operators import clustering, density2d, interaction, radial, spatial, statistics, summaries
from cytoloom.plans import cell_queries

FOLDER = "/root/testdata/sf0.001"


def test_file_names_are_well_then_cell_type(spark):
    names = ["A1_tumor_REEC_chan_T=3_out.csv", "A1_tumor_chan_T=3_out.csv", "B2_NK_REEC_chan_T=14_out.csv", "C10_NK_chan_T=0_out.csv", None]
    df = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, input_filename string")
    got = {r.k: (r.well_id, r.cell_type, r.REEC) for r in radial.parse_filenames(df).collect()}
    assert got == {0: ("A1", "tumor", True), 1: ("A1", "tumor", False), 2: ("B2", "NK", True), 3: ("C10", "NK", False), 4: (None, None, None)}
    assert radial.parse_filenames(df.limit(0)).count() == 0


def test_windows_are_named_by_their_centres(spark):
    df = spark.createDataFrame([("s", 0.0, 0.0), ("s", 123456.0, 45.0)], "slide_id string, x double, y double")
    rois = {r.roi_id: ((r.roi_x_min + r.roi_x_max) / 2, (r.roi_y_min + r.roi_y_max) / 2) for r in spatial.assign_rois(df, 10.0, 0.0).collect()}
    for name, (x, y) in rois.items():
        assert name == f"s_roi_[{round(x):06d},{round(y):06d}]"
    assert len(rois) == 2  # windows 0 and beyond 9999, which a cut of long numbers would merge
    widths = spark.createDataFrame([(7, 3), (123456, 3), (-5, 3)], "n long, w int").select(spatial.padded(F.col("n"), F.col("w")).alias("t")).collect()
    assert [r.t for r in widths] == ["007", "123456", "-05"]
    many = spark.createDataFrame([("a", "c", k) for k in range(10_050)], "id string, ch string, k int")
    assert summaries.unique_ids(many, "id", "ch", 1, "k").select("id").distinct().count() == 10_050


def test_binomial_tails():
    r = random.Random(1)
    rows = [(r.randint(0, n), n, r.choice([0.0, 1.0, r.random()])) for n in [r.randint(0, 60) for _ in range(200)]]
    k, n, p = (np.array(x) for x in zip(*rows))
    left, right = numeric.binomial_tails(k, n, p, at_once=50)
    for a, m, q, x, y in zip(k, n, p, left, right):
        mass = [math.comb(m, i) * q**i * (1 - q) ** (m - i) for i in range(m + 1)]
        assert x == pytest.approx(sum(mass[: a + 1]), abs=1e-9) and y == pytest.approx(sum(mass[a:]), abs=1e-9)


def test_resamples_do_not_depend_on_the_plan_and_have_the_right_spread(spark):
    rows = [(k, "g" if k % 3 else None, 5.0 if k % 2 else 1.0) for k in range(3000)] + [(9000, "lone", 2.0), (9001, "none", None)]
    df = spark.createDataFrame(rows, "id long, side string, v double")
    one, two = ({(r.side, r.resample): (r.weight, r.total) for r in statistics.resampled(d, ["side"], "v", 300, ["id"], 3).collect()} for d in (df.repartition(3), df.repartition(7, "v")))
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k]) for k in one)
    for g, n in (("g", 2000), (None, 1000)):
        w = np.array([one[g, r][0] for r in range(300)])
        assert w.mean() == pytest.approx(n, rel=0.02) and w.std() == pytest.approx(math.sqrt(n), rel=0.2)
        means = np.array([one[g, r][1] / one[g, r][0] for r in range(300)])
        assert means.std() == pytest.approx(2 / math.sqrt(n), rel=0.2)  # equal values draw for themselves
    out = {r.side: r for r in statistics.bootstrap_interval(df, ["side"], "v", 300, ["id"]).collect()}
    assert out["g"].low < out["g"].mean < out["g"].high and out["lone"].low == out["lone"].high == 2.0 and out["none"].mean is None
    flags = spark.createDataFrame([(k, "x" if k < 400 else "y", k % 2, float(k % 2) * (k < 400) + k % 7) for k in range(800)] + [(900, "z", 0, 1.0)], "id long, g string, s int, v double")
    assert {r.g: r.flag for r in statistics.difference_flags(flags, ["g"], "v", "s", 1, 0, 200, ["id"]).collect()} == {"x": 1.0, "y": 0.0, "z": None}
    total = interaction.bootstrap_counts(df, ["side"], "v", 50, ["id"]).where("side = 'g'").agg(F.avg("total")).first()[0]
    assert total == pytest.approx(sum(v for _, g, v in rows if g == "g"), rel=0.02)


def test_approximate_neighbours_find_nine_of_ten(spark):
    exact = {(r.src, r.dst) for r in cell_queries.exact_knn(spark, FOLDER).collect()}
    found = {(r.src, r.dst) for r in cell_queries.approximate_knn(spark, FOLDER).collect()}
    assert len(exact & found) / len(exact) >= 0.9


def test_blocks_do_not_change_neighbours(spark):
    df = spark.read.parquet(f"{FOLDER}/embeddings.parquet").where("vec_id < 200")
    one, more = (sorted(tuple(r) for r in clustering.nearest_neighbors(df, "vec_id", "embedding", 4, blocks=b).collect()) for b in (1, 5))
    assert one == more


def test_vectors_and_back_and_cluster_names(spark):
    df = spark.createDataFrame([(1, 0.5, 2.0, 0), (2, -1.0, 3.0, 1), (3, 0.0, 0.0, None)], "id int, a double, b double, cluster int")
    back = clustering.disassemble(clustering.assemble(df, ["b", "a"]).drop("a", "b"), ["b", "a"])
    assert back.columns == ["id", "cluster", "b", "a"] and [(r.a, r.b) for r in back.orderBy("id").collect()] == [(0.5, 2.0), (-1.0, 3.0), (0.0, 0.0)]
    named = clustering.rename_clusters(df, {0: "T cells"}, prefix="is ").orderBy("id").collect()
    assert [(r.cluster, r["is T cells"]) for r in named] == [("T cells", 1), ("1", 0), (None, 0)]


def test_fractions_are_stable(spark):
    df = spark.range(20_000)
    taken = {r.id for r in summaries.sample_fraction(df, ["id"], 0.1, 4).collect()}
    assert taken == {r.id for r in summaries.sample_fraction(df.repartition(9), ["id"], 0.1, 4).collect()} and 1_700 < len(taken) < 2_300


def test_bins_of_each_sign_are_clustered_by_place(spark):
    rows = [(x, y, 1.0) for x in range(3) for y in range(3)] + [(15, 15, 1.0), (15, 16, 1.0)] + [(0, 19, -1.0), (9, 9, 0.3), (9, 8, 0.0)]
    out = {(r.bx, r.by): r.label for r in density2d.sign_clusters(spark.createDataFrame(rows, "bx int, by int, mask double"), 2, 3).collect()}
    assert {out[x, y] for x in range(3) for y in range(3)} == {"Left Cluster 1"} and out[15, 15] == out[15, 16] == "Left Cluster 2"
    assert out[0, 19] == "Right Cluster 1" and out[9, 9] == out[9, 8] == "No Cluster" and len(out) == len(rows)


def test_nearest_ends_where_images_are_small(spark):
    df = spark.createDataFrame([("a", 1, 0.0, 0.0), ("a", 2, 1e6, 0.0), ("b", 3, 5.0, 5.0), ("c", 4, None, 1.0), ("c", 5, float("nan"), 1.0)], "slide_id string, cell_id long, x double, y double")
    assert sorted((r.src, r.dst, r["rank"]) for r in spatial.nearest(df, 3, 10.0).collect()) == [(1, 2, 1), (2, 1, 1)]


def test_communities_end_and_large_ones_split(spark):
    inside = [(a + o, b + o, 1.0 + 0.01 * a) for o in (0, 10) for a in range(5) for b in range(a)]
    edges = spark.createDataFrame([*inside, *[(k, 10 + k, 0.1) for k in range(5)], *[(100 + k, 100 + k + 1, 0.1) for k in range(2)]], "src long, dst long, w double")
    found = {r.node: r.community for r in clustering.communities(edges, 20).collect()}
    assert len({found[k] for k in range(5)}) == len({found[10 + k] for k in range(5)}) == 1
    whole = spark.createDataFrame([(k, 0) for k in (*range(5), *range(10, 15))] + [(100 + k, 100) for k in range(3)], "node long, community long")
    parts = {r.node: r.community for r in clustering.split_large(whole, edges).collect()}
    assert len({parts[k] for k in range(5)}) == len({parts[10 + k] for k in range(5)}) == 1 and parts[0] != parts[10]
    assert {parts[100 + k] for k in range(3)} == {100}
